import numpy as np
import pytest
from pyspark.sql import functions as F

from bitempo.llm import neighbours, queries


def unit(rng, n, dim=64):
    v = rng.standard_normal((n, dim)).astype("float32")
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def close(rng, v, most):
    w = v + rng.standard_normal(v.shape) * most / 8 * rng.random((len(v), 1))
    return (w / np.linalg.norm(w, axis=1, keepdims=True)).astype("float32")


def test_collisions_are_counted_right():
    rng = np.random.default_rng(2)
    data, queries = rng.standard_normal((150, 21)), rng.standard_normal((40, 21))
    arrays = neighbours.Arrays(data)
    counts = (np.abs(queries[:, None, :] - data[None]) <= 0.9).sum(axis=2)
    for least in (1, 5, 12, 21):
        x, y = arrays.colliding(queries, 0.9, least)
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*np.nonzero(counts >= least), strict=True))


def test_pairs_above_recall():
    rng = np.random.default_rng(3)
    a = unit(rng, 2000)
    b = close(rng, a, 0.5)
    x, y, cosine = neighbours.pairs_above(a, b, 0.9)
    want = set(zip(*np.nonzero(a.astype(float) @ b.T.astype(float) >= 0.9), strict=True))
    got = set(zip(x.tolist(), y.tolist(), strict=True))
    assert got <= want and len(got) >= 0.999 * len(want) and (cosine >= 0.9).all()


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_recall(clustered):
    rng = np.random.default_rng(4)
    rows = unit(rng, 1500)
    if clustered:
        rows = close(rng, np.repeat(rows[:150], 10, axis=0), 0.6)
    x, y, _ = neighbours.nearest(rows[:60], rows, 10)
    best = np.argsort(-(rows[:60] @ rows.T), axis=1)[:, :10]
    got = set(zip(x.tolist(), y.tolist(), strict=True))
    assert len(got & {(i, j) for i in range(60) for j in best[i]}) >= 0.9 * 600


def test_pairs_in_spark(spark):
    rng = np.random.default_rng(5)
    v = unit(rng, 300)
    w = close(rng, v, 0.3)
    data = [(f"a{i}", "g", (x * 10.0 ** (i % 5 - 2)).tolist()) for i, x in enumerate(v)] + [(f"b{i}", "g", x.tolist()) for i, x in enumerate(w)] + [("x", "h", v[0].tolist())]
    data += [("null", "g", None), ("empty", "g", []), ("zero", "g", [0.0] * 64), ("nan", "g", [float("nan")] + [1.0] * 63), ("far", "g", [1.0] * 63 + [float("-inf")]), ("short", "g", [1.0] * 63), ("hole", "g", [None] + [1.0] * 63), (None, "g", v[0].tolist())]
    df = spark.createDataFrame(data, "id string, grp string, vec array<float>").withColumn("g", F.lit("clash"))
    fit = neighbours.comparable(df, ["grp"], "id", "vec", 64)
    assert fit.count() == 601
    got = {(r["k_a"], r["k_b"]) for r in neighbours.similar_pairs(fit, 0.9, 64, block_rows=100).collect()}
    all_ = np.concatenate([v, w])
    names = [f"a{i}" for i in range(300)] + [f"b{i}" for i in range(300)]
    near = all_.astype(float) @ all_.T.astype(float)
    want = {tuple(sorted((names[i], names[j]))) for i, j in zip(*np.nonzero(near >= 0.9), strict=True) if i != j}
    assert got <= want and len(got) >= 0.999 * len(want)
    assert neighbours.similar_pairs(fit.limit(0), 0.9, 64).count() == 0


def test_nearest_in_spark(spark):
    rng = np.random.default_rng(6)
    v = unit(rng, 400)
    fit = neighbours.comparable(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>"), [], "id", "vec", 64)
    found = neighbours.nearest_k(fit.where("k % 20 = 0"), fit, 5, 64, block_rows=150).collect()
    got = {}
    for r in found:
        got.setdefault(r["k"], {})[r["rank"]] = r["neighbour"]
    near = v.astype(float) @ v.T.astype(float)
    np.fill_diagonal(near, -2)
    assert set(got) == set(range(0, 400, 20))
    hit = sum(len(set(got[q].values()) & set(np.argsort(-near[q])[:5].tolist())) for q in got)
    assert hit >= 0.9 * 5 * 20 and all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())


def test_every_entity_has_its_nearest(spark, small_dir):
    groups, got = {}, {}
    for r in queries._vectors(spark, small_dir).collect():
        groups.setdefault(r["g"], {})[r["k"]] = np.array(r["v"], float) / np.linalg.norm(r["v"])
    for r in queries.p6_nearest(spark, small_dir).collect():
        got.setdefault((r["collection_name"], r["channel"], r["uid"]), {})[r["rank"]] = r["neighbour"]
    hit = want = 0
    for g, vectors in groups.items():
        names, near = list(vectors), np.array(list(vectors.values())) @ np.array(list(vectors.values())).T
        np.fill_diagonal(near, -2)
        n = min(10, len(names) - 1)
        for i, name in enumerate(names):
            found = got.pop((*g.split("\x1f")[:2], name), {})
            assert sorted(found) == list(range(1, n + 1))
            hit += len(set(found.values()) & {names[j] for j in np.argsort(-near[i])[:n]})
            want += n
    assert not got and want and hit >= 0.9 * want


def test_copies_share_a_class(spark):
    rows = spark.createDataFrame([("g", "b", [1.0, 0.0]), ("g", "a", [1.0, 0.0]), ("g", "c", [0.0, 1.0])], "g string, k string, v array<float>")
    assert sorted((r["k"], r["rep"]) for r in neighbours.vector_classes(rows).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]
