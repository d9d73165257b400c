import random

import pytest
from pyspark.sql import functions as F

from bitempo.operators import hierarchy
from tests.rows import rows

COLUMNS = ("id", "root_id", "depth", "n_descendants")


def brute(parent):
    out = []
    below = dict.fromkeys(parent, 0)
    roots = {}
    for i in parent:
        seen, at = [], i
        while parent[at] is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            loop = seen[seen.index(at) :]
            roots[i] = (min(loop), -1)
        else:
            roots[i] = (at, len(seen))
            for a in [*seen[1:], at] if seen else []:
                below[a] += 1
    for i in parent:
        root, depth = roots[i]
        out.append((i, root, depth, -1 if depth < 0 else below[i]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(1, 3))
@pytest.mark.parametrize("component_rows", [5, 10_000])
def test_forest_against_brute_force(spark, seed, component_rows):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(120)]
    parent = {i: r.choice([None, *ids[: k + 1]]) if k % 3 else (ids[k - 1] if k else None) for k, i in enumerate(ids)}
    for _ in range(seed):
        parent[r.choice(ids)] = r.choice(ids)
    links = spark.createDataFrame(list(parent.items()), "id string, parent string")
    found = hierarchy.forest(links, True, component_rows, 20).cache()
    assert rows(found, *COLUMNS) == brute(parent)
    for r in found.where("depth >= 0").collect():
        assert len(r["path"]) == r["depth"] + 1 and r["path"][-1] == r["id"] and all(parent[b] == a for a, b in zip([None, *r["path"]], r["path"], strict=False))
    for r in found.where("back_edge_to is not null").collect():
        assert parent[r["back_edge_to"]] == r["id"] and r["back_edge_to"] == r["root_id"] and r["in_loop"]


def test_long_chain(spark):
    parent = {f"{i:04d}": f"{i - 1:04d}" if i else None for i in range(700)}
    links = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = {r["id"]: r for r in hierarchy.forest(links, paths=True).collect()}
    assert got["0699"]["depth"] == 699 and got["0000"]["n_descendants"] == 699
    assert got["0002"]["path"] == ["0000", "0001", "0002"]


def test_shapes_in_fragments(spark, monkeypatch):
    """A chain, a star of chains, a comb and a long loop with tails, each far above the bound."""
    monkeypatch.setattr(hierarchy, "FRAGMENT", 4)
    monkeypatch.setattr(hierarchy, "WIDE", 5)
    parent = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(150)}
    parent |= {"s": None} | {f"s{i}_{j}": f"s{i}_{j - 1}" if j else "s" for i in range(40) for j in range(3)}
    parent |= {f"k{i:03d}": f"k{i - 1:03d}" if i else None for i in range(60)} | {f"t{i:03d}": f"k{i:03d}" for i in range(60)}
    parent |= {f"l{i:03d}": f"l{(i - 1) % 70:03d}" for i in range(70)} | {f"m{i:03d}": f"l{i:03d}" for i in range(0, 70, 7)} | {"n0": "m007", "n1": "n0"}
    found = hierarchy.forest(spark.createDataFrame(list(parent.items()), "id string, parent string"), component_rows=20, task_rows=50).cache()
    assert rows(found, *COLUMNS) == brute(parent)
    assert {r["id"] for r in found.where("in_loop").collect()} == {f"l{i:03d}" for i in range(70)}
    assert rows(found.where("back_edge_to is not null"), "id", "back_edge_to") == [("l069", "l000")]


def test_long_chain_in_one_task():
    """As many nodes as a task ever walks, without a path: a few lists."""
    n = hierarchy.COMPONENT_ROWS
    last = None
    for last in hierarchy._walk([str(i) for i in range(n)], [str(i - 1) if i else None for i in range(n)], False):
        pass
    assert last == (str(n - 1), "0", n - 1, 0, False, False, None)


def test_self_parent_is_a_loop(spark):
    links = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, parent string")
    got = rows(hierarchy.forest(links), *COLUMNS, "in_loop", "leads_to_loop", "back_edge_to")
    assert got == [("a", "a", -1, -1, True, False, "a"), ("b", "a", -1, -1, False, True, None)]


def test_parents_and_ids(spark):
    data = [("1", " 2 "), ("2", ""), ("3", "1.0"), ("4", "99"), ("5", None), ("6", "\t03"), (None, "1"), ("3", "1")]
    links = hierarchy.parents(spark.createDataFrame(data, "issue_id string, parent_id string").withColumn("p", F.lit(1)), "issue_id", "parent_id")
    assert rows(links, "id", "parent") == [("1", "2"), ("2", None), ("3", "1"), ("4", None), ("5", None), ("6", "3")]


def test_empty(spark):
    assert hierarchy.forest(spark.createDataFrame([], "id string, parent string")).count() == 0


def test_descendants(spark):
    links = spark.createDataFrame([("a", None), ("b/1", "a"), ("c", "b/1"), ("x", "y"), ("y", "x")], "id string, parent string")
    assert rows(hierarchy.descendants(links), "ancestor_id", "id", "distance") == [("a", "b/1", 1), ("a", "c", 2), ("b/1", "c", 1)]
