"""Similar vectors by collision counting over query-centred windows.

Each of ``m`` random directions projects all vectors of a block to one sorted
array.  A query opens a window around its own projection in each array; a
vector that falls into at least ``threshold`` of the windows is a candidate and
its cosine is computed.  For the k nearest the windows are widened step by step
(virtual rehashing) until k verified vectors lie within the radius.

Windows are bitsets: the exclusive or of two prefixes of the sorted array.  The
collisions of 64 vectors at a time are counted in bit planes by carry-save
adders, so a pair costs about m bit operations.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROJECTIONS = 64
BLOCK_ROWS = 8192
#: Half width of a window, in standard deviations of the projected distance.
WIDTH = 1.566
SEED = 20240501
_TILE = 2048
_SLICE = 256


def directions(dim: int, m: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m)).astype("float32")


def threshold(m: int = PROJECTIONS, width: float = WIDTH) -> int:
    """Collisions needed: five standard deviations below what a pair at the radius has."""
    p = math.erf(width / math.sqrt(2))
    return max(1, math.floor(m * p - 5 * math.sqrt(m * p * (1 - p))))


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """Bitset of counters (bit planes, lowest first) that are ``least`` or more."""
    over = np.zeros_like(planes[0])
    same = ~over
    for i in reversed(range(len(planes))):
        if least >> i & 1:
            same &= planes[i]
        else:
            over |= same & planes[i]
            same &= ~planes[i]
    return over | same


class Arrays:
    """The sorted arrays of one tile of vectors, with prefix bitsets."""

    def __init__(self, projected: np.ndarray):
        n, m = projected.shape
        self.n, self.words = n, -(-n // 64)
        self.sorted, self.prefix = [], []
        for t in range(m):
            order = np.argsort(projected[:, t], kind="stable")
            self.sorted.append(projected[order, t])
            bits = np.zeros((n + 1, self.words), "uint64")
            bits[np.arange(1, n + 1), order >> 6] = np.uint64(1) << (order & 63).astype("uint64")
            self.prefix.append(np.bitwise_xor.accumulate(bits, axis=0))

    def colliding(self, queries: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) positions with at least ``least`` collisions."""
        levels: list[list[np.ndarray]] = [[]]
        for t, (values, prefix) in enumerate(zip(self.sorted, self.prefix, strict=True)):
            low = np.searchsorted(values, queries[:, t] - half, "left")
            high = np.searchsorted(values, queries[:, t] + half, "right")
            levels[0].append(prefix[low] ^ prefix[high])
            i = 0
            while len(levels[i]) == 3:  # three of a weight become one of it and one of the next
                total, carry = _adder(*levels[i])
                levels[i] = [total]
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(carry)
                i += 1
        planes, i = [], 0
        while i < len(levels):
            while len(levels[i]) > 1:
                a, b = levels[i].pop(), levels[i].pop()
                if i + 1 == len(levels):
                    levels.append([])
                levels[i].append(a ^ b)
                levels[i + 1].append(a & b)
                if len(levels[i + 1]) == 3:
                    total, carry = _adder(*levels[i + 1])
                    levels[i + 1] = [total]
                    if i + 2 == len(levels):
                        levels.append([])
                    levels[i + 2].append(carry)
            planes.append(levels[i][0] if levels[i] else np.zeros((len(queries), self.words), "uint64"))
            i += 1
        hit = _at_least(planes, least) if least < 1 << len(planes) else np.zeros_like(planes[0])
        q, w = np.nonzero(hit)
        if not len(q):
            return q, w
        spread = np.unpackbits(hit[q, w].view("uint8").reshape(-1, 8), axis=1, bitorder="little")
        k, b = np.nonzero(spread)
        return q[k], w[k] * 64 + b


def pairs_above(queries: np.ndarray, rows: np.ndarray, bound: float, m: int = PROJECTIONS, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and cosines of pairs of unit vectors with cosine ``bound`` or more."""
    a = directions(rows.shape[1], m)
    half, least = width * math.sqrt(max(0.0, 2 - 2 * bound)), threshold(m, width)
    pq, pr = queries @ a, rows @ a
    found = []
    for r in range(0, len(rows), _TILE):
        arrays = Arrays(pr[r : r + _TILE])
        for q in range(0, len(queries), _TILE):
            i, j = arrays.colliding(pq[q : q + _TILE], half, least)
            i, j = i + q, j + r
            for s in range(0, len(i), 1 << 18):
                x, y = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
                cosine = np.einsum("ij,ij->i", queries[x].astype("float64"), rows[y].astype("float64"))
                keep = cosine >= bound
                found.append((x[keep], y[keep], cosine[keep]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, m: int = PROJECTIONS, width: float = WIDTH, start: float = 0.9, growth: float = 1.35) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and cosines of the ``k`` nearest of ``rows`` for each query.

    The radius begins at that of cosine ``start`` and grows by ``growth`` for
    the queries that have fewer than k verified vectors within it.  Beyond the
    largest distance of unit vectors every row is verified.
    """
    a = directions(rows.shape[1], m)
    pq, least, k = queries @ a, threshold(m, width), min(k, len(rows))
    tiles = [(r, Arrays(rows[r : r + _TILE] @ a)) for r in range(0, len(rows), _TILE)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # A slice of queries at a time: its last round verifies every row.
    for begin in range(0, len(queries), _SLICE):
        todo, radius = np.arange(begin, min(begin + _SLICE, len(queries))), math.sqrt(2 - 2 * start)
        while len(todo):
            last = radius >= 1.3
            xs, ys = [np.zeros(0, int)], [np.zeros(0, int)]
            for r, arrays in tiles:
                if last:
                    x, y = np.divmod(np.arange(len(todo) * arrays.n), arrays.n)
                else:
                    x, y = arrays.colliding(pq[todo], width * radius, least)
                xs.append(x)
                ys.append(y + r)
            x, y = np.concatenate(xs), np.concatenate(ys)
            cosine = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", queries[todo[x[s : s + (1 << 18)]]].astype("float64"), rows[y[s : s + (1 << 18)]].astype("float64")) for s in range(0, len(x), 1 << 18)]])
            near = np.bincount(x[cosine >= 1 - radius * radius / 2], minlength=len(todo))
            ready = (near >= k) | last
            order = np.lexsort((y, -cosine, x))
            x, y, cosine = x[order], y[order], cosine[order]
            first = np.searchsorted(x, np.arange(len(todo)))
            rank = np.arange(len(x)) - first[x] if len(x) else x
            keep = ready[x] & (rank < k) if len(x) else np.zeros(0, bool)
            out.append((todo[x[keep]], y[keep], cosine[keep]))
            todo, radius = todo[~ready], radius * growth
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def comparable(df: DataFrame, group: list[str], key: str, vector: str, dim: int) -> DataFrame:
    """``(g, k, v)``: rows whose vector has ``dim`` values, none null, NaN or infinite, not all zero.

    ``g`` is a string of the group columns.  Rows with a null key are left out.
    Vectors travel as they are and are scaled where they are compared.
    """
    v = F.col(vector)
    # Native array functions only: no lambda is run for each value.
    top, low = F.array_max("v"), F.array_min("v")
    fine = (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim)
    g = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in group])
    rows = df.where(v.isNotNull() & F.col(key).isNotNull() & fine).select(g.alias("g"), F.col(key).alias("k"), v.cast("array<float>").alias("v"))
    return rows.where(~F.isnan(top) & (top < float("inf")) & (low > float("-inf")) & ((top != 0) | (low != 0)))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors as rows of length 1."""
    flat = column.combine_chunks().flatten() if column.num_chunks != 1 else column.chunk(0).flatten()
    rows = flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype("float64")
    rows /= np.abs(rows).max(axis=1, keepdims=True, initial=1e-300)  # squares of tiny or huge values stay in range
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return np.ascontiguousarray(rows, dtype="float32")


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells over all cores, however few bytes they are: their cost is the square of their rows."""
    spark = cells.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(n, "g", "i", "j")


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    sizes = rows.groupBy("g").count().select("g", F.ceil(F.col("count") / block_rows).cast("int").alias("nb"))
    return rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))


def similar_pairs(rows: DataFrame, bound: float, dim: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(g, k_a, k_b, cosine)`` of pairs of one group with cosine ``bound`` or more, ``k_a < k_b``.

    ``rows`` come from ``comparable``.  Groups are cut into blocks by a hash of
    the key, and each pair of blocks is one task, so a group of any size is
    spread.  Equal vectors are pairs like others; see ``vector_classes`` for
    groups of copies.
    """
    blocked = _blocks(rows, block_rows)
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    cells = blocked.select("g", "k", "v", "b", other.alias("o")).select("g", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") <= F.col("o")).alias("left"), (F.col("b") == F.col("o")).alias("both"), "k", "v")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side, both = t["left"].to_numpy(), t["both"].to_numpy()
        v, k = _matrix(t["v"], dim), t["k"].combine_chunks()
        ia, ib = np.nonzero(side)[0], np.nonzero(~side | both)[0]
        x, y, cosine = pairs_above(v[ia], v[ib], bound)
        a, b = k.take(pa.array(ia[x])).to_pylist(), k.take(pa.array(ib[y])).to_pylist()
        if key[1].as_py() == key[2].as_py():
            keep = [n for n in range(len(a)) if a[n] < b[n]]
            a, b, cosine = [a[n] for n in keep], [b[n] for n in keep], cosine[keep]
        lo, hi = [min(p) for p in zip(a, b, strict=True)], [max(p) for p in zip(a, b, strict=True)]
        return pa.table({"g": pa.array([key[0].as_py()] * len(lo), pa.string()), "k_a": pa.array(lo, k.type), "k_b": pa.array(hi, k.type), "cosine": pa.array(cosine, pa.float64())})

    kind = dict(rows.dtypes)["k"]
    return _dealt(cells).groupBy("g", "i", "j").applyInArrow(run, f"g string, k_a {kind}, k_b {kind}, cosine double")


def vector_classes(rows: DataFrame) -> DataFrame:
    """``(g, v, rep, k)``: equal vectors of a group share the smallest key as ``rep``."""
    reps = rows.groupBy("g", "v").agg(F.min("k").alias("rep"))
    return rows.join(reps, ["g", "v"])


def nearest_k(queries: DataFrame, rows: DataFrame, k: int, dim: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(g, k, neighbour, cosine, rank)``: the ``k`` most similar rows of each query's group.

    Both inputs come from ``comparable``; a query is not its own neighbour.
    Ties go to the smaller key.  Query blocks meet every block of rows of
    their group; each meeting returns its own k, of which the best k remain.
    """
    blocked = _blocks(rows, block_rows)
    groups = blocked.groupBy("g").agg(F.max("nb").alias("nb"))
    asked = queries.join(groups, "g").withColumn("qb", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(1 << 20)))
    size = queries.groupBy("g").count().select("g", F.ceil(F.col("count") / block_rows).cast("int").alias("nq"))
    asked = asked.join(size, "g").withColumn("i", (F.col("qb") % F.col("nq")).cast("int"))
    left = asked.select("g", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(True).alias("q"), "k", "v")
    right = blocked.join(size, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("i"), F.col("b").alias("j"), F.lit(False).alias("q"), "k", "v")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        is_q = t["q"].to_numpy()
        v, keys = _matrix(t["v"], dim), t["k"].combine_chunks()
        ia, ib = np.nonzero(is_q)[0], np.nonzero(~is_q)[0]
        if not len(ia) or not len(ib):
            x = y = np.zeros(0, int)
            cosine = np.zeros(0)
        else:
            x, y, cosine = nearest(v[ia], v[ib], k + 1)
        a, b = keys.take(pa.array(ia[x])), keys.take(pa.array(ib[y]))
        t = pa.table({"g": pa.array([key[0].as_py()] * len(a), pa.string()), "k": a, "neighbour": b, "cosine": pa.array(cosine, pa.float64())})
        return t.filter(pa.compute.not_equal(t["k"], t["neighbour"]))

    import pyarrow.compute  # noqa: F401 - used in run

    kind = dict(rows.dtypes)["k"]
    met = _dealt(left.unionByName(right)).groupBy("g", "i", "j").applyInArrow(run, f"g string, k {kind}, neighbour {kind}, cosine double")
    best = met.groupBy("g", "k").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbour"))), 1, k).alias("n"))
    return best.select("g", "k", F.posexplode("n").alias("p", "n")).select("g", "k", "n.neighbour", (-F.col("n.c")).alias("cosine"), (F.col("p") + 1).alias("rank"))
