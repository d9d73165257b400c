import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bitempo.llm import pack


@pytest.mark.parametrize("open_bins", [1, 8])
def test_bins(open_bins):
    r = random.Random(1)
    bins, used, opened = pack.Bins(100, open_bins), defaultdict(int), set()
    for _ in range(3000):
        n = r.choice([0, 1, 5, 30, 60, 99, 100, r.randint(0, 100)])
        b = bins.place(n)
        used[b] += n
        opened.add(b)
        assert used[b] <= 100 and bins.open <= open_bins
    assert opened == set(range(bins.made))


def test_best_fit_and_fullest_closes():
    bins = pack.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [0, 1]
    assert bins.place(3) == 1  # leaves nothing, the other would leave one
    assert bins.place(7) == 2  # two are open again
    assert bins.place(8) == 3  # bin 2, the fullest, closed
    assert bins.place(4) == 0


def test_fill(spark):
    r = random.Random(5)
    sizes = [(i, r.choice([None, 0, 3, 50, 99, 100, 101, 250, r.randint(1, 120)])) for i in range(500)]
    df = spark.createDataFrame(sizes, "id long, n int").withColumn("b", F.lit("clash"))
    rows = pack.fill(df, "id", F.col("n"), capacity=100, open_bins=16, task_rows=100).collect()
    used, parts = defaultdict(int), defaultdict(list)
    for x in rows:
        used[x["bin_id"]] += x["to_unit"] - x["from_unit"]
        parts[x["id"]].append((x["part_no"], x["from_unit"], x["to_unit"]))
    assert max(used.values()) <= 100 and set(parts) == {i for i, _ in sizes}
    for i, n in sizes:
        p, n = sorted(parts[i]), n or 0
        assert [a for a, _, _ in p] == list(range(max(1, -(-n // 100))))
        assert p[0][1] == 0 and p[-1][2] == n and all(x[2] == y[1] for x, y in zip(p, p[1:], strict=False))
        if n <= 100:
            assert len(p) == 1
    total = sum(n or 0 for _, n in sizes)
    assert total / (100 * len(used)) > 0.85


def test_fill_again_is_the_same_and_empty_is_empty(spark):
    df = spark.range(300).withColumn("n", F.col("id") % 37)
    one = {tuple(r) for r in pack.fill(df, "id", F.col("n"), 40, 4, 50).collect()}
    assert one == {tuple(r) for r in pack.fill(df.repartition(7), "id", F.col("n"), 40, 4, 50).collect()}
    assert pack.fill(df.limit(0), "id", F.col("n")).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, 30)] * 9 + [(None, 5)], "id long, n int")
    assert pack.fill(df, "id", F.col("n"), 100).count() == 10
