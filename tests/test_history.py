import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bitempo.operators import history
from tests.rows import rows

EVENT = "entity_id string, attribute string, at_ms long, rank long, value string, value_hash long, ends_ms long"


def events(spark, data):
    return spark.createDataFrame([(e, a, t, r, v, None if v is None else hash(v) % 1000, end) for e, a, t, r, v, end in data], EVENT)


def brute(data):
    groups = defaultdict(dict)
    for e, a, t, r, v, end in data:
        if e is None or a is None or t is None:
            continue
        if t not in groups[e, a] or r > groups[e, a][t][0]:
            groups[e, a][t] = (r, v, end)
    out = []
    for (e, a), at in groups.items():
        current = None  # [value, start, end of the last row]
        for t in sorted(at):
            _, v, end = at[t]
            if current and current[0] == v and not (current[2] is not None and current[2] < t):
                current[2] = end
                continue
            if current and current[0] is not None:
                out.append((e, a, current[1], min(t, current[2]) if current[2] is not None else t))
            current = [v, t, end]
        if current and current[0] is not None:
            out.append((e, a, current[1], -1 if current[2] is None else current[2]))
    return sorted(out, key=repr)


COLUMNS = ("entity_id", "attribute", "valid_from_ms", "valid_to_ms")


@pytest.mark.parametrize("hot", [3, 100_000])
def test_versions_against_brute_force(spark, hot):
    r = random.Random(7)
    data = [(r.choice(["a", "b", "hot", "hot", None]), r.choice(["x", "y"]), r.choice([None, *range(60)]), i, r.choice(["p", "q", None]), r.choice([None, None, None, *range(60)])) for i in range(300)]
    data += data[:40]
    assert rows(history.versions(events(spark, data), hot_rows=hot), *COLUMNS) == brute(data)


def stored(spark, dimension):
    """The dimension as rows, so that the next merge does not read through this one."""
    return history.Dimension(*[spark.createDataFrame(df.collect(), df.schema) for df in dimension])


@pytest.mark.parametrize(("hot", "seed"), [(3, 0), (100_000, 1), (100_000, 2)])
def test_merge_in_any_order_equals_one_pass(spark, hot, seed):
    r = random.Random(seed)
    data = [(r.choice("abcd"), "x", r.randrange(60), i + 1, r.choice(["p", "q", None]), r.choice([None, None, *range(60)])) for i in range(120)]
    data += [("late", "x", 1, 1, "A", None), ("late", "x", 3, 3, "A", None), ("ended", "x", 1, 1, "A", None), ("ended", "x", 3, 3, "A", None), ("none", "x", 5, 5, None, None)]
    late = [("late", "x", 2, 2, "B", None), ("ended", "x", 2, 2, "A", 2), ("none", "x", 3, 3, "A", None), (None, "x", 3, 3, "A", None), ("none", "x", None, 3, "A", None)]
    data.sort(key=lambda e: e[2] if seed % 2 else e[3])
    dimension = None
    for part in (data[:60], data[60:], late, data[20:90]) if seed < 2 else (data[60:], data[:60], late, data[20:90]):
        dimension = stored(spark, history.merge(dimension, events(spark, part), hot_rows=hot))
    got = rows(history.held(dimension.states), *COLUMNS)
    assert got == brute(data + late)
    assert [x[2:] for x in got if x[0] == "late"] == [(1, 2), (2, 3), (3, -1)]


def test_a_value_that_ends_after_it_was_confirmed(spark):
    parts = [[("a", "s", 1, 1, "A", None), ("a", "s", 2, 2, "A", 50)], [("a", "s", 10, 10, "A", None)], [("a", "s", 20, 20, None, None)], [("a", "s", 30, 30, "A", None)]]
    dimension = None
    for part in parts:
        dimension = stored(spark, history.merge(dimension, events(spark, part)))
    assert rows(history.held(dimension.states), *COLUMNS) == brute(sum(parts, [])) == [("a", "s", 1, 20), ("a", "s", 30, -1)]


def test_merge_closes_and_inserts(spark):
    first = history.merge(None, events(spark, [("a", "s", 10, 1, "open", None), ("b", "s", 10, 1, "open", None)]))
    second = history.merge(first, events(spark, [("a", "s", 20, 1, "done", None)]))
    assert rows(history.held(second.states), *COLUMNS, "value") == [("a", "s", 10, 20, "open"), ("a", "s", 20, -1, "done"), ("b", "s", 10, -1, "open")]
    again = history.merge(second, events(spark, [("a", "s", 20, 1, "done", None)]))
    assert rows(history.held(again.states), *COLUMNS) == rows(history.held(second.states), *COLUMNS)


def test_merge_reads_the_log_for_late_events_only(spark):
    """A log that is broken on purpose: what comes in order never looks at it."""
    first = history.merge(None, events(spark, [("a", "s", 10, 1, "open", None)]))
    broken = history.Dimension(first.states, first.log.withColumn("at_ms", F.raise_error(F.lit("read")).cast("long")))
    assert rows(history.held(history.merge(broken, events(spark, [("a", "s", 20, 2, "done", None)])).states), *COLUMNS) == [("a", "s", 10, 20), ("a", "s", 20, -1)]


def test_empty_table_and_extra_columns(spark):
    empty = events(spark, [])
    assert history.versions(empty).count() == 0
    extra = events(spark, [("a", "s", 1, 1, "v", None)]).withColumn("_chunk", F.lit(1)).withColumn("valid_to_ms", F.lit(9))
    assert rows(history.versions(extra), *COLUMNS) == [("a", "s", 1, -1)]


def test_instants(spark):
    texts = ["2020-01-02T03:04:05.678Z", "2020-01-02 03:04:05+0530", "2020-01-02T03:04:05-08:00", "2020-01-02T03:04:05", "0000-00-00T00:00:00Z", "unknown", "", None, "2020-02-30T00:00:00Z", "12:30"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(history.instant_ms(F.col("t"))).collect()]
    assert got == [1577934245678, 1577914445000, 1577963045000, 1577934245000, None, None, None, None, None, None]


def test_equal_values(spark):
    values = ["To Do", " to  do ", "TO DO", "", "   ", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(history.folded(F.col("v"))).collect()]
    assert got == ["todo", "todo", "todo", None, None, None]
