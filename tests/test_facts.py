import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bitempo.functions import temporal
from bitempo.functions.access import Scope
from bitempo.functions.ids import NAMESPACE, make_uid, uuid5
from bitempo.operators import changes, facts
from tests.rows import rows

FACT = "fact_uid string, from_uid string, rel_type string, to_uid string, from_label string, to_label string, valid_at timestamp, invalid_at timestamp, first_seen_at timestamp, last_confirmed_at timestamp, source_record_keys array<string>, evidence string, confidence double, assertion_status string"
T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)


def now():
    return F.lit("2025-01-01").cast("timestamp")


NOW_ = datetime(2025, 1, 1)


def fact(uid, a="a", r="R", b="b", valid=T0, invalid=None, keys=("r1",), evidence="e", confidence=0.5, status="live", confirmed=T0):
    return (uid, a, r, b, "X", "Y", valid, invalid, valid, confirmed, None if keys is None else list(keys), evidence, confidence, status)


def table(spark, *data):
    return spark.createDataFrame(list(data), FACT)


def batch(spark, *data):
    return spark.createDataFrame(list(data), "from_uid string, rel_type string, to_uid string, source_record_keys array<string>, evidence string, confidence double, valid_at timestamp, invalid_at timestamp")


def one(df):
    return df.collect()[0].asDict()


def test_unchanged_confirms_nothing(spark):
    old = table(spark, fact("f"))
    got = one(facts.upsert(old, batch(spark, ("a", "R", "b", ["r1"], "e", 0.5, None, None)), now()))
    assert got["last_confirmed_at"] == T0 and got["source_record_keys"] == ["r1"] and got["fact_uid"] == "f"


def test_changes_confirm(spark):
    old = table(spark, fact("f"))
    for keys, evidence, confidence in ((["r2"], "e", 0.5), (["r1"], "other", 0.5), (["r1"], "e", 0.9)):
        got = one(facts.upsert(old, batch(spark, ("a", "R", "b", keys, evidence, confidence, None, None)), now()))
        assert got["last_confirmed_at"] == NOW_ and got["evidence"] == "e" and got["confidence"] == 0.5
    assert one(facts.upsert(old, batch(spark, ("a", "R", "b", ["r1"], "other", None, None, None)), now(), update_evidence=True))["evidence"] == "other"


def test_null_compares_as_unknown(spark):
    old = table(spark, fact("f", evidence=None))
    assert one(facts.upsert(old, batch(spark, ("a", "R", "b", ["r1"], "new", None, None, None)), now()))["last_confirmed_at"] == T0


def test_support_checks_the_first_key_only(spark):
    old = table(spark, fact("f", keys=["r1"]))
    assert one(facts.upsert(old, batch(spark, ("a", "R", "b", ["r1", "r9"], "e", 0.5, None, None)), now()))["source_record_keys"] == ["r1"]
    assert one(facts.upsert(old, batch(spark, ("a", "R", "b", ["r9", "r1"], "e", 0.5, None, None)), now()))["source_record_keys"] == ["r1", "r9", "r1"]


def test_revive(spark):
    old = table(spark, fact("f", invalid=T1))
    row = ("a", "R", "b", ["r1"], "e", 0.5, T2, T2)
    got = one(facts.upsert(old, batch(spark, row), now()))
    assert got["invalid_at"] is None and got["valid_at"] == T2 and got["last_confirmed_at"] == NOW_
    got = one(facts.upsert(old, batch(spark, row), now(), revive=False))
    assert got["invalid_at"] == T1 and got["valid_at"] == T0


def test_new_fact(spark):
    got = {r["to_uid"]: r for r in facts.upsert(table(spark, fact("f")), batch(spark, ("a", "R", "c", ["r1"], "e", 0.7, None, T2), (None, "R", "c", [], None, None, None, None), ("a", "R", "c", ["r1"], "e", 0.7, None, T2)), now()).collect()}
    assert set(got) == {"b", "c"} and got["c"]["valid_at"] == NOW_ and got["c"]["invalid_at"] == T2 and got["c"]["assertion_status"] == "live"
    assert got["c"]["fact_uid"] == str(uuid.uuid5(NAMESPACE, "Fact|a|R|c"))


def test_replay_changes_nothing(spark):
    new = batch(spark, ("a", "R", "c", ["r2"], "e", 0.7, None, None), ("a", "R", "b", ["r2"], "e", 0.5, None, None))
    once = facts.upsert(table(spark, fact("f")), new, now())
    assert rows(facts.upsert(once, new, now()), *once.columns) == rows(once, *once.columns)


def test_supersede_and_history(spark):
    old = table(spark, fact("f"), fact("g", b="c", invalid=T1), fact("h", a="z"), fact("i", r="S", b="d"))
    closed, history = facts.supersede(old, "R", spark.createDataFrame([("a",), (None,)], "from_uid string"), now())
    assert {r["fact_uid"]: r["invalid_at"] for r in closed.collect()} == {"f": NOW_, "g": T1, "h": None, "i": None}
    assert rows(history, "fact_uid", "valid_from", "valid_to") == [("f", T0, NOW_)]


def test_support_removal(spark):
    old = table(spark, fact("f", keys=["r1"]), fact("g", b="c", keys=["r1", "r2"]), fact("h", b="d", keys=None), fact("i", b="e", keys=["r1"], invalid=T1))
    got = {r["fact_uid"]: (r["source_record_keys"], r["invalid_at"]) for r in facts.remove_support(old, spark.createDataFrame([("r1",)], "record_key string"), now())[0].collect()}
    assert got == {"f": ([], NOW_), "g": (["r2"], None), "h": (None, None), "i": ([], T1)}


def test_support_removal_archives(spark):
    old = table(spark, fact("f", keys=["r1"]), fact("g", b="c", keys=["r1", "r2"]))
    _, history = facts.remove_support(old, spark.createDataFrame([("r1", T2), (None, T1)], "record_key string, valid_to timestamp"), now())
    assert rows(history, "fact_uid", "valid_from", "valid_to", "observed_to", "source_record_keys") == [("f", T0, T2, NOW_, ["r1"])]


def test_repeated_rows_of_a_batch_all_support(spark):
    old = table(spark, fact("f", keys=["r1"]))
    said = [("a", "R", "b", [k], "e", 0.5, None, None) for k in ("k1", "k2", "r1", "k1")] + [("a", "R", "c", [k], "e", 0.5, None, None) for k in ("k1", "k2", "k1")] + [("a", "R", "d", None, "e", 0.5, None, None)]
    got = {r["to_uid"]: r["source_record_keys"] for r in facts.upsert(old, batch(spark, *said), now()).collect()}
    assert sorted(got["b"]) == ["k1", "k2", "r1"] and sorted(got["c"]) == ["k1", "k2"] and got["d"] is None


def test_close_correct_confirm(spark):
    old = table(spark, fact("f", valid=T1), fact("g", b="c", valid=T1), fact("h", b="d", valid=T0, invalid=T1))
    early, history = facts.close(old, spark.createDataFrame([("f", T0), ("g", T2), ("h", T2), ("none", T2)], "fact_uid string, valid_to timestamp"), now())
    assert rows(early, "fact_uid", "invalid_at") == [("f", None), ("g", T2), ("h", T1)]
    assert rows(history, "fact_uid", "valid_from", "valid_to", "observed_to") == [("g", T1, T2, NOW_)]
    for order in (("f", T0), ("h", T2), ("none", T2)):
        with pytest.raises(facts.Refused):
            facts.close(old, spark.createDataFrame([order], "fact_uid string, valid_to timestamp"), now(), strict=True)
    wrong, history = facts.correct(old, spark.createDataFrame([("f",), ("h",)], "fact_uid string"), now())
    assert rows(wrong, "fact_uid", "invalid_at", "assertion_status") == [("f", T1, "corrected"), ("g", None, "live"), ("h", T1, "live")]
    assert rows(history, "fact_uid", "valid_from", "valid_to", "observed_from", "observed_to", "assertion_status") == [("f", T1, T1, T1, NOW_, "corrected")]
    again = facts.upsert_history(history, history.withColumn("confidence", F.lit(0.9)))
    assert rows(again, "fact_uid", "confidence") == [("f", 0.9)]
    more = facts.confirm(old, spark.createDataFrame([("f", "r0", "new"), ("f", "r1", None), ("g", None, None), ("h", "r9", None)], "fact_uid string, record_key string, evidence string"), now())
    assert rows(more, "fact_uid", "source_record_keys", "evidence", "last_confirmed_at") == [("f", ["r1", "r0"], "new", NOW_), ("g", ["r1"], "e", T0), ("h", ["r1"], "e", T0)]
    ended = facts.mark_ended_unknown(old, spark.createDataFrame([("g", T2)], "fact_uid string, attested_from timestamp"))
    assert rows(ended, "fact_uid", "ended_unknown", "attested_from") == [("f", False, None), ("g", True, T2), ("h", False, None)]
    linked = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("a", "r2")], "uid string, record_key string")
    assert rows(facts.unlink_mentions(linked, spark.createDataFrame([("r1", "a")], "record_key string, primary_uid string")), "uid", "record_key") == [("a", "r1"), ("a", "r2")]


def test_delete_and_orphans(spark):
    nodes = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Y")], "uid string, label string")
    left, kept = facts.delete_nodes(nodes, table(spark, fact("f"), fact("g", a="c", b="c")), nodes.where("uid = 'b'"))
    assert rows(left, "uid") == [("a",), ("c",)] and rows(kept, "fact_uid") == [("g",)]
    assert rows(facts.orphans(nodes, facts.mentions(table(spark, fact("f"))), ("Y",)), "uid") == [("c",)]


def test_holds_at(spark):
    cases = [
        # start, end, attested, ended_unknown, at, until, temporal -> held
        (T0, None, None, False, T1, None, "state", True),
        (T1, None, None, False, T0, None, "state", False),
        (T0, T1, None, False, T1, None, "state", False),
        (None, None, None, False, T1, None, "state", False),
        (None, None, T1, False, T0, None, "state", False),
        (None, None, T1, False, T1, None, "state", True),
        (T0, None, T1, True, T2, None, "state", False),
        (T0, None, T1, True, T0, None, "state", True),
        (T0, None, None, False, None, None, "state", True),
        (T0, None, None, False, T1, T2, "event", False),
        (T1, None, None, False, T1, T2, "event", True),
        (T0, T2, None, False, T1, T2, "state", True),
        (None, None, None, False, T1, T2, "state", False),
        (None, None, None, False, T1, T2, "eternal", True),
    ]
    for kind in ("state", "event", "eternal"):
        for window in (False, True):
            some = [c for c in cases if c[6] == kind and (c[5] is not None) == window]
            if not some:
                continue
            df = spark.createDataFrame([c[:6] + (c[7], i) for i, c in enumerate(some)], "s timestamp, e timestamp, a timestamp, u boolean, at timestamp, until timestamp, want boolean, i int")
            c = F.col
            held = temporal.holds_at(c("s"), c("e"), c("at"), c("until") if window else None, kind, c("a"), c("u"))
            assert [r["i"] for r in df.withColumn("got", held).where("got <> want or got is null").collect()] == []


def test_held_at_and_disjoint(spark):
    df = spark.createDataFrame([(T0, None, None, True), (T0, T1, None, False), (T0, T2, T1, True), (T1, None, T0, False), (T0, T1, T1, False)], "f timestamp, t timestamp, a timestamp, want boolean")
    assert df.where(temporal.held_at(F.col("f"), F.col("t"), F.col("a")) != F.col("want")).count() == 0
    df = spark.createDataFrame([(T0, T1, T1, T2, True), (T0, T2, T1, None, False), (T0, None, T1, None, False), (None, T1, T2, None, True)], "a timestamp, b timestamp, c timestamp, d timestamp, want boolean")
    assert df.where(temporal.disjoint(*[F.col(x) for x in "abcd"]) != F.col("want")).count() == 0


def test_freshness(spark):
    day = lambda n: datetime.fromtimestamp(NOW_.timestamp() - n * 86400)
    data = [("fast", day(21), None, "stale"), ("fast", day(20), None, "fresh"), (None, day(180), None, "stale"), ("durable", day(200), None, "fresh"), ("task", day(999), False, "fresh"), ("task", day(0), True, "stale"), ("slow", None, None, "stale"), ("unheard", day(179), None, "fresh")]
    df = spark.createDataFrame(data, "d string, c timestamp, closed boolean, want string")
    assert df.where(temporal.freshness(F.col("d"), F.col("c"), now(), F.col("closed")) != F.col("want")).count() == 0


def test_scope(spark):
    df = spark.createDataFrame([("jira", "c0", "jira:c0:x:1", ["p"], False), ("jira", "c1", "jira:c1:x:1", [], True), ("github", None, "github:c9:x:1", None, None)], "p string, c string, k string, who array<string>, pub boolean")
    see = lambda s: [r["k"] for r in df.where(s.allows(*[F.col(x) for x in ("p", "c", "k", "who", "pub")])).collect()]
    assert see(Scope(public=False)) == [] and len(see(Scope(everything=True))) == 3 and see(Scope()) == ["jira:c1:x:1"]
    assert see(Scope.of([("GitHub", "c9")], public=False)) == ["github:c9:x:1"] and see(Scope(principals=("p",), public=False)) == ["jira:c0:x:1"]


def test_ids(spark):
    names = ["", "a", "Zürich|1", "x" * 200]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(NAMESPACE, n)) for n in names]
    assert spark.range(1).select(make_uid(F.lit("Fact"), F.lit("a"), F.lit(None).cast("string"))).first()[0] == str(uuid.uuid5(NAMESPACE, "Fact|a|"))


def test_plan_and_chunks(spark):
    s = "record_key string, content_hash string"
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("a", "1"), (None, "1")], s)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], s)
    assert rows(changes.plan(old, new), "record_key", "action") == [("a", "keep"), ("b", "update"), ("c", "delete"), ("d", "insert")]
    c = "record_key string, chunk_id string"
    got = changes.chunk_diff(spark.createDataFrame([("a", "1"), ("a", "2"), ("z", "9")], c), spark.createDataFrame([("a", "1"), ("a", "3"), ("a", "4")], c))
    assert rows(got, "chunk_id", "state") == [("1", "kept"), ("2", "superseded"), ("3", "added"), ("4", "added")]


def test_field_intervals(spark):
    items = spark.createDataFrame([("a", T0, "now"), ("b", T0, "only")], "item string, created_at timestamp, current string")
    moved = spark.createDataFrame([("a", T1, 1, "x", "y"), ("a", T2, 2, "y", "now")], "item string, at timestamp, seq int, from_value string, to_value string")
    assert rows(changes.field_intervals(items, moved), "item", "value", "start_at", "end_at") == [("a", "now", T2, None), ("a", "x", T0, T1), ("a", "y", T1, T2), ("b", "only", T0, None)]
