import random
from datetime import date

from pyspark.sql import functions as F

from bitempo.functions import dates, text
from bitempo.operators import graph, infer, reports, resolve, search, windows
from tests.rows import rows


def test_fusion_strategies(spark):
    s = spark.createDataFrame([("q", 1, "Document", 1.0), ("q", 2, "SourceFile", 9.0), ("q", 3, "SourceFile", 4.0)], "q string, id int, label string, score double")
    order = lambda how: [r[0] for r in search.fuse_labels(s, how, 9).orderBy("rank").select("id").collect()]
    assert order("global_score") == [2, 3, 1] and order("per_label_rank") == [1, 2, 3] and order("normalized") == [2, 1, 3]


def test_interleave_and_rrf(spark):
    lists = spark.createDataFrame([("q", 1, 1, "a"), ("q", 1, 2, "b"), ("q", 1, 3, "c"), ("q", 2, 1, "x"), ("q", 2, 2, "a")], "q string, channel int, rank int, id string")
    assert [r["id"] for r in search.interleave(lists).orderBy("rank").collect()] == ["a", "x", "b", "c"]
    legs = lists.withColumn("weight", F.when(F.col("channel") == 1, 1.0).otherwise(3.0))
    best = search.rrf(legs).orderBy("rank").collect()
    assert [r["id"] for r in best][:2] == ["a", "x"] and abs(best[0]["score"] - (1 / 11 + 3 / 12)) < 1e-9


def test_roles(spark):
    data = [("d", 0.9, ["v"]), ("n", 0.01, ["named_entity"]), ("t", 0.01, ["time_window"]), *[(f"b{i}", 0.4 - i / 100, ["v"]) for i in range(5)], ("z", 0.1, ["v"])]
    s = spark.createDataFrame([("q", *r) for r in data], "q string, id string, score double, methods array<string>")
    got = {r["id"]: r["role"] for r in search.roles(s).collect()}
    assert got["d"] == got["n"] == "direct" and got["t"] == "temporal" and [got[f"b{i}"] for i in range(5)] == ["bridge"] * 4 + ["irrelevant"] and got["z"] == "irrelevant"
    few = {r["id"]: r["role"] for r in search.roles(s.where("id in ('b0', 'z')")).collect()}
    assert few == {"b0": "bridge", "z": "bridge"}


def test_select_final(spark):
    s = spark.createDataFrame([("q", i, x) for i, x in enumerate((0.9, 0.3, 0.2, 0.1, 0.9))] + [("q", 0, 0.8)], "q string, id int, score double")
    assert rows(search.select_final(s), "id") == [(0,), (1,), (4,)]
    assert rows(search.select_final(s, 0.0, 0, 2), "id") == [(0,), (4,)] and rows(search.select_final(s, 1.0, 0), "id") == []


def test_pack(spark):
    h = spark.createDataFrame([("q", 1, 1, 60), ("q", 2, 2, 30), ("q", 3, 3, 50), ("q", 4, 4, 5)], "q string, rank int, id int, tokens int")
    assert rows(search.pack(h, 100, 40), "id", "taken") == [(1, 60), (2, 30), (4, 5)]
    assert rows(search.pack(h, 100, 10), "id", "taken") == [(1, 60), (2, 30), (3, 10)]


def test_anchors(spark):
    t = "See DATA-12 and data-13, DATA-12; https://x.example/a/). PR #7, github.com/Own/Repo.git/pull/9, bitbucket.org/own/lib/pull-requests/3 Commit: ABCDEF1 Repository: Own/Repo.git src/a/b.py"
    r = spark.createDataFrame([(t,), (None,)], "t string").select(*[f(F.col("t")).alias(n) for n, f in (("k", text.issue_keys), ("u", text.urls), ("p", text.pull_request_refs), ("c", text.commit_shas), ("r", text.repository_names), ("f", text.file_paths))]).collect()
    assert r[0]["k"] == ["DATA-12"] and r[0]["u"] == ["https://x.example/a"] and r[0]["p"] == ["#7", "own/lib#3", "own/repo#9"] and r[0]["c"] == ["abcdef1"] and "src/a/b.py" in r[0]["f"] and "own/repo" in r[0]["r"]
    assert all(x == [] for x in r[1])


def test_text(spark):
    c = F.col
    df = spark.createDataFrame([("We do not  use it", "not use", "A b.C!d")], "a string, b string, n string")
    r = df.select(text.polarity_conflict(c("a"), c("n")).alias("p"), text.evidence_in(c("b"), c("a")).alias("e"), text.identity(c("n")).alias("i"), text.excerpt(c("a"), c("b"), 3).alias("x"), text.units(F.lit("One. Two!\n\n\nThree")).alias("u"), text.sha_prefixes(F.lit("abcdef1 abcdef1234 ffffff")).alias("s")).first()
    assert r["p"] and r["e"] and r["i"] == "a b c d" and r["x"] == "…do not use it" and r["u"] == ["One.", "Two!", "Three"] and r["s"] == ["abcdef1234"]
    w = spark.createDataFrame([(0,), (5,), (10,), (23,)], "n int").select(text.token_windows(c("n"), 10).alias("w")).collect()
    assert [[tuple(x) for x in r["w"]] for r in w] == [[(0, 0)], [(0, 5)], [(0, 10)], [(0, 10), (5, 15), (10, 20), (15, 23)]]


def test_windows_and_names(spark):
    words = ["filler"] * 100 + ["alpha", "beta"] + ["filler"] * 100
    assert "alpha beta" in windows.best_window(" ".join(words), ["alpha", "beta"], 20) and windows.best_window(None, ["x"]) == ""
    assert windows.best_window("short text", ["x"], 20) == "short text"
    assert windows.pack_units(["a b c", "d e", "f", "g h i j k"], 4) == ["a b c", "d e\n\nf", "g h i j k"]
    people = spark.createDataFrame([(1, "Henrike Sebrezitz"), (2, "Ulla Grizibra"), (3, None)], "id int, name string")
    assert rows(windows.fuzzy_names(people, spark.createDataFrame([("hnrike",), ("zz",), (None,)], "word string")), "id", "word") == [(1, "hnrike")]


STATED = [
    ("since 2026-03-12", "2026-03-12", None, False),
    ("valid from 12 March 2026 until April 1st, 2026", "2026-03-12", "2026-04-01", False),
    ("12 March 2026 to 4 August 2026.", "2026-03-12", "2026-08-04", False),
    ("until Mar 2026", None, "2026-03-01", False),
    ("since Q2", "2026-04-01", None, False),
    ("in Q3 2025", "2025-07-01", None, False),
    ("3 days ago", "2026-05-17", None, False),
    ("2 months ago", "2026-03-21", None, False),
    ("from next sprint", "2026-06-03", None, False),
    ("superseded on 4 Sept 2026", None, "2026-09-04", False),
    ("it ended. On 2026-01-05 another began", "2026-01-05", None, True),
    ("recorded at 2026-03-12T10:00:00+05:30 in the log; live until the migration", "2026-03-12", None, True),
    ("see DS-2026-03-12, /exports/2026-03-12/x and v2.0.3", None, None, False),
    ("the endpoint was replaced", None, None, True),
    ("30 February 2026 and 2026-13-40", None, None, False),
    ("first yesterday, then LAST  WEEK", "2026-05-19", "2026-05-13", False),
    ("", None, None, False),
    (None, None, None, False),
]


def test_stated_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(STATED)], "i int, t string")
    said = lambda ref: [tuple(None if x is None else x if isinstance(x, bool) else str(x) for x in r) for r in df.select("i", dates.stated(F.col("t"), ref).alias("s")).orderBy("i").select("s.*").collect()]
    assert said(F.lit("2026-05-20").cast("date")) == [tuple(x[1:]) for x in STATED]
    alone = said(F.lit(None).cast("date"))
    assert alone[6][0] is None and alone[4][0] is None and alone[5][0] == "2025-07-01"


def test_query_windows():
    q = dates.query_window
    assert q("what happened in August 2026?") == ("2026-08-01", "2026-09-01", None) and q("Dec'25") == ("2025-12-01", "2026-01-01", None)
    assert q("in 2026") == ("2026-01-01", "2027-01-01", None) and q("on 2026-08-14") == ("2026-08-14", "2026-08-15", None)
    assert q("at 2026-08-14T10:30") == ("2026-08-14T10:30:00", None, None) and q("what did we believe in 2026-08") == (None, None, "2026-08-01")
    assert q("status of DATA-2026") == (None, None, None)


def test_closure(spark):
    e = lambda *p: spark.createDataFrame([(a, b, None, None, 1.0) for a, b in p], "from_uid string, to_uid string, valid_at timestamp, invalid_at timestamp, confidence double")
    pairs = lambda df: rows(df, "from_uid", "to_uid")
    assert pairs(infer.transitive_closure(e(("a", "b"), ("b", "c"), ("c", "d")))) == [("a", "c"), ("a", "d"), ("b", "d")]
    assert pairs(infer.transitive_closure(e(("a", "b"), ("b", "c"), ("a", "c")))) == []
    assert pairs(infer.transitive_closure(e(("a", "b"), ("b", "a")))) == []
    assert len(pairs(infer.transitive_closure(e(*[(str(i), str(i + 1)) for i in range(10)]), max_depth=3))) == 9 + 8
    assert pairs(infer.symmetric_closure(e(("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")))) == [("c", "a")]


def test_closure_needs_a_common_period(spark):
    data = [("a", "b", "2024-01-01", "2024-02-01", 0.9), ("b", "c", "2024-03-01", None, 0.8), ("b", "d", "2024-01-15", None, 0.7)]
    e = spark.createDataFrame(data, "from_uid string, to_uid string, s string, t string, confidence double").select("from_uid", "to_uid", F.col("s").cast("timestamp").alias("valid_at"), F.col("t").cast("timestamp").alias("invalid_at"), "confidence")
    got = infer.transitive_closure(e).collect()
    assert [(r["to_uid"], str(r["valid_at"])[:10], str(r["invalid_at"])[:10], r["confidence"]) for r in got] == [("d", "2024-01-15", "2024-02-01", 0.7)]


def _chains(edges, depth):
    """Every chain walked: the shortest depth of each concluded pair and its best confidence."""
    asserted, out = {e[:2] for e in edges}, {}
    walks = list(edges)
    for n in range(2, depth + 1):
        walks = {(a, d, max(s, t), min(e, f), min(c, k)) for a, b, s, e, c in walks for x, d, t, f, k in edges if x == b and a != d}
        walks = {w for w in walks if w[2] < w[3]}
        for a, b, _, _, c in walks:
            if (a, b) not in asserted and out.get((a, b), (n, 0))[0] == n:
                out[a, b] = (n, max(c, out.get((a, b), (n, 0))[1]))
    return sorted((*p, *v) for p, v in out.items())


def test_dated_closure_walks_every_chain(spark):
    r = random.Random(5)
    edges = []
    for _ in range(45):
        a, b, s = r.randrange(14), r.randrange(14), r.randrange(40)
        edges += [(f"n{a:02d}", f"n{b:02d}", s, s + r.randrange(1, 40), r.randrange(1, 9) / 10)] if a != b else []
    edges += [("p0", "p1", 1, 5, 0.9), ("p0", "p1", 1, 50, 0.4), ("p1", "p2", 20, 30, 0.8)]
    edges += [(f"q{i}", f"q{i + 1}", 1, 50, 0.5) for i in range(9)]
    e = spark.createDataFrame(edges, "from_uid string, to_uid string, s long, t long, confidence double").select("from_uid", "to_uid", F.timestamp_seconds("s").alias("valid_at"), F.timestamp_seconds("t").alias("invalid_at"), "confidence")
    got = rows(infer.transitive_closure(e), "from_uid", "to_uid", "depth", "confidence")
    assert got == _chains(edges, 8) and ("p0", "p2", 2, 0.4) in got and ("q0", "q8", 8, 0.5) in got
    from bitempo.plans.graph import QUERIES

    assert "transitive_closure_dated" in QUERIES


def test_clusters(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y"), ("x", "x"), (None, "x")], "a string, b string")
    got = dict(rows(graph.clusters(e), "uid", "cluster"))
    assert got["n30"] == "n00" and got["y"] == "x" and len(got) == 33
    assert dict(rows(graph.clusters(e, hops=2), "uid", "cluster"))["n30"] == "n28"


def test_expand(spark):
    f = spark.createDataFrame([("s", "IMPLEMENTS", f"t{i}", i == 0) for i in range(6)] + [("p", "PARENT_OF", "s", True), ("s", "OWNS", "o", False), ("s", "IMPLEMENTS", "hub", False)], "from_uid string, rel_type string, to_uid string, derived boolean")
    labels = spark.createDataFrame([(f"t{i}", "WorkItem") for i in range(6)] + [("p", "WorkItem"), ("s", "WorkItem"), ("hub", "Person"), ("o", "WorkItem")], "uid string, label string")
    assert [r["neighbour"] for r in graph.expand(f, labels, spark.createDataFrame([("s",)], "seed string")).orderBy("rank").collect()] == ["t1", "t2", "t3", "t4"]


def test_path_support(spark):
    p = spark.createDataFrame([("x", 1.0), ("x", 0.0), ("y", 1.0)], "path string, support double")
    got = {r["path"]: (round(r["support"], 6), r["low"]) for r in graph.path_support(p).collect()}
    assert got == {"x": (0.1, True), "y": (1.0, False)}


def test_reports(spark):
    pairs = spark.createDataFrame([(0.95, True), (0.95, True), (0.15, False), (1.0, False), (None, True)], "confidence double, correct boolean")
    r = reports.calibration_error(pairs).first()
    assert r["n"] == 4 and abs(r["ece"] - (3 / 4 * abs(2 / 3 - 2.9 / 3) + 1 / 4 * 0.15)) < 1e-9
    cases = spark.createDataFrame([("a", ["x"], ["y", "x"]), ("b", ["x"], []), ("c", [], ["x"])], "q string, expected array<string>, retrieved array<string>")
    assert rows(reports.retrieval_scores(cases), "q", "precision", "recall", "reciprocal_rank") == [("a", 0.5, 1.0, 0.5), ("b", 0.0, 0.0, 0.0), ("c", 0.0, 0.0, 0.0)]
    drops = spark.createDataFrame([("r1", "A", "R", "B", "x", "y"), ("r2", "A", "R", "B", "x", "z"), ("r2", "A", "R", "B", "q", "Q"), ("r2", "A", "R", "B", None, "w"), ("r3", "A", "R", "B", "u", "v")], "record_key string, subject_kind string, relation string, object_kind string, subject_name string, object_name string")
    assert rows(reports.adoption_candidates(drops, drops.limit(0), drops.limit(0)), "records", "facts", "example") == [(3, 3, "u > v")]


def test_ladder_and_actions(spark):
    items = spark.createDataFrame([(1, "T", "n")], "item int, label string, name string")
    none = spark.createDataFrame([], "label string, name string, uid string")
    near = lambda *d: spark.createDataFrame([(1, *x) for x in d], "item int, uid string, cosine double, probability double, veto boolean")
    rung = lambda n: tuple(resolve.ladder(items, none, none, n).select("uid", "rung").first())
    assert rung(near(("a", 0.91, 0.0, False))) == ("a", "vector") and rung(near(("a", 0.95, 0.1, False), ("b", 0.92, 0.2, False))) == (None, "new")
    assert rung(near(("a", 0.8, 0.9, False), ("b", 0.8, 0.7, False))) == ("a", "classifier") and rung(near(("a", 0.8, 0.9, False), ("b", 0.8, 0.8, False))) == (None, "new")
    assert rung(near(("a", 0.99, 0.9, True))) == (None, "new")
