from pyspark.sql import functions as F

from bitempo.functions import code, models, routing
from bitempo.operators import ledger, selective
from tests.rows import rows


def test_keyed_upsert(spark):
    s = "k int, a string, b string, c string"
    old = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "c")], s)
    new = spark.createDataFrame([(1, "A", None, None), (3, None, "B", "C"), (None, "x", "x", "x"), (3, None, "B", "C")], s)
    got = ledger.keyed_upsert(old, new, ["k"], keep=("a",), fill=("b",))
    assert rows(got, "k", "a", "b", "c") == [(1, "a", "b", None), (2, "a", "b", "c"), (3, None, "B", "C")]
    assert rows(ledger.keyed_upsert(got, new, ["k"], ("a",), ("b",)), *s.replace("int", "").replace("string", "").replace(" ", "").split(",")) == rows(got, "k", "a", "b", "c")
    assert ledger.keyed_delete(old, new, ["k"]).count() == 1


def test_anchors(spark):
    r = spark.createDataFrame([("r1", "github", ["DATA-1", "#12", "#7"]), ("r2", "jira", ["DATA-1"]), ("r3", "github", None)], "record_key string, provider string, anchors array<string>")
    t = spark.createDataFrame([("DATA-1", "w1", "jira"), ("o/a#12", "p12", "bitbucket"), ("o/a#112", "p112", "bitbucket"), ("o/a#7", "p7", "bitbucket"), ("o/b#7", "q7", "bitbucket")], "anchor string, uid string, provider string")
    assert rows(ledger.anchored(r, t), "record_key", "uid") == [("r1", "p12"), ("r1", "w1")]


def test_people_and_paths(spark):
    p = spark.createDataFrame([("c", "X@y "), ("a", "x@y"), ("b", "x@Y"), ("d", ""), ("e", None), (None, "x@y")], "uid string, email string")
    assert rows(ledger.same_people(p), "a", "b") == [("a", "b"), ("a", "c")]
    c = spark.createDataFrame([("r", "h", [("new", "old"), ("gone", None)]), ("r", "i", None)], "repository string, commit_hash string, files array<struct<path:string,old_path:string>>")
    assert rows(ledger.modified(c, spark.createDataFrame([("r", "old"), ("r", "new"), ("s", "gone")], "repository string, path string")), "path") == [("new",), ("old",)]


def test_queue_and_runs(spark):
    q = spark.createDataFrame([(1, 5, "b"), (2, 9, "c"), (3, 9, "a"), (4, 9, None)], "id int, priority int, at string")
    assert [r["id"] for r in ledger.queue(q, 3).collect()] == [3, 2, 4]
    runs = spark.createDataFrame([("g", "r1", 1), ("g", "r2", 2), ("g", "r2", 2), ("h", "r1", 1)], "g string, run string, at int")
    assert rows(ledger.newest_run(runs, ["g"], "run", "at"), "g", "run") == [("g", "r2"), ("g", "r2"), ("h", "r1")]
    assert rows(ledger.fresh_reviews(spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), (None, "1")], "identity string, payload string"), spark.createDataFrame([("y",)], "identity string")), "identity", "payload") == [("x", "1")]


def test_first_known_and_mentions(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one, two = (spark.createDataFrame(x, "k string, uid string") for x in ([("a", "1"), ("a", "0")], [("a", "2"), ("b", "2")]))
    assert rows(ledger.first_known(n, [("one", one), ("two", two)], "k"), "k", "found", "via") == [("a", "0", "one"), ("b", "2", "two"), ("c", None, None)]
    names = spark.createDataFrame([("API gateway",), ("api",), ("the api",), ("ab",), (None,)], "n string")
    assert [r[0] for r in names.select(ledger.mentionable(F.col("n"), ["api", "the"])).collect()] == [True, False, False, False, False]


def test_selective(spark):
    t = [("1", "See DATA-1 for details.", ["DATA-1"]), ("2", "Fixes DATA-1. We decided to keep it because DATA-1 is old.", ["DATA-1"]), ("3", "No anchor here.", None), ("4", None, ["X"]), ("5", "DATA-1 " + "word " * 30 + "see", ["DATA-1"])]
    df = spark.createDataFrame(t, "id string, text string, anchors array<string>")
    assert rows(selective.selective(df, "id", "text", "anchors"), "id", "units", "resolved", "status") == [("1", 1, 1, "deterministic"), ("2", 2, 1, "partial"), ("3", 1, 0, "unresolved"), ("4", 0, 0, "deterministic"), ("5", 1, 0, "unresolved")]


def test_models(spark):
    df = spark.createDataFrame([("red car", "a red thing", 1), ("red car", None, 2), (None, "x", 3)], "q string, t string, i int")
    got = df.select("i", models.scorer(models.overlap_model)(F.col("q"), F.col("t")).alias("s"), models.embedder(lambda ts: [[float(len(t)), 1.0] for t in ts])(F.col("t")).alias("v"), models.classifier(lambda ts: [("long" if len(t) > 3 else "short", 0.5) for t in ts])(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["s"] for r in got] == [0.5, 0.0, 0.0] and [r["v"] for r in got] == [[11.0, 1.0], None, [1.0, 1.0]] and [r["c"]["kind"] for r in got] == ["long", "short", "short"]


def test_code_comments(spark):
    py = '"""Doc.\nmore\n"""\nx = 1  # no\n# yes\ndef f():\n    """One line."""\n    return 2\n'
    assert code.comment_lines(py, "python") == ['"""Doc.', "more", '"""', "# yes", '"""One line."""']
    assert code.comment_lines("/* a\n b */\nint x; // no\n// yes", "Java") == ["/* a", "b */", "// yes"]
    assert code.comment_lines(None, "python") == code.comment_lines("# x", None) == code.comment_lines("", "sql") == []
    df = spark.createDataFrame([(py, "python"), (None, None)], "t string, l string")
    assert [len(r[0]) for r in df.select(code.comments(F.col("t"), F.col("l"))).collect()] == [5, 0]


def test_routes():
    assert routing.route("Which work items are unassigned?") == "unassigned_items"
    assert routing.route("What is assigned to Henrike?") == "assigned_to"
    assert routing.route("show the latest commit in kestrel") == "latest_commits"
    assert routing.route("Which projects call the orders API?") == "api_consumers"
    assert routing.route("status of DATA-12") == "work_items_by_key" and routing.route("what is 3f2a9bc1?") == "commits_by_sha"
    assert routing.route("what changed in August 2026?") == "window_activity" and routing.route("why is it slow?") is None
    assert routing.knowledge_layers("Which findings and lessons apply?") == {"wisdom": True, "findings": True}
