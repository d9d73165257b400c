import json
import uuid

import pytest
from pyspark.sql import functions as F

from bitempo.functions import code, text
from bitempo.functions.ids import NAMESPACE
from bitempo.operators import changes, mapping, ontology, sequence, state, windows
from bitempo.sources import json_exports as sources
from tests.rows import rows


def test_tokens_and_limits():
    assert windows.split_tokens("a b, c d", 2) == ["a b", ", c", "d"] and windows.split_tokens("", 2) == [] and windows.split_tokens(" a b ", 2) == [" a b "]
    assert windows.within_limit(["a b c", " ", "d"], 2) == ["a b", "c", "d"]
    parts = windows.char_windows("word " * 1000, 100, 20)
    assert all(len(p) <= 100 for p in parts) and parts[0].endswith("word") and windows.char_windows("", 5) == [] and "".join(windows.char_windows("x" * 250, 100, 0)) == "x" * 250


def test_chunks_of_records(spark):
    prose = " ".join(f"Sentence number {i} says something." for i in range(400))
    data = [("p", prose, None), ("same", "x.\n\n" + "y " * 600 + ".\n\nx.", ""), ("c", "# one\n# two\nx = 1\n# three\n", "python"), ("u", "begin end", "cobol"), ("none", None, None), ("blank", "  \n", "python"), (None, "text", None)]
    df = spark.createDataFrame(data, "record_key string, content string, language string").withColumn("route", F.lit(1))
    got = {}
    for r in windows.chunk_records(df).orderBy("record_key", "chunk_index").collect():
        got.setdefault(r["record_key"], []).append(r)
    assert set(got) == {"p", "same", "c", "u"} and [r["text"] for r in got["c"]] == ["# one\n# two\n\n# three"] and got["u"][0]["route"] == "code"
    assert all(len(windows._TOKEN.findall(r["text"])) <= 900 for r in got["p"]) and "".join("".join(r["text"].split()) for r in got["p"]) == "".join(prose.split())
    r = got["u"][0]
    assert r["chunk_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"u:{r['content_hash']}:0"))
    ids = [r["chunk_id"] for v in got.values() for r in v]
    assert len(ids) == len(set(ids))
    twice = windows.chunk_records(spark.createDataFrame([("k", "a b c\n\na b c", "")], "record_key string, content string, language string"), target=1)
    assert len({r["chunk_id"] for r in twice.collect()}) == 2


def test_comment_blocks():
    assert code.blocks_of("// a\n// b\n\n// c\nx();\n/* d\ne */\n", "java") == ["// a\n// b\n// c", "/* d\ne */"]
    assert code.blocks_of(None, "java") == [] and code.blocks_of("// a", "none") == []


def test_blocks_and_pages(spark):
    rich = lambda t: [{"plain_text": t}]
    data = [
        ("heading_2", {"rich_text": rich("Title")}, "## Title"), ("to_do", {"rich_text": rich("do"), "checked": True}, "- [x] do"), ("to_do", {"rich_text": rich("do")}, "- [ ] do"), ("code", {"rich_text": rich("x"), "language": "sql"}, "```sql\nx\n```"),
        ("divider", {}, "---"), ("table_row", {"cells": [rich("a"), rich("b")]}, "| a | b |"), ("bookmark", {"url": "u"}, "[u](u)"), ("bookmark", {"url": "u", "caption": rich("c")}, "[c](u)"), ("child_page", {"title": "P"}, "## P"), ("paragraph", {"rich_text": rich("text")}, "text"), ("quote", {"rich_text": []}, None),
    ]
    df = spark.createDataFrame([("p", i, t, json.dumps(b)) for i, (t, b, _) in enumerate(data)] + [("q", 0, "paragraph", None)], "page_id string, position int, type string, body string")
    want = [line for _, _, line in data if line]
    assert [r["line"] for r in sources.blocks(df).orderBy("position").collect()] == want
    assert rows(sources.page_texts(df), "page_id", "markdown") == [("p", "\n".join(want))]


def test_files_of_a_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("a/x.py", "print(1)"), ("a/y.bin", "z"), ("big.py", "y" * 500)):
        (tmp_path / name).write_text(body)
    got = [(r["path"].rsplit("/", 1)[1], r["content"]) for r in sources.files(spark, str(tmp_path), (".py",), 100).collect()]
    assert got == [("x.py", "print(1)")]


def test_newest_commits_cut_before_or_after(spark):
    df = spark.createDataFrame([("r", "a", "m", 3), ("r", "b", " ", 2), ("r", "c", "m", 1), ("s", "d", None, 1)], "repository string, sha string, message string, at int")
    assert rows(sources.newest_commits(df, 2), "sha", "more") == [("a", True)]
    assert rows(sources.newest_commits(df, 2, empty_first=True), "sha", "more") == [("a", False), ("c", False)]


def test_names_and_hints(spark):
    one = lambda *c: spark.range(1).select(*c).first()[0]
    lit = F.lit
    assert one(text.repository_hint(lit("what broke in the Pay-Hub/api today"))) == "pay-hub/api" and one(text.repository_hint(lit("nothing"))) is None
    used = [("Plan", "plan", True), ("Plan — May", "Plan", True), ("Plan", "Plan May", True), ("Plan", "Planning", False), ("", "x", False), (None, "x", False)]
    assert [one(text.name_used(lit(a).cast("string"), lit(b))) for a, b, _ in used] == [w for *_, w in used]
    same = [("Service", "Payment Service", "payment-service", True), ("Service", "payment service api", "payment service", True), ("Service", "pay", "payment", False), ("Service", "runtime v1.2 engine", "runtime v1.3 engine", False), ("API", "GET /orders/list", "POST /orders/list", False), ("API", None, "x", False)]
    assert [one(text.same_thing(lit(k), lit(a).cast("string"), lit(b))) for k, a, b, _ in same] == [w for *_, w in same]
    assert one(text.excerpt(lit("x" * 300 + " Needle " + "y" * 300), lit("needle"), 5)) == "…xxxx Needle yyyy…" and one(text.excerpt(lit("abcdef"), lit("q"), 2)) == "abcd"
    assert one(text.pull_request_refs(lit("see https://github.com/A/b.git/pull/7, bitbucket.org/c/d/pull-requests/8 and PR #9"))) == ["#9", "a/b#7", "c/d#8"]


def test_hot_items_of_a_change_log(spark):
    data = [("hot" if i % 3 else f"i{i % 7}", i // 2, i, f"v{i % 4}", f"v{i % 5}") for i in range(400)] + [(None, 1, 1, "a", "b"), ("x", None, 1, "a", "b")]
    df = spark.createDataFrame(data, "item string, at int, seq int, from_value string, to_value string")
    columns = ("item", "value", "start_at", "end_at", "first")
    assert rows(changes.value_spans(df, 10), *columns) == rows(changes.value_spans(df), *columns)
    states = df.select(F.col("item").alias("record_key"), "at", F.col("to_value").alias("content_hash"))
    names = ("record_key", "version", "content_hash", "at")
    assert rows(changes.record_versions(states, 10), *names) == rows(changes.record_versions(states), *names)
    small = spark.createDataFrame([("k", i) for i in range(50)], "k string, o int")
    hot = sequence.hot_groups(small, ["k"], 10)
    assert rows(sequence.running(small, ["k"], "o", F.lit(2), "s", hot, 4), "o", "s") == [(i, 2 * i + 2) for i in sorted(range(50), key=lambda i: repr((i, 2 * i + 2)))]


def test_graph_of_issues(spark):
    person = "struct<account_id:string,display_name:string,email:string>"
    schema = f"issue_id string, project_key string, summary string, content string, parent_id string, parent_key string, assignee {person}, reporter {person}, blocks array<string>, created_at timestamp, updated_at timestamp"
    data = [("1", "P", "s", "c", " 2 ", "P-2", ("a", "A", None), None, ["3", None, ""], None, None), (None, "P", None, None, None, None, None, None, None, None, None)]
    g = mapping.issues(spark.createDataFrame(data, schema), "site")
    assert rows(g.facts, "from_key", "rel_type", "to_key") == [
        ("WorkItem|site|1", "ASSIGNED_TO", "Person|jira-account|a"), ("WorkItem|site|1", "BELONGS_TO", "Project|site|P"), ("WorkItem|site|1", "BLOCKS", "WorkItem|site|3"), ("WorkItem|site|1", "PARENT_OF", "WorkItem|site|2"),
    ]
    nodes = mapping.with_uids(g).nodes
    assert rows(nodes.where("label = 'Person'"), "uid", "name") == [(str(uuid.uuid5(NAMESPACE, "Person|jira-account|a")), "A")]
    empty = mapping.issues(spark.createDataFrame([], schema), "site")
    assert empty.nodes.count() == 0 and empty.facts.count() == 0


def test_decisions_are_taken_once(spark):
    now = F.lit("2025-01-01").cast("timestamp")
    r = spark.createDataFrame([(1, "pending", "x", None, None), (2, "approved", "y", "me", None)], "id int, state string, identity string, decided_by string, decided_at timestamp")
    both = spark.createDataFrame([(1, "b"), (2, "b"), (9, "b")], "id int, decided_by string")
    once = state.approve(r, both, now)
    again, known = state.reject(once, both, r.select("identity").limit(0), now)
    assert rows(again, "id", "state", "decided_by") == [(1, "approved", "b"), (2, "approved", "me")] and known.count() == 0
    s = spark.createDataFrame([("auto_extend", "Yes")], "key string, value string")
    assert state.auto_extend(s).first()[0] and not state.auto_extend(s.limit(0)).first()[0]


def test_gates_in_their_order(spark):
    axioms = spark.createDataFrame([("A", "R", "B", True)], "subject_kind string, relation string, object_kind string, extractable boolean")
    told = [("A", "x", "R", "B", "y", "it is", "well IT  is", False), ("B", "y", "R", "A", "x", "it is", "it is", False), ("A", "x", "R", "A", "y", "it is", "it is", False), ("A", "x", "R", "B", "y", None, "it is", False), ("A", "x", "R", "B", "y", None, None, True)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(told)], "i int, subject_kind string, subject string, relation string, object_kind string, object string, evidence string, chunk_text string, skipped boolean")
    got = ontology.admit(df, axioms, spark.createDataFrame([], "term string"))
    assert rows(got, "i", "drop_reason", "swapped") == [(0, None, False), (1, None, True), (2, "relation_not_allowed", False), (3, "evidence_not_in_chunk", False), (4, "triage_skip", False)]


@pytest.mark.parametrize("name", ["functional", "is_transitive"])
def test_axioms_of_the_code(spark, name):
    assert ontology.relations(ontology.seed(spark), name).count() > 0
