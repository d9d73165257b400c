import json

import pytest
from pyspark.sql import functions as F

from bitempo import session
from bitempo.operators import export, history
from bitempo.operators.store import Conflict, Store
from bitempo.sources import json_exports as sources
from bitempo.streaming import incremental
from tests.rows import rows


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_issues(spark, tmp_path):
    adf = json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "one"}, {"type": "hardBreak"}, {"type": "text", "text": "two"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "three"}]}]})
    full = {
        "key": "DATA-1", "id": "7",
        "fields": {"summary": "S", "description": adf, "status": {"name": "Done"}, "issuetype": {"name": "Task"}, "project": {"key": "DATA", "name": "D"}, "assignee": {"accountId": "a", "displayName": "A B", "emailAddress": None}, "labels": ["x"],
                   "created": "2024-01-01T00:00:00.000+0000", "updated": "bad", "parent": {"id": "3", "key": "DATA-3"}, "comment": {"comments": [{"author": {"displayName": "C"}, "body": "hi"}]},
                   "issuelinks": [{"type": {"outward": "blocks"}, "outwardIssue": {"id": "9"}}, {"type": {"outward": "relates"}, "outwardIssue": {"id": "8"}}, {"type": {"outward": "Blocks"}, "outwardIssue": None}]},
        "changelog": {"histories": [{"created": "2024-02-01T00:00:00Z", "author": {"displayName": "Z"}, "items": [{"field": "Status", "fromString": "To Do", "toString": "Done"}, {"field": "labels", "toString": "x"}]}]},
    }
    df = sources.issues(spark, put(tmp_path / "issues.json", [full, {"key": "DATA-2", "fields": {}}, {"id": "5"}]))
    got = {r["issue_key"]: r for r in df.collect()}
    assert set(got) == {"DATA-1", "DATA-2"} and got["DATA-1"]["description"] == "one\ntwo\nthree" and got["DATA-1"]["blocks"] == ["9"] and got["DATA-1"]["updated_at"] is None
    assert "Assignee: A B" in got["DATA-1"]["content"] and "C: hi" in got["DATA-1"]["content"] and got["DATA-2"]["issue_id"] == "DATA-2"
    assert rows(sources.changes(df), "issue_id", "field", "to_string") == [("7", "status", "Done")]
    assert rows(sources.by_keys(df, spark.createDataFrame([(" data-1",)], "key string")), "issue_key") == [("DATA-1",)]


def test_code_hosts(spark, tmp_path):
    pulls = put(tmp_path / "pulls.json", {"values": [{"id": 4, "title": "T", "author": {"display_name": "N", "uuid": "u"}, "source": {"branch": {"name": "f"}}, "destination": {"branch": {"name": "main"}, "repository": {"full_name": "Own/Repo"}}, "created_on": "2024-01-01T00:00:00+00:00"}]})
    assert rows(sources.pull_requests(spark, pulls), "pr_ref", "source_branch", "destination_branch") == [("own/repo#4", "f", "main")]
    commits = put(tmp_path / "12.json", {"values": [{"hash": "h", "message": "m", "author": {"raw": "N M <n@x>"}}, {"hash": "i", "message": " "}, {"hash": "j"}]})
    assert rows(sources.commits_of_pull_requests(spark, commits), "pr_id", "commit_hash", "author_name", "author_email") == [(12, "h", "N M", "n@x")]
    stat = put(tmp_path / "stat.json", {"values": [{"status": "renamed", "old": {"path": "a"}, "new": {"path": "b"}}, {"status": "removed", "old": {"path": "c"}, "new": None}]})
    assert rows(sources.diffstat(spark, stat), "path", "status") == [("b", "renamed"), ("c", "removed")]
    pages = put(tmp_path / "pages.json", {"results": [{"id": "p", "url": "u", "parent": {"type": "page_id", "page_id": "q"}, "properties": {"Name": {"type": "title", "title": [{"plain_text": "A"}, {"plain_text": "B"}]}}}]})
    body = put(tmp_path / "p.json", {"id": "p", "markdown": "# text"})
    assert rows(sources.pages(spark, pages, body), "page_id", "title", "parent_id", "markdown") == [("p", "AB", "q", "# text")]


def test_rich_text_is_not_recursive():
    deep = {"type": "text", "text": "x"}
    for _ in range(5000):
        deep = {"type": "doc", "content": [deep]}
    assert sources.rich_text(deep) == "x" and sources.rich_text(None) == ""


def test_store_and_sync(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    assert store.read("history") is None
    schema = "entity_id string, attribute string, at_ms long, rank long, value string, value_hash long, ends_ms long"
    feed = tmp_path / "feed"
    for i, part in enumerate([[("a", "s", 1, 1, "x", 1, None), ("b", "s", 1, 1, "x", 1, None)], [("a", "s", 5, 2, "y", 2, None)], [("a", "s", 3, 3, "z", 3, None)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(feed / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(feed))
    incremental.sync_history(stream, store, str(tmp_path / "check")).awaitTermination()
    want = history.versions(spark.read.option("recursiveFileLookup", True).schema(schema).parquet(str(feed)))
    columns = ("entity_id", "value", "valid_from_ms", "valid_to_ms")
    assert rows(history.held(store.read("history")), *columns) == rows(want, *columns) == [("a", "x", 1, 3), ("a", "y", 5, -1), ("a", "z", 3, 5), ("b", "x", 1, -1)]
    store.write({"other": spark.range(3)})
    assert store.read("other").count() == 3 and store.read("history").count() == 4 and store.read("history_log").count() == 4
    # A writer that starts from an old commit loses nothing: it gets an error, and readers the tables of before.
    late = Store(spark, store.root)
    late._last = lambda: 1
    with pytest.raises(Conflict):
        late.write({"other": spark.range(9)})
    assert store.read("other").count() == 3 and store.read("history", 1).count() == 2


def test_streamed_records(spark, tmp_path):
    feed = tmp_path / "feed"
    schema = "record_key string, content_hash string, at timestamp"
    for i, h in enumerate(["1", "1", "2", "1"]):
        spark.createDataFrame([("a", h, None)], schema).coalesce(1).write.parquet(str(feed / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(feed))
    seen = []
    incremental.record_actions(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(x[1] for x in seen) == ["insert", "keep", "update", "update"] and {x[3] for x in seen if x[1] == "update"} == {200, 201}


def test_exports(spark):
    nodes = spark.createDataFrame([("u 1", "Term", 'say "hi"\n'), ("v", "Term", None)], "uid string, label string, name string")
    facts = spark.createDataFrame([("u 1", "PARENT_OF", "v", None, "live"), ("v", "BLOCKS", "u 1", None, "corrected")], "from_uid string, rel_type string, to_uid string, invalid_at timestamp, assertion_status string")
    lines = [r[0] for r in export.skos(nodes, facts).collect()]
    assert len(lines) == 3 and '"say \\"hi\\"\\n"' in lines[0] and "<urn:bitempo:u+1> skos:broader <urn:bitempo:v> ." in lines
    quads = export.nquads(nodes, facts)
    assert quads.count() == 5 and rows(export.checksum(quads), "checksum") == rows(export.checksum(quads.repartition(3)), "checksum")


def test_shared_folder(spark):
    folder = session.checkpoint_dir(spark)
    assert folder and session.checkpoint_dir(spark) == folder
    c = session.Cut(spark.range(5))
    assert c.df.count() == 5 and c.path.startswith(folder)
    c.drop()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Cluster)
    assert session.small(spark.range(10), 10) and not session.small(spark.range(11), 10)
    assert session.broadcast_if_small(spark.range(3)).count() == 3


def test_entry_without_the_subpackage(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith("bitempo.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {"p1_found", "p2_found", "live_facts"} <= names and not any(n.startswith(("p3", "p4", "p5", "p6", "p7", "p8", "p9")) for n in names)
    assert set(entry.oracle_sql()) <= names
    sys.modules.pop("__spark_entry__", None)


def test_smoke(spark, small_dir):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["entity_id", "attribute", "valid_from_ms", "valid_to_ms"] and df.where(F.col("valid_to_ms") == -1).count() > 0


@pytest.mark.parametrize("bad", ["", "x"])
def test_unreadable_rich_text_stays(bad):
    assert sources._plain("{" + bad) == "{" + bad
