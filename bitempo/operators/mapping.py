"""Source records to the graph: nodes, dated facts and mentions of each kind of record.

Every function takes a table of records, one row each, and gives a ``Graph``.
Nodes and ends of facts carry a natural key (label and parts, parted by ``|``);
``with_uids`` hashes keys to stable ids, so that any run of any size names a
thing alike.  A record becomes one array of nodes and one of facts, which are
exploded where it lies: nothing is joined or moved.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.functions.ids import uuid5

NODE = "struct<key: string, label: string, name: string, text: string, url: string>"
FACT = "struct<from_key: string, from_label: string, rel_type: string, to_key: string, to_label: string, evidence: string>"


class Graph(NamedTuple):
    """``nodes(key, label, name, text, url, record_key)`` and ``facts(from_key, ..., valid_at, record_key)``."""

    nodes: DataFrame
    facts: DataFrame


def key(label: str, *parts: Column | str) -> Column:
    """The natural key of a node; null if a part is null or blank."""
    columns = [F.trim(F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts]
    known = F.lit(True)
    for c in columns:
        known = known & (F.coalesce(c, F.lit("")) != "")
    return F.when(known, F.concat_ws("|", F.lit(label), *columns))


def person(namespace: str, *identities: Column) -> Column:
    """A person by the first identity that is not blank, in lower case."""
    first = F.coalesce(*[F.when(F.trim(i) != "", F.lower(F.trim(i))) for i in identities])
    return key("Person", namespace, first)


def _node(of: Column, label: str, name: Column, text: Column | None = None, url: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(of.alias("key"), F.lit(label).alias("label"), name.cast("string").alias("name"), (none if text is None else text).alias("text"), (none if url is None else url).alias("url"))


def _fact(a: Column, a_label: str, relation: str, b: Column, b_label: str, evidence: Column | None = None) -> Column:
    return F.struct(a.alias("from_key"), F.lit(a_label).alias("from_label"), F.lit(relation).alias("rel_type"), b.alias("to_key"), F.lit(b_label).alias("to_label"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"))


def _graph(rows: DataFrame, record: Column, at: Column, nodes: list[Column], facts: list[Column], more: Column | None = None) -> Graph:
    """Nodes without a key and facts without both ends are left out; repeated rows fall together."""
    links = F.array(*facts) if more is None else F.concat(F.array(*facts), more)
    base = rows.select(record.alias("record_key"), at.cast("timestamp").alias("valid_at"), F.array(*nodes).cast(f"array<{NODE}>").alias("n"), links.cast(f"array<{FACT}>").alias("f"))
    made = base.select("record_key", F.explode("n").alias("n")).select("n.*", "record_key").where("key is not null").distinct()
    told = base.select("record_key", "valid_at", F.explode("f").alias("f")).select("f.*", "valid_at", "record_key").where("from_key is not null and to_key is not null").distinct()
    return Graph(made, told)


def issues(rows: DataFrame, site: str) -> Graph:
    """Issues as work items of a project, with assignee, reporter, parent and what they block.

    ``rows`` are those of an issue export, one state each.  A parent or a
    blocked issue need not be among them: its key is reserved as a stub.
    """
    me, project = key("WorkItem", site, F.col("issue_id")), key("Project", site, F.col("project_key"))
    parent = key("WorkItem", site, F.col("parent_id"))
    people = [(relation, role, key("Person", "jira-account", F.col(f"{role}.account_id"))) for relation, role in (("ASSIGNED_TO", "assignee"), ("REPORTED_BY", "reporter"))]
    nodes = [_node(me, "WorkItem", F.col("summary"), F.col("content")), _node(project, "Project", F.col("project_key")), _node(parent, "WorkItem", F.col("parent_key"))]
    nodes += [_node(p, "Person", F.col(f"{role}.display_name")) for _, role, p in people]
    facts = [_fact(me, "WorkItem", "BELONGS_TO", project, "Project"), _fact(me, "WorkItem", "PARENT_OF", parent, "WorkItem")]
    facts += [_fact(me, "WorkItem", relation, p, "Person") for relation, _, p in people]
    blocked = F.transform(F.coalesce("blocks", F.array().cast("array<string>")), lambda b: _fact(me, "WorkItem", "BLOCKS", key("WorkItem", site, b), "WorkItem"))
    return _graph(rows, key("jira", site, "issue", F.col("issue_id")), F.coalesce("updated_at", "created_at"), nodes, facts, blocked)


#: Relations of issues that have one target at a time.
SINGLE_VALUED = ("BELONGS_TO", "ASSIGNED_TO", "REPORTED_BY", "PARENT_OF")


def changelog(intervals: DataFrame, site: str, field: str, relation: str) -> DataFrame:
    """Closed periods of a field as history: ``(from_key, rel_type, to_key, valid_from, valid_to, record_key)``.

    ``intervals(item, value, start_at, end_at)`` come from ``changes.field_intervals``;
    open ones are left to the live facts, and blank values are none.
    """
    target = key("Person", "jira-account", F.col("value")) if field == "assignee" else key("Status", "jira-status", F.lower("value"))
    told = intervals.where("end_at is not null").select(
        key("WorkItem", site, F.col("item")).alias("from_key"), F.lit(relation).alias("rel_type"), target.alias("to_key"), F.col("start_at").alias("valid_from"), F.col("end_at").alias("valid_to"), key("jira", site, "issue", F.col("item")).alias("record_key")
    )
    return told.where("from_key is not null and to_key is not null").distinct()


def history_intervals(told: DataFrame) -> DataFrame:
    """History rows keyed by ends and period, so that writing them again changes nothing."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    uid = uuid5(F.concat_ws("|", F.lit("FactHistory"), "from_key", "rel_type", "to_key", day("valid_from"), day("valid_to")))
    return told.groupBy("from_key", "rel_type", "to_key", "valid_from", "valid_to").agg(F.array_sort(F.collect_set("record_key")).alias("source_record_keys")).withColumn("uid", uid)


def commits(rows: DataFrame, provider: str, present: DataFrame | None = None) -> Graph:
    """Commits of a repository with their author, and the present files that they modify.

    ``rows(repository, sha, message, author_name, author_email, at, url[, files])``;
    ``present(repository, path)`` are the files that exist.  The author is known
    by address, else by name.
    """
    me, repository = key("Commit", provider, F.col("repository"), F.col("sha")), key("Repository", provider, F.col("repository"))
    author = person(f"{provider}-author", F.col("author_email"), F.col("author_name"))
    record = key(provider, F.col("repository"), "commit", F.col("sha"))
    nodes = [_node(me, "Commit", F.split_part("message", F.lit("\n"), F.lit(1)), F.col("message"), F.col("url")), _node(repository, "Repository", F.col("repository")), _node(author, "Person", F.col("author_name"))]
    facts = [_fact(repository, "Repository", "CONTAINS", me, "Commit"), _fact(me, "Commit", "AUTHORED_BY", author, "Person")]
    out = _graph(rows, record, F.col("at"), nodes, facts)
    if present is None:
        return out
    touched = rows.select("repository", "sha", F.col("at").cast("timestamp").alias("valid_at"), F.explode("files").alias("f"))
    spots = touched.select("repository", "sha", "valid_at", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("f.path").alias("path")), F.struct(F.lit(1).alias("i"), F.col("f.old_path").alias("path")))).alias("p"), F.xxhash64("f").alias("change"), F.format_string("%s +%d/-%d", "f.status", "f.lines_added", "f.lines_removed").alias("evidence"))
    there = spots.select("repository", "sha", "valid_at", "change", "evidence", "p.i", "p.path").where("coalesce(path, '') <> ''").join(present.select("repository", "path").distinct(), ["repository", "path"], "left_semi")
    # The new path counts, the old one only where that is gone; each file once for a commit.
    one = there.groupBy("repository", "sha", "change").agg(F.min(F.struct("i", "path", "evidence", "valid_at")).alias("m"))
    one = one.groupBy("repository", "sha", F.col("m.path").alias("path")).agg(F.min("m.evidence").alias("evidence"), F.min("m.valid_at").alias("valid_at"))
    changed = one.select(me.alias("from_key"), F.lit("Commit").alias("from_label"), F.lit("MODIFIES").alias("rel_type"), key("SourceFile", provider, F.col("repository"), F.col("path")).alias("to_key"), F.lit("SourceFile").alias("to_label"), "evidence", "valid_at", record.alias("record_key"))
    return Graph(out.nodes, out.facts.unionByName(changed.where("from_key is not null")))


def files(rows: DataFrame, provider: str) -> Graph:
    """Files as nodes that their repository contains: ``rows(repository, path, content, at)``."""
    me, repository = key("SourceFile", provider, F.col("repository"), F.col("path")), key("Repository", provider, F.col("repository"))
    nodes = [_node(me, "SourceFile", F.col("path"), F.col("content")), _node(repository, "Repository", F.col("repository"))]
    return _graph(rows, key(provider, F.col("repository"), "file", F.col("path")), F.col("at"), nodes, [_fact(repository, "Repository", "CONTAINS", me, "SourceFile")])


def repositories(rows: DataFrame, provider: str) -> Graph:
    """Repositories alone: ``rows(repository, description, url)``."""
    me = key("Repository", provider, F.col("repository"))
    return _graph(rows, key(provider, F.col("repository"), "repository"), F.lit(None), [_node(me, "Repository", F.col("repository"), F.col("description"), F.col("url"))], [])


def pull_requests(rows: DataFrame, provider: str = "bitbucket") -> Graph:
    """Change requests with repository and author: ``rows(repository, id, title, description, author_name, author_uuid, updated_on, url)``.

    Their authors have no address, so they are known by name, else by account.
    """
    me, repository = key("PullRequest", provider, F.col("repository"), F.col("id")), key("Repository", provider, F.col("repository"))
    author = person(f"{provider}-author", F.col("author_name"), F.col("author_uuid"))
    name = F.concat(F.lit("PR #"), F.col("id").cast("string"), F.lit(" — "), F.coalesce("title", F.lit("")))
    nodes = [_node(me, "PullRequest", name, F.col("description"), F.col("url")), _node(repository, "Repository", F.col("repository")), _node(author, "Person", F.col("author_name"))]
    facts = [_fact(repository, "Repository", "CONTAINS", me, "PullRequest"), _fact(me, "PullRequest", "AUTHORED_BY", author, "Person")]
    return _graph(rows, key(provider, F.col("repository"), "pull_request", F.col("id")), F.col("updated_on"), nodes, facts)


def pages(rows: DataFrame, workspace: str) -> Graph:
    """Pages below their workspace and, if nested, below their page: ``rows(page_id, title, markdown, url, parent_id, edited_at)``."""
    me, root, parent = key("Document", workspace, F.col("page_id")), key("Workspace", F.lit(workspace)), key("Document", workspace, F.col("parent_id"))
    nodes = [_node(me, "Document", F.col("title"), F.col("markdown"), F.col("url")), _node(root, "Workspace", F.lit(workspace)), _node(parent, "Document", F.lit(None))]
    facts = [_fact(root, "Workspace", "CONTAINS", me, "Document"), _fact(parent, "Document", "PARENT_OF", me, "Document")]
    return _graph(rows, key("notion", workspace, "page", F.col("page_id")), F.col("edited_at"), nodes, facts)


def projects(rows: DataFrame, site: str) -> Graph:
    """Projects alone: ``rows(project_key, name, description)``."""
    me = key("Project", site, F.col("project_key"))
    return _graph(rows, key("jira", site, "project", F.col("project_key")), F.lit(None), [_node(me, "Project", F.col("name"), F.col("description"))], [])


def with_uids(graph: Graph) -> Graph:
    """The same rows for ``facts.upsert_nodes`` and ``facts.upsert``: keys hashed to ids.

    A stub, which has a key and no name, never hides what another record says of the node.
    """
    nodes = graph.nodes.groupBy("key", "label").agg(F.max("name").alias("name"), F.max("text").alias("search_text"), F.max("url").alias("url"))
    facts = graph.facts.groupBy("from_key", "from_label", "rel_type", "to_key", "to_label").agg(F.min("valid_at").alias("valid_at"), F.max("evidence").alias("evidence"), F.array_sort(F.collect_set("record_key")).alias("source_record_keys"))
    uid = lambda c: uuid5(F.col(c))
    return Graph(
        nodes.select(uid("key").alias("uid"), "label", "name", "search_text", "url"),
        facts.select(uid("from_key").alias("from_uid"), "from_label", "rel_type", uid("to_key").alias("to_uid"), "to_label", "valid_at", "evidence", "source_record_keys", F.lit("deterministic").alias("extraction_method"), F.lit(1.0).alias("confidence")),
    )


def mentions(graph: Graph) -> DataFrame:
    """``(key, record_key)``: the record tells of every node that it makes."""
    return graph.nodes.select("key", "record_key").distinct()
