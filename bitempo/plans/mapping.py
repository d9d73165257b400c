"""Queries that turn the tables of records into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.operators import changes, mapping
from bitempo.plans import base
from bitempo.plans.base import ISSUES
from bitempo.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SITE = "site"


def query(sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _k(label: str, *parts: str) -> str:
    """SQL of a natural key, null where a part is null or blank."""
    cols = [f"trim(CAST({p} AS VARCHAR))" for p in parts]
    return "CASE WHEN " + " AND ".join(f"coalesce({c}, '') <> ''" for c in cols) + f" THEN '{label}|' || " + " || '|' || ".join(cols) + " END"


def _rows(graph: mapping.Graph) -> DataFrame:
    return graph.facts.select("from_key", "rel_type", "to_key", F.unix_millis("valid_at").alias("valid_ms"), "record_key")


_ME = _k("WorkItem", "'site'", "issue_id")
_FROM_ISSUES = f"""WITH {ISSUES}, i AS (SELECT *, coalesce(updated_at, created_at) AS t0, {_ME} AS me, {_k("jira", "'site'", "'issue'", "issue_id")} AS record_key FROM issues),
b AS (SELECT DISTINCT ON (issue_id) issue_id, blocks FROM jira_issue WHERE issue_id IS NOT NULL ORDER BY issue_id, updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, md5(CAST(blocks AS VARCHAR)) DESC),
f AS (SELECT me, 'BELONGS_TO' AS r, {_k("Project", "'site'", "project_key")} AS t, t0, record_key FROM i
UNION ALL SELECT me, 'PARENT_OF', {_k("WorkItem", "'site'", "parent_id")}, t0, record_key FROM i
UNION ALL SELECT me, 'ASSIGNED_TO', {_k("Person", "'jira-account'", "assignee.account_id")}, t0, record_key FROM i
UNION ALL SELECT me, 'REPORTED_BY', {_k("Person", "'jira-account'", "reporter.account_id")}, t0, record_key FROM i)
SELECT DISTINCT me AS from_key, r AS rel_type, t AS to_key, epoch_ms(t0) AS valid_ms, record_key FROM f WHERE me IS NOT NULL AND t IS NOT NULL"""


def _issue_states(spark: SparkSession, d: str) -> DataFrame:
    """One state an issue, all columns."""
    j = table(spark, d, "jira_issue").where("issue_id is not null")
    rest = [c for c in j.columns if c != "issue_id"]
    return j.groupBy("issue_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "ingested_at")).alias("s")).select("issue_id", "s.*")


@query(_FROM_ISSUES)
def graph_from_issues(spark: SparkSession, d: str) -> DataFrame:
    """Facts of issues with one target; what they block is in ``graph_of_blocks``."""
    return _rows(mapping.issues(_issue_states(spark, d), SITE)).where("rel_type <> 'BLOCKS'")


@query(f"""SELECT DISTINCT {_ME} AS from_key, {_k("WorkItem", "'site'", "b")} AS to_key FROM (SELECT issue_id, unnest(blocks) AS b FROM jira_issue) WHERE from_key IS NOT NULL AND to_key IS NOT NULL""")
def graph_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What any state of an issue blocks."""
    return mapping.issues(table(spark, d, "jira_issue"), SITE).facts.where("rel_type = 'BLOCKS'").select("from_key", "to_key").distinct()


def _commits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "bitbucket_commit").select(F.col("repository_full_name").alias("repository"), F.col("commit_hash").alias("sha"), "message", "author_name", "author_email", F.col("commit_date").alias("at"), F.col("html_url").alias("url"), "files")
    present = table(spark, d, "bitbucket_file").select(F.col("repository_full_name").alias("repository"), "path")
    return c, present


_WHO = "coalesce(CASE WHEN trim(author_email) <> '' THEN lower(trim(author_email)) END, CASE WHEN trim(author_name) <> '' THEN lower(trim(author_name)) END)"


def _sql_commits(provider: str, name: str, sha: str, at: str) -> str:
    repo, me = _k("Repository", f"'{provider}'", "repository_full_name"), _k("Commit", f"'{provider}'", "repository_full_name", sha)
    record = _k(provider, "repository_full_name", "'commit'", sha)
    return f"""SELECT DISTINCT {repo} AS from_key, 'CONTAINS' AS rel_type, {me} AS to_key, epoch_ms({at}) AS valid_ms, {record} AS record_key FROM {name} WHERE from_key IS NOT NULL AND to_key IS NOT NULL
UNION ALL SELECT DISTINCT {me} AS from_key, 'AUTHORED_BY', {_k("Person", f"'{provider}-author'", _WHO)} AS to_key, epoch_ms({at}), {record} FROM {name} WHERE from_key IS NOT NULL AND to_key IS NOT NULL"""


@query(_sql_commits("bitbucket", "bitbucket_commit", "commit_hash", "commit_date") + " UNION ALL " + _sql_commits("github", "github_commit", "sha", "authored_at"))
def graph_from_commits(spark: SparkSession, d: str) -> DataFrame:
    """Repositories and authors of the commits of both code hosts."""
    c, _ = _commits(spark, d)
    g = table(spark, d, "github_commit").select(F.col("repository_full_name").alias("repository"), "sha", "message", "author_name", "author_email", F.col("authored_at").alias("at"), F.col("html_url").alias("url"))
    return _rows(mapping.commits(c, "bitbucket")).unionByName(_rows(mapping.commits(g, "github")))


_C = _k("Commit", "'bitbucket'", "repository_full_name", "commit_hash")


@query(f"""WITH c AS (SELECT DISTINCT repository_full_name, commit_hash, f FROM (SELECT repository_full_name, commit_hash, unnest(files) AS f FROM bitbucket_commit)),
p AS (SELECT repository_full_name, path FROM bitbucket_file UNION SELECT repository_full_name, f.path FROM c WHERE f.status = 'added'), x AS (SELECT c.*, a.path AS np, b.path AS op FROM c LEFT JOIN p a ON c.repository_full_name = a.repository_full_name AND c.f.path = a.path AND a.path <> ''
LEFT JOIN p b ON c.repository_full_name = b.repository_full_name AND c.f.old_path = b.path AND b.path <> '')
SELECT DISTINCT {_C} AS from_key, {_k("SourceFile", "'bitbucket'", "repository_full_name", "coalesce(np, op)")} AS to_key FROM x WHERE coalesce(np, op) IS NOT NULL AND {_C} IS NOT NULL""")
def graph_of_changes(spark: SparkSession, d: str) -> DataFrame:
    """Which files commits modify, by their new path or else their old one, of those that are there or were added once."""
    c, present = _commits(spark, d)
    added = c.select("repository", F.explode("files").alias("f")).where("f.status = 'added'").select("repository", "f.path")
    present = present.unionByName(added)
    return mapping.commits(c, "bitbucket", present).facts.where("rel_type = 'MODIFIES'").select("from_key", "to_key").distinct()


@query(f"""SELECT DISTINCT {_k("Repository", "'bitbucket'", "repository_full_name")} AS from_key, 'CONTAINS' AS rel_type, {_k("SourceFile", "'bitbucket'", "repository_full_name", "path")} AS to_key,
epoch_ms(ingested_at) AS valid_ms, {_k("bitbucket", "repository_full_name", "'file'", "path")} AS record_key FROM bitbucket_file WHERE from_key IS NOT NULL AND to_key IS NOT NULL""")
def graph_from_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "bitbucket_file").select(F.col("repository_full_name").alias("repository"), "path", "content", F.col("ingested_at").alias("at"))
    return _rows(mapping.files(f, "bitbucket"))


_P = _k("PullRequest", "'bitbucket'", "repository_full_name", "id")
_PR = _k("bitbucket", "repository_full_name", "'pull_request'", "id")
_PWHO = "coalesce(CASE WHEN trim(author_name) <> '' THEN lower(trim(author_name)) END, CASE WHEN trim(author_uuid) <> '' THEN lower(trim(author_uuid)) END)"


@query(f"""SELECT DISTINCT {_k("Repository", "'bitbucket'", "repository_full_name")} AS from_key, 'CONTAINS' AS rel_type, {_P} AS to_key, epoch_ms(updated_on) AS valid_ms, {_PR} AS record_key FROM bitbucket_pull_request WHERE from_key IS NOT NULL AND to_key IS NOT NULL
UNION ALL SELECT DISTINCT {_P} AS from_key, 'AUTHORED_BY', {_k("Person", "'bitbucket-author'", _PWHO)} AS to_key, epoch_ms(updated_on), {_PR} FROM bitbucket_pull_request WHERE from_key IS NOT NULL AND to_key IS NOT NULL""")
def graph_from_requests(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "bitbucket_pull_request").withColumnsRenamed({"repository_full_name": "repository", "html_url": "url"})
    return _rows(mapping.pull_requests(p))


@query(f"""WITH p AS (SELECT DISTINCT doc_id, namespace_uid, created_at FROM documents WHERE entity_type IS NOT NULL)
SELECT DISTINCT 'Workspace|ws' AS from_key, 'CONTAINS' AS rel_type, {_k("Document", "'ws'", "doc_id")} AS to_key, epoch_ms(created_at) AS valid_ms, {_k("notion", "'ws'", "'page'", "doc_id")} AS record_key FROM p
UNION ALL SELECT DISTINCT {_k("Document", "'ws'", "namespace_uid")} AS from_key, 'PARENT_OF', {_k("Document", "'ws'", "doc_id")}, epoch_ms(created_at), {_k("notion", "'ws'", "'page'", "doc_id")} FROM p WHERE from_key IS NOT NULL""")
def graph_from_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages, nested below the page of their namespace."""
    p = table(spark, d, "documents").where("entity_type is not null").select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("markdown"), F.lit(None).cast("string").alias("url"), F.col("namespace_uid").alias("parent_id"), F.col("created_at").alias("edited_at"))
    return _rows(mapping.pages(p, "ws"))


@query(f"""WITH {ISSUES}, k AS (SELECT {_k("Project", "'site'", "project_key")} AS key, 'Project' AS label FROM issues UNION SELECT {_ME}, 'WorkItem' FROM issues UNION SELECT {_k("WorkItem", "'site'", "parent_id")}, 'WorkItem' FROM issues
UNION SELECT {_k("Person", "'jira-account'", "assignee.account_id")}, 'Person' FROM issues UNION SELECT {_k("Person", "'jira-account'", "reporter.account_id")}, 'Person' FROM issues)
SELECT label, count(*) AS nodes, count(DISTINCT key) AS uids FROM k WHERE key IS NOT NULL GROUP BY label""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes issues make, with as many ids."""
    made = mapping.with_uids(mapping.issues(_issue_states(spark, d), SITE)).nodes
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("uid").alias("uids"))


_HIST = f"""WITH c AS (SELECT DISTINCT ON (change_id) change_id, issue_id, lower(trim(field)) AS field, from_string, to_string, try_cast(changed_at AS TIMESTAMP) AS t0 FROM jira_change
WHERE change_id IS NOT NULL AND issue_id IS NOT NULL AND regexp_matches(changed_at, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}$') ORDER BY change_id, ingested_at DESC NULLS LAST, t0 DESC NULLS LAST, to_string DESC NULLS LAST, from_string DESC NULLS LAST),
s AS (SELECT * FROM c WHERE field = 'status' AND t0 IS NOT NULL), n AS (SELECT issue_id, to_string AS v, t0, lead(t0) OVER (PARTITION BY issue_id ORDER BY t0, change_id) AS e FROM s)
SELECT DISTINCT {_ME} AS from_key, {_k("Status", "'jira-status'", "lower(v)")} AS to_key, epoch_ms(t0) AS from_ms, epoch_ms(e) AS to_ms FROM n WHERE e IS NOT NULL AND from_key IS NOT NULL AND to_key IS NOT NULL"""


@query(_HIST)
def changelog_history(spark: SparkSession, d: str) -> DataFrame:
    """Closed periods of the status of issues, as history rows (changes with a plain time)."""
    c = table(spark, d, "jira_change").where("change_id is not null and issue_id is not null").where(F.col("changed_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"))
    c = c.withColumn("at", F.col("changed_at").try_cast("timestamp"))
    last = F.max_by(F.struct("issue_id", "field", "at", "from_string", "to_string"), F.struct("ingested_at", "at", "to_string", "from_string")).alias("s")
    one = c.groupBy("change_id").agg(last).select("change_id", "s.*").where(F.lower(F.trim("field")) == "status").where("at is not null")
    moved = one.select(F.col("issue_id").alias("item"), "at", F.col("change_id").alias("seq"), F.col("from_string").alias("from_value"), F.col("to_string").alias("to_value"))
    spans = changes.value_spans(moved)
    told = mapping.history_intervals(mapping.changelog(spans, SITE, "status", "HAS_STATUS"))
    return told.select("from_key", "to_key", F.unix_millis("valid_from").alias("from_ms"), F.unix_millis("valid_to").alias("to_ms"))
