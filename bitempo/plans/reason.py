"""Queries on admission, rules, support of pairs, decisions that are carried out, and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.functions import text
from bitempo.operators import facts as writes
from bitempo.operators import infer, ontology, resolve, windows
from bitempo.plans import base
from bitempo.plans.base import FACTS, LIVE, NODES, NOW, ts
from bitempo.session import table
from bitempo.sources import json_exports as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_SHAPES = "s AS (SELECT DISTINCT from_label AS subject_kind, rel_type AS relation, to_label AS object_kind FROM facts WHERE from_label IS NOT NULL AND to_label IS NOT NULL)"


def _axioms(spark: SparkSession, d: str) -> DataFrame:
    """One axiom for each shape of the facts; BLOCKS is not extractable, others are functional or transitive by name."""
    s = base.facts(spark, d).where("from_label is not null and to_label is not null").select(F.col("from_label").alias("subject_kind"), F.col("rel_type").alias("relation"), F.col("to_label").alias("object_kind")).distinct()
    r, none = F.col("relation"), F.lit(None).cast("string")
    return s.select(
        "*", (r != "BLOCKS").alias("extractable"), r.isin("ASSIGNED_TO", "BELONGS_TO", "REPORTED_BY").alias("functional"), (r == "PARENT_OF").alias("is_transitive"), F.lit(False).alias("is_symmetric"),
        F.when(r == "BLOCKS", "BLOCKED_BY").alias("inverse_of"), F.when(r == "ASSIGNED_TO", "INVOLVES").alias("sub_property_of"), F.when(r == "REPORTED_BY", "event").otherwise("state").alias("temporal"), none.alias("batch_id"),
    )


@query(f"""WITH {FACTS}, {_SHAPES} SELECT relation, relation IN ('ASSIGNED_TO', 'BELONGS_TO', 'REPORTED_BY') AS functional, relation = 'PARENT_OF' AS transitive, CASE relation WHEN 'BLOCKS' THEN 'BLOCKED_BY' ELSE '' END AS inverse, CASE relation WHEN 'REPORTED_BY' THEN 'event' ELSE 'state' END AS temporal FROM (SELECT DISTINCT relation FROM s)""")
def axiom_traits(spark: SparkSession, d: str) -> DataFrame:
    """What the axioms say of each relation."""
    a = _axioms(spark, d)
    trait = lambda name, to: ontology.relations(a, name).withColumn(to, F.lit(True))
    out = ontology.temporal(a).join(trait("functional", "functional"), "relation", "left").join(trait("is_transitive", "transitive"), "relation", "left").join(ontology.inverse_pairs(a), "relation", "left")
    return out.select("relation", F.coalesce("functional", F.lit(False)).alias("functional"), F.coalesce("transitive", F.lit(False)).alias("transitive"), F.coalesce("inverse_of", F.lit("")).alias("inverse"), "temporal")


@query(f"WITH {FACTS}, {_SHAPES} SELECT count(*) AS axioms FROM (SELECT * FROM s UNION SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{r}', '{o}')" for s, r, o, _, _ in ontology.STRUCTURAL) + ") t(subject_kind, relation, object_kind))")
def axioms_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Stored axioms with those of the code."""
    return ontology.load(_axioms(spark, d)).agg(F.count(F.lit(1)).alias("axioms"))


_SAID = f"""WITH {FACTS}, {_SHAPES}, x AS (SELECT fact_uid, ascii(substr(fact_uid, 1, 1)) % 5 AS k, ascii(substr(fact_uid, 2, 1)) % 7 AS j, from_label AS sk, from_uid AS a, rel_type AS r, to_label AS ok, to_uid AS b FROM facts WHERE from_uid IS NOT NULL AND to_uid IS NOT NULL AND from_label IS NOT NULL AND to_label IS NOT NULL),
y AS (SELECT fact_uid, k, j, r, CASE WHEN k = 1 THEN ok ELSE sk END AS sk, CASE WHEN k = 1 THEN sk ELSE ok END AS ok, CASE WHEN j = 3 THEN '' ELSE a END AS a, CASE WHEN j = 4 THEN a WHEN j = 5 THEN 'the service' ELSE b END AS b FROM x)
SELECT fact_uid, CASE WHEN k = 4 THEN 'triage_skip' WHEN j = 2 THEN 'evidence_not_in_chunk' WHEN j = 3 THEN 'unresolved_endpoint' WHEN j = 5 THEN 'generic_mention' WHEN j = 4 THEN 'self_reference'
WHEN r <> 'BLOCKS' AND (sk, r, ok) IN (SELECT * FROM s) THEN '' WHEN r <> 'BLOCKS' AND (ok, r, sk) IN (SELECT * FROM s) THEN '' ELSE 'relation_not_allowed' END AS reason,
coalesce(r <> 'BLOCKS' AND (sk, r, ok) NOT IN (SELECT * FROM s) AND (ok, r, sk) IN (SELECT * FROM s), false) AS swapped FROM y"""


@query(_SAID)
def admitted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts as a model might tell them, faults among them, and the first gate that each fails."""
    f = base.facts(spark, d).where("from_uid is not null and to_uid is not null and from_label is not null and to_label is not null")
    k, j = F.ascii(F.substring("fact_uid", 1, 1)) % 5, F.ascii(F.substring("fact_uid", 2, 1)) % 7
    told = f.select(
        "fact_uid", F.when(k == 1, F.col("to_label")).otherwise(F.col("from_label")).alias("subject_kind"), F.when(j == 3, "").otherwise(F.col("from_uid")).alias("subject"), F.col("rel_type").alias("relation"),
        F.when(k == 1, F.col("from_label")).otherwise(F.col("to_label")).alias("object_kind"), F.when(j == 4, F.col("from_uid")).when(j == 5, "the service").otherwise(F.col("to_uid")).alias("object"),
        F.when(j == 2, "never said").otherwise(F.upper("fact_uid")).alias("evidence"), F.concat(F.lit("it was  said: "), "fact_uid", F.lit(" there")).alias("chunk_text"), (k == 4).alias("skipped"),
    )
    stopped = spark.createDataFrame([("The Service",), (None,)], "term string")
    out = ontology.admit(told, _axioms(spark, d), stopped)
    return out.select("fact_uid", F.coalesce("drop_reason", F.lit("")).alias("reason"), "swapped")


@query(f"""WITH RECURSIVE {FACTS}, l AS (SELECT * FROM facts WHERE {LIVE} AND from_uid IS NOT NULL AND to_uid IS NOT NULL), e AS (SELECT from_uid AS a, to_uid AS b, valid_at AS s, max(confidence) AS c FROM l WHERE rel_type = 'PARENT_OF' AND from_uid <> to_uid GROUP BY ALL),
w AS (SELECT a, b, 1 AS depth FROM e UNION SELECT w.a, e.b, depth + 1 FROM w JOIN e ON w.b = e.a WHERE depth < 8 AND w.a <> e.b),
x AS (SELECT a AS f, 'PARENT_OF' AS r, b AS t, 'transitive' AS rule FROM w UNION SELECT to_uid, 'BLOCKED_BY', from_uid, 'inverse' FROM l WHERE rel_type = 'BLOCKS' AND from_uid <> to_uid UNION SELECT from_uid, 'INVOLVES', to_uid, 'sub_property' FROM l WHERE rel_type = 'ASSIGNED_TO')
SELECT r AS rel_type, min(rule) AS rule, count(*) AS n FROM x WHERE (f, r, t) NOT IN (SELECT from_uid, rel_type, to_uid FROM l) GROUP BY r""")
def materialized_rules(spark: SparkSession, d: str) -> DataFrame:
    """How much each rule concludes from the asserted facts."""
    made = infer.materialize(base.facts(spark, d), _axioms(spark, d), cap=20_000)
    return made.groupBy("rel_type").agg(F.min("rule").alias("rule"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FACTS}, l AS (SELECT * FROM facts WHERE {LIVE} AND from_uid IS NOT NULL AND to_uid IS NOT NULL), s AS (SELECT DISTINCT from_uid AS uid FROM l WHERE rel_type = 'BLOCKS'),
n1 AS (SELECT uid FROM s UNION SELECT to_uid FROM l WHERE from_uid IN (FROM s) UNION SELECT from_uid FROM l WHERE to_uid IN (FROM s)) SELECT fact_uid FROM l WHERE from_uid IN (FROM n1) AND to_uid IN (FROM n1)""")
def facts_around(spark: SparkSession, d: str) -> DataFrame:
    """Facts that rules about a few changed nodes can rest on."""
    f = infer.asserted(base.facts(spark, d))
    return infer.around(f, f.where("rel_type = 'BLOCKS'").select(F.col("from_uid").alias("uid")), 1).select("fact_uid")


@query(f"""WITH {FACTS}, {NODES}, l AS (SELECT * FROM facts WHERE {LIVE} AND from_uid IS NOT NULL AND to_uid IS NOT NULL AND rel_type IN ('BLOCKS', 'PARENT_OF')), t AS (SELECT DISTINCT from_uid AS x, to_uid AS c FROM l JOIN nodes a ON a.uid = from_uid JOIN nodes b ON b.uid = to_uid WHERE a.label = 'WorkItem' AND b.label = 'WorkItem')
SELECT p.x AS from_uid, q.x AS to_uid, count(*) AS shared FROM t p JOIN t q USING (c) WHERE p.x <> q.x AND (p.x, q.x) NOT IN (SELECT from_uid, to_uid FROM l WHERE rel_type = 'BLOCKS') GROUP BY ALL""")
def shared_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Work items that point to one work item: candidates for a review."""
    f = base.facts(spark, d).where("rel_type in ('BLOCKS', 'PARENT_OF')")
    return infer.shared_concept(f, base.nodes(spark, d), ("WorkItem",), "WorkItem", "WorkItem", "BLOCKS").select("from_uid", "to_uid", "shared")


_SUP = f"""WITH {FACTS}, {NODES}, l AS (SELECT * FROM facts WHERE {LIVE}), e AS (SELECT DISTINCT from_uid AS x, to_uid AS y FROM l WHERE from_uid IS NOT NULL AND to_uid IS NOT NULL UNION SELECT DISTINCT to_uid, from_uid FROM l WHERE from_uid IS NOT NULL AND to_uid IS NOT NULL),
p AS (SELECT DISTINCT p.to_uid AS a, q.to_uid AS b FROM facts p JOIN facts q ON p.from_uid = q.from_uid WHERE p.rel_type = 'BLOCKS' AND q.rel_type = 'PARENT_OF' AND p.to_uid IS NOT NULL AND q.to_uid IS NOT NULL),
m AS (SELECT DISTINCT uid, k FROM (SELECT from_uid AS uid, unnest(source_record_keys) AS k FROM facts UNION ALL SELECT to_uid, unnest(source_record_keys) FROM facts) WHERE uid IS NOT NULL AND k IS NOT NULL),
mid AS (SELECT DISTINCT p.a, p.b FROM p JOIN e u ON u.x = p.a JOIN e v ON v.x = p.b AND v.y = u.y), rec AS (SELECT DISTINCT p.a, p.b FROM p JOIN m u ON u.uid = p.a JOIN m v ON v.uid = p.b AND v.k = u.k),
s AS (SELECT p.a, p.b, CAST(CASE WHEN p.a = p.b OR (p.a, p.b) IN (SELECT x, y FROM e) THEN 1.0 WHEN (p.a, p.b) IN (FROM mid) THEN 0.8 WHEN substr(p.a, 1, 2) = substr(p.b, 2, 2) OR substr(p.b, 1, 2) = substr(p.a, 2, 2) THEN 0.7 WHEN (p.a, p.b) IN (FROM rec) THEN 0.5 ELSE 0.01 END AS DOUBLE) AS support FROM p)"""


def _supported(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    arm = lambda r, c: f.where(F.col("rel_type") == r).select("from_uid", F.col("to_uid").alias(c))
    pairs = arm("BLOCKS", "a").join(arm("PARENT_OF", "b"), "from_uid").where("a is not null and b is not null").select("a", "b").distinct()
    nodes = base.nodes(spark, d).select("uid", F.substring("uid", 1, 2).alias("name"), F.substring("uid", 2, 2).alias("text"))
    live = f.where("invalid_at is null and coalesce(assertion_status, 'live') <> 'corrected'")
    return resolve.pair_support(pairs, live, writes.mentions(f), nodes)


@query(f"{_SUP} SELECT a, b, support FROM s")
def pair_support(spark: SparkSession, d: str) -> DataFrame:
    """How well the ends of two facts of one subject are tied."""
    return _supported(spark, d)


@query(f"{_SUP} SELECT least(a, b) AS a, greatest(a, b) AS b, max(support) AS support FROM s WHERE support >= 0.6 AND a <> b AND (a, b) NOT IN (SELECT x, y FROM e) GROUP BY ALL")
def verified_links(spark: SparkSession, d: str) -> DataFrame:
    """Well supported pairs without a fact of their own."""
    f = base.facts(spark, d).where("from_uid is not null and to_uid is not null and invalid_at is null and coalesce(assertion_status, 'live') <> 'corrected'")
    return resolve.verified_links(_supported(spark, d), f)


@query(f"""WITH {FACTS}, m AS (SELECT to_uid AS absorbed, min(from_uid) AS survivor FROM facts WHERE rel_type = 'BLOCKS' AND from_uid < to_uid GROUP BY 1), x AS (SELECT DISTINCT uid, k FROM (SELECT from_uid AS uid, unnest(source_record_keys) AS k FROM facts UNION ALL SELECT to_uid, unnest(source_record_keys) FROM facts) WHERE uid IS NOT NULL AND k IS NOT NULL)
SELECT DISTINCT coalesce(survivor, uid) AS uid, k AS record_key FROM x LEFT JOIN m ON uid = absorbed""")
def absorbed_mentions(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    m = f.where("rel_type = 'BLOCKS' and from_uid < to_uid").select(F.col("to_uid").alias("absorbed"), F.col("from_uid").alias("survivor"))
    return resolve.absorb_mentions(writes.mentions(f), m)


_DO = "ascii(substr(fact_uid, 1, 1)) % 5"


@query(f"""WITH {FACTS}, x AS (SELECT *, {_DO} AS k, {LIVE} AS l, coalesce(TIMESTAMP '{NOW}' >= valid_at, true) AS fine FROM facts) SELECT fact_uid, coalesce(epoch_ms(CASE WHEN l AND k = 0 AND fine THEN TIMESTAMP '{NOW}' WHEN l AND k = 1 THEN valid_at ELSE invalid_at END), -1) AS ended_ms,
CASE WHEN l AND k = 1 THEN 'corrected' ELSE assertion_status END AS status, coalesce(len(source_record_keys), 0) + CASE WHEN l AND k = 2 THEN 1 ELSE 0 END AS records, k = 3 AS ended_unknown FROM x""")
def applied_actions(spark: SparkSession, d: str) -> DataFrame:
    """Decided actions carried out: facts closed, corrected, confirmed, or known to have ended."""
    f = base.facts(spark, d)
    k = F.expr(_DO.replace("substr", "substring"))
    word = F.when(k == 0, "close_old").when(k == 1, "correct_old").when(k == 2, "confirm_old").when(k == 3, "ended_unknown").otherwise("dispute")
    orders = f.select(F.col("fact_uid").alias("old"), word.alias("action"), ts(NOW).alias("new_from"), F.concat(F.lit("said:"), "fact_uid").alias("record_key"))
    out = resolve.apply_actions(f, orders, ts(NOW))
    return out.select("fact_uid", F.coalesce(F.unix_millis("invalid_at"), F.lit(-1)).alias("ended_ms"), F.col("assertion_status").alias("status"), F.coalesce(F.size("source_record_keys"), F.lit(0)).cast("long").alias("records"), "ended_unknown")


@query(f"WITH {FACTS} SELECT DISTINCT least(from_uid, to_uid) AS from_uid, greatest(from_uid, to_uid) AS to_uid FROM facts WHERE {_DO} = 4 AND from_uid <> to_uid")
def disputed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of things in dispute, found again among the live facts."""
    f = base.facts(spark, d)
    actions = f.select(F.when(F.expr(_DO.replace("substr", "substring")) == 4, "dispute").otherwise("confirm_old").alias("action"), F.col("from_uid").alias("old_uid"), F.col("to_uid").alias("new_uid"))
    made = resolve.disputes(actions).withColumn("rel_type", F.lit("DISPUTED_WITH")).withColumn("invalid_at", F.lit(None).cast("timestamp")).withColumn("assertion_status", F.lit("live"))
    return resolve.open_disputes(made).select(F.col("a").alias("from_uid"), F.col("b").alias("to_uid"))


@query(f"WITH {FACTS} SELECT from_uid, 'RELATES_TO' AS rel_type, to_uid, round(max(confidence), 6) AS confidence FROM facts WHERE confidence >= 0.8 AND from_uid IS NOT NULL AND to_uid IS NOT NULL GROUP BY ALL")
def approved_links(spark: SparkSession, d: str) -> DataFrame:
    """Approved link candidates as derived facts."""
    f = base.facts(spark, d)
    c = f.select("from_uid", "to_uid", F.lit("RELATES_TO").alias("relation"), F.lit("two_hop").alias("derived_rule"), "confidence", F.when(F.col("confidence") >= 0.8, "approved").otherwise("pending").alias("state"))
    return resolve.link_facts(c).select("from_uid", "rel_type", "to_uid", F.round("confidence", 6).alias("confidence"))


@query("""WITH k AS (SELECT DISTINCT c_mktsegment AS kind, c_name AS name, 'n' || c_nationkey AS ns, 'u' || c_custkey AS uid, c_custkey AS k FROM customer), m AS (SELECT DISTINCT 'r' || (k % 50) AS record_key, kind, name, 'n' || (k % 25) AS ns FROM k),
a AS (SELECT kind, name, ns, min(uid) AS uid FROM k GROUP BY ALL HAVING count(DISTINCT uid) = 1), b AS (SELECT kind, name, min(uid) AS uid FROM k GROUP BY ALL HAVING count(DISTINCT uid) = 1)
SELECT record_key, m.kind, m.name, coalesce(a.uid, b.uid) AS uid, CASE WHEN a.uid IS NOT NULL THEN 'namespace' WHEN b.uid IS NOT NULL THEN 'anywhere' END AS via FROM m LEFT JOIN a ON a.kind = m.kind AND a.name = m.name AND a.ns = m.ns LEFT JOIN b ON b.kind = m.kind AND b.name = m.name""")
def resolved_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Named things of records looked up in the record's namespace, then anywhere."""
    c = table(spark, d, "customer")
    known = c.select(F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("namespace"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("uid"))
    record = F.concat(F.lit("r"), (F.col("c_custkey") % 50).cast("string")).alias("record_key")
    said = c.select(record, F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"))
    primary = c.select(record, (F.col("c_custkey") % 25).alias("n")).distinct().select("record_key", F.lit("Record").alias("kind"), F.lit("own").alias("name"), F.col("record_key").alias("uid"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("namespace"))
    return ontology.endpoint(said, known, primary)


@query("""WITH p AS (SELECT repository_full_name AS repository, sha, message, authored_at AS t0 FROM (SELECT DISTINCT ON (repository_full_name, sha) * FROM github_commit WHERE repository_full_name IS NOT NULL ORDER BY repository_full_name, sha, ingested_at DESC NULLS LAST, coalesce(message, '') DESC)),
r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY t0 DESC NULLS LAST, sha DESC) AS n, count(*) OVER (PARTITION BY repository) > 20 AS more FROM p) SELECT repository, sha, more FROM r WHERE n <= 20 AND trim(coalesce(message, '')) <> ''""")
def newest_commits(spark: SparkSession, d: str) -> DataFrame:
    """The twenty newest commits of each repository, those with a message (a report of the top k)."""
    c = table(spark, d, "github_commit").where("repository_full_name is not null")
    one = c.groupBy("repository_full_name", "sha").agg(F.max_by(F.struct("message", "authored_at"), F.struct("ingested_at", F.coalesce("message", F.lit("")))).alias("s"))
    return sources.newest_commits(one.select(F.col("repository_full_name").alias("repository"), "sha", "s.message", F.col("s.authored_at").alias("at")), 20).select("repository", "sha", "more")


@query("""WITH f AS (SELECT DISTINCT commit_hash AS sha, f FROM (SELECT commit_hash, unnest(files) AS f FROM bitbucket_commit)), c AS (SELECT DISTINCT commit_hash AS sha FROM bitbucket_commit), n AS (SELECT sha, count(*) AS n, sum(f.lines_added) AS a FROM f GROUP BY 1) SELECT sha, coalesce(n, 0) AS files, coalesce(a, 0) AS added FROM c LEFT JOIN n USING (sha)""")
def diffstats_attached(spark: SparkSession, d: str) -> DataFrame:
    """Commits with the files that they change."""
    c = table(spark, d, "bitbucket_commit")
    changed = c.select(F.col("commit_hash").alias("sha"), F.explode("files").alias("f")).distinct().select("sha", "f.*")
    out = sources.with_diffstats(c.select(F.col("commit_hash").alias("sha")).distinct(), changed)
    return out.select("sha", F.size("files").cast("long").alias("files"), F.aggregate("files", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["lines_added"], F.lit(0))).alias("added"))


@query("""SELECT DISTINCT issue_key, regexp_replace(issue_type, '[^A-Za-z0-9_]', '', 'g') AS label, sha256(issue_key || CASE WHEN trim(coalesce(summary, '')) <> '' THEN ' — ' || summary ELSE '' END) AS hash, length(issue_key || ' ' || coalesce(status, '')) + 1 + least(length(coalesce(content, '')), 3500) AS n_chars, least(length(content), 4096) AS n_embedded
FROM jira_issue WHERE issue_key IS NOT NULL AND trim(issue_key) <> ''""")
def issue_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Issues as a reader and an embedding model get them."""
    i = table(spark, d, "jira_issue").where("issue_key is not null and trim(issue_key) <> ''")
    head = F.concat("issue_key", F.lit(" "), F.coalesce("status", F.lit("")))
    return i.select(
        "issue_key", text.identifier(F.col("issue_type")).alias("label"), text.embedding_hash(text.embedding_text(F.col("issue_key"), F.col("summary"))).alias("hash"),
        F.length(text.summary(head, F.col("content"), 3500)).cast("long").alias("n_chars"), F.length(text.write_time_content(F.col("content"))).cast("long").alias("n_embedded"),
    ).distinct()


@query()
def chunked_records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of files and documents; tested case by case."""
    f = table(spark, d, "bitbucket_file").select(F.concat_ws(":", F.lit("file"), F.col("file_id").cast("string")).alias("record_key"), "content", F.col("file_language").alias("language"))
    docs = table(spark, d, "documents").select(F.concat_ws(":", F.lit("doc"), F.col("doc_id").cast("string")).alias("record_key"), F.col("text").alias("content"), F.lit(None).cast("string").alias("language"))
    return windows.chunk_records(f.distinct().unionByName(docs))
