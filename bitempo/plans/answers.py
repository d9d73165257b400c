"""Queries on what answers rest on, on records that change, and on evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.functions import text
from bitempo.operators import answers, graph, reports
from bitempo.operators import facts as writes
from bitempo.plans import base
from bitempo.plans.base import AT, FACTS, LIVE, NODES, NOW, ts
from bitempo.session import table

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


def _live(spark: SparkSession, d: str) -> DataFrame:
    return base.facts(spark, d).where("invalid_at is null and coalesce(assertion_status, 'live') <> 'corrected'")


_SEEN = "r AS (SELECT DISTINCT k FROM (SELECT unnest(source_record_keys) AS k FROM facts) WHERE k LIKE 'jira:%')"
_BOTH = f"""WITH {FACTS}, {NODES}, {_SEEN}, u AS (SELECT uid FROM nodes WHERE label = 'WorkItem'), l AS (SELECT *, unnest(source_record_keys) AS k FROM facts WHERE {LIVE}),
b AS (SELECT from_uid AS uid, fact_uid, 'out' AS direction, rel_type, to_uid AS other, k, valid_at, invalid_at FROM l UNION ALL SELECT to_uid, fact_uid, 'in', rel_type, from_uid, k, valid_at, invalid_at FROM l)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return base.facts(spark, d).select(F.explode("source_record_keys").alias("record_key")).where(F.col("record_key").startswith("jira:")).distinct()


def _items(spark: SparkSession, d: str) -> DataFrame:
    return base.nodes(spark, d).where("label = 'WorkItem'").select("uid")


@query(f"{_BOTH} SELECT uid, fact_uid, direction, rel_type, other, count(DISTINCT k) AS records FROM b WHERE uid IN (FROM u) AND k IN (FROM r) GROUP BY ALL")
def entity_facts(spark: SparkSession, d: str) -> DataFrame:
    """Live facts of work items, both ways, that a visible record backs."""
    out = answers.entity_facts(_live(spark, d), _items(spark, d), _records(spark, d))
    return out.withColumn("records", F.size("records").cast("long"))


@query(f"{_BOTH} SELECT uid, count(DISTINCT fact_uid) AS facts, count(DISTINCT k) AS records FROM b WHERE uid IN (FROM u) AND k IN (FROM r) AND (valid_at IS NOT NULL OR invalid_at IS NOT NULL) AND coalesce(valid_at <= TIMESTAMP '{AT}', true) AND coalesce(invalid_at > TIMESTAMP '{AT}', true) GROUP BY uid")
def entity_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What backed work items at an instant."""
    out = answers.entity_evidence(_live(spark, d), _items(spark, d), _records(spark, d), ts(AT))
    return out.select("uid", F.size("fact_uids").cast("long").alias("facts"), F.size("record_keys").cast("long").alias("records"))


@query(f"""WITH {FACTS}, {NODES}, l AS (SELECT *, CASE ascii(substr(fact_uid, 1, 1)) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS t FROM facts WHERE {LIVE} AND rel_type = 'PARENT_OF'), e AS (SELECT from_uid AS uid, t FROM l UNION ALL SELECT to_uid, t FROM l)
SELECT uid, CASE max(t) WHEN 3 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 1 THEN 'derived' ELSE 'unknown' END AS tier FROM e WHERE uid IN (SELECT uid FROM nodes WHERE label = 'WorkItem') GROUP BY uid""")
def expansion_tiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.ascii(F.substring("fact_uid", 1, 1)) % 4
    f = _live(spark, d).withColumn("extraction_method", F.when(k == 0, "derived").when(k == 1, "llm").when(k == 2, "deterministic").otherwise("guess"))
    return answers.expansion_tier(f, _items(spark, d), "PARENT_OF")


@query(f"WITH {FACTS}, x AS (SELECT from_uid AS uid, unnest(source_record_keys) AS k FROM facts UNION SELECT to_uid, unnest(source_record_keys) FROM facts) SELECT uid, count(DISTINCT k) AS records FROM x WHERE uid IS NOT NULL AND k LIKE 'jira:%' GROUP BY uid")
def node_records(spark: SparkSession, d: str) -> DataFrame:
    m = writes.mentions(base.facts(spark, d))
    return answers.record_keys(m, m, _records(spark, d)).select("uid", F.size("record_keys").cast("long").alias("records"))


@query(f"WITH {FACTS} SELECT from_uid AS uid, count(DISTINCT to_uid) AS targets FROM facts WHERE {LIVE} AND rel_type IN ('BLOCKS', 'PARENT_OF') AND from_uid IS NOT NULL AND to_uid IS NOT NULL GROUP BY 1")
def outgoing_targets(spark: SparkSession, d: str) -> DataFrame:
    return answers.outgoing_targets(_live(spark, d), ("BLOCKS", "PARENT_OF")).select("uid", F.size("targets").cast("long").alias("targets"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS q, p_name AS name, 'p' || p_partkey AS record_key FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity < 3), s AS (SELECT DISTINCT q, string_split(name, ' ')[1] AS used FROM a)
SELECT DISTINCT a.q, record_key FROM a JOIN s USING (q) WHERE lower(trim(name)) = lower(trim(used)) OR starts_with(lower(trim(name)), lower(trim(used)) || ' ') OR starts_with(lower(trim(name)), lower(trim(used)) || '-')""")
def used_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose name begins with a word that was used."""
    x = table(spark, d, "lineitem").where("l_quantity < 3").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a = x.select(F.col("l_suppkey").alias("q"), F.col("p_name").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("record_key")).distinct()
    return answers.used_records(a.select("q", F.split("name", " ")[0].alias("used")).distinct(), a)


@query("""WITH t AS (SELECT DISTINCT issue_key AS anchor, 'i' || issue_id AS uid FROM jira_issue WHERE issue_key IS NOT NULL AND issue_id IS NOT NULL), c AS (SELECT DISTINCT sha AS record_key, unnest(regexp_extract_all(message, '\\b([A-Z][A-Z0-9]{1,11}-[0-9]+)\\b', 1)) AS anchor FROM github_commit)
SELECT DISTINCT record_key, uid FROM c JOIN t USING (anchor)""")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Commits that name issues which came later."""
    t = table(spark, d, "jira_issue").where("issue_key is not null and issue_id is not null").select(F.col("issue_key").alias("anchor"), F.concat(F.lit("i"), "issue_id").alias("uid"), F.lit("jira").alias("provider"))
    c = table(spark, d, "github_commit").select(F.col("sha").alias("record_key"), F.lit("github").alias("provider"), text.issue_keys(F.col("message")).alias("anchors"))
    return answers.backlinks(t, c)


_NEWT = f"WITH {FACTS}, k AS (SELECT DISTINCT ON (from_uid, to_uid) * FROM facts WHERE rel_type = 'ASSIGNED_TO' AND from_uid IS NOT NULL AND to_uid IS NOT NULL ORDER BY from_uid, to_uid, fact_uid), n AS (SELECT from_uid, min(to_uid) AS t FROM k GROUP BY 1)"


@query(f"{_NEWT} SELECT fact_uid, coalesce(epoch_ms(CASE WHEN k.to_uid = n.t THEN NULL WHEN invalid_at IS NULL THEN TIMESTAMP '{NOW}' ELSE invalid_at END), -1) AS ended_ms, coalesce(k.to_uid <> n.t AND invalid_at IS NULL, false) AS archived FROM k JOIN n USING (from_uid)")
def single_valued(spark: SparkSession, d: str) -> DataFrame:
    """Each subject assigned anew to one of those it had: the others end and are archived."""
    f = base.facts(spark, d).where("rel_type = 'ASSIGNED_TO' and from_uid is not null and to_uid is not null")
    rest = [c for c in f.columns if c not in writes.KEY]
    old = f.groupBy(*writes.KEY).agg(F.min_by(F.struct(*rest), "fact_uid").alias("s")).select(*writes.KEY, "s.*")
    new = old.groupBy("from_uid", "rel_type").agg(F.min("to_uid").alias("to_uid")).withColumn("source_record_keys", F.array(F.lit("new")))
    out, history = answers.write_single_valued(old, new, "ASSIGNED_TO", ts(NOW))
    return out.join(history.select("fact_uid", F.lit(True).alias("h")), "fact_uid", "left").select("fact_uid", F.coalesce(F.unix_millis("invalid_at"), F.lit(-1)).alias("ended_ms"), F.coalesce("h", F.lit(False)).alias("archived"))


_GONE = f"""WITH {FACTS}, {NODES}, g AS (SELECT uid, 'rec:' || uid AS k FROM nodes WHERE label = 'WorkItem' AND substr(uid, 1, 1) < '4'), m AS (SELECT DISTINCT uid, k FROM (SELECT from_uid AS uid, unnest(source_record_keys) AS k FROM facts UNION ALL SELECT to_uid, unnest(source_record_keys) FROM facts) WHERE uid IS NOT NULL AND k IS NOT NULL)
SELECT label, count(*) AS nodes FROM nodes WHERE uid NOT IN (SELECT uid FROM g) AND NOT (label = 'Person' AND uid NOT IN (SELECT uid FROM m)) GROUP BY 1"""


@query(_GONE)
def deleted_with_records(spark: SparkSession, d: str) -> DataFrame:
    """Nodes left when records go with their own nodes, and people whom nothing mentions."""
    f, n = base.facts(spark, d), base.nodes(spark, d)
    gone = n.where("label = 'WorkItem' and substring(uid, 1, 1) < '4'").select(F.concat(F.lit("rec:"), "uid").alias("record_key"), F.col("uid").alias("primary_uid"))
    nodes, _, _ = answers.delete_records(n, f, writes.mentions(f), gone, ts(NOW), ("Person",))
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""WITH {FACTS}, f AS (SELECT * FROM facts WHERE {LIVE}), a AS (SELECT DISTINCT from_uid AS n0, to_uid AS n1 FROM f WHERE rel_type = 'BLOCKS' AND to_uid IS NOT NULL), b AS (SELECT DISTINCT from_uid AS n1, to_uid AS n2 FROM f WHERE rel_type = 'BELONGS_TO' AND to_uid IS NOT NULL),
c AS (SELECT 'two' AS pattern, n0 AS start FROM a JOIN b USING (n1) UNION SELECT 'one', n0 FROM a) SELECT pattern, start FROM c WHERE start IS NOT NULL""")
def sampled_chains(spark: SparkSession, d: str) -> DataFrame:
    """One chain of each pattern from each start node."""
    f = _live(spark, d)
    return answers.sample_chains({"one": graph.path(f, ["BLOCKS"]), "two": graph.path(f, ["BLOCKS", "BELONGS_TO"])}).select("pattern", "start")


@query("SELECT l_orderkey AS q FROM (SELECT l_orderkey, max(p_name) AS m, list(DISTINCT p_name) AS ns FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE l_orderkey % 2 = 1")
def leak_free_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of which every other one names a thing of its chain."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("q"), F.col("p_name").alias("name"))
    asked = x.groupBy("q").agg(F.max("name").alias("m")).select("q", F.when(F.col("q") % 2 == 0, F.concat(F.lit("what about the "), F.upper("m"), F.lit("?"))).otherwise("what about it?").alias("question"))
    none = F.lit(None).cast("string")
    return answers.leak_free(asked, x.select("q", "name", none.alias("issue_key"), none.alias("path"), none.alias("sha"), none.alias("pr_ref"))).select("q")


@query("""WITH r AS (SELECT l_linestatus = 'O' AS scored, l_quantity > 10 AS c, l_quantity > 25 AS f, 1 / l_linenumber AS rr, l_discount AS cov, CASE WHEN l_returnflag = 'N' THEN l_tax > 0.04 END AS ev, CAST(l_partkey AS BIGINT) AS tokens, l_suppkey + 0.5 AS ms FROM lineitem)
SELECT count(*) AS cases, count(*) FILTER (WHERE scored) AS scored, round(avg(CAST(c AS INT)) FILTER (WHERE scored), 6) AS candidate_recall, round(avg(CAST(f AS INT)) FILTER (WHERE scored), 6) AS final_recall, round(avg(rr) FILTER (WHERE scored), 6) AS mrr, round(avg(CAST(cov AS DOUBLE)), 6) AS coverage, round(avg(CAST(ev AS INT)), 6) AS evidence_recall,
CAST(median(tokens) AS DOUBLE) AS median_tokens, CAST(quantile_disc(tokens, 0.9) AS DOUBLE) AS p90_tokens, CAST(median(ms) AS DOUBLE) AS median_ms, CAST(quantile_disc(ms, 0.9) AS DOUBLE) AS p90_ms FROM r""")
def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    r = table(spark, d, "lineitem").select(
        (c("l_linestatus") == "O").alias("scored"), (c("l_quantity") > 10).alias("in_candidates"), (c("l_quantity") > 25).alias("in_final"), (1 / c("l_linenumber")).alias("reciprocal_rank"), c("l_discount").cast("double").alias("coverage"),
        F.when(c("l_returnflag") == "N", c("l_tax") > 0.04).alias("evidence"), c("l_partkey").cast("double").alias("tokens"), (c("l_suppkey") + F.lit(0.5).cast("double")).alias("latency_ms"),
    )
    out = answers.stage_metrics(r)
    return out.select("cases", "scored", *[F.round(x, 6).alias(x) for x in ("candidate_recall", "final_recall", "mrr", "coverage", "evidence_recall")], "median_tokens", "p90_tokens", "median_ms", "p90_ms")


@query(f"""WITH {FACTS}, {NODES}, i AS (SELECT count(*) AS total, count(*) FILTER (WHERE uid NOT IN (SELECT from_uid FROM facts WHERE rel_type = 'ASSIGNED_TO' AND {LIVE} AND from_uid IS NOT NULL)) AS isolated FROM nodes WHERE label = 'WorkItem')
SELECT 'queue' AS what, o_orderpriority AS name, count(*) AS n, -1.0::DOUBLE AS share FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL UNION ALL SELECT 'isolated', 'WorkItem', isolated, round(isolated / total, 6) FROM i""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("state"), F.col("o_orderpriority").alias("kind"))
    out = answers.dashboard(q, reports.isolation(base.nodes(spark, d), _live(spark, d), "ASSIGNED_TO", "WorkItem"))
    return out.withColumn("share", F.coalesce(F.round("share", 6), F.lit(-1.0)))


@query("WITH v AS (SELECT collection_name, uid, max(embedded_model) AS m FROM entity_embeddings WHERE uid IS NOT NULL AND collection_name IS NOT NULL GROUP BY ALL), c AS (SELECT min(collection_name) AS c FROM v) SELECT collection_name, count(*) AS n, count(*) FILTER (WHERE m = 'new') AS fresh FROM (SELECT collection_name, uid, m FROM v WHERE collection_name <> (FROM c) UNION ALL SELECT c, uid, 'new' FROM (SELECT DISTINCT uid FROM v), c) GROUP BY 1")
def rebuilt_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One collection of vectors made anew for all nodes."""
    e = table(spark, d, "entity_embeddings").where("uid is not null and collection_name is not null")
    v = e.groupBy("collection_name", "uid").agg(F.max("embedded_model").alias("model"))
    first = v.agg(F.min("collection_name").alias("c")).first()["c"]  # one name
    out = answers.rebuild(v, first or "", v.select("uid").distinct().withColumn("model", F.lit("new")))
    return out.groupBy("collection_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("model") == "new").alias("fresh"))
