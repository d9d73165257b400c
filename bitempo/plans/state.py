"""Queries on the operational ledger, over ledger tables that the driver's tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.operators import state
from bitempo.plans.base import NOW, ts
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


# Reviews are orders, findings and drops are line items, records are documents.
_REVIEWS = "r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS state, o_orderpriority AS kind, o_custkey AS identity, o_orderdate AS created_at FROM orders)"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), word.alias("state"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("identity"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return o.withColumn("decided_by", F.lit(None).cast("string")).withColumn("decided_at", F.lit(None).cast("timestamp"))


@query(f"WITH {_REVIEWS} SELECT id, CASE WHEN state = 'pending' AND id % 3 = 0 THEN 'approved' WHEN state = 'pending' AND id % 3 = 1 THEN 'rejected' ELSE state END AS state, coalesce(state = 'pending' AND id % 3 < 2, false) AS decided FROM r")
def review_states(spark: SparkSession, d: str) -> DataFrame:
    """A third of the reviews approved, a third rejected; only pending ones change."""
    r = _reviews(spark, d)
    out = state.approve(r, r.where("id % 3 = 0").select("id", F.lit("me").alias("decided_by")), ts(NOW))
    out, _ = state.reject(out, r.where("id % 3 = 1").select("id", F.lit("me").alias("decided_by")), r.select("identity").limit(0), ts(NOW))
    return out.select("id", "state", F.col("decided_by").isNotNull().alias("decided"))


@query(f"WITH {_REVIEWS} SELECT DISTINCT identity FROM r WHERE identity IN (SELECT identity FROM r WHERE state = 'pending' AND id % 3 = 1)")
def rejected_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities that may not be proposed again."""
    r = _reviews(spark, d)
    _, known = state.reject(r, r.where("id % 3 = 1").select("id", F.lit("me").alias("decided_by")), r.select("identity").limit(0), ts(NOW))
    return state.rejected(r.select("identity").distinct(), known)


@query(f"WITH {_REVIEWS} SELECT id, kind FROM r WHERE state = 'pending' AND kind = '1-URGENT' ORDER BY created_at DESC, id DESC LIMIT 50")
def pending_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest urgent reviews (a report of the top k)."""
    return state.reviews(_reviews(spark, d), 50, kind="1-URGENT").select("id", "kind")


_FINDINGS = "f AS (SELECT l_orderkey * 10 + l_linenumber AS finding_key, 'r' || l_suppkey AS record_key, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'resolved' END AS status, l_shipdate AS updated_at, l_returnflag AS reason FROM lineitem)"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_key"), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("record_key"), F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("updated_at"), F.col("l_returnflag").alias("reason"),
    )


@query(f"WITH {_FINDINGS} SELECT status, reason, count(*) AS n FROM (SELECT CASE WHEN status = 'open' AND record_key LIKE 'r1%' THEN 'stale' WHEN status = 'open' AND finding_key % 7 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN status = 'open' AND record_key LIKE 'r1%' THEN 'source changed' WHEN status = 'open' AND finding_key % 7 = 0 THEN 'done' ELSE reason END AS reason FROM f) GROUP BY ALL")
def finding_states(spark: SparkSession, d: str) -> DataFrame:
    """Open findings of some records become stale, others are resolved."""
    f = _findings(spark, d)
    out = state.stale_findings(f, state.keys_with_prefix(f, "r1"), "source changed", ts(NOW))
    out = state.end_findings(out, f.where("finding_key % 7 = 0"), "resolved", "done", ts(NOW))
    return out.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FINDINGS} SELECT finding_key, record_key FROM f WHERE status = 'open' AND record_key LIKE 'r1%' ORDER BY updated_at DESC, finding_key DESC LIMIT 100")
def open_findings(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest open findings below a prefix (a report of the top k)."""
    return state.findings(_findings(spark, d), 100, prefix="r1").select("finding_key", "record_key")


@query(f"WITH {_FINDINGS}, e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS finding_key, 'p' || l_partkey AS k FROM lineitem WHERE l_quantity < 10), n AS (SELECT finding_key, count(*) AS n FROM e GROUP BY 1) SELECT finding_key, status, coalesce(n, 0) AS evidence FROM f LEFT JOIN n USING (finding_key) WHERE status <> 'resolved'")
def findings_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").where("l_quantity < 10").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_key"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("record_key"))
    named = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("record_key"), F.col("p_name").alias("name"))
    out = state.findings_with_evidence(_findings(spark, d), e, named)
    return out.select("finding_key", "status", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("evidence"))


@query(f"WITH {_FINDINGS} SELECT reason, count(*) AS n FROM f WHERE record_key LIKE 'r2%' GROUP BY 1")
def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return state.drop_counts(_findings(spark, d), "r2")


@query(f"WITH {_FINDINGS} SELECT finding_key AS drop_id FROM f WHERE reason = 'R' ORDER BY updated_at DESC, finding_key DESC LIMIT 100")
def newest_drops(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest drops of one reason (a report of the top k)."""
    f = _findings(spark, d).select(F.col("finding_key").alias("drop_id"), F.col("updated_at").alias("at"), "reason")
    return state.drops(f, 100, "R").select("drop_id")


_SHAPES = "x AS (SELECT DISTINCT CASE WHEN l_suppkey % 4 = 0 THEN 'AIR' ELSE 'S' || l_suppkey END AS subject_kind, l_returnflag AS relation, l_linestatus AS object_kind, 'o' || l_orderkey AS record_key, CAST(l_linenumber AS VARCHAR) AS chunk_id FROM lineitem)"
_OFTEN = "often AS (SELECT subject_kind, relation, object_kind FROM x GROUP BY ALL HAVING count(DISTINCT record_key) >= 40 AND count(*) >= 40), new AS (FROM often WHERE subject_kind <> 'AIR')"


def _shapes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refused shapes, axioms, chunks): shapes of one kind are axioms already."""
    x = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 4 == 0, "AIR").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("subject_kind"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("object_kind"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("record_key"), F.col("l_linenumber").cast("string").alias("chunk_id")).distinct()
    keys = ["subject_kind", "relation", "object_kind"]
    axioms = x.where("subject_kind = 'AIR'").select(*keys).distinct().withColumn("batch_id", F.lit(None).cast("string"))
    return x, axioms, x.select("record_key", "chunk_id").distinct().withColumn("status", F.lit("done"))


def _no_batches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "batch_id string, adopted_at timestamp, undone_at timestamp")


@query(f"WITH {_SHAPES}, {_OFTEN}, a AS (SELECT DISTINCT subject_kind, relation, object_kind, NULL AS batch_id FROM x WHERE subject_kind = 'AIR' UNION ALL SELECT *, 'b1' FROM new) SELECT 'axiom' AS what, coalesce(batch_id, '') AS word, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'chunk', CASE WHEN (record_key, chunk_id) IN (SELECT record_key, chunk_id FROM x JOIN new USING (subject_kind, relation, object_kind)) THEN 'pending' ELSE 'done' END AS w, count(*) FROM (SELECT DISTINCT record_key, chunk_id FROM x) GROUP BY w")
def adopted_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes that were refused often become axioms, and their chunks pending again."""
    x, axioms, chunks = _shapes(spark, d)
    grown, _, queued = state.adopt(axioms, _no_batches(spark), x, chunks, x, "b1", 40, 40, ts(NOW))
    a = grown.select(F.lit("axiom").alias("what"), F.coalesce("batch_id", F.lit("")).alias("word"))
    return a.unionByName(queued.select(F.lit("chunk").alias("what"), F.col("status").alias("word"))).groupBy("what", "word").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SHAPES}, {_OFTEN} SELECT (SELECT count(*) FROM (SELECT DISTINCT subject_kind, relation, object_kind FROM x WHERE subject_kind = 'AIR')) AS axioms, 0 AS standing, (SELECT count(*) FROM orders WHERE o_orderpriority <> '1-URGENT') AS facts")
def unadopted_shapes(spark: SparkSession, d: str) -> DataFrame:
    """A batch taken back: its axioms and facts go, the batch is stamped."""
    x, axioms, chunks = _shapes(spark, d)
    grown, batches, _ = state.adopt(axioms, _no_batches(spark), x, chunks, x, "b1", 40, 40, ts(NOW))
    facts = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "b1").alias("adopted_batch"))
    left, stamped, kept = state.unadopt(grown, batches, facts, "b1", ts(NOW))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(left, "axioms").crossJoin(n(state.adoptions(stamped), "standing")).crossJoin(n(kept, "facts"))


@query(f"WITH {_SHAPES}, y AS (SELECT subject_kind, relation, object_kind, count(DISTINCT record_key) AS docs, count(*) AS n FROM x GROUP BY ALL) SELECT count(*) AS shapes, count(*) FILTER (WHERE docs >= 50 AND n >= 80) AS eligible FROM y")
def pending_shapes(spark: SparkSession, d: str) -> DataFrame:
    return state.pending_shapes(_shapes(spark, d)[0], 50, 80)


_RECORDS = "c AS (SELECT doc_id AS id, 'doc:' || coalesce(lang, '') || ':' || doc_id AS record_key, source AS provider, namespace_uid AS project_ref, text IS NULL AS gone FROM documents)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("doc:"), F.coalesce("lang", F.lit("")), F.lit(":"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), key.alias("record_key"), F.col("source").alias("provider"), F.col("namespace_uid").alias("project_ref"), F.when(F.col("text").isNull(), ts(NOW)).alias("deleted_at"))


@query(f"WITH {_RECORDS} SELECT provider, count(*) FILTER (WHERE NOT gone AND id % 5 <> 0) AS present, count(*) FILTER (WHERE gone OR id % 5 = 0) AS gone FROM c GROUP BY 1")
def deleted_records(spark: SparkSession, d: str) -> DataFrame:
    """Records marked as deleted, and what is left of each provider."""
    r = _records(spark, d)
    out = state.mark_deleted(r, r.where("id % 5 = 0"), ts(NOW))
    here = state.current_records(out).select("provider", F.lit(1).alias("p"), F.lit(0).alias("g"))
    away = out.where("deleted_at is not null").select("provider", F.lit(0).alias("p"), F.lit(1).alias("g"))
    return here.unionByName(away).groupBy("provider").agg(F.sum("p").alias("present"), F.sum("g").alias("gone"))


@query(f"WITH {_RECORDS} SELECT 'records' AS name, count(*) AS n FROM c WHERE id % 4 <> 0 UNION ALL SELECT 'chunks', count(*) FROM c WHERE id % 4 <> 0 UNION ALL SELECT 'versions', count(*) FROM c UNION ALL SELECT 'below', count(*) FROM c WHERE record_key NOT LIKE 'doc:en:%'")
def purged_records(spark: SparkSession, d: str) -> DataFrame:
    """Records deleted with their chunks; versions stay.  And a whole prefix deleted."""
    r = _records(spark, d)
    left = state.delete_records({"records": r, "chunks": r, "versions": r}, r.where("id % 4 = 0"))
    left["below"] = state.delete_below(r, "doc:en:")
    out = None
    for name, df in left.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"WITH {_RECORDS} SELECT record_key FROM c WHERE NOT gone AND id % 2 = 0 ORDER BY record_key LIMIT 100")
def unembedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred chunks without a vector (a queue)."""
    r = _records(spark, d).withColumn("embedding", F.when(F.col("id") % 2 == 1, F.array(F.lit(0.0)))).withColumn("position", F.lit(0)).withColumn("chunk_id", F.col("id"))
    return state.unembedded(r, 100).select("record_key")


@query("WITH t AS (SELECT p_brand AS term, p_size AS label, p_type AS reason FROM part WHERE p_size < 25) SELECT label, count(*) AS terms FROM (SELECT DISTINCT term, label FROM (FROM t UNION ALL SELECT p_brand, p_size, p_type FROM part WHERE p_size < 40)) GROUP BY 1")
def added_terms(spark: SparkSession, d: str) -> DataFrame:
    """Stopped terms, with more of them added where they are not known."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_size").alias("label"), F.col("p_type").alias("reason"))
    known = p.where("label < 25").groupBy("term", "label").agg(F.min("reason").alias("reason"))
    return state.add_missing(known, p.where("label < 40"), ["term", "label"]).groupBy("label").agg(F.count(F.lit(1)).alias("terms"))


@query("SELECT l_suppkey AS run_id, l_returnflag AS label, l_linestatus AS resolved_by, 2 * count(*) AS n FROM lineitem GROUP BY ALL")
def resolution_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of runs, counted twice in batches."""
    keys = [F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("resolved_by")]
    one = table(spark, d, "lineitem").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return state.count_resolution(one, one)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE o_orderstatus END AS status, o_orderkey % 2 = 0 AS stamped FROM orders")
def chunk_states(spark: SparkSession, d: str) -> DataFrame:
    """The status of some chunks set and stamped."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("timestamp").alias("done_at"))
    out = state.set_status(c, c.where("id % 2 = 0").select("id", F.lit("done").alias("status")), ["id"], ts(NOW), "done_at")
    return out.select("id", "status", F.col("done_at").isNotNull().alias("stamped"))


@query("SELECT l_orderkey AS record_key, l_linenumber AS chunk_id, CASE WHEN l_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS reason FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def replaced_drops(spark: SparkSession, d: str) -> DataFrame:
    """The drops of some chunks replaced by new ones."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_key"), F.col("l_linenumber").alias("chunk_id")).distinct().withColumn("reason", F.lit("old"))
    return state.replace(x, x.where("record_key % 2 = 0").withColumn("reason", F.lit("new")), ["record_key", "chunk_id"])
