"""Queries on operational tables, anchors, models and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.functions import code, models, text
from bitempo.operators import answers
from bitempo.operators import facts as writes
from bitempo.operators import graph, ledger, search, selective, state
from bitempo.plans import base
from bitempo.plans.base import FACTS, ISSUES, LIVE, NODES
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


_KEY = r"\b([A-Z][A-Z0-9]{1,11}-[0-9]+)\b"


@query(rf"WITH {ISSUES}, a AS (SELECT DISTINCT sha, unnest(regexp_extract_all(message, '{_KEY}', 1)) AS k FROM github_commit) SELECT DISTINCT sha AS record_key, issue_id AS uid FROM a JOIN issues ON k = issue_key")
def anchor_targets(spark: SparkSession, d: str) -> DataFrame:
    """Issues that commits of another provider name by their key."""
    c = table(spark, d, "github_commit").select(F.col("sha").alias("record_key"), F.lit("github").alias("provider"), text.issue_keys(F.col("message")).alias("anchors"))
    t = base.issues(spark, d).select(F.col("issue_key").alias("anchor"), F.col("issue_id").alias("uid"), F.lit("jira").alias("provider"))
    return ledger.anchored(c, t)


@query("""WITH p AS (SELECT DISTINCT account_id AS uid, lower(trim(email)) AS e FROM jira_person UNION SELECT DISTINCT 'github:' || lower(trim(author_email)), lower(trim(author_email)) FROM github_commit UNION SELECT DISTINCT 'bitbucket:' || lower(trim(author_email)), lower(trim(author_email)) FROM bitbucket_commit),
q AS (SELECT * FROM p WHERE e <> '' AND uid IS NOT NULL), m AS (SELECT e, min(uid) AS a FROM q GROUP BY 1) SELECT DISTINCT a, uid AS b FROM q JOIN m USING (e) WHERE a <> uid""")
def verified_people(spark: SparkSession, d: str) -> DataFrame:
    """Accounts and authors that have one address."""
    mail = F.lower(F.trim("author_email"))
    p = table(spark, d, "jira_person").select(F.col("account_id").alias("uid"), "email")
    for name in ("github", "bitbucket"):
        p = p.unionByName(table(spark, d, f"{name}_commit").select(F.concat(F.lit(f"{name}:"), mail).alias("uid"), mail.alias("email")).distinct())
    return ledger.same_people(p)


@query("""WITH f AS (SELECT repository_full_name AS repository, commit_hash, unnest(files) AS f FROM bitbucket_commit), t AS (SELECT repository, commit_hash, f.path AS path FROM f UNION SELECT repository, commit_hash, f.old_path FROM f)
SELECT DISTINCT repository, commit_hash, path FROM t WHERE coalesce(path, '') <> '' AND (repository, path) IN (SELECT repository_full_name, path FROM bitbucket_file WHERE path IS NOT NULL AND repository_full_name IS NOT NULL)""")
def modified_paths(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "bitbucket_commit").select(F.col("repository_full_name").alias("repository"), "commit_hash", "files")
    present = table(spark, d, "bitbucket_file").select(F.col("repository_full_name").alias("repository"), "path")
    return ledger.modified(c, present)


@query("SELECT doc_id AS id, coalesce(n_chars, 0) AS priority FROM documents ORDER BY priority DESC, created_at NULLS LAST, id LIMIT 100")
def pending_records(spark: SparkSession, d: str) -> DataFrame:
    """The next hundred records of the queue (a report of the top k)."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("n_chars", F.lit(0)).alias("priority"), F.col("created_at").alias("at"))
    return ledger.queue(rows, 100).select("id", "priority")


@query("WITH m AS (SELECT o_orderpriority, arg_max(o_custkey, ROW(o_orderdate, o_custkey)) AS o_custkey FROM orders GROUP BY 1) SELECT o_orderpriority, o_custkey, o_orderkey FROM orders SEMI JOIN m USING (o_orderpriority, o_custkey)")
def newest_run(spark: SparkSession, d: str) -> DataFrame:
    """All orders of the customer who ordered last, by priority, as the rows of a newest run."""
    return ledger.newest_run(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey", "o_orderdate").select("o_orderpriority", "o_custkey", "o_orderkey")


@query("WITH r AS (SELECT o_orderpriority AS label, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) SELECT * FROM r WHERE rank <= 10")
def report_trend(spark: SparkSession, d: str) -> DataFrame:
    """The last ten runs of each label."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), "o_orderdate", "o_orderkey")
    return graph.latest(o, ["label"], ["o_orderdate", "o_orderkey"], 10).select("label", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FACTS} SELECT from_uid || '|' || to_uid AS identity, min(fact_uid) AS payload FROM facts WHERE rel_type = 'BLOCKS' AND from_uid || '|' || to_uid NOT IN (SELECT from_uid || '|' || to_uid FROM facts WHERE rel_type = 'BELONGS_TO' AND from_uid || to_uid IS NOT NULL) AND from_uid || to_uid IS NOT NULL GROUP BY 1")
def new_reviews(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d).withColumn("identity", F.concat("from_uid", F.lit("|"), "to_uid"))
    wanted = f.where("rel_type = 'BLOCKS'").select("identity", F.col("fact_uid").alias("payload"))
    return ledger.fresh_reviews(wanted, f.where("rel_type = 'BELONGS_TO'"))


@query("""WITH o AS (SELECT s_suppkey AS k, s_name AS title, 'open' AS status, s_acctbal AS score FROM supplier WHERE s_acctbal < 5000), n AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal < 2000 THEN upper(s_name) END AS title, 'new' AS status, s_acctbal + 1 AS score FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.title, o.title, '') AS title, coalesce(o.status, n.status) AS status, round(coalesce(n.score, o.score), 2) AS score FROM o FULL JOIN n ON o.k = n.k""")
def finding_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Status of a known finding stays, a null title does not overwrite, the score does."""
    s = table(spark, d, "supplier")
    old = s.where("s_acctbal < 5000").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("title"), F.lit("open").alias("status"), F.col("s_acctbal").alias("score"))
    new = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") < 2000, F.upper("s_name")).alias("title"), F.lit("new").alias("status"), (F.col("s_acctbal") + 1).alias("score"))
    return ledger.keyed_upsert(old, new, ["k"], ("status",), ("title",)).select("k", F.coalesce("title", F.lit("")).alias("title"), "status", F.round("score", 2).alias("score"))


@query("""WITH l AS (SELECT DISTINCT ON (collection_name, uid) * FROM entity_embeddings WHERE uid IS NOT NULL AND collection_name IS NOT NULL ORDER BY collection_name, uid, updated_at DESC NULLS LAST) SELECT collection_name, count(*) AS vectors, count(coalesce(name_embedding, content_embedding)) AS named FROM l GROUP BY 1""")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per collection after rows of one model are put in over those of others."""
    e = table(spark, d, "entity_embeddings").select("collection_name", "uid", "name_embedding", "content_embedding", "embedded_model", F.col("updated_at").cast("timestamp").alias("updated_at"))
    first = F.col("embedded_model").eqNullSafe(F.lit("encoder-m1"))
    out = answers.upsert_vectors(e.where(first), e.where(~first))
    return out.groupBy("collection_name").agg(F.count(F.lit(1)).alias("vectors"), F.count("name_embedding").alias("named"))


@query(f"""WITH {FACTS}, m AS (SELECT from_uid AS uid, unnest(source_record_keys) AS k FROM facts UNION SELECT to_uid, unnest(source_record_keys) FROM facts), p AS (SELECT DISTINCT from_uid AS a, to_uid AS b FROM facts WHERE rel_type = 'ASSIGNED_TO')
SELECT a, b, count(*) AS records FROM p JOIN m x ON x.uid = a JOIN m y ON y.uid = b AND x.k = y.k GROUP BY ALL""")
def shared_records(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    pairs = f.where("rel_type = 'ASSIGNED_TO'").select(F.col("from_uid").alias("a"), F.col("to_uid").alias("b"))
    return ledger.shared_records(pairs, writes.mentions(f))


@query(f"""WITH {FACTS}, {NODES}, f AS (SELECT * FROM facts WHERE {LIVE}), b AS (SELECT from_uid AS uid, min(to_uid) AS u FROM f WHERE rel_type = 'BELONGS_TO' GROUP BY 1), p AS (SELECT from_uid AS uid, min(to_uid) AS u FROM f WHERE rel_type = 'PARENT_OF' GROUP BY 1)
SELECT n.uid, coalesce(CASE WHEN label = 'Project' THEN n.uid END, b.u, p.u, '') AS found, CASE WHEN label = 'Project' THEN 'self' WHEN b.u IS NOT NULL THEN 'container' WHEN p.u IS NOT NULL THEN 'parent' ELSE '' END AS via FROM nodes n LEFT JOIN b USING (uid) LEFT JOIN p USING (uid)""")
def namespaces(spark: SparkSession, d: str) -> DataFrame:
    """The container of each node: itself, what it belongs to, or its parent."""
    f = base.facts(spark, d).where(LIVE)
    n = base.nodes(spark, d)
    to = lambda r: f.where(f"rel_type = '{r}'").select(F.col("from_uid").alias("_f"), "to_uid").select(F.col("_f").alias("uid_"), F.col("to_uid").alias("uid"))
    own = n.where("label = 'Project'").select(F.col("uid").alias("uid_"), "uid")
    out = ledger.first_known(n.select(F.col("uid").alias("uid_")), [("self", own), ("container", to("BELONGS_TO")), ("parent", to("PARENT_OF"))], "uid_")
    return out.select(F.col("uid_").alias("uid"), F.coalesce("found", F.lit("")).alias("found"), F.coalesce("via", F.lit("")).alias("via"))


_STOP = ["red", "small", "part", "the"]


@query(f"""WITH p AS (SELECT p_partkey, p_name, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM part)
SELECT p_partkey, length(trim(p_name)) >= 3 AND NOT list_contains({_STOP}, lower(trim(p_name))) AND len(list_filter(w, lambda x: NOT list_contains({_STOP}, x))) > 0 AS kept FROM p""")
def mention_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", ledger.mentionable(F.col("p_name"), _STOP).alias("kept"))


@query("""WITH s AS (SELECT q.vec_id AS q, r.vec_id AS id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS c FROM embeddings q JOIN embeddings r ON q.label <> r.label WHERE q.vec_id % 20 = 0)
SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rank FROM s WHERE c >= 0.2 QUALIFY rank <= 7""")
def cross_source_context(spark: SparkSession, d: str) -> DataFrame:
    """The seven nearest of other sources for each query, above a bound."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))
    met = search.meet(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")).where("ql <> label")
    scored = met.select("q", "id", search.dot(F.col("qv"), F.col("v")).alias("score")).where("score >= 0.2")
    return search.top(scored, ["q"], "id", 7).select("q", "id", F.col("rank").cast("long").alias("rank"))


@query("""WITH l AS (SELECT user_id AS q, CASE WHEN event_type = 'click' THEN 'vector' ELSE 'text' END AS leg, event_id % 50 AS id, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY value DESC, event_id) AS rank FROM events),
g AS (SELECT * FROM (VALUES (5, 1.0), (10, 3.0), (60, 1.0)) t(constant, weight)), s AS (SELECT constant, weight, q, id, round(sum(CAST(CASE leg WHEN 'vector' THEN weight ELSE 1.0 END AS DOUBLE) / (constant + rank)), 9) AS score FROM l, g GROUP BY ALL)
SELECT CAST(constant AS BIGINT) AS constant, CAST(weight AS DOUBLE) AS weight, q, id, row_number() OVER (PARTITION BY constant, weight, q ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("leg", F.when(F.col("event_type") == "click", "vector").otherwise("text"))
    legs = e.select(F.col("user_id").alias("q"), "leg", (F.col("event_id") % 50).alias("id"), F.row_number().over(Window.partitionBy("user_id", "leg").orderBy(F.desc("value"), "event_id")).alias("rank"))
    grid = spark.createDataFrame([(5, 1.0), (10, 3.0), (60, 1.0)], "constant int, weight double")
    return ledger.sweep(legs, grid, 5).select(F.col("constant").cast("long").alias("constant"), F.col("weight").cast("double").alias("weight"), "q", "id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FACTS} SELECT count(*) AS present FROM (SELECT DISTINCT unnest(source_record_keys) AS k FROM facts) WHERE k IN (SELECT record_key FROM documents WHERE record_key IS NOT NULL)")
def records_present(spark: SparkSession, d: str) -> DataFrame:
    """How many of the records that facts name are there."""
    keys = base.facts(spark, d).select(F.explode("source_record_keys").alias("record_key")).distinct()
    return state.count_present(keys, table(spark, d, "documents"))


@query("SELECT namespace_uid, bool_and(text IS NOT NULL) AS done FROM documents WHERE namespace_uid IS NOT NULL GROUP BY 1")
def fully_processed(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces without an unfinished text."""
    chunks = table(spark, d, "documents").withColumn("status", F.when(F.col("text").isNull(), "pending").otherwise("done"))
    return state.fully_processed(chunks, "namespace_uid")


@query("SELECT doc_id, concat_ws(chr(10), 'Source: ' || source, 'Type: ' || entity_type, 'Key: ' || record_key, 'Namespace: ' || namespace_uid) AS header FROM documents")
def source_headers(spark: SparkSession, d: str) -> DataFrame:
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", line("Source", "source"), line("Type", "entity_type"), line("Key", "record_key"), line("Namespace", "namespace_uid")).alias("header"))


@query()
def selective_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Commit messages whose statements are only references to issues, in part or not at all; tested case by case."""
    c = table(spark, d, "github_commit").where("message is not null").select("sha", "message").distinct().withColumn("anchors", text.issue_keys(F.col("message")))
    return selective.selective(c, "sha", "message", "anchors")


@query()
def code_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comment lines of source files; tested case by case."""
    f = table(spark, d, "bitbucket_file").where("content is not null").select("file_id", "file_language", "content").distinct()
    return f.select("file_id", F.size(code.comments(F.col("content"), F.col("file_language"))).alias("comment_lines"))


@query()
def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Subject descriptions against documents of their label, scored by an injected model."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    areas = table(spark, d, "subject_area").select(F.col("subject").alias("q"), "description")
    asked = table(spark, d, "doc_label").select(F.col("doc_id").alias("id"), F.col("subject").alias("q")).distinct()
    scored = asked.join(docs, "id").join(areas, "q").select("q", "id", models.scorer(models.overlap_model)(F.col("description"), F.col("text")).alias("score"))
    return search.select_final(scored, 0.3)
