"""Queries on search, ranking, resolution and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitempo.functions import dates, text
from bitempo.operators import resolve, search, windows
from bitempo.operators.sequence import hot_groups, neighbours
from bitempo.plans import base
from bitempo.plans.base import FACTS, LIVE, NOW, ts
from bitempo.session import broadcast_if_small, table

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


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents for the titles of the subject areas."""
    asked = table(spark, d, "subject_area").select(F.col("subject").alias("q"), F.col("title").alias("text"))
    scored = search.bm25_search(table(spark, d, "documents"), "doc_id", "text", asked)
    return scored.withColumnRenamed("doc_id", "id").withColumn("score", F.round("score", 6))


_BM = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
e AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w), p AS (SELECT term, doc_id, dl, count(*) AS tf FROM e GROUP BY ALL), st AS (SELECT count(*) AS n, avg(dl) AS al FROM (SELECT DISTINCT doc_id, dl FROM p)),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1), qs AS (SELECT DISTINCT subject AS q, unnest(regexp_extract_all(lower(title), '[a-z0-9_]+')) AS w FROM subject_area),
a AS (SELECT DISTINCT q, term FROM qs JOIN dfs ON CASE WHEN length(w) > 1 THEN starts_with(term, w) ELSE term = w END),
s AS (SELECT q, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score FROM a JOIN dfs USING (term) JOIN p USING (term), st GROUP BY ALL)"""


@query(f"WITH {_BM} SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 30")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top(_bm25(spark, d), ["q"], "id", 30).withColumn("rank", F.col("rank").cast("long"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    label = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("entity_type", F.lit("none")).alias("label"))
    return _bm25(spark, d).join(label, "id")


_LAB = f"{_BM}, l AS (SELECT s.*, coalesce(entity_type, 'none') AS label FROM s JOIN documents ON doc_id = id)"


@query(f"WITH {_LAB} SELECT q, id, label, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM l QUALIFY rank <= 30")
def fulltext_fusion_global(spark: SparkSession, d: str) -> DataFrame:
    return search.fuse_labels(_labelled(spark, d), "global_score", 30).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_LAB}, m AS (SELECT *, score / max(score) OVER (PARTITION BY q, label) AS z FROM l) SELECT q, id, label, row_number() OVER (PARTITION BY q ORDER BY z DESC, score DESC, id) AS rank FROM m QUALIFY rank <= 30")
def fulltext_fusion_normalized(spark: SparkSession, d: str) -> DataFrame:
    return search.fuse_labels(_labelled(spark, d), "normalized", 30).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_LAB}, m AS (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY score DESC, id) AS z FROM l) SELECT q, id, label, row_number() OVER (PARTITION BY q ORDER BY z, label, id) AS rank FROM m QUALIFY rank <= 30")
def fulltext_fusion_per_label(spark: SparkSession, d: str) -> DataFrame:
    return search.fuse_labels(_labelled(spark, d), "per_label_rank", 30).withColumn("rank", F.col("rank").cast("long"))


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), sc AS (SELECT a.vec_id AS q, b.vec_id AS id, list_dot_product(a.e, b.e) AS c FROM v a, v b WHERE a.vec_id % 20 = 0)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.where("id % 20 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv")), rows


@query(f"WITH {_VEC} SELECT q, id, round(c, 5) AS cosine, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rank FROM sc QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _vectors(spark, d)
    return search.nearest(q, rows, 10).select("q", "id", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_VEC} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rank FROM sc WHERE c >= 0.25 AND c < 0.4 QUALIFY rank <= 20")
def vector_band(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _vectors(spark, d)
    return search.nearest(q, rows, 20, 0.25, 0.4).select("q", "id", F.col("rank").cast("long").alias("rank"))


_CH = f"WITH {_VEC}, a AS (SELECT q, id, 1 AS channel, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rank FROM sc QUALIFY rank <= 12), b AS (SELECT q, id, 2 AS channel, row_number() OVER (PARTITION BY q ORDER BY abs(c), id) AS rank FROM sc QUALIFY rank <= 12), u AS (FROM a UNION ALL FROM b)"


def _channels(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _vectors(spark, d)
    best = search.nearest(q, rows, 12).select("q", F.lit(1).alias("channel"), "rank", "id")
    scored = search.meet(q, rows).select("q", "id", (-F.abs(search.dot(F.col("qv"), F.col("v")))).alias("score"))
    return best.unionByName(search.top(scored, ["q"], "id", 12).select("q", F.lit(2).alias("channel"), "rank", "id"))


@query(f"{_CH}, f AS (SELECT q, id, min(ROW(rank, channel)) AS m FROM u GROUP BY ALL) SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY m, id) AS rank FROM f")
def interleave_channels(spark: SparkSession, d: str) -> DataFrame:
    return search.interleave(_channels(spark, d)).withColumn("rank", F.col("rank").cast("long"))


_HY = f"""WITH {_BM}, sub AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS n FROM (SELECT DISTINCT subject FROM subject_area)), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vl AS (SELECT subject AS q, b.vec_id AS id, list_dot_product(a.e, b.e) AS c FROM sub JOIN v a ON a.vec_id = n, v b), x AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank, 1.0 AS w FROM s QUALIFY rank <= 30
UNION ALL SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rank, 3.0 FROM vl QUALIFY rank <= 30), f AS (SELECT q, id, round(sum(w / (10 + rank)), 6) AS score FROM x GROUP BY ALL)"""


def _hybrid_legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents by keywords, and by the vector that has the number of the subject."""
    number = table(spark, d, "subject_area").select(F.col("subject").alias("q")).distinct().withColumn("n", F.row_number().over(Window.orderBy("q")) - 1)  # a small fixed table
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = number.join(v.withColumnRenamed("id", "n").withColumnRenamed("v", "qv"), "n").select("q", "qv")
    near = search.nearest(asked, v, search.PER_METHOD).select("q", "id", F.col("cosine").alias("score"))
    return _bm25(spark, d), near


@query(f"{_HY} SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 8")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search and vector search fused by rank."""
    fused = search.hybrid(*_hybrid_legs(spark, d), k=1 << 30).select("q", "id", F.round("score", 6).alias("score"))
    return search.top(fused, ["q"], "id", 8).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH a AS (SELECT user_id AS q, event_type AS uid, min(event_id) AS pos FROM events GROUP BY ALL), t AS (SELECT q, uid FROM a QUALIFY row_number() OVER (PARTITION BY q ORDER BY pos, uid) <= 2),
m AS (SELECT DISTINCT event_type AS uid, CAST(floor(value) AS BIGINT) AS record_key FROM events) SELECT q, record_key FROM t JOIN m USING (uid) GROUP BY ALL HAVING count(*) = 2""")
def shared_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What both of the first two kinds of events of a user have in common."""
    e = table(spark, d, "events")
    anchors = e.select(F.col("user_id").alias("q"), F.col("event_type").alias("uid"), F.col("event_id").alias("pos"))
    mentions = e.select(F.col("event_type").alias("uid"), F.floor("value").cast("long").alias("record_key"))
    return search.shared_evidence(anchors, mentions)


_SC = "sc AS (SELECT l_orderkey AS q, l_linenumber * 1000000 + l_partkey AS id, max(round(l_discount * 10, 2)) AS score, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"), F.round(F.col("l_discount") * 10, 2).alias("score"), "l_returnflag")
    return rows.groupBy("q", "id").agg(F.max("score").alias("score"), F.max("l_returnflag").alias("flag"))


@query(f"WITH {_SC}, n AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY flag = 'A' DESC, score DESC, id) AS rank FROM sc) SELECT * FROM n WHERE rank <= 4")
def reserved_first(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).withColumn("methods", F.array(F.when(F.col("flag") == "A", "time_window").otherwise("vector")))
    return search.reserved_first(s, 4).select("q", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SC}, a AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc WHERE flag = 'A'), b AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc),
u AS (SELECT q, id, min(ROW(g, rank)) AS m FROM (SELECT *, 0 AS g FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL), k AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY m, id) AS rank FROM u QUALIFY rank <= 3),
w AS (SELECT q, id, 0 AS g, rank FROM k UNION ALL SELECT k.q, k.id + 1, 1, rank FROM k), y AS (SELECT q, id, min(ROW(g, rank)) AS m FROM w GROUP BY ALL) SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY m, id) AS rank FROM y""")
def retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Two lanes merged, cut at three hits, with a neighbour of each."""
    s = _scores(spark, d)
    lanes = [search.top(x, ["q"], "id", 1 << 30) for x in (s.where("flag = 'A'"), s)]
    step = s.select(F.col("id").alias("seed"), (F.col("id") + 1).alias("id")).distinct()
    return search.retrieve(lanes, step, 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_SC}, r AS (SELECT *, CASE WHEN flag = 'A' THEN 'temporal' WHEN score >= 0.5 THEN 'direct' WHEN score >= 0.2 THEN 'bridge' ELSE 'irrelevant' END AS r0 FROM sc),
n AS (SELECT *, row_number() OVER (PARTITION BY q, r0 ORDER BY score DESC, id) AS n, count(*) FILTER (WHERE r0 = 'bridge') OVER (PARTITION BY q) AS b FROM r)
SELECT q, id, score, CASE WHEN r0 = 'bridge' AND n > 4 THEN 'irrelevant' WHEN r0 = 'irrelevant' AND n <= 4 - b THEN 'bridge' ELSE r0 END AS role FROM n""")
def rerank_roles(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).withColumn("methods", F.array(F.when(F.col("flag") == "A", "time_window").otherwise("vector")))
    return search.roles(s)


@query(f"WITH {_SC}, n AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc) SELECT * FROM n WHERE (score >= 0.5 OR rank <= 3) AND rank <= 12")
def select_final(spark: SparkSession, d: str) -> DataFrame:
    return search.select_final(_scores(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH g AS (SELECT user_id AS q, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS grp, event_id AS pos, event_id % 97 AS id FROM events),
f AS (SELECT q, id, min(ROW(grp, pos)) AS m FROM g GROUP BY ALL) SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY m, id) AS rank FROM f""")
def merge_unique_hits(spark: SparkSession, d: str) -> DataFrame:
    grp = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    g = table(spark, d, "events").select(F.col("user_id").alias("q"), grp.alias("grp"), F.col("event_id").alias("pos"), (F.col("event_id") % 97).alias("id"))
    return search.merge_unique(g).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {FACTS}, f AS (SELECT from_uid AS q, fact_uid AS id, rel_type <> 'ASSIGNED_TO' AS derived FROM facts WHERE from_uid IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY derived, id) AS rank, greatest(0, count(*) OVER (PARTITION BY q) - 6) AS dropped FROM f)
SELECT q, id, rank, dropped FROM n WHERE rank <= 6""")
def cap_facts(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d).where("from_uid is not null").select(F.col("from_uid").alias("q"), F.col("fact_uid").alias("id"), (F.col("rel_type") != "ASSIGNED_TO").alias("derived"))
    return search.cap(f, 6).select("q", "id", F.col("rank").cast("long").alias("rank"), F.col("dropped").cast("long").alias("dropped"))


@query("""WITH RECURSIVE h AS (SELECT l_orderkey AS q, l_linenumber * 1000000 + l_partkey AS id, CAST(max(l_quantity) AS INT) AS tokens FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY id) AS r FROM h),
w AS (SELECT q, id, tokens, r, least(tokens, 100) AS used, least(tokens, 100) AS taken FROM n WHERE r = 1 UNION ALL
SELECT n.q, n.id, n.tokens, n.r, w.used + CASE WHEN n.tokens <= 100 - w.used THEN n.tokens WHEN 100 - w.used >= 20 THEN 100 - w.used ELSE 0 END, CASE WHEN n.tokens <= 100 - w.used THEN n.tokens WHEN 100 - w.used >= 20 THEN 100 - w.used ELSE 0 END
FROM w JOIN n ON n.q = w.q AND n.r = w.r + 1) SELECT q, id, tokens, taken FROM w WHERE taken > 0""")
def pack_context(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id")).agg(F.max("l_quantity").cast("int").alias("tokens"))
    return search.pack(h.withColumn("rank", F.col("id")), 100, 20)


@query(r"""SELECT sha, array_to_string(list_sort(list_distinct(regexp_extract_all(message, '\b([A-Z][A-Z0-9]{1,11}-[0-9]+)\b', 1))), ',') AS issue_keys, array_to_string(list_sort(list_distinct([lower(x) for x in regexp_extract_all(message, '\b([0-9a-fA-F]{40})\b', 1)])), ',') AS shas
FROM (SELECT DISTINCT sha, message FROM github_commit WHERE message IS NOT NULL)""")
def anchors_extract(spark: SparkSession, d: str) -> DataFrame:
    """Issue keys and full commit hashes that commit messages name."""
    c = table(spark, d, "github_commit").where("message is not null").select("sha", "message").distinct()
    shas = F.filter(text.sha_prefixes(F.col("message")), lambda x: F.length(x) == 40)
    return c.select("sha", F.array_join(text.issue_keys(F.col("message")), ",").alias("issue_keys"), F.array_join(shas, ",").alias("shas"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(not|no longer|don''t|do not|never|instead of|rejected|avoid|deprecated|stop(ped)? using)\b') AS negates FROM documents WHERE text IS NOT NULL""")
def polarity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.polarity_conflict(F.col("text"), F.lit("")).alias("negates"))


@query(r"""WITH i AS (SELECT DISTINCT item_id, s AS n, lower(trim(regexp_replace(e, '\s+', ' ', 'g'))) AS e FROM (SELECT item_id, unnest(string_split(passage, '. ')) AS e, generate_subscripts(string_split(passage, '. '), 1) AS s FROM eval_item) WHERE trim(e) <> '')
SELECT doc_id, item_id, count(*) AS sentences FROM documents JOIN i ON contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), e) GROUP BY ALL""")
def evidence_in_text(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences of an evaluation item a document quotes (a stated, fixed set of items)."""
    parts = table(spark, d, "eval_item").select("item_id", F.posexplode(F.split("passage", r"\. ")).alias("n", "e")).where("trim(e) <> ''").distinct()
    items = broadcast_if_small(parts.withColumn("e", text.flat(F.col("e"))), 10_000)
    docs = table(spark, d, "documents").select("doc_id", text.flat(F.col("text")).alias("t"))
    return docs.join(items, text.quoted(F.col("e"), F.col("t"))).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("sentences"))


_TOK = r"WITH n AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL)"


@query(f"{_TOK}, w AS (SELECT doc_id, n, unnest(range(0, greatest(0, CAST(ceil((n - 300) / 150.0) AS INT)) + 1)) AS i FROM n) SELECT doc_id, i * 150 AS start_, least(i * 150 + 300, n) AS end_ FROM w")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.split("text", " ")).alias("n"))
    return n.select("doc_id", F.explode(text.token_windows(F.col("n"), 300)).alias("w")).select("doc_id", F.col("w.start").cast("long").alias("start_"), F.col("w.end").cast("long").alias("end_"))


_JAC = "p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, string_split(a.p_name, ' ') AS x, string_split(b.p_name, ' ') AS y, a.p_retailprice AS u, b.p_retailprice AS v FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)"


@query(f"""WITH {_JAC}, j AS (SELECT a, b, least(u, v) / greatest(u, v) AS s, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS l FROM p) SELECT a, b, round(0.4 * s + 0.2 * l + 0.2 + 0.2, 6) AS score FROM j WHERE 0.4 * s + 0.2 * l + 0.4 >= 0.6""")
def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one type, size and brand that look alike."""
    p = table(spark, d, "part")
    keys = ["p_type", "p_size", "p_brand"]
    a = p.select(*keys, F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("u"))
    b = p.select(*keys, F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("v"))
    pairs = a.join(b, keys).where("a < b").select("a", "b", (F.least("u", "v") / F.greatest("u", "v")).alias("vector"))
    things = p.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"), F.array("p_type").alias("targets"), F.array("p_brand").alias("records"), F.lit(False).alias("negated"))
    return resolve.scored_pairs(pairs, things).where("score >= 0.6").withColumn("score", F.round("score", 6))


_MERGE = f"WITH {FACTS}, m AS (SELECT to_uid AS absorbed, min(from_uid) AS survivor FROM facts WHERE rel_type = 'BLOCKS' AND from_uid < to_uid GROUP BY 1)"


@query(f"""{_MERGE}, x AS (SELECT coalesce(a.survivor, f.from_uid) AS from_uid, rel_type, coalesce(b.survivor, f.to_uid) AS to_uid, valid_at, confidence FROM facts f LEFT JOIN m a ON f.from_uid = a.absorbed LEFT JOIN m b ON f.to_uid = b.absorbed WHERE {LIVE})
SELECT from_uid, rel_type, to_uid, coalesce(epoch_ms(min(valid_at)), -1) AS valid_ms, round(max(confidence), 6) AS confidence, count(*) AS facts FROM x WHERE from_uid <> to_uid GROUP BY ALL""")
def merge_rewire(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    m = f.where("rel_type = 'BLOCKS' and from_uid < to_uid").groupBy(F.col("to_uid").alias("absorbed")).agg(F.min("from_uid").alias("survivor"))
    live = f.where("invalid_at is null and coalesce(assertion_status, 'live') <> 'corrected'")
    out = resolve.rewire(live, m)
    return out.select("from_uid", "rel_type", "to_uid", F.coalesce(F.unix_millis("valid_at"), F.lit(-1)).alias("valid_ms"), F.round("confidence", 6).alias("confidence"), "facts")


@query(f"""WITH {FACTS}, p AS (SELECT DISTINCT from_uid AS a, to_uid AS b FROM facts WHERE rel_type = 'BLOCKS' AND from_uid <> to_uid), n AS (SELECT from_uid AS id, sum(coalesce(len(source_record_keys), 0)) AS s, min(valid_at) AS t FROM facts GROUP BY 1),
x AS (SELECT a, b, x.s > y.s OR (x.s = y.s AND coalesce(x.t <= y.t, y.t IS NULL)) AS k FROM p JOIN n x ON a = x.id JOIN n y ON b = y.id) SELECT CASE WHEN k THEN a ELSE b END AS survivor, CASE WHEN k THEN b ELSE a END AS absorbed FROM x""")
def choose_survivor(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    pairs = f.where("rel_type = 'BLOCKS' and from_uid <> to_uid").select(F.col("from_uid").alias("a"), F.col("to_uid").alias("b")).distinct()
    n = f.groupBy(F.col("from_uid").alias("id")).agg(F.sum(F.coalesce(F.size("source_record_keys"), F.lit(0))).alias("support"), F.min("valid_at").alias("since"))
    return resolve.survivors(pairs, n)


@query("""WITH i AS (SELECT c_custkey AS item, c_mktsegment AS label, c_name AS name, c_custkey % 7 AS k FROM customer), e AS (SELECT label, name, min('u' || item) AS uid FROM i WHERE k = 0 GROUP BY ALL), a AS (SELECT label, name, min('a' || item) AS uid FROM i WHERE k IN (0, 1) GROUP BY ALL)
SELECT item, coalesce(e.uid, a.uid, CASE k WHEN 2 THEN 'v' || item WHEN 4 THEN 'w' || item ELSE '' END) AS uid, CASE WHEN e.uid IS NOT NULL THEN 'exact' WHEN a.uid IS NOT NULL THEN 'alias' WHEN k = 2 THEN 'vector' WHEN k = 4 THEN 'classifier' ELSE 'new' END AS rung FROM i LEFT JOIN e USING (label, name) LEFT JOIN a USING (label, name)""")
def identity_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Customers resolved rung by rung against made-up neighbours."""
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"), (F.col("c_custkey") % 7).alias("k"))
    exact = i.where("k = 0").select("label", "name", F.concat(F.lit("u"), "item").alias("uid"))
    alias = i.where("k in (0, 1)").select("label", "name", F.concat(F.lit("a"), "item").alias("uid"))
    one = lambda k, uid, cosine, p, veto=False: i.where(f"k = {k}").select("item", F.concat(F.lit(uid), "item").alias("uid"), F.lit(cosine).alias("cosine"), F.lit(p).alias("probability"), F.lit(veto).alias("veto"))
    near = one(2, "v", 0.95, 0.1)
    for x in (one(3, "x", 0.95, 0.9), one(3, "y", 0.93, 0.85), one(4, "w", 0.8, 0.95), one(4, "z", 0.78, 0.5), one(5, "w", 0.8, 0.8), one(6, "v", 0.97, 0.99, True)):
        near = near.unionByName(x)
    return resolve.ladder(i, exact, alias, near).select("item", F.coalesce("uid", F.lit("")).alias("uid"), "rung")


_ACT = f"""WITH {FACTS}, n AS (SELECT fact_uid AS old, valid_at AS s1, invalid_at AS e1, lead(fact_uid) OVER w AS new, lead(valid_at) OVER w AS s2, lead(invalid_at) OVER w AS e2 FROM facts WHERE from_uid IS NOT NULL AND rel_type IS NOT NULL AND valid_at IS NOT NULL WINDOW w AS (PARTITION BY from_uid, rel_type ORDER BY valid_at, fact_uid)),
p AS (SELECT *, CASE ascii(substr(new, 1, 1)) % 5 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'extends' WHEN 2 THEN 'newer_state' WHEN 3 THEN 'corrects' ELSE 'contradicts' END AS kind, ascii(substr(old, 2, 1)) % 6 = 0 AS pinned FROM n WHERE new IS NOT NULL)
SELECT old, new, kind, CASE WHEN kind = 'duplicate' THEN 'confirm_old' WHEN kind = 'extends' THEN 'write_both' WHEN pinned THEN 'dispute' WHEN kind = 'newer_state' THEN CASE WHEN coalesce(e2 <= s1, false) OR coalesce(e1 <= s2, false) THEN 'write_both' WHEN s1 < s2 THEN 'close_old' ELSE 'backfill_new' END
WHEN kind = 'corrects' THEN 'correct_old' ELSE 'dispute' END AS action FROM p"""


@query(_ACT)
def text_fact_actions(spark: SparkSession, d: str) -> DataFrame:
    """What each dated fact does to the one before it of the same subject and relation; the kinds stand for a classifier's."""
    c = F.col
    f = base.facts(spark, d).where("from_uid is not null and rel_type is not null and valid_at is not null").select("fact_uid", "from_uid", "rel_type", "valid_at", "invalid_at")
    keys = ["from_uid", "rel_type"]
    p = neighbours(f, keys, "valid_at", {}, {"new": c("fact_uid"), "s2": c("valid_at"), "e2": c("invalid_at")}, hot_groups(f, keys), then=("fact_uid",)).where("new is not null")
    k = F.ascii(F.substring("new", 1, 1)) % 5
    kind = F.when(k == 0, "duplicate").when(k == 1, "extends").when(k == 2, "newer_state").when(k == 3, "corrects").otherwise("contradicts")
    p = p.withColumnRenamed("fact_uid", "old").withColumn("kind", kind)
    return p.select("old", "new", "kind", resolve.text_fact_action(c("kind"), F.ascii(F.substring("old", 2, 1)) % 6 == 0, c("valid_at"), c("invalid_at"), c("s2"), c("e2")).alias("action"))


@query(f"""WITH {FACTS}, s AS (SELECT DISTINCT from_label AS subject_kind, rel_type AS relation, to_label AS object_kind FROM facts), a AS (SELECT * FROM s WHERE relation NOT IN ('BLOCKS')),
t AS (SELECT CASE WHEN relation = 'ASSIGNED_TO' THEN object_kind ELSE subject_kind END AS subject_kind, relation, CASE WHEN relation = 'ASSIGNED_TO' THEN subject_kind ELSE object_kind END AS object_kind FROM s)
SELECT *, CASE WHEN (subject_kind, relation, object_kind) IN (FROM a) THEN 'as_is' WHEN (object_kind, relation, subject_kind) IN (FROM a) THEN 'swapped' ELSE 'refused' END AS direction FROM t""")
def relation_direction(spark: SparkSession, d: str) -> DataFrame:
    s = base.facts(spark, d).select(F.col("from_label").alias("subject_kind"), F.col("rel_type").alias("relation"), F.col("to_label").alias("object_kind")).distinct()
    turned = F.col("relation") == "ASSIGNED_TO"
    t = s.select(F.when(turned, F.col("object_kind")).otherwise(F.col("subject_kind")).alias("subject_kind"), "relation", F.when(turned, F.col("subject_kind")).otherwise(F.col("object_kind")).alias("object_kind"))
    return resolve.direction(t, s.where("relation <> 'BLOCKS'"))


@query(f"""WITH {FACTS}, n AS (SELECT * FROM facts WHERE rel_type = 'PARENT_OF'), f AS (SELECT * FROM facts WHERE {LIVE})
SELECT n.fact_uid AS new_uid, f.fact_uid AS fact_uid FROM n JOIN f ON n.rel_type = f.rel_type AND n.to_uid = f.to_uid WHERE n.fact_uid <> f.fact_uid UNION SELECT n.fact_uid, f.fact_uid FROM n JOIN f ON n.rel_type = f.rel_type AND n.from_uid = f.from_uid WHERE n.fact_uid <> f.fact_uid""")
def conflict_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    live = f.where("invalid_at is null and coalesce(assertion_status, 'live') <> 'corrected'")
    return resolve.conflicts(f.where("rel_type = 'PARENT_OF'"), live, ("PARENT_OF",))


@query("SELECT l_suppkey AS absorbed, arg_max(l_partkey, ROW(l_shipdate, l_partkey)) AS survivor FROM lineitem GROUP BY 1")
def merged_into(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("absorbed"), F.col("l_partkey").alias("survivor"), F.col("l_shipdate").alias("at"))
    return resolve.merged_into(t)


@query()
def stated_dates(spark: SparkSession, d: str) -> DataFrame:
    """Start and end dates that comments of change requests state; tested case by case."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", dates.stated(F.col("text"), F.to_date("created_at")).alias("s"))
    return docs.select("doc_id", F.col("s.start").alias("start_date"), F.col("s.end").alias("end_date"), "s.unresolved")


@query()
def best_windows(spark: SparkSession, d: str) -> DataFrame:
    """The densest window of each document for the word ``report``; tested against brute force."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", windows.best_windows(F.col("text"), text.query_terms(F.lit("report missing record"))).alias("best_window"))


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each document's sentences packed into chunks of 500 tokens."""
    return windows.chunks(table(spark, d, "documents"), "doc_id", text.units(F.col("text")))


@query()
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with a name part like one of a few misspelt words."""
    people = table(spark, d, "jira_person").select(F.col("account_id").alias("id"), F.col("display_name").alias("name"))
    return windows.fuzzy_names(people, spark.createDataFrame([("hnrike",), ("valentine",), ("josephin",)], "word string"))


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '{NOW}' GROUP BY 1")
def events_before(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("ts").cast("timestamp") < ts(NOW)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
