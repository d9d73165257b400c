"""Queries on the graph: lists, neighbours, rules, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.functions import temporal, text
from bitempo.operators import graph, infer, reports
from bitempo.operators import facts as writes
from bitempo.plans import base
from bitempo.plans.base import AT, FACTS, ISSUES, LIVE, NODES, UNTIL, ts
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
    return base.facts(spark, d).where(temporal.live(F.col("invalid_at"), F.col("assertion_status"), F.lit("live")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return base.nodes(spark, d).where("label = 'WorkItem'")


@query(f"WITH {FACTS}, {NODES} SELECT uid FROM nodes WHERE label = 'WorkItem' AND uid NOT IN (SELECT from_uid FROM facts WHERE rel_type = 'ASSIGNED_TO' AND {LIVE} AND from_uid IS NOT NULL)")
def unassigned_items(spark: SparkSession, d: str) -> DataFrame:
    return graph.without(_items(spark, d), _live(spark, d), "ASSIGNED_TO").select("uid")


@query(f"WITH {ISSUES} SELECT issue_id, assignee.display_name AS person FROM issues WHERE assignee.account_id IN (SELECT account_id FROM jira_person WHERE lower(display_name) LIKE '%henrike%')")
def assigned_to(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "jira_person").where(F.lower("display_name").contains("henrike")).select("account_id").distinct()
    i = base.issues(spark, d).select("issue_id", F.col("assignee.display_name").alias("person"), F.col("assignee.account_id").alias("account_id"))
    return i.join(people, "account_id", "left_semi").select("issue_id", "person")


@query("""WITH c AS (SELECT DISTINCT repository_full_name, sha, authored_at FROM github_commit WHERE authored_at IS NOT NULL)
SELECT repository_full_name, sha, row_number() OVER (PARTITION BY repository_full_name ORDER BY authored_at DESC, sha DESC) AS rank FROM c QUALIFY rank <= 2""")
def latest_by_group(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "github_commit").where("authored_at is not null").select("repository_full_name", "sha", "authored_at").distinct()
    return graph.latest(c, ["repository_full_name"], ["authored_at", "sha"], 2).select("repository_full_name", "sha", F.col("rank").cast("long").alias("rank"))


@query("""WITH p AS (SELECT DISTINCT substr(sha, 1, 7) AS prefix FROM github_commit) SELECT DISTINCT prefix, commit_hash FROM bitbucket_commit, p WHERE starts_with(commit_hash, prefix)
UNION SELECT prefix, sha FROM github_commit, p WHERE starts_with(sha, prefix)""")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "github_commit").select(F.col("sha").alias("commit_hash"))
    p = g.select(F.substring("commit_hash", 1, 7).alias("prefix"))
    rows = g.unionByName(table(spark, d, "bitbucket_commit").select("commit_hash")).distinct()
    return graph.by_prefix(rows, "commit_hash", p, 7).select("prefix", "commit_hash")


@query(f"WITH {ISSUES} SELECT DISTINCT issue_id, issue_key FROM issues WHERE upper(issue_key) IN (SELECT upper(unnest(regexp_extract_all(message, '\\b([A-Z][A-Z0-9]{{1,11}}-[0-9]+)\\b', 1))) FROM github_commit)")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Issues whose key some commit message names."""
    keys = table(spark, d, "github_commit").select(F.explode(text.issue_keys(F.col("message"))).alias("k")).select(F.upper("k").alias("k")).distinct()
    i = base.issues(spark, d).select("issue_id", "issue_key", F.upper("issue_key").alias("k"))
    return i.join(keys, "k", "left_semi").select("issue_id", "issue_key").distinct()


@query(f"""WITH {FACTS}, f AS (SELECT from_uid AS uid, count(*) AS n FROM facts WHERE valid_at >= TIMESTAMP '{AT}' AND valid_at < TIMESTAMP '{UNTIL}' GROUP BY 1),
m AS (SELECT uid, count(*) AS n FROM (SELECT DISTINCT uid, k FROM (SELECT from_uid AS uid, unnest(source_record_keys) AS k FROM facts UNION ALL SELECT to_uid, unnest(source_record_keys) FROM facts) WHERE k IS NOT NULL) GROUP BY 1)
SELECT uid, f.n * m.n AS activity FROM f JOIN m USING (uid)""")
def window_activity(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    return graph.window_activity(f, writes.mentions(f), ts(AT), ts(UNTIL))


_SAME = r"""WITH RECURSIVE p AS (SELECT account_id AS id, lower(trim(regexp_replace(display_name, '\s+', ' ', 'g'))) AS n, lower(trim(email)) AS e FROM jira_person),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.n = b.n OR a.e = b.e) AND a.id <> b.id),
w AS (SELECT a AS uid, a AS r FROM pairs UNION SELECT pairs.b, w.r FROM w JOIN pairs ON w.uid = pairs.a) SELECT uid, min(r) AS cluster FROM w GROUP BY uid"""


@query(_SAME)
def same_as_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that share a name or an address, directly or through others.

    Accounts are tied to the smallest one of their name or address, so a name
    that many share makes as many edges, not pairs.
    """
    p = table(spark, d, "jira_person").select(F.col("account_id").alias("id"), F.lower(F.trim(F.regexp_replace("display_name", r"\s+", " "))).alias("n"), F.lower(F.trim("email")).alias("e"))
    edges = None
    for key in ("n", "e"):
        known = p.where(f"{key} is not null")
        part = known.join(known.groupBy(key).agg(F.min("id").alias("b")), key).select(F.col("id").alias("a"), "b")
        edges = part if edges is None else edges.unionByName(part)
    return graph.clusters(edges)


@query(f"""WITH {FACTS}, f AS (SELECT * FROM facts WHERE {LIVE}), a AS (SELECT DISTINCT from_uid AS n0, to_uid AS n1 FROM f WHERE rel_type = 'BLOCKS'), b AS (SELECT DISTINCT from_uid AS n1, to_uid AS n2 FROM f WHERE rel_type = 'PARENT_OF'),
c AS (SELECT DISTINCT from_uid AS n2, to_uid AS n3 FROM f WHERE rel_type = 'BELONGS_TO') SELECT n0, n1, n2, n3 FROM a JOIN b USING (n1) JOIN c USING (n2)""")
def four_node_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.path(_live(spark, d), ["BLOCKS", "PARENT_OF", "BELONGS_TO"])


@query(f"""WITH {FACTS}, {NODES}, f AS (SELECT *, ascii(substr(fact_uid, 1, 1)) % 2 = 0 AS derived FROM facts WHERE {LIVE} AND ascii(substr(fact_uid, 1, 1)) % 4 <> 3 AND rel_type IN ('PARENT_OF', 'BLOCKS', 'REPORTED_BY')),
x AS (SELECT from_uid AS seed, to_uid AS neighbour, rel_type, derived FROM f UNION ALL SELECT to_uid, from_uid, rel_type, derived FROM f),
y AS (SELECT seed, neighbour, min(ROW(derived, rel_type)) AS m FROM x WHERE seed <> neighbour AND seed IN (SELECT uid FROM nodes WHERE label = 'WorkItem') AND neighbour IN (SELECT uid FROM nodes WHERE label NOT IN ('Repository','Project','Workspace','Person','SourceRecord')) GROUP BY ALL)
SELECT seed, neighbour, m[2] AS rel_type, row_number() OVER (PARTITION BY seed ORDER BY m[1], m[2], neighbour) AS rank FROM y QUALIFY rank <= 4""")
def expand_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by facts of some authority: a quarter of the facts have an unknown method and are not followed."""
    k = F.ascii(F.substring("fact_uid", 1, 1))
    method = F.when(k % 4 == 0, "derived").when(k % 4 == 1, "llm").when(k % 4 == 2, "deterministic").otherwise("guess")
    f = _live(spark, d).withColumn("derived", k % 2 == 0).withColumn("extraction_method", method)
    out = graph.expand(f, base.nodes(spark, d), _items(spark, d).select(F.col("uid").alias("seed")), ("PARENT_OF", "BLOCKS", "REPORTED_BY"))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {FACTS}, r AS (SELECT DISTINCT k FROM (SELECT unnest(source_record_keys) AS k FROM facts) WHERE k LIKE 'jira:%'),
m AS (SELECT from_uid AS uid, unnest(source_record_keys) AS k FROM facts UNION ALL SELECT to_uid, unnest(source_record_keys) FROM facts), v AS (SELECT DISTINCT uid FROM m WHERE k IN (FROM r)),
b AS (SELECT DISTINCT fact_uid FROM (SELECT fact_uid, unnest(source_record_keys) AS k FROM facts WHERE {LIVE}) WHERE k IN (FROM r))
SELECT fact_uid FROM facts WHERE {LIVE} AND fact_uid IN (FROM b) AND from_uid IN (FROM v) AND to_uid IN (FROM v)""")
def visible_graph(spark: SparkSession, d: str) -> DataFrame:
    """Live facts that a reader of some records may see between nodes that they may see."""
    f = base.facts(spark, d)
    records = f.select(F.explode("source_record_keys").alias("record_key")).where(F.col("record_key").startswith("jira:"))
    _, shown = graph.visible(base.nodes(spark, d), _live(spark, d), writes.mentions(f), records)
    return shown.select("fact_uid")


_TWO = f"""WITH {FACTS}, {NODES}, e AS (SELECT from_uid AS x, to_uid AS z FROM facts WHERE {LIVE} UNION ALL SELECT to_uid, from_uid FROM facts WHERE {LIVE}), ee AS (SELECT * FROM e WHERE x IS NOT NULL AND z IS NOT NULL AND x <> z),
mm AS (SELECT from_uid AS z, unnest(source_record_keys) AS k FROM facts UNION SELECT to_uid, unnest(source_record_keys) FROM facts), c AS (SELECT z FROM (SELECT z FROM ee UNION ALL SELECT z FROM mm WHERE z IS NOT NULL AND k IS NOT NULL) GROUP BY z HAVING count(*) <= 50), arms AS (SELECT DISTINCT x, z FROM ee WHERE z IN (FROM c) AND z IN (SELECT uid FROM nodes WHERE label = 'WorkItem')),
p AS (SELECT a.x AS a, b.x AS b, count(*) AS shared FROM arms a JOIN arms b USING (z) WHERE a.x < b.x GROUP BY ALL)
SELECT a, b, shared FROM p WHERE (a, b) NOT IN (SELECT least(x, z), greatest(x, z) FROM ee)"""


@query(_TWO)
def two_hop_candidates(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hop(_live(spark, d), _items(spark, d), mentions=writes.mentions(base.facts(spark, d)))


@query("""SELECT l_orderkey AS path, round(exp(avg(ln(greatest(0.01, l_discount * 10)))), 6) AS support, exp(avg(ln(greatest(0.01, l_discount * 10)))) < 0.4 AS low FROM lineitem GROUP BY 1""")
def path_support(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_discount") * 10).alias("support"))
    return graph.path_support(pairs).withColumn("support", F.round("support", 6))


def _chain(spark: SparkSession, d: str) -> DataFrame:
    """Blocking work items as edges, dated and with confidence."""
    return base.facts(spark, d).where("rel_type in ('BLOCKS', 'PARENT_OF') and from_uid is not null and to_uid is not null").select("from_uid", "to_uid", "valid_at", "invalid_at", "confidence")


_CLOSE = f"""WITH RECURSIVE {FACTS}, e AS (SELECT DISTINCT from_uid AS a, to_uid AS b FROM facts WHERE rel_type IN ('BLOCKS', 'PARENT_OF') AND from_uid <> to_uid),
w AS (SELECT a, b, 1 AS depth FROM e UNION SELECT w.a, e.b, depth + 1 FROM w JOIN e ON w.b = e.a WHERE depth < 4 AND w.a <> e.b)
SELECT a AS from_uid, b AS to_uid, min(depth) AS depth FROM w WHERE (a, b) NOT IN (FROM e) GROUP BY ALL"""


@query(_CLOSE)
def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    """Pairs up to four steps apart (undated, so that every chain counts)."""
    never = F.lit(None).cast("timestamp")
    e = _chain(spark, d).withColumn("valid_at", never).withColumn("invalid_at", never)
    return infer.transitive_closure(e, 4).select("from_uid", "to_uid", "depth")


_DATED = f"""WITH RECURSIVE {FACTS}, e AS (SELECT from_uid AS a, to_uid AS b, valid_at AS s, invalid_at AS t, max(confidence) AS c FROM facts WHERE rel_type IN ('BLOCKS', 'PARENT_OF') AND from_uid <> to_uid GROUP BY ALL),
w AS (SELECT a, b, s, t, c, 1 AS depth FROM e UNION SELECT w.a, e.b, greatest(w.s, e.s), least(w.t, e.t), least(w.c, e.c), depth + 1 FROM w JOIN e ON w.b = e.a
  WHERE depth < 8 AND w.a <> e.b AND coalesce(greatest(w.s, e.s) < least(w.t, e.t), true)), d AS (SELECT a, b, min(depth) AS depth FROM w WHERE (a, b) NOT IN (SELECT a, b FROM e) GROUP BY ALL)
SELECT a AS from_uid, b AS to_uid, depth, round(max(c), 6) AS confidence FROM w JOIN d USING (a, b, depth) GROUP BY ALL"""


@query(_DATED)
def closure_dated(spark: SparkSession, d: str) -> DataFrame:
    """What chains of full depth conclude while all of their links hold, and how surely."""
    return infer.transitive_closure(_chain(spark, d)).select("from_uid", "to_uid", "depth", F.round("confidence", 6).alias("confidence"))


@query(_DATED.split("SELECT a AS from_uid, b AS to_uid, depth")[0] + "SELECT DISTINCT ON (a, b) a AS from_uid, b AS to_uid, depth, coalesce(epoch_ms(s), -1) AS from_ms, coalesce(epoch_ms(t), -1) AS to_ms FROM w JOIN d USING (a, b, depth) ORDER BY a, b, c DESC, s DESC NULLS LAST, t DESC NULLS LAST")
def transitive_closure_dated(spark: SparkSession, d: str) -> DataFrame:
    """The same with the period of each conclusion."""
    ms = lambda c: F.coalesce(F.unix_millis(c), F.lit(-1))
    return infer.transitive_closure(_chain(spark, d)).select("from_uid", "to_uid", "depth", ms("valid_at").alias("from_ms"), ms("invalid_at").alias("to_ms"))


@query(f"WITH {FACTS}, e AS (SELECT DISTINCT from_uid, to_uid FROM facts WHERE rel_type = 'BLOCKS') SELECT DISTINCT to_uid AS from_uid, from_uid AS to_uid FROM e WHERE from_uid <> to_uid AND (to_uid, from_uid) NOT IN (FROM e)")
def symmetric_closure(spark: SparkSession, d: str) -> DataFrame:
    return infer.symmetric_closure(base.facts(spark, d).where("rel_type = 'BLOCKS'"))


@query(f"WITH {FACTS} SELECT DISTINCT to_uid AS from_uid, 'BLOCKED_BY' AS rel_type, from_uid AS to_uid, confidence FROM facts WHERE rel_type = 'BLOCKS'")
def inverse_rule(spark: SparkSession, d: str) -> DataFrame:
    return infer.inverse(base.facts(spark, d).where("rel_type = 'BLOCKS'"), "BLOCKED_BY")


@query(f"WITH {FACTS} SELECT DISTINCT from_uid, 'INVOLVES' AS rel_type, to_uid, confidence FROM facts WHERE rel_type IN ('ASSIGNED_TO', 'REPORTED_BY')")
def sub_property_rule(spark: SparkSession, d: str) -> DataFrame:
    return infer.sub_property(base.facts(spark, d).where("rel_type in ('ASSIGNED_TO', 'REPORTED_BY')"), "INVOLVES")


@query(f"""WITH {FACTS}, f AS (SELECT * FROM facts WHERE {LIVE}) SELECT p.to_uid AS from_uid, c.to_uid AS to_uid, count(*) AS premises FROM f c JOIN f p ON c.from_uid = p.from_uid
WHERE c.rel_type = 'BELONGS_TO' AND p.rel_type = 'PARENT_OF' AND p.to_uid NOT IN (SELECT from_uid FROM f WHERE rel_type = 'BELONGS_TO') GROUP BY ALL""")
def derived_lift(spark: SparkSession, d: str) -> DataFrame:
    f = _live(spark, d)
    own = f.where("rel_type = 'BELONGS_TO'")
    return infer.lift(own, f.where("rel_type = 'PARENT_OF'"), own)


@query(f"""WITH {FACTS}, f AS (SELECT * FROM facts WHERE {LIVE}) SELECT a.from_uid, b.to_uid, count(*) AS premises FROM f a JOIN f b ON a.to_uid = b.from_uid
WHERE a.rel_type = 'BLOCKS' AND b.rel_type = 'ASSIGNED_TO' AND a.from_uid <> b.to_uid AND (a.from_uid, b.to_uid) NOT IN (SELECT from_uid, to_uid FROM f WHERE rel_type = 'ASSIGNED_TO') GROUP BY ALL""")
def derived_via(spark: SparkSession, d: str) -> DataFrame:
    f = _live(spark, d)
    own = f.where("rel_type = 'ASSIGNED_TO'")
    return infer.via(f.where("rel_type = 'BLOCKS'"), own, own)


@query(f"""WITH {FACTS}, {NODES}, u AS (SELECT DISTINCT from_uid FROM facts WHERE {LIVE} AND rel_type = 'ASSIGNED_TO'), v AS (SELECT DISTINCT from_uid FROM facts WHERE {LIVE} AND rel_type = 'BELONGS_TO')
SELECT 'WorkItem' AS label, 'ASSIGNED_TO' AS relation, count(*) AS total, count(*) FILTER (WHERE uid NOT IN (FROM u)) AS isolated FROM nodes WHERE label = 'WorkItem'
UNION ALL SELECT 'WorkItem', 'BELONGS_TO', count(*), count(*) FILTER (WHERE uid NOT IN (FROM v)) FROM nodes WHERE label = 'WorkItem'""")
def isolation_report(spark: SparkSession, d: str) -> DataFrame:
    f, n = _live(spark, d), base.nodes(spark, d)
    out = [reports.isolation(n, f, r, "WorkItem").withColumn("relation", F.lit(r)) for r in ("ASSIGNED_TO", "BELONGS_TO")]
    return out[0].unionByName(out[1]).select("label", "relation", "total", "isolated")


@query(f"""WITH {FACTS}, {NODES}, x AS (SELECT from_uid AS uid, rel_type FROM facts WHERE {LIVE} UNION ALL SELECT to_uid, rel_type FROM facts WHERE {LIVE}), g AS (SELECT uid, count(*) AS n, max(rel_type) AS r FROM x GROUP BY 1)
SELECT 'Person' AS label, count(*) AS total, count(*) FILTER (WHERE n = 1 AND r = 'REPORTED_BY') AS isolated FROM nodes LEFT JOIN g USING (uid) WHERE label = 'Person'""")
def degree_one_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.degree_one(base.nodes(spark, d), _live(spark, d), "Person", "REPORTED_BY")


@query(f"WITH {FACTS} SELECT from_uid, rel_type, count(DISTINCT to_uid) AS objects FROM facts WHERE {LIVE} AND rel_type IN ('ASSIGNED_TO','BELONGS_TO','REPORTED_BY') AND from_uid IS NOT NULL GROUP BY ALL HAVING objects > 1")
def cardinality_violations(spark: SparkSession, d: str) -> DataFrame:
    return reports.cardinality_violations(_live(spark, d), ("ASSIGNED_TO", "BELONGS_TO", "REPORTED_BY"))


_DROPS = """drops AS (SELECT repository_full_name AS record_key, 'Commit' AS subject_kind, 'TOUCHES_' || upper(coalesce(file_language, 'other')) AS relation, 'SourceFile' AS object_kind, commit_hash AS subject_name, path AS object_name FROM bitbucket_file)"""


@query(f"""WITH {_DROPS} SELECT subject_kind, relation, object_kind, count(DISTINCT record_key) AS records, count(*) AS facts, min(subject_name || ' > ' || object_name) AS example FROM drops
WHERE lower(subject_name) <> lower(object_name) AND relation NOT IN ('TOUCHES_SQL', 'TOUCHES_JSON') GROUP BY ALL HAVING records >= 2 AND facts >= 3""")
def adoption_candidates(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bitbucket_file")
    relation = F.concat(F.lit("TOUCHES_"), F.upper(F.coalesce("file_language", F.lit("other"))))
    drops = b.select(F.col("repository_full_name").alias("record_key"), F.lit("Commit").alias("subject_kind"), relation.alias("relation"), F.lit("SourceFile").alias("object_kind"), F.col("commit_hash").alias("subject_name"), F.col("path").alias("object_name"))
    shape = drops.select("subject_kind", "relation", "object_kind")
    return reports.adoption_candidates(drops, shape.where("relation = 'TOUCHES_SQL'"), shape.where("relation = 'TOUCHES_JSON'"))


@query("""WITH c AS (SELECT entity_type AS kind0, CASE doc_id % 4 WHEN 0 THEN 'noise' WHEN 1 THEN 'discussion' WHEN 2 THEN 'decision' ELSE 'scheduling' END AS kind, (doc_id % 100) / 100.0 AS p, length(text) % 7 AS facts FROM documents)
SELECT kind, count(*) AS chunks, count(*) FILTER (WHERE kind IN ('noise','scheduling') OR (kind = 'discussion' AND p < 0.3) OR p < 0.15) AS skipped,
CAST(coalesce(sum(facts) FILTER (WHERE kind IN ('noise','scheduling') OR (kind = 'discussion' AND p < 0.3) OR p < 0.15), 0) AS BIGINT) AS lost_facts FROM c GROUP BY kind""")
def triage_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "noise").when(k == 1, "discussion").when(k == 2, "decision").otherwise("scheduling")
    c = table(spark, d, "documents").select(kind.alias("kind"), ((F.col("doc_id") % 100) / 100).alias("probability"), (F.length("text") % 7).alias("facts"))
    return reports.triage(c)


@query("""SELECT source, count(*) AS chunks, count(*) FILTER (WHERE text IS NULL) AS empty_, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars <> length(text)) AS wrong_size, count(*) FILTER (WHERE record_key IS NULL) AS unlinked FROM documents GROUP BY ALL""")
def chunk_resolution_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), n(F.col("text").isNull()).alias("empty_"), n(F.col("lang") == "en").alias("english"), n(F.col("n_chars") != F.length("text")).alias("wrong_size"), n(F.col("record_key").isNull()).alias("unlinked"))


_REV = "r AS (SELECT rater AS kind, CASE doc_id % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' ELSE 'approved' END AS state FROM doc_label)"


@query(f"""WITH {_REV}, c AS (SELECT kind, count(*) FILTER (WHERE state = 'approved') AS approved, count(*) FILTER (WHERE state = 'rejected') AS rejected FROM r GROUP BY kind)
SELECT kind, approved, rejected, round(CASE WHEN approved + rejected > 0 THEN approved / (approved + rejected) ELSE -1 END, 6) AS precision,
CASE WHEN approved + rejected < 20 THEN 'too few' WHEN approved / (approved + rejected) >= 0.9 THEN 'trusted' WHEN approved / (approved + rejected) >= 0.7 THEN 'usable' ELSE 'weak' END AS verdict FROM c""")
def review_precision(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    r = table(spark, d, "doc_label").select(F.col("rater").alias("kind"), F.when(k == 0, "rejected").when(k == 1, "pending").otherwise("approved").alias("state"))
    return reports.review_precision(r).withColumn("precision", F.round("precision", 6))


@query(f"""WITH {FACTS}, b AS (SELECT least(9, floor(confidence * 10)) AS b, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN assertion_status = 'live' THEN 1.0 ELSE 0.0 END) AS a FROM facts WHERE confidence IS NOT NULL AND assertion_status IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b""")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    p = base.facts(spark, d).select("confidence", (F.col("assertion_status") == "live").alias("correct"))
    return reports.calibration_error(p).select("n", F.round("ece", 6).alias("ece"))


_CASES = """a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
g AS (SELECT user_id, list(event_id ORDER BY r) FILTER (WHERE r <= 8) AS got, list(event_id) FILTER (WHERE event_type = 'purchase') AS want FROM a GROUP BY 1)"""


@query(f"""WITH {_CASES}, h AS (SELECT user_id, CAST(len(list_intersect(got, coalesce(want, []))) AS DOUBLE) AS hits, len(got) AS ng, len(coalesce(want, [])) AS nw, list_min([i FOR i IN range(1, len(got) + 1) IF list_contains(coalesce(want, []), got[i])]) AS first_ FROM g)
SELECT user_id AS q, round(CASE WHEN ng > 0 THEN hits / ng ELSE 0 END, 6) AS precision, round(CASE WHEN nw > 0 THEN hits / nw ELSE 0 END, 6) AS recall, round(coalesce(1.0 / first_, 0), 6) AS reciprocal_rank FROM h""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A user's purchases as expected answers, their most valuable events as retrieved ones."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 8, F.struct("r", "event_id")))), lambda x: x["event_id"])
    cases = e.groupBy(F.col("user_id").alias("q")).agg(top.alias("retrieved"), F.collect_list(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("expected"))
    return reports.retrieval_scores(cases).select("q", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


@query("SELECT event_type, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return reports.nearest_rank(table(spark, d, "events"), ["event_type"], "value", 0.9)


@query("""SELECT event_type AS kind, CAST(user_id % 50 AS VARCHAR) AS key, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s, CAST(min_by(event_id, (ts, CAST(event_id AS VARCHAR))) AS VARCHAR) AS example FROM events GROUP BY ALL""")
def miss_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters kept from one half of the events, with the other half added."""
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 50).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("string").alias("example"))
    none = e.select("kind", "key", F.lit(0).cast("long").alias("n"), F.col("at").alias("first_at"), F.col("at").alias("last_at"), "example").limit(0)
    half = F.crc32("example") % 2 == 0
    out = reports.counters(reports.counters(none, e.where(half)), e.where(~half))
    return out.select("kind", "key", "n", F.unix_seconds("first_at").alias("first_s"), F.unix_seconds("last_at").alias("last_s"), "example")
