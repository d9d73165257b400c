"""Queries on facts in time: predicates, writes, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.functions import temporal, text
from bitempo.functions.access import Scope
from bitempo.functions.ids import make_uid, uuid5
from bitempo.operators import changes, facts
from bitempo.plans import base
from bitempo.plans.base import AS_OF, AT, FACTS, ISSUES, LIVE, NODES, NOW, UNTIL, ts
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


def _live():
    return temporal.live(F.col("invalid_at"), F.col("assertion_status"), F.lit("live"))


@query(f"WITH {FACTS} SELECT fact_uid, from_uid, rel_type, to_uid FROM facts WHERE {LIVE}")
def live_facts(spark: SparkSession, d: str) -> DataFrame:
    return base.facts(spark, d).where(_live()).select("fact_uid", "from_uid", "rel_type", "to_uid")


@query(f"WITH {FACTS} SELECT fact_uid FROM facts WHERE (valid_at IS NOT NULL OR invalid_at IS NOT NULL) AND coalesce(valid_at <= TIMESTAMP '{AT}', true) AND coalesce(invalid_at > TIMESTAMP '{AT}', true)")
def world_time_point(spark: SparkSession, d: str) -> DataFrame:
    return base.facts(spark, d).where(temporal.holds_at(F.col("valid_at"), F.col("invalid_at"), ts(AT))).select("fact_uid")


@query(f"WITH {FACTS} SELECT fact_uid FROM facts WHERE valid_at >= TIMESTAMP '{AT}' AND valid_at < TIMESTAMP '{UNTIL}'")
def world_time_window_event(spark: SparkSession, d: str) -> DataFrame:
    return base.facts(spark, d).where(temporal.holds_at(F.col("valid_at"), F.col("invalid_at"), ts(AT), ts(UNTIL), "event")).select("fact_uid")


@query(f"WITH {FACTS} SELECT fact_uid FROM facts WHERE (valid_at IS NOT NULL OR invalid_at IS NOT NULL) AND coalesce(valid_at < TIMESTAMP '{UNTIL}', true) AND coalesce(invalid_at > TIMESTAMP '{AT}', true)")
def world_time_window_state(spark: SparkSession, d: str) -> DataFrame:
    return base.facts(spark, d).where(temporal.holds_at(F.col("valid_at"), F.col("invalid_at"), ts(AT), ts(UNTIL))).select("fact_uid")


@query(f"WITH {FACTS} SELECT fact_uid FROM facts WHERE observed_at <= TIMESTAMP '{AS_OF}'")
def record_time_as_of(spark: SparkSession, d: str) -> DataFrame:
    never = F.lit(None).cast("timestamp")
    return base.facts(spark, d).where(temporal.held_at(F.col("observed_at"), never, ts(AS_OF))).select("fact_uid")


@query(f"""WITH {FACTS} SELECT from_uid, rel_type, count(*) AS facts, CAST(sum(CASE WHEN {LIVE} THEN 1 ELSE 0 END) AS BIGINT) AS live
FROM facts WHERE observed_at <= TIMESTAMP '{AS_OF}' AND (valid_at IS NOT NULL OR invalid_at IS NOT NULL) AND coalesce(valid_at <= TIMESTAMP '{AT}', true) AND coalesce(invalid_at > TIMESTAMP '{AT}', true) GROUP BY ALL""")
def bitemporal_entity(spark: SparkSession, d: str) -> DataFrame:
    """Per entity and relation: what held at an instant, as known at another."""
    f = base.facts(spark, d)
    seen = temporal.held_at(F.col("observed_at"), F.lit(None).cast("timestamp"), ts(AS_OF)) & temporal.holds_at(F.col("valid_at"), F.col("invalid_at"), ts(AT))
    return f.where(seen).groupBy("from_uid", "rel_type").agg(F.count(F.lit(1)).alias("facts"), F.sum(_live().cast("int")).cast("long").alias("live"))


@query(f"""WITH {FACTS}, gone AS (SELECT *, TIMESTAMP '{NOW}' AS seen_to FROM facts WHERE rel_type = 'BELONGS_TO' AND {LIVE})
SELECT fact_uid, coalesce(epoch_ms(valid_at), -1) AS from_ms, epoch_ms(seen_to) AS to_ms, 'archived' AS state FROM gone
UNION ALL SELECT fact_uid, coalesce(epoch_ms(valid_at), -1), coalesce(epoch_ms(CASE WHEN rel_type = 'BELONGS_TO' AND {LIVE} THEN TIMESTAMP '{NOW}' ELSE invalid_at END), -1), 'current' FROM facts""")
def fact_history_union(spark: SparkSession, d: str) -> DataFrame:
    """Archived periods and current ones, after a relation was superseded for all subjects."""
    f = base.facts(spark, d)
    closed, old = facts.supersede(f, "BELONGS_TO", f, ts(NOW))
    ms = lambda c: F.coalesce(F.unix_millis(F.col(c)), F.lit(-1))
    archived = old.select("fact_uid", ms("valid_from").alias("from_ms"), ms("valid_to").alias("to_ms"), F.lit("archived").alias("state"))
    return archived.unionByName(closed.select("fact_uid", ms("valid_at").alias("from_ms"), ms("invalid_at").alias("to_ms"), F.lit("current").alias("state")))


@query("""SELECT record_key FROM documents WHERE (source = 'jira' AND record_key LIKE 'jira:c0:%') OR (source = 'notion' AND record_key LIKE 'notion:c0:%') OR lang = 'fr' OR coalesce(namespace_uid = 'ns-alder', false)""")
def acl_visible_records(spark: SparkSession, d: str) -> DataFrame:
    scope = Scope.of([("Jira", "c0"), ("notion", " c0"), ("jira", "c0")], principals=["fr"])
    seen = scope.allows(F.col("source"), F.split("record_key", ":")[1], F.col("record_key"), F.array("lang"), F.col("namespace_uid") == "ns-alder")
    return table(spark, d, "documents").where(seen).select("record_key")


@query("SELECT count(*) AS records FROM documents WHERE false")
def acl_nothing_granted(spark: SparkSession, d: str) -> DataFrame:
    scope = Scope(public=False)
    seen = scope.allows(F.col("source"), F.lit("c0"), F.col("record_key"), F.array("lang"), F.lit(True))
    return table(spark, d, "documents").where(seen).agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT uid, label FROM (SELECT from_uid AS uid, from_label AS label FROM edge UNION SELECT to_uid, to_label FROM edge) WHERE uid IS NOT NULL AND label IN ('Person','Project')""")
def labelled_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edge")
    ends = e.select(F.col("from_uid").alias("uid"), F.col("from_label").alias("label")).union(e.select("to_uid", "to_label"))
    return ends.where("uid is not null").where(F.col("label").isin("Person", "Project")).distinct()


@query("""WITH a AS (SELECT issue_id AS k, md5(coalesce(max_by(content, updated_at), '')) AS h FROM jira_issue WHERE updated_at < TIMESTAMP '2024-01-01' GROUP BY 1),
b AS (SELECT issue_id AS k, md5(coalesce(max_by(content, updated_at), '')) AS h FROM jira_issue WHERE created_at >= TIMESTAMP '2021-01-01' GROUP BY 1)
SELECT k AS record_key, CASE WHEN b.h IS NULL THEN 'delete' WHEN a.h IS NULL THEN 'insert' WHEN a.h = b.h THEN 'keep' ELSE 'update' END AS action FROM a FULL JOIN b USING (k)""")
def record_actions(spark: SparkSession, d: str) -> DataFrame:
    """Insert, update, keep or delete of each issue between a stored and a newer state."""
    j = table(spark, d, "jira_issue").where("issue_id is not null")
    state = lambda df: df.groupBy(F.col("issue_id").alias("record_key")).agg(changes.content_hash(F.max_by("content", "updated_at")).alias("content_hash"))
    return changes.plan(state(j.where("updated_at < timestamp_ntz'2024-01-01 00:00:00'")), state(j.where("created_at >= timestamp_ntz'2021-01-01 00:00:00'")))


@query("""WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents WHERE text IS NOT NULL),
o AS (SELECT DISTINCT doc_id, md5(p) AS c FROM u), n AS (SELECT DISTINCT doc_id, md5(regexp_replace(p, 'March', 'April', 'g')) AS c FROM u)
SELECT doc_id, CASE WHEN n.c IS NULL THEN 'superseded' WHEN o.c IS NULL THEN 'added' ELSE 'kept' END AS state, count(*) AS chunks
FROM o FULL JOIN n USING (doc_id, c) GROUP BY ALL""")
def chunk_diff(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs kept, added and superseded when the documents are read again, edited."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("record_key"), F.explode(F.split("text", "\n\n")).alias("p"))
    old = docs.select("record_key", F.md5("p").alias("chunk_id"))
    new = docs.select("record_key", F.md5(F.regexp_replace("p", "March", "April")).alias("chunk_id"))
    return changes.chunk_diff(old, new).groupBy(F.col("record_key").alias("doc_id"), "state").agg(F.count(F.lit(1)).alias("chunks"))


_UP = f"""WITH {FACTS}, batch AS (SELECT DISTINCT ON (from_uid, to_uid) from_uid, to_uid, ['r:' || substr(to_uid, 1, 8)] AS k FROM facts WHERE rel_type = 'PARENT_OF' ORDER BY from_uid, to_uid),
old AS (SELECT DISTINCT ON (from_uid, rel_type, to_uid) * FROM facts WHERE rel_type IN ('PARENT_OF', 'BLOCKS') AND from_uid IS NOT NULL AND to_uid IS NOT NULL AND NOT (rel_type = 'PARENT_OF' AND confidence < 0.8)
  ORDER BY from_uid, rel_type, to_uid, fact_uid),
both_ AS (SELECT coalesce(o.from_uid, n.from_uid) AS from_uid, coalesce(o.rel_type, 'PARENT_OF') AS rel_type, coalesce(o.to_uid, n.to_uid) AS to_uid, o.fact_uid, o.valid_at, o.source_record_keys AS ok, n.k AS nk
  FROM old o FULL JOIN batch n ON o.from_uid = n.from_uid AND o.to_uid = n.to_uid AND o.rel_type = 'PARENT_OF')
SELECT from_uid, rel_type, to_uid, CASE WHEN fact_uid IS NULL THEN 'new' ELSE 'old' END AS origin, epoch_ms(CASE WHEN fact_uid IS NULL THEN TIMESTAMP '{NOW}' ELSE valid_at END) AS valid_ms,
  CAST(CASE WHEN fact_uid IS NULL THEN 1 WHEN nk IS NULL OR list_contains(coalesce(ok, []), nk[1]) THEN coalesce(len(ok), 0) ELSE coalesce(len(ok), 0) + 1 END AS BIGINT) AS records FROM both_"""


@query(_UP)
def fact_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a batch are made, or confirmed where they are known."""
    f = base.facts(spark, d).where("from_uid is not null and to_uid is not null")
    old = f.where("rel_type in ('PARENT_OF', 'BLOCKS') and not (rel_type = 'PARENT_OF' and confidence < 0.8)")
    rest = [c for c in f.columns if c not in facts.KEY]
    old = old.groupBy(*facts.KEY).agg(F.min_by(F.struct(*rest), "fact_uid").alias("s")).select(*facts.KEY, "s.*")
    batch = f.where("rel_type = 'PARENT_OF'").select("from_uid", "rel_type", "to_uid", F.array(F.concat(F.lit("r:"), F.substring("to_uid", 1, 8))).alias("source_record_keys"))
    known = old.select("fact_uid", F.lit(True).alias("_o"))
    out = facts.upsert(old, batch, ts(NOW)).join(known, "fact_uid", "left")
    return out.select(*facts.KEY, F.when(F.col("_o"), "old").otherwise("new").alias("origin"), F.unix_millis("valid_at").alias("valid_ms"), F.coalesce(F.size("source_record_keys"), F.lit(0)).cast("long").alias("records"))


@query(f"""WITH {FACTS} SELECT fact_uid, coalesce(epoch_ms(CASE WHEN rel_type = 'ASSIGNED_TO' AND from_uid IS NOT NULL AND {LIVE} THEN TIMESTAMP '{NOW}' ELSE invalid_at END), -1) AS ended_ms FROM facts""")
def fact_supersede(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    closed, _ = facts.supersede(f, "ASSIGNED_TO", f, ts(NOW))
    return closed.select("fact_uid", F.coalesce(F.unix_millis("invalid_at"), F.lit(-1)).alias("ended_ms"))


@query(f"""WITH {FACTS}, gone AS (SELECT DISTINCT k FROM (SELECT unnest(source_record_keys) AS k FROM facts WHERE confidence < 0.6) WHERE k IS NOT NULL),
lost AS (SELECT fact_uid, list(DISTINCT k) AS ks FROM (SELECT fact_uid, unnest(source_record_keys) AS k FROM facts) JOIN gone USING (k) GROUP BY 1),
x AS (SELECT f.*, CAST(len(list_distinct([k for k in f.source_record_keys if NOT list_contains(coalesce(l.ks, []), k)])) AS BIGINT) AS rest, l.fact_uid IS NOT NULL AS hit FROM facts f LEFT JOIN lost l USING (fact_uid))
SELECT fact_uid, CASE WHEN hit THEN rest ELSE coalesce(len(source_record_keys), 0) END AS records, coalesce(epoch_ms(CASE WHEN hit AND rest = 0 AND invalid_at IS NULL THEN TIMESTAMP '{NOW}' ELSE invalid_at END), -1) AS ended_ms FROM x""")
def support_removal(spark: SparkSession, d: str) -> DataFrame:
    """Facts after some records are gone: those without any record left end."""
    f = base.facts(spark, d)
    gone = f.where("confidence < 0.6").select(F.explode("source_record_keys").alias("record_key"))
    out, _ = facts.remove_support(f, gone, ts(NOW))
    return out.select("fact_uid", F.coalesce(F.size("source_record_keys"), F.lit(0)).cast("long").alias("records"), F.coalesce(F.unix_millis("invalid_at"), F.lit(-1)).alias("ended_ms"))


@query(f"""WITH {FACTS} SELECT fact_uid, coalesce(epoch_ms(CASE WHEN rel_type = 'BLOCKS' AND {LIVE} AND valid_at < TIMESTAMP '{AT}' THEN TIMESTAMP '{AT}' WHEN rel_type = 'PARENT_OF' AND confidence < 0.6 AND {LIVE} THEN valid_at ELSE invalid_at END), -1) AS ended_ms,
CASE WHEN rel_type = 'PARENT_OF' AND confidence < 0.6 AND {LIVE} THEN 'corrected' ELSE assertion_status END AS status FROM facts""")
def fact_close_correct(spark: SparkSession, d: str) -> DataFrame:
    """Facts of one relation closed at an instant, and some of another corrected."""
    f = base.facts(spark, d)
    out, _ = facts.close(f, f.where(f"rel_type = 'BLOCKS' and valid_at < '{AT}'").select("fact_uid", ts(AT).alias("valid_to")), ts(NOW))
    out, _ = facts.correct(out, f.where(_live() & F.expr("rel_type = 'PARENT_OF' and confidence < 0.6")), ts(NOW))
    return out.select("fact_uid", F.coalesce(F.unix_millis("invalid_at"), F.lit(-1)).alias("ended_ms"), F.col("assertion_status").alias("status"))


@query(f"""WITH {FACTS}, m AS (SELECT from_uid AS uid, unnest(source_record_keys) AS record_key FROM facts UNION SELECT to_uid, unnest(source_record_keys) FROM facts)
SELECT DISTINCT uid, record_key FROM m WHERE uid IS NOT NULL AND record_key IS NOT NULL""")
def mentioned_in(spark: SparkSession, d: str) -> DataFrame:
    return facts.mentions(base.facts(spark, d))


@query(f"WITH {FACTS}, {NODES} SELECT uid, label FROM nodes WHERE uid NOT IN (SELECT uid FROM entity_embeddings WHERE uid IS NOT NULL)")
def node_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Ends of facts that no entity row stands for."""
    return facts.stubs(base.facts(spark, d), table(spark, d, "entity_embeddings"))


@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal >= 0), b AS (SELECT c_custkey, CASE WHEN c_acctbal < 5000 THEN lower(c_mktsegment) END AS seg FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'customer:' || coalesce(c.c_custkey, b.c_custkey) AS uid, coalesce(b.seg, c.c_mktsegment) AS name, c.c_custkey IS NULL AS made FROM c FULL JOIN b USING (c_custkey)""")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A null of the batch never overwrites; new entities are made."""
    c = table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("uid"), "c_acctbal", F.col("c_mktsegment").alias("name"))
    nodes = c.where("c_acctbal >= 0").select("uid", "name", ts(AT).alias("first_seen_at"), ts(AT).alias("last_seen_at"))
    batch = c.where("name <> 'BUILDING'").select("uid", F.when(F.col("c_acctbal") < 5000, F.lower("name")).alias("name"))
    return facts.upsert_nodes(nodes, batch, ts(NOW)).select("uid", "name", (F.col("first_seen_at") == ts(NOW)).alias("made"))


_STATUS = f"""WITH {ISSUES}, c AS (SELECT DISTINCT ON (change_id) * FROM jira_change ORDER BY change_id, ingested_at DESC NULLS LAST, changed_at DESC NULLS LAST, to_string DESC NULLS LAST, from_string DESC NULLS LAST),
t AS (SELECT issue_id AS item, change_id AS seq, from_string AS f, to_string AS v, try_cast(regexp_extract(changed_at, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}') AS TIMESTAMP) AS t0 FROM c WHERE lower(field) = 'status' AND regexp_matches(changed_at, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z$')),
w AS (SELECT *, lead(t0) OVER (PARTITION BY item ORDER BY t0, seq) AS e, row_number() OVER (PARTITION BY item ORDER BY t0, seq) AS n FROM t WHERE t0 IS NOT NULL AND item IS NOT NULL),
o AS (SELECT i.issue_id AS item, CASE WHEN w.n IS NULL THEN i.status ELSE w.f END AS value, i.created_at AS s, w.t0 AS e FROM issues i LEFT JOIN w ON w.item = i.issue_id AND w.n = 1)
SELECT item, value, coalesce(epoch_ms(s), -1) AS start_ms, coalesce(epoch_ms(e), -1) AS end_ms FROM o UNION ALL SELECT item, v, epoch_ms(t0), coalesce(epoch_ms(e), -1) FROM w WHERE item IN (SELECT issue_id FROM issues)"""


@query(_STATUS)
def changelog_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Periods of the status of each issue, from the changes whose time is written in UTC."""
    c = table(spark, d, "jira_change")
    rest = [x for x in c.columns if x != "change_id"]
    one = c.groupBy("change_id").agg(F.max_by(F.struct(*rest), F.struct("ingested_at", "changed_at", "to_string", "from_string")).alias("s")).select("change_id", "s.*")
    utc = F.col("changed_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
    moved = one.where((F.lower("field") == "status") & utc).select(F.col("issue_id").alias("item"), F.col("changed_at").try_cast("timestamp").alias("at"), F.col("change_id").alias("seq"), F.col("from_string").alias("from_value"), F.col("to_string").alias("to_value"))
    items = base.issues(spark, d).select(F.col("issue_id").alias("item"), F.col("created_at").cast("timestamp").alias("created_at"), F.col("status").alias("current"))
    out = changes.field_intervals(items, moved)
    return out.select("item", "value", F.coalesce(F.unix_millis("start_at"), F.lit(-1)).alias("start_ms"), F.coalesce(F.unix_millis("end_at"), F.lit(-1)).alias("end_ms"))


@query("""WITH s AS (SELECT repository_full_name || ':' || path AS record_key, md5(coalesce(content, '')) AS h, ingested_at AS t0 FROM bitbucket_file WHERE path IS NOT NULL),
w AS (SELECT *, lag(h) OVER (PARTITION BY record_key ORDER BY t0, h) AS p FROM s)
SELECT record_key, row_number() OVER (PARTITION BY record_key ORDER BY t0, h) AS version, h AS content_hash FROM w WHERE h IS DISTINCT FROM p""")
def record_versions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "bitbucket_file").where("path is not null")
    states = f.select(F.concat_ws(":", "repository_full_name", "path").alias("record_key"), F.md5(F.coalesce("content", F.lit(""))).alias("content_hash"), F.col("ingested_at").alias("at"))
    return changes.record_versions(states).select("record_key", "version", "content_hash")


@query("""WITH r AS (SELECT CAST(file_id AS VARCHAR) AS k, repository_full_name AS c, md5(content) AS h, min(ingested_at) AS t0 FROM bitbucket_file WHERE content IS NOT NULL GROUP BY ALL),
f AS (SELECT c, h, first(k ORDER BY t0, k) AS m FROM r GROUP BY ALL) SELECT k AS record_key, m AS moved_from FROM r JOIN f USING (c, h) WHERE k <> m""")
def moved_records(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "bitbucket_file").where("content is not null")
    r = f.groupBy(F.col("file_id").cast("string").alias("record_key"), F.col("repository_full_name").alias("connection"), F.md5("content").alias("content_hash")).agg(F.min("ingested_at").alias("at"))
    return changes.moved_from(r)


@query("""SELECT DISTINCT record_key FROM documents WHERE record_key LIKE 'github:c0:%' AND record_key NOT IN (SELECT record_key FROM documents WHERE created_at >= TIMESTAMP '2023-01-01' AND record_key IS NOT NULL)""")
def reconcile_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return changes.missing(docs, docs.where("created_at >= timestamp_ntz'2023-01-01 00:00:00'"), "github:c0:")


@query(f"""WITH {FACTS}, x AS (SELECT fact_uid, confidence, CASE ascii(substr(fact_uid, 1, 1)) % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'durable' WHEN 2 THEN 'task' ELSE NULL END AS decay, observed_at, ascii(substr(fact_uid, 2, 1)) % 2 = 0 AS closed, ascii(substr(fact_uid, 3, 1)) % 5 = 0 AS pinned FROM facts),
y AS (SELECT *, CASE WHEN decay = 'task' THEN closed ELSE observed_at IS NULL OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(observed_at) >= (CASE decay WHEN 'fast' THEN 21 WHEN 'durable' THEN 365 ELSE 180 END) * 86400000000 END AS stale FROM x)
SELECT fact_uid, CASE WHEN stale THEN 'stale' ELSE 'fresh' END AS freshness, round(confidence * CASE WHEN stale AND NOT pinned THEN 0.7 ELSE 1.0 END, 6) AS effective FROM y""")
def freshness_confidence(spark: SparkSession, d: str) -> DataFrame:
    letter = lambda i: F.ascii(F.substring("fact_uid", i, 1))
    decay = F.when(letter(1) % 4 == 0, "fast").when(letter(1) % 4 == 1, "durable").when(letter(1) % 4 == 2, "task")
    f = base.facts(spark, d).withColumn("freshness", temporal.freshness(decay, F.col("observed_at"), ts(NOW), letter(2) % 2 == 0))
    return f.select("fact_uid", "freshness", F.round(temporal.effective_confidence(F.col("confidence"), F.col("freshness"), letter(3) % 5 == 0), 6).alias("effective"))


@query(f"""WITH {FACTS}, a AS (SELECT from_uid, fact_uid, valid_at, invalid_at FROM facts WHERE rel_type = 'PARENT_OF'), b AS (SELECT from_uid, fact_uid, valid_at, invalid_at FROM facts WHERE rel_type = 'BELONGS_TO')
SELECT a.fact_uid AS a, b.fact_uid AS b, coalesce(b.invalid_at <= a.valid_at, false) OR coalesce(a.invalid_at <= b.valid_at, false) AS disjoint_ FROM a JOIN b USING (from_uid)""")
def windows_disjoint(spark: SparkSession, d: str) -> DataFrame:
    f = base.facts(spark, d)
    a = f.where("rel_type = 'PARENT_OF'").select("from_uid", F.col("fact_uid").alias("a"), F.col("valid_at").alias("s1"), F.col("invalid_at").alias("e1"))
    b = f.where("rel_type = 'BELONGS_TO'").select("from_uid", F.col("fact_uid").alias("b"), F.col("valid_at").alias("s2"), F.col("invalid_at").alias("e2"))
    return a.join(b, "from_uid").select("a", "b", temporal.disjoint(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("disjoint_"))


@query(f"""WITH {FACTS} SELECT fact_uid, CASE WHEN valid_at IS NOT NULL AND invalid_at IS NOT NULL THEN 'from ' || strftime(valid_at, '%Y-%m-%d') || ' until ' || strftime(invalid_at, '%Y-%m-%d')
WHEN valid_at IS NOT NULL THEN 'since ' || strftime(valid_at, '%Y-%m-%d') WHEN invalid_at IS NOT NULL THEN 'until ' || strftime(invalid_at, '%Y-%m-%d') ELSE 'undated' END AS note FROM facts""")
def interval_notes(spark: SparkSession, d: str) -> DataFrame:
    return base.facts(spark, d).select("fact_uid", temporal.interval_note(F.col("valid_at"), F.col("invalid_at"), F.lit(False)).alias("note"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) AS identity FROM part")
def normalize_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.identity(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("identity"))


@query()
def fact_uids(spark: SparkSession, d: str) -> DataFrame:
    """Ids derived from what a fact says; tested against the UUID standard."""
    e = table(spark, d, "edge").select("from_uid", "rel_type", "to_uid").distinct()
    return e.select("*", make_uid(F.lit("Fact"), F.col("from_uid"), F.col("rel_type"), F.col("to_uid")).alias("uid"), uuid5(F.col("from_uid")).alias("end_uid"))


_ARCH = f"""WITH {FACTS}, h AS (SELECT fact_uid, 'closed' AS why, valid_at AS f, TIMESTAMP '{AT}' AS t FROM facts WHERE rel_type = 'BLOCKS' AND {LIVE} AND valid_at < TIMESTAMP '{AT}'
UNION ALL SELECT fact_uid, 'corrected', valid_at, valid_at FROM facts WHERE rel_type = 'PARENT_OF' AND confidence < 0.6 AND {LIVE}
UNION ALL SELECT fact_uid, 'unsupported', valid_at, TIMESTAMP '{NOW}' FROM facts WHERE confidence < 0.6 AND invalid_at IS NULL AND len(source_record_keys) > 0
AND len(list_filter(source_record_keys, k -> k NOT IN (SELECT DISTINCT k FROM (SELECT unnest(source_record_keys) AS k FROM facts WHERE confidence < 0.6) WHERE k IS NOT NULL))) = 0)
SELECT fact_uid, why, coalesce(epoch_ms(f), -1) AS from_ms, coalesce(epoch_ms(t), -1) AS to_ms FROM h"""


@query(_ARCH.replace("confidence < 0.6 AND invalid_at IS NULL AND len", "invalid_at IS NULL AND len").replace("len(list_filter(source_record_keys, k -> k NOT IN (SELECT DISTINCT k FROM (SELECT unnest(source_record_keys) AS k FROM facts WHERE confidence < 0.6) WHERE k IS NOT NULL))) = 0", "fact_uid NOT IN (SELECT fact_uid FROM (SELECT fact_uid, unnest(source_record_keys) AS k FROM facts) WHERE k IS NULL OR k NOT IN (SELECT k FROM (SELECT unnest(source_record_keys) AS k FROM facts WHERE confidence < 0.6) WHERE k IS NOT NULL))"))
def fact_archive(spark: SparkSession, d: str) -> DataFrame:
    """History rows of facts that are closed, corrected, or lose their last record."""
    f = base.facts(spark, d)
    _, closed = facts.close(f, f.where(f"rel_type = 'BLOCKS' and valid_at < '{AT}'").select("fact_uid", ts(AT).alias("valid_to")), ts(NOW))
    _, wrong = facts.correct(f, f.where("rel_type = 'PARENT_OF' and confidence < 0.6"), ts(NOW))
    _, lost = facts.remove_support(f, f.where("confidence < 0.6").select(F.explode("source_record_keys").alias("record_key")), ts(NOW))
    out = closed.withColumn("why", F.lit("closed")).unionByName(wrong.withColumn("why", F.lit("corrected"))).unionByName(lost.withColumn("why", F.lit("unsupported")))
    ms = lambda c: F.coalesce(F.unix_millis(c), F.lit(-1))
    return out.select("fact_uid", "why", ms("valid_from").alias("from_ms"), ms("valid_to").alias("to_ms"))


@query(f"""WITH {FACTS}, b AS (SELECT from_uid, to_uid, unnest([fact_uid, 'x:' || fact_uid, fact_uid]) AS k FROM facts WHERE rel_type = 'PARENT_OF' AND from_uid IS NOT NULL AND to_uid IS NOT NULL)
SELECT from_uid, to_uid, count(DISTINCT k) AS records FROM b GROUP BY ALL""")
def fact_upsert_repeats(spark: SparkSession, d: str) -> DataFrame:
    """A batch that states each fact three times, by two records: both support it, though one is known already."""
    f = base.facts(spark, d).where("rel_type = 'PARENT_OF' and from_uid is not null and to_uid is not null")
    said = f.select(*facts.KEY, F.explode(F.array(F.col("fact_uid"), F.concat(F.lit("x:"), "fact_uid"), F.col("fact_uid"))).alias("k")).select(*facts.KEY, F.array("k").alias("source_record_keys"))
    old = f.groupBy(*facts.KEY).agg(F.min_by(F.struct(*[c for c in f.columns if c not in facts.KEY]), "fact_uid").alias("s")).select(*facts.KEY, "s.*").withColumn("source_record_keys", F.array("fact_uid"))
    return facts.upsert(old, said, ts(NOW)).select("from_uid", "to_uid", F.size("source_record_keys").cast("long").alias("records"))


@query(f"""WITH {FACTS}, x AS (SELECT *, rel_type = 'BLOCKS' AS hit FROM facts) SELECT fact_uid, CASE WHEN hit THEN 'pending_review' ELSE 'live' END AS projection, hit AND {LIVE} AS touched, coalesce(len(source_record_keys), 0) AS support,
coalesce(epoch_ms(CASE WHEN rel_type = 'PARENT_OF' AND from_uid IS NOT NULL AND to_uid IS NOT NULL AND invalid_at IS NULL THEN TIMESTAMP '{NOW}' ELSE invalid_at END), -1) AS ended_ms, coalesce(assertion_status, 'live') AS status FROM x""")
def fact_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Facts set aside for review, touched, counted by support, closed by their ends, with defaults filled in."""
    f = base.facts(spark, d)
    some = f.where("rel_type = 'BLOCKS'")
    out = facts.set_projection(f, some.select("fact_uid", F.lit("pending_review").alias("projection_status")))
    out = facts.touch_metadata(out, some.where(_live()).select("fact_uid"), ts(NOW))
    out = facts.with_defaults(facts.invalidate(out, f.where("rel_type = 'PARENT_OF'"), ts(NOW)))
    return out.select("fact_uid", F.col("projection_status").alias("projection"), F.col("metadata_revised_at").isNotNull().alias("touched"), facts.reinforcement(F.col("source_record_keys")).cast("long").alias("support"), F.coalesce(F.unix_millis("invalid_at"), F.lit(-1)).alias("ended_ms"), F.col("assertion_status").alias("status"))


@query(f"""WITH {FACTS} SELECT fact_uid, coalesce(from_uid, '') || ' ' || rel_type || ' ' || coalesce(to_uid, '') || ' (' || CASE WHEN valid_at IS NOT NULL AND invalid_at IS NOT NULL THEN 'from ' || strftime(valid_at, '%Y-%m-%d') || ' until ' || strftime(invalid_at, '%Y-%m-%d')
WHEN valid_at IS NOT NULL THEN 'since ' || strftime(valid_at, '%Y-%m-%d') WHEN invalid_at IS NOT NULL THEN 'until ' || strftime(invalid_at, '%Y-%m-%d') ELSE 'undated' END || ')' AS text, {LIVE} AS live FROM facts WHERE from_uid IS NOT NULL AND to_uid IS NOT NULL""")
def fact_rows(spark: SparkSession, d: str) -> DataFrame:
    """Facts as lines of text."""
    f = base.facts(spark, d).where("from_uid is not null and to_uid is not null")
    return facts.fact_row(f, base.nodes(spark, d).withColumn("name", F.col("uid"))).select("fact_uid", "text", "live")
