"""Queries on the history of attributes and on hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.operators import hierarchy, history
from bitempo.session import Cut, table


#: Deliveries are merged in batches that begin at these instants (milliseconds of 2022 and 2024, UTC).
BATCHES = (1_640_995_200_000, 1_704_067_200_000)


def _merged(spark: SparkSession, d: str, edges: bool = True, order: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Versions of the attributes from a dimension that deliveries are merged into, batch by batch.

    Of a change delivered again the last row counts, and belongs to the batch of that.
    """
    events = history.change_events(table(spark, d, "jira_change"), carry=False)
    if edges:
        events = events.unionByName(history.edge_events(table(spark, d, "edge")).drop("value"))
    batch = sum((F.col("seen_ms") >= at).cast("int") for at in BATCHES)
    known = events.where("entity_id is not null and at_ms is not null")
    parts = Cut(known.withColumn("batch", batch).drop("seen_ms"), by="batch")
    now, old = None, None
    for i, number in enumerate(order):
        new = history.merge(now, parts.df.where(F.col("batch") == number).drop("batch"), carry=())
        if i + 1 == len(order):
            return history.held(new.states).select("entity_id", "attribute", "valid_from_ms", "valid_to_ms")
        states = Cut(new.states)
        # The events of a batch are stored already: its log is read from there.
        now = history.Dimension(states.df, parts.df.where(F.col("batch").isin(*order[: i + 1])).drop("batch"))
        if old:
            old.drop()
        old = states


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of the attributes of issues and of functional edges, merged in three batches by delivery."""
    return _merged(spark, d)


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """``p1_found`` with the batches merged in reverse: what comes late is told anew from the log."""
    return _merged(spark, d, order=(2, 1, 0))


def p1_late(spark: SparkSession, d: str) -> DataFrame:
    """The change log alone, the middle batch last."""
    return _merged(spark, d, edges=False, order=(0, 2, 1))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """``p1_found`` told in one pass over all events, without a dimension: merging must equal it."""
    change, edge = table(spark, d, "jira_change"), table(spark, d, "edge")
    events = history.change_events(change, carry=False).unionByName(history.edge_events(edge).drop("value"))
    return history.versions(events, carry=()).select("entity_id", "attribute", "valid_from_ms", "valid_to_ms")


def issues(spark: SparkSession, d: str) -> DataFrame:
    """One row per issue: the state with the largest ``updated_at``."""
    rows = table(spark, d, "jira_issue").select(hierarchy.plain_id(F.col("issue_id")).alias("issue_id"), "parent_id", "updated_at", "ingested_at")
    state = F.struct("updated_at", "ingested_at", "parent_id")
    return rows.where("issue_id is not null").groupBy("issue_id").agg(F.max(state).alias("s")).select("issue_id", "s.parent_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and number of descendants of each issue."""
    tree = hierarchy.forest(hierarchy.parents(issues(spark, d), "issue_id", "parent_id", plain=True))
    return tree.select(F.col("id").alias("issue_id"), "root_id", "depth", "n_descendants")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of each issue, and which lie on a loop or lead into one."""
    tree = hierarchy.forest(hierarchy.parents(issues(spark, d), "issue_id", "parent_id", plain=True), paths=True)
    return tree.select(F.col("id").alias("issue_id"), F.coalesce(F.array_join("path", "/"), F.lit("")).alias("path"), "in_loop", "leads_to_loop")


def p2_loops(spark: SparkSession, d: str) -> DataFrame:
    """The link of each loop that closes it, seen from its smallest issue."""
    tree = hierarchy.forest(hierarchy.parents(issues(spark, d), "issue_id", "parent_id", plain=True))
    return tree.where("back_edge_to is not null").select(F.col("id").alias("issue_id"), F.col("back_edge_to").alias("child_id"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of an issue and an issue below it, with the distance."""
    return hierarchy.descendants(hierarchy.parents(issues(spark, d), "issue_id", "parent_id", plain=True))


QUERIES = {f.__name__: f for f in (p1_found, p1_merged, p1_late, p1_loaded, p2_found, p2_paths, p2_loops, p2_descendants)}

_CHANGES = r"""
latest AS (SELECT DISTINCT ON (change_id) change_id, issue_id, trim(changed_at) AS c, lower(trim(field)) AS attribute, to_string
  FROM jira_change ORDER BY change_id, ingested_at DESC NULLS LAST, changed_at DESC NULLS LAST),
timed AS (SELECT change_id, issue_id AS entity_id, attribute, nullif(regexp_replace(lower(to_string), '\s+', '', 'g'), '') AS v,
    epoch_ms(try_cast(replace(regexp_extract(c, '^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?)', 1), 'T', ' ') AS TIMESTAMP))
    - CASE WHEN regexp_matches(c, '[+-]\d{2}:?\d{2}$') AND length(c) > 19 THEN
        (CASE WHEN regexp_extract(c, '([+-])\d{2}:?\d{2}$', 1) = '-' THEN -1 ELSE 1 END)
        * (cast(regexp_extract(c, '[+-](\d{2}):?\d{2}$', 1) AS BIGINT) * 60 + cast(regexp_extract(c, '[+-]\d{2}:?(\d{2})$', 1) AS BIGINT)) * 60000
      ELSE 0 END AS at_ms
  FROM latest WHERE attribute IN ('status','assignee','priority') AND issue_id IS NOT NULL),
change_events AS (SELECT DISTINCT ON (entity_id, attribute, at_ms) entity_id, attribute, at_ms, v, CAST(NULL AS BIGINT) AS e
  FROM timed WHERE at_ms IS NOT NULL ORDER BY entity_id, attribute, at_ms, change_id DESC)"""
EDGES = """
edge_events AS (SELECT DISTINCT ON (from_uid, rel_type, valid_at) from_uid AS entity_id, rel_type AS attribute, epoch_ms(valid_at) AS at_ms, to_uid AS v, epoch_ms(invalid_at) AS e
  FROM edge WHERE rel_type IN ('ASSIGNED_TO','BELONGS_TO','REPORTED_BY') AND assertion_status = 'live' AND valid_at IS NOT NULL AND from_uid IS NOT NULL
  ORDER BY from_uid, rel_type, valid_at, observed_at DESC NULLS LAST)"""
VERSIONS = """
near AS (SELECT *, lag(v) OVER w AS pv, lag(e) OVER w AS pe, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY entity_id, attribute ORDER BY at_ms)),
runs AS (SELECT *, sum(CASE WHEN n = 1 OR v IS DISTINCT FROM pv OR pe < at_ms THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, attribute ORDER BY at_ms) AS run FROM near),
spans AS (SELECT entity_id, attribute, run, min(at_ms) AS f, arg_max(v, at_ms) AS v, max_by(coalesce(e, -1), at_ms) AS e FROM runs GROUP BY ALL),
ended AS (SELECT *, lead(f) OVER (PARTITION BY entity_id, attribute ORDER BY run) AS nf FROM spans)
SELECT entity_id, attribute, f AS valid_from_ms, coalesce(CASE WHEN e = -1 THEN nf WHEN nf IS NULL THEN e ELSE least(nf, e) END, -1) AS valid_to_ms FROM ended WHERE v IS NOT NULL"""

_TREE = r"""
WITH RECURSIVE latest AS (SELECT DISTINCT ON (issue_id) issue_id AS id, regexp_replace(trim(parent_id, E' \t\n\r'), '\.0+$', '') AS p
  FROM jira_issue ORDER BY issue_id, updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST),
links AS (SELECT a.id, b.id AS p FROM latest a LEFT JOIN latest b ON a.p = b.id),
down AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path FROM links WHERE p IS NULL
  UNION ALL SELECT l.id, d.root_id, d.depth + 1, d.path || '/' || l.id FROM links l JOIN down d ON l.p = d.id),
pairs AS (SELECT unnest(string_split(path, '/')[:-2]) AS ancestor_id, id, unnest(range(length(string_split(path, '/')) - 1, 0, -1)) AS distance FROM down),
below AS (SELECT ancestor_id AS id, count(*) AS n FROM pairs GROUP BY 1),
lost AS (SELECT id, p FROM links WHERE id NOT IN (SELECT id FROM down)),
chase AS (SELECT id, p AS spot, 1 AS k FROM lost UNION ALL SELECT c.id, l.p, c.k + 1 FROM chase c JOIN lost l ON c.spot = l.id WHERE c.k < (SELECT count(*) FROM lost)),
onloop AS (SELECT DISTINCT id FROM chase WHERE id = spot),
stuck AS (SELECT c.id, min(c.spot) AS root_id FROM chase c JOIN onloop o ON c.spot = o.id GROUP BY 1)"""

ORACLES = {
    "p1_found": "WITH " + _CHANGES.strip() + "," + EDGES + ",\nevents AS (FROM change_events UNION ALL FROM edge_events)," + VERSIONS,
    "p1_merged": "WITH " + _CHANGES.strip() + "," + EDGES + ",\nevents AS (FROM change_events UNION ALL FROM edge_events)," + VERSIONS,
    "p1_loaded": "WITH " + _CHANGES.strip() + "," + EDGES + ",\nevents AS (FROM change_events UNION ALL FROM edge_events)," + VERSIONS,
    "p1_late": "WITH " + _CHANGES.strip() + ",\nevents AS (FROM change_events)," + VERSIONS,
    "p2_found": _TREE + """
SELECT d.id AS issue_id, root_id, depth, coalesce(n, 0) AS n_descendants FROM down d LEFT JOIN below b ON d.id = b.id
UNION ALL SELECT id, root_id, -1, -1 FROM stuck""",
    "p2_paths": _TREE + """
SELECT id AS issue_id, path, false AS in_loop, false AS leads_to_loop FROM down
UNION ALL SELECT id, '', id IN (FROM onloop), id NOT IN (FROM onloop) FROM stuck""",
    "p2_loops": _TREE + """
SELECT l.p AS issue_id, l.id AS child_id FROM lost l JOIN stuck s ON l.id = s.id AND l.id = s.root_id""",
    "p2_descendants": _TREE + " SELECT ancestor_id, id, distance FROM pairs",
}
