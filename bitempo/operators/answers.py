"""What an answer rests on: facts and records of things, citations, evaluation chains, vectors of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.functions import temporal
from bitempo.functions.text import name_used
from bitempo.operators import facts as writes
from bitempo.operators.graph import TIERS, tier
from bitempo.operators.ledger import keyed_upsert

# Words of record keys and the labels that they stand for.
KINDS = {"issue": "WorkItem", "project": "Project", "commit": "Commit", "file": "SourceFile", "pull_request": "PullRequest", "page": "Document", "repository": "Repository", "workspace": "Workspace"}


# --- facts and records of a node ------------------------------------------------


def entity_facts(facts: DataFrame, uids: DataFrame, records: DataFrame) -> DataFrame:
    """``(uid, fact_uid, direction, rel_type, other, records)``: facts of some nodes, both ways, that a visible record backs.

    ``records(record_key)`` are those that the reader may see; facts of no
    visible record do not exist for them.
    """
    some = uids.select("uid").distinct()
    out = facts.join(some.withColumnRenamed("uid", "from_uid"), "from_uid").select(F.col("from_uid").alias("uid"), "fact_uid", F.lit("out").alias("direction"), "rel_type", F.col("to_uid").alias("other"), "source_record_keys")
    back = facts.join(some.withColumnRenamed("uid", "to_uid"), "to_uid").select(F.col("to_uid").alias("uid"), "fact_uid", F.lit("in").alias("direction"), "rel_type", F.col("from_uid").alias("other"), "source_record_keys")
    backed = out.unionByName(back).withColumn("record_key", F.explode("source_record_keys")).join(records.select("record_key").distinct(), "record_key", "left_semi")
    return backed.groupBy("uid", "fact_uid", "direction", "rel_type", "other").agg(F.array_sort(F.collect_set("record_key")).alias("records"))


def entity_evidence(facts: DataFrame, uids: DataFrame, records: DataFrame, at: Column, until: Column | None = None) -> DataFrame:
    """``(uid, fact_uids, record_keys)``: what backs some nodes at an instant or in a window."""
    held = facts.where(temporal.holds_at(F.col("valid_at"), F.col("invalid_at"), at, until))
    told = entity_facts(held, uids, records)
    return told.groupBy("uid").agg(F.array_sort(F.collect_set("fact_uid")).alias("fact_uids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("records")))).alias("record_keys"))


def expansion_tier(facts: DataFrame, uids: DataFrame, relation: str) -> DataFrame:
    """``(uid, tier)``: the best authority among the live facts of a relation at each node."""
    some = facts.where(F.col("rel_type") == relation)
    ends = some.select(F.col("from_uid").alias("uid"), "extraction_method").unionByName(some.select(F.col("to_uid").alias("uid"), "extraction_method")).join(uids.select("uid").distinct(), "uid", "left_semi")
    rank = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[tier(F.col("extraction_method"))]
    back = F.create_map(*[F.lit(x) for k, v in TIERS.items() for x in (v, k)])
    return ends.groupBy("uid").agg(F.max(rank).alias("r")).select("uid", back[F.col("r")].alias("tier"))


def assignment_facts(told: DataFrame) -> DataFrame:
    """Facts of assignment only."""
    return told.where("rel_type = 'ASSIGNED_TO'")


def record_keys(mentions: DataFrame, uids: DataFrame, records: DataFrame) -> DataFrame:
    """``(uid, record_keys)``: visible records that mention some nodes; deleted ones are none."""
    here = records.where("deleted_at is null") if "deleted_at" in records.columns else records
    m = mentions.join(uids.select("uid").distinct(), "uid", "left_semi").join(here.select("record_key").distinct(), "record_key", "left_semi")
    return m.groupBy("uid").agg(F.array_sort(F.collect_set("record_key")).alias("record_keys"))


def outgoing_targets(facts: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """``(uid, targets)``: what each node points to by live facts of some relations."""
    some = facts.where(F.col("rel_type").isin(*relations) & F.col("from_uid").isNotNull() & F.col("to_uid").isNotNull())
    return some.groupBy(F.col("from_uid").alias("uid")).agg(F.array_sort(F.collect_set("to_uid")).alias("targets"))


def label_nodes(nodes: DataFrame, label: str) -> DataFrame:
    """``(uid, name, text)`` of a label; a node without a text has its name."""
    return nodes.where(F.col("label") == label).select("uid", "name", F.coalesce("search_text", "name").alias("text"))


def first_seen(nodes: DataFrame, uids: DataFrame) -> DataFrame:
    """``(uid, first_seen_at)``."""
    return nodes.join(uids.select("uid").distinct(), "uid", "left_semi").groupBy("uid").agg(F.min("first_seen_at").alias("first_seen_at"))


def own_kind(key: Column) -> Column:
    """The label of a record's own node, by the kind in its key; null for an unknown one."""
    return F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.split(key, ":")[2]]


def namespace(container: Column, key: Column) -> Column:
    """The container that a record's names belong to, else its provider and connection."""
    return F.coalesce(container, F.substring_index(key, ":", 2))


# --- citations ----------------------------------------------------------------------


def citations(hits: DataFrame, records: DataFrame) -> DataFrame:
    """``(q, record_key, name, url)`` of ``hits(q, record_key)``; records that are deleted or unknown are not cited."""
    some = records.where("deleted_at is null") if "deleted_at" in records.columns else records
    return hits.select("q", "record_key").distinct().join(some.select("record_key", "name", "url"), "record_key").select("q", "record_key", "name", "url")


def used_records(said: DataFrame, offered: DataFrame) -> DataFrame:
    """``(q, record_key)``: offered records whose name an answer used, as a whole or as a beginning.

    ``said(q, used)`` and ``offered(q, name, record_key)`` of one question meet,
    so no question sees another's.
    """
    return said.join(offered, "q").where(name_used(F.col("name"), F.col("used"))).select("q", "record_key").distinct()


def actionable(hits: DataFrame, wisdom: DataFrame) -> DataFrame:
    """Hits that are wisdom still active or proposed."""
    return hits.join(wisdom.where(F.col("status").isin("active", "proposed")).select("uid").distinct(), "uid", "left_semi")


def linked_findings(hits: DataFrame, facts: DataFrame, records: DataFrame) -> DataFrame:
    """``(uid, finding)``: findings that some wisdom comes from and that a visible record backs."""
    some = facts.where("rel_type = 'DERIVED_FROM'").join(hits.select(F.col("uid").alias("from_uid")).distinct(), "from_uid", "left_semi")
    backed = some.withColumn("record_key", F.explode("source_record_keys")).join(records.select("record_key").distinct(), "record_key", "left_semi")
    return backed.select(F.col("from_uid").alias("uid"), F.col("to_uid").alias("finding")).distinct()


def named_people(matched: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(q, uid, similarity)``: everybody in the cluster of a person that a question names; the best match counts.

    ``matched(q, uid, similarity)``, ``clusters(uid, cluster)``; a person of no
    cluster stands alone.
    """
    c = clusters.select("uid", "cluster")
    known = matched.join(c, "uid", "left").withColumn("cluster", F.coalesce("cluster", "uid"))
    best = known.groupBy("q", "cluster").agg(F.max("similarity").alias("similarity"))
    members = c.unionByName(matched.select("uid", F.col("uid").alias("cluster")).join(c.select("uid"), "uid", "left_anti").select("uid", "cluster").distinct())
    return best.join(members, "cluster").select("q", "uid", "similarity")


def backlinks(targets: DataFrame, records: DataFrame) -> DataFrame:
    """``(record_key, uid)``: records that already name a new target of another provider.

    ``targets(anchor, uid, provider)`` are few and new, ``records(record_key,
    provider, anchors)`` all: anchors are exploded and met by equality.
    """
    named = records.select("record_key", F.col("provider").alias("_p"), F.explode(F.array_distinct("anchors")).alias("anchor"))
    return named.join(targets.select("anchor", "uid", "provider").distinct(), "anchor").where("_p <> provider").select("record_key", "uid").distinct()


def removal_findings(findings: DataFrame, kind: str = "removal") -> DataFrame:
    """Open findings of a kind, newest first."""
    return findings.where((F.col("status") == "open") & (F.col("kind") == kind)).orderBy(F.col("updated_at").desc_nulls_last(), "finding_key")


def signals(rows: DataFrame, findings: DataFrame, pattern: str | None = None) -> DataFrame:
    """Signals with the status of their finding, of one pattern if given."""
    some = rows if pattern is None else rows.where(F.col("pattern_key") == pattern)
    return some.join(findings.select("finding_key", F.col("status").alias("finding_status")), "finding_key")


def proposals(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Proposals with their evidence as an array; those without any have an empty one."""
    lists = evidence.groupBy("proposal_id").agg(F.array_sort(F.collect_set(F.struct("signal_id", "role"))).alias("evidence"))
    return rows.join(lists, "proposal_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(dict(lists.dtypes)["evidence"])))


# --- records that change ----------------------------------------------------------------


def write_single_valued(facts: DataFrame, batch: DataFrame, relation: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Merge facts of a relation with one target at a time: (facts, new history).

    What a subject of the batch pointed to before is closed and archived,
    unless the batch says it again.
    """
    new = batch.where(F.col("rel_type") == relation)
    same = new.select(*writes.KEY).distinct().withColumn("_same", F.lit(True))
    subjects = new.select("from_uid").distinct().withColumn("_in", F.lit(True))
    marked = facts.join(subjects, "from_uid", "left").join(same, writes.KEY, "left")
    ends = F.coalesce("_in", F.lit(False)) & (F.col("rel_type") == relation) & F.col("_same").isNull() & F.col("invalid_at").isNull()
    marked = marked.withColumn("_ends", ends)
    closed = marked.withColumn("invalid_at", F.when(F.col("_ends"), now).otherwise(F.col("invalid_at"))).select(*facts.columns)
    return writes.upsert(closed, new, now), writes.archive(marked, F.col("_ends"), now)


def reset_support(facts: DataFrame, mentions: DataFrame, records: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undo what updated ``records(record_key, primary_uid[, valid_to])`` supported, before they are told again: (facts, history, mentions)."""
    out, history = writes.remove_support(facts, records, now)
    return out, history, writes.unlink_mentions(mentions, records)


def delete_records(nodes: DataFrame, facts: DataFrame, mentions: DataFrame, records: DataFrame, now: Column, shared: tuple[str, ...] = ("Person", "Decision", "Term", "System")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete records with their own nodes, their support and their mentions, then shared nodes that nothing mentions any more.

    ``records(record_key, primary_uid)``; gives (nodes, facts, mentions).
    """
    kept, _ = writes.remove_support(facts, records, now)
    left = mentions.join(records.select("record_key").distinct(), "record_key", "left_anti").select(*mentions.columns)
    nodes, kept = writes.delete_nodes(nodes, kept, records.select(F.col("primary_uid").alias("uid")).where("uid is not null"))
    return *writes.delete_nodes(nodes, kept, writes.orphans(nodes, left, shared)), left


# --- vectors -----------------------------------------------------------------------------


def set_embeddings(rows: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Chunks or nodes with new vectors put in; ``vectors(key..., embedding, model)`` of unknown keys make no rows."""
    names = [c for c in ("embedding", "model") if c in vectors.columns]
    one = vectors.groupBy(*key).agg(F.max_by(F.struct(*names), F.to_json(F.struct(*names))).alias("_v"))
    out = rows.join(one, key, "left")
    for c in names:
        out = out.withColumn(c, F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)))
    return out.select(*rows.columns)


def clear_collection(vectors: DataFrame, collection: str) -> DataFrame:
    """Vectors without those of one collection."""
    return vectors.where(F.coalesce(F.col("collection_name") != collection, F.lit(True)))


def rebuild(vectors: DataFrame, collection: str, fresh: DataFrame) -> DataFrame:
    """A collection made anew from ``fresh`` rows; others stay."""
    rest = clear_collection(vectors, collection)
    empty = rest.limit(0)
    new = keyed_upsert(empty, fresh.withColumn("collection_name", F.lit(collection)).select(*vectors.columns), ["collection_name", "uid"])
    return rest.unionByName(new.select(*vectors.columns))


# --- evaluation -----------------------------------------------------------------------------


def sample_chains(paths: dict[str, DataFrame], seed: int = 7) -> DataFrame:
    """``(pattern, start, nodes)``: of each pattern one path from each start node, drawn by a seeded hash.

    ``paths`` have the columns n0, n1, ... of ``graph.path``.
    """
    out = None
    for name, p in sorted(paths.items()):
        nodes = F.array(*[F.col(c) for c in sorted(p.columns, key=lambda c: int(c[1:]))])
        one = p.select(F.col("n0").alias("start"), nodes.alias("nodes")).where(F.forall("nodes", lambda x: x.isNotNull()))
        drawn = one.groupBy("start").agg(F.min_by("nodes", F.struct(F.xxhash64("nodes", F.lit(seed)), "nodes")).alias("nodes")).select(F.lit(name).alias("pattern"), "start", "nodes")
        out = drawn if out is None else out.unionByName(drawn)
    return out


def group_keys(chains: DataFrame, projects: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(start, group)``: the project of a node of the chain, else provider and connection of a record, else ungrouped.

    ``projects(uid, project)``.
    """
    each = chains.select("start", F.explode("nodes").alias("uid")).distinct()
    p = each.join(projects, "uid").groupBy("start").agg(F.min("project").alias("_p"))
    r = each.join(mentions, "uid").groupBy("start").agg(F.min(F.substring_index("record_key", ":", 2)).alias("_r"))
    out = chains.select("start").distinct().join(p, "start", "left").join(r, "start", "left")
    return out.select("start", F.coalesce(F.concat(F.lit("project:"), "_p"), F.concat(F.lit("record:"), "_r"), F.lit("ungrouped")).alias("group"))


def leak_free(questions: DataFrame, nodes: DataFrame, least: int = 4, sha: int = 7) -> DataFrame:
    """Questions that name no node of their chain: ``questions(q, question)``, ``nodes(q, name, issue_key, path, sha, pr_ref)``."""
    terms = F.filter(F.array(*[F.lower(F.trim(c)) for c in ("name", "issue_key", "path", "pr_ref")]), lambda t: F.length(t) >= least)
    named = nodes.select("q", F.explode(F.concat(terms, F.filter(F.array(F.substring(F.lower("sha"), 1, sha)), lambda t: F.length(t) >= sha))).alias("term")).distinct()
    leaking = questions.join(named, "q").where(F.contains(F.lower("question"), "term")).select("q").distinct()
    return questions.join(leaking, "q", "left_anti")


def splits(groups: DataFrame, share: float = 0.5, seed: int = 7) -> DataFrame:
    """``(group, split)``: dev or test by a seeded hash of the group, so that no group is in both."""
    part = F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return groups.select("group").distinct().select("group", F.when(part, "dev").otherwise("test").alias("split"))


def stage_metrics(results: DataFrame) -> DataFrame:
    """How retrieval did stage by stage: one row of ``results(scored, in_candidates, in_final, reciprocal_rank, coverage, evidence, tokens, latency_ms)``.

    Recalls are over the scored ones; medians and nearest-rank 90th percentiles
    are order statistics that no task gathers.  Nothing scored gives nulls.
    """
    share = lambda c: F.avg(F.when(F.col("scored"), F.col(c).cast("double")))
    p90 = lambda c: F.expr(f"percentile_disc(0.9) within group (order by {c})")
    return results.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("scored").alias("scored"), share("in_candidates").alias("candidate_recall"), share("in_final").alias("final_recall"), share("reciprocal_rank").alias("mrr"), F.avg("coverage").alias("coverage"),
        F.avg(F.col("evidence").cast("double")).alias("evidence_recall"), F.expr("percentile(tokens, 0.5)").alias("median_tokens"), p90("tokens").alias("p90_tokens"), F.expr("percentile(latency_ms, 0.5)").alias("median_ms"), p90("latency_ms").alias("p90_ms"),
    )


def dashboard(queues: DataFrame, isolated: DataFrame) -> DataFrame:
    """``(what, name, n, share)``: waiting reviews by kind, and isolated nodes by label with their share."""
    waiting = queues.where("state = 'pending'").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("queue").alias("what"), F.col("kind").alias("name"), "n", F.lit(None).cast("double").alias("share"))
    return waiting.unionByName(isolated.select(F.lit("isolated").alias("what"), F.col("label").alias("name"), F.col("isolated").alias("n"), (F.col("isolated") / F.col("total")).alias("share")))


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors put in by collection and node: the row updated last counts, a missing name vector is the content's."""
    key = ["collection_name", "uid"]
    rest = [c for c in vectors.columns if c not in key]
    both = vectors.unionByName(new.select(*vectors.columns)).where("collection_name is not null and uid is not null")
    one = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("updated_at", F.xxhash64(*rest))).alias("s")).select(*key, "s.*")
    return one.withColumn("name_embedding", F.coalesce("name_embedding", "content_embedding")).select(*vectors.columns)
