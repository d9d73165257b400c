"""The operational ledger: records, chunks, reviews, findings, shapes and runs as keyed tables.

Reads are filters with a total order, writes take a snapshot and give a new
one.  ``now`` is an argument, so that a replay gives the same rows.  A decision
is taken once: what is not pending any more stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.operators.ledger import keyed_delete, keyed_upsert

PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"


# --- reading ---------------------------------------------------------------


def by_key(rows: DataFrame, column: str, value: object) -> DataFrame:
    """Rows of one key: a record, a review, a finding's evidence, a run, a setting; null finds none."""
    return rows.where(F.col(column) == F.lit(value))


def newest(rows: DataFrame, k: int, at: str, key: str, *which: Column) -> DataFrame:
    """The ``k`` newest rows that pass all of ``which``; equal times go to the larger key.

    A top-k: every task sends its own k at most.
    """
    for w in which:
        rows = rows.where(w)
    return rows.orderBy(F.col(at).desc_nulls_last(), F.col(key).desc()).limit(k)


def record(records: DataFrame, key: str) -> DataFrame:
    """The state of one record."""
    return by_key(records, "record_key", key)


def versions(all_versions: DataFrame, key: str) -> DataFrame:
    """The versions of one record, oldest first."""
    return by_key(all_versions, "record_key", key).orderBy("version")


def chunk_status(chunks: DataFrame, key: str, chunk: str) -> DataFrame:
    """The status of one chunk."""
    return by_key(by_key(chunks, "record_key", key), "chunk_id", chunk).select("status")


def edges_for_record(edges: DataFrame, key: str) -> DataFrame:
    """The edges that one record supports."""
    return by_key(edges, "record_key", key).select("rel_type", "from_uid", "to_uid").distinct()


def keys_with_prefix(records: DataFrame, prefix: str) -> DataFrame:
    """Record keys below a prefix."""
    return records.where(F.col("record_key").startswith(prefix)).select("record_key").distinct()


def current_records(records: DataFrame, providers: tuple[str, ...] = (), project: str | None = None) -> DataFrame:
    """Records that are not deleted, of some providers (all by default) and one project."""
    live = records.where("deleted_at is null")
    live = live.where(F.col("provider").isin(*providers)) if providers else live
    return live.where(F.col("project_ref") == project) if project is not None else live


def unembedded(chunks: DataFrame, k: int) -> DataFrame:
    """The first ``k`` live chunks without a vector, by record and place."""
    return chunks.where("deleted_at is null and embedding is null").orderBy("record_key", "position", "chunk_id").limit(k)


def reviews(rows: DataFrame, k: int, state: str | None = PENDING, kind: str | None = None) -> DataFrame:
    """Reviews or link candidates of a state and kind, newest first."""
    which = [F.col("state") == state] if state else []
    return newest(rows, k, "created_at", "id", *which, *([F.col("kind") == kind] if kind else []))


def findings(rows: DataFrame, k: int, status: str | None = "open", prefix: str = "") -> DataFrame:
    """Findings of a status whose record is below a prefix, newest first."""
    which = [F.col("status") == status] if status else []
    return newest(rows, k, "updated_at", "finding_key", *which, *([F.col("record_key").startswith(prefix)] if prefix else []))


def findings_with_evidence(rows: DataFrame, evidence: DataFrame, records: DataFrame, resolved: bool = False) -> DataFrame:
    """Findings with what shows them and the records of that, open ones first; those without evidence stay."""
    some = rows if resolved else rows.where("status <> 'resolved'")
    named = evidence.join(records.select("record_key", F.col("name").alias("record_name")), "record_key", "left").groupBy("finding_key").agg(F.array_sort(F.collect_set(F.struct("record_key", "record_name"))).alias("evidence"))
    return some.join(named, "finding_key", "left").orderBy(F.when(F.col("status") == "open", 0).otherwise(1), F.col("updated_at").desc_nulls_last(), "finding_key")


def drops(rows: DataFrame, k: int, reason: str | None = None) -> DataFrame:
    """The newest drops, of one reason if given."""
    return newest(rows, k, "at", "drop_id", *([F.col("reason") == reason] if reason else []))


def drop_counts(rows: DataFrame, prefix: str = "") -> DataFrame:
    """``(reason, n)`` of drops whose record is below a prefix."""
    return rows.where(F.col("record_key").startswith(prefix)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def rejected(identities: DataFrame, rejections: DataFrame) -> DataFrame:
    """Which identities have been turned down before."""
    return identities.join(rejections.select("identity").distinct(), "identity", "left_semi")


def aliases_of(aliases: DataFrame, uids: DataFrame) -> DataFrame:
    """``(uid, label, alias)`` of some nodes."""
    return aliases.join(uids.select("uid").distinct(), "uid", "left_semi").select("uid", "label", "alias").distinct()


def stoplist(terms: DataFrame, label: str) -> DataFrame:
    """Terms that are stopped for a label or for all."""
    return terms.where(F.col("label").isin(label, "")).select("term").distinct()


def adoptions(batches: DataFrame, undone: bool = False) -> DataFrame:
    """Adopted batches, newest first; undone ones only if asked for."""
    return (batches if undone else batches.where("undone_at is null")).orderBy(F.col("adopted_at").desc(), F.col("batch_id").desc())


def adoptions_with_edges(batches: DataFrame, facts: DataFrame, undone: bool = False) -> DataFrame:
    """``(batch_id, edges)``: how many facts each adopted batch has let in."""
    n = facts.where("adopted_batch is not null").groupBy(F.col("adopted_batch").alias("batch_id")).agg(F.count(F.lit(1)).alias("edges"))
    return (batches if undone else batches.where("undone_at is null")).join(n, "batch_id", "left").select("batch_id", F.coalesce("edges", F.lit(0)).alias("edges"))


def setting(settings: DataFrame, key: str, default: str) -> DataFrame:
    """``(value)``: a stored setting, or the default in one row."""
    found = by_key(settings, "key", key).agg(F.max("value").alias("v"))
    return found.select(F.coalesce("v", F.lit(default)).alias("value"))


def auto_extend(settings: DataFrame, default: bool = False) -> DataFrame:
    """``(enabled)``: whether new shapes are adopted without a question."""
    return setting(settings, "auto_extend", str(default)).select(F.lower(F.trim("value")).isin("1", "true", "yes", "on").alias("enabled"))


# --- writing ----------------------------------------------------------------


def decide(rows: DataFrame, orders: DataFrame, state: str, now: Column) -> DataFrame:
    """Approve or reject: ``orders(id, decided_by)`` set the state of pending rows, once."""
    one = orders.groupBy("id").agg(F.min("decided_by").alias("_by"))
    hit = F.col("_by").isNotNull() & (F.col("state") == PENDING)
    out = rows.join(one, "id", "left").withColumn("_hit", hit)
    for c, v in (("state", F.lit(state)), ("decided_by", F.col("_by")), ("decided_at", now)):
        out = out.withColumn(c, F.when(F.col("_hit"), v).otherwise(F.col(c)))
    return out.select(*rows.columns)


def approve(rows: DataFrame, orders: DataFrame, now: Column) -> DataFrame:
    """Pending reviews or link candidates become approved."""
    return decide(rows, orders, APPROVED, now)


def reject(rows: DataFrame, orders: DataFrame, rejections: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Pending ones become rejected, and their identities are remembered: (rows, rejections)."""
    out = decide(rows, orders, REJECTED, now)
    new = rows.where(F.col("state") == PENDING).join(orders.select("id").distinct(), "id", "left_semi").select("identity").where("identity is not null")
    return out, rejections.select("identity").unionByName(new).distinct()


def set_status(rows: DataFrame, orders: DataFrame, key: list[str], now: Column, at: str | None = None) -> DataFrame:
    """Set columns of known keys: ``orders(key..., columns...)``; unknown keys make no rows.

    The status of a record or chunk, the triage of a chunk, how many facts it gave, the progress of a run.
    """
    names = [c for c in orders.columns if c not in key]
    one = orders.groupBy(*key).agg(F.max(F.struct(*names)).alias("_n"))
    out = rows.join(one, key, "left")
    for c in names:
        out = out.withColumn(c, F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)))
    if at:
        out = out.withColumn(at, F.when(F.col("_n").isNotNull(), now).otherwise(F.col(at)))
    return out.select(*rows.columns)


def replace(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the keys in ``new`` give way to its rows: all drops of a chunk, all edges of a record."""
    return rows.join(new.select(*key).distinct(), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns).distinct())


def add_missing(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows with those of ``new`` whose key is not there: axioms, shapes, stoplisted terms, edge support, graphs."""
    rest = [c for c in rows.columns if c not in key]
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in key)
    one = new.where(known).groupBy(*key).agg(F.min(F.struct(*rest)).alias("_n")).select(*key, *[F.col(f"_n.{c}").alias(c) for c in rest]) if rest else new.where(known).select(*key).distinct()
    return rows.unionByName(one.join(rows.select(*key).distinct(), key, "left_anti").select(*rows.columns))


def delete_below(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows without those of records below a prefix."""
    return rows.where(~F.coalesce(F.col("record_key").startswith(prefix), F.lit(False)))


def delete_records(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Records with their chunks and edges deleted; versions, drops and findings stay as they are."""
    return {name: keyed_delete(df, gone, ["record_key"]) if name in ("records", "chunks", "edges") else df for name, df in tables.items()}


def mark_deleted(records: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Soft deletion: the first time counts."""
    hit = gone.select("record_key").distinct().withColumn("_hit", F.lit(True))
    return records.join(hit, "record_key", "left").withColumn("deleted_at", F.when(F.col("_hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).select(*records.columns)


def adopt(axioms: DataFrame, batches: DataFrame, shapes: DataFrame, chunks: DataFrame, refused: DataFrame, batch: str, least_docs: int, least_facts: int, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shapes refused often enough become axioms of a batch, their chunks pending again: (axioms, batches, chunks).

    ``refused(subject_kind, relation, object_kind, record_key, chunk_id)``;
    ``shapes`` are those to choose from (all that were refused, by default).
    """
    keys = ["subject_kind", "relation", "object_kind"]
    often = refused.groupBy(*keys).agg(F.count_distinct("record_key").alias("docs"), F.count(F.lit(1)).alias("n")).where((F.col("docs") >= least_docs) & (F.col("n") >= least_facts)).select(*keys)
    chosen = often.join(shapes.select(*keys).distinct(), keys, "left_semi").join(axioms.select(*keys).distinct(), keys, "left_anti")
    grown = axioms.select(*keys, "batch_id").unionByName(chosen.withColumn("batch_id", F.lit(batch)))
    made = chosen.limit(1).select(F.lit(batch).alias("batch_id"), now.alias("adopted_at"), F.lit(None).cast("timestamp").alias("undone_at"))
    return grown, batches.select("batch_id", "adopted_at", "undone_at").unionByName(made), requeue(chunks, refused, chosen)


def requeue(chunks: DataFrame, refused: DataFrame, shapes: DataFrame) -> DataFrame:
    """Chunks that gave a fact of one of these shapes are pending again."""
    keys = ["subject_kind", "relation", "object_kind"]
    hit = refused.join(shapes.select(*keys).distinct(), keys, "left_semi").select("record_key", "chunk_id").distinct().withColumn("_hit", F.lit(True))
    return chunks.join(hit, ["record_key", "chunk_id"], "left").withColumn("status", F.when(F.col("_hit"), PENDING).otherwise(F.col("status"))).select(*chunks.columns)


def unadopt(axioms: DataFrame, batches: DataFrame, facts: DataFrame, batch: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take a batch back: its axioms and the facts that it let in go, and it is stamped: (axioms, batches, facts)."""
    other = lambda c: F.coalesce(F.col(c) != batch, F.lit(True))
    stamp = F.when((F.col("batch_id") == batch) & F.col("undone_at").isNull(), now).otherwise(F.col("undone_at"))
    return axioms.where(other("batch_id")), batches.withColumn("undone_at", stamp), facts.where(other("adopted_batch"))


def pending_shapes(refused: DataFrame, least_docs: int, least_facts: int) -> DataFrame:
    """``(shapes, eligible)``: all refused shapes, and those refused often enough."""
    keys = ["subject_kind", "relation", "object_kind"]
    each = refused.groupBy(*keys).agg(F.count_distinct("record_key").alias("docs"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("shapes"), F.count_if((F.col("docs") >= least_docs) & (F.col("n") >= least_facts)).alias("eligible"))


def dismiss(misses: DataFrame, orders: DataFrame) -> DataFrame:
    """Flag misses: ``orders(kind, key)``."""
    hit = orders.select("kind", "key").distinct().withColumn("_hit", F.lit(True))
    return misses.join(hit, ["kind", "key"], "left").withColumn("dismissed", F.coalesce("_hit", "dismissed")).select(*misses.columns)


def stale_findings(rows: DataFrame, records: DataFrame, reason: str, now: Column) -> DataFrame:
    """Open findings of some records become stale."""
    hit = records.select("record_key").distinct().withColumn("_hit", F.lit(True))
    return _end(rows.join(hit, "record_key", "left"), rows.columns, "stale", reason, now)


def end_findings(rows: DataFrame, keys: DataFrame, status: str, reason: str, now: Column) -> DataFrame:
    """Open findings become resolved or stale by their keys, once."""
    hit = keys.select("finding_key").distinct().withColumn("_hit", F.lit(True))
    return _end(rows.join(hit, "finding_key", "left"), rows.columns, status, reason, now)


def _end(rows: DataFrame, columns: list[str], status: str, reason: str, now: Column) -> DataFrame:
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "open")
    out = rows.withColumn("_end", hit)
    for c, v in (("status", F.lit(status)), ("reason", F.lit(reason)), ("updated_at", now)):
        out = out.withColumn(c, F.when(F.col("_end"), v).otherwise(F.col(c)))
    return out.select(*columns)


def count_resolution(counters: DataFrame, new: DataFrame) -> DataFrame:
    """``(run_id, label, resolved_by, n)``: counters of ``new`` added to those known."""
    keys = ["run_id", "label", "resolved_by"]
    return counters.select(*keys, "n").unionByName(new.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows and new ones, whatever the order of their columns: coverage, hygiene counts, merges, runs."""
    return rows.unionByName(new, allowMissingColumns=True)


def upsert_setting(settings: DataFrame, new: DataFrame) -> DataFrame:
    """Settings with new values put in by key."""
    return keyed_upsert(settings, new, ["key"])


def add_alias(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases put in by label, namespace and alias: the new node counts."""
    return keyed_upsert(aliases, new, ["label", "namespace_uid", "alias"])


def count_present(keys: DataFrame, records: DataFrame) -> DataFrame:
    """``(present)``: how many of some distinct record keys are stored."""
    return keys.select("record_key").distinct().join(records.select("record_key").distinct(), "record_key", "left_semi").agg(F.count(F.lit(1)).alias("present"))


def fully_processed(chunks: DataFrame, group: str) -> DataFrame:
    """``(group, done)``: whether no chunk of a group is waiting."""
    return chunks.where(F.col(group).isNotNull()).groupBy(group).agg(F.bool_and(F.coalesce(F.col("status") != PENDING, F.lit(False))).alias("done"))
