"""Writing facts: keyed merges of a batch into a snapshot, and what closes, corrects and confirms them.

Facts are one table keyed by (from_uid, rel_type, to_uid).  Each operator takes
snapshots and returns new ones; ``now`` is an argument, so a replay gives the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.functions.ids import make_uid
from bitempo.functions.temporal import interval_note, live

KEY = ["from_uid", "rel_type", "to_uid"]
#: Columns that a batch may set on a known fact when it states them.
STATED = ["derived", "derived_rule", "premise_fact_uids", "ended_unknown", "attested_from", "attested_by_record", "adopted_batch", "decay_class", "chunk_id", "chunk_hash", "extractor_version", "model"]


def _col(df: DataFrame, side: str, name: str, kind: str) -> Column:
    return F.col(f"{side}.{name}") if name in df.columns else F.lit(None).cast(kind)


def upsert(facts: DataFrame, batch: DataFrame, now: Column, revive: bool = True, update_evidence: bool = False) -> DataFrame:
    """Merge a batch of stated facts into the snapshot.

    * A new key makes a live fact, dated ``now`` unless the batch says since when.
    * A known one is confirmed (``last_confirmed_at``) only if evidence or
      confidence is stated and differs, a new record supports it, or it is
      revived.  Plain comparison: against a null nothing differs.
    * ``revive`` opens a closed fact again and ignores a stated end; without
      it a closed fact stays closed.
    * Evidence and confidence of a known fact stay, unless ``update_evidence``.
    * Records are added when the first of the batch row is not among them.

    Of repeated keys in a batch the largest row (by record keys, then evidence)
    states the rest, but every one adds its records, in the order of their
    size.  Rows with a null in the key are left out.
    """
    kinds = dict(facts.dtypes)
    known = batch.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY))
    ranked = F.struct(*[F.col(c) for c in ("source_record_keys", "evidence", "confidence", "valid_at") if c in batch.columns])
    rest = [c for c in batch.columns if c not in KEY]
    none = F.array().cast("array<string>")
    stated = F.sort_array(F.collect_set(F.col("source_record_keys") if "source_record_keys" in batch.columns else none), asc=False)
    one = known.groupBy(*KEY).agg(F.max_by(F.struct(*rest), ranked).alias("_n"), stated.alias("_keys")).select(*KEY, "_n.*", "_keys")
    both = facts.alias("o").join(one.withColumn("_new", F.lit(True)).alias("n"), KEY, "full_outer")
    n = lambda c: _col(one, "n", c, kinds.get(c, "string"))
    o = lambda c: F.col(f"o.{c}")
    made, met = F.col("o.fact_uid").isNull(), F.col("o.fact_uid").isNotNull() & F.col("n._new").isNotNull()
    keys = F.coalesce(o("source_record_keys"), none)

    def add(held: Column, more: Column) -> Column:
        first = F.try_element_at(more, F.lit(1))
        return F.when(first.isNotNull() & ~F.array_contains(held, first), F.concat(held, more)).otherwise(held)

    made_keys = F.when(F.size("n._keys") > 1, F.aggregate(F.slice("n._keys", F.lit(2), F.greatest(F.size("n._keys") - 1, F.lit(0))), F.coalesce(F.try_element_at("n._keys", F.lit(1)), none), add)).otherwise(n("source_record_keys"))
    merged_keys = F.aggregate(F.coalesce("n._keys", F.array().cast("array<array<string>>")), keys, add)
    supported = F.size(merged_keys) > F.size(keys)
    reopened = o("invalid_at").isNotNull() & F.lit(revive)
    differs = lambda c: F.coalesce(n(c) != o(c), F.lit(False))
    changed = differs("evidence") | differs("confidence") | F.coalesce(supported, F.lit(False)) | reopened

    def pick(created: Column, matched: Column, kept: Column) -> Column:
        return F.when(made, created).when(met, matched).otherwise(kept)

    out: dict[str, Column] = {
        "fact_uid": F.when(met | ~made, o("fact_uid")).otherwise(F.coalesce(n("fact_uid"), make_uid(F.lit("Fact"), *[F.col(k) for k in KEY]))),
        "valid_at": pick(F.coalesce(n("valid_at"), now), F.when(reopened, F.coalesce(n("valid_at"), now)).otherwise(o("valid_at")), o("valid_at")),
        "invalid_at": pick(n("invalid_at"), F.lit(None).cast("timestamp") if revive else o("invalid_at"), o("invalid_at")),
        "first_seen_at": pick(now, o("first_seen_at"), o("first_seen_at")) if "first_seen_at" in kinds else None,
        "last_confirmed_at": pick(now, F.when(changed, now).otherwise(o("last_confirmed_at")), o("last_confirmed_at")) if "last_confirmed_at" in kinds else None,
        "source_record_keys": pick(made_keys, F.when(supported, merged_keys).otherwise(o("source_record_keys")), o("source_record_keys")),
        "assertion_status": pick(F.lit("live"), o("assertion_status"), o("assertion_status")),
    }
    for c in ("evidence", "confidence"):
        if c in kinds:
            out[c] = pick(n(c), F.coalesce(n(c), o(c)) if update_evidence else o(c), o(c))
    if "valid_at_basis" in kinds:
        stated = F.coalesce(n("valid_at_basis"), o("valid_at_basis"), F.lit("record_time")) if revive else F.coalesce(o("valid_at_basis"), n("valid_at_basis"), F.lit("record_time"))
        out["valid_at_basis"] = pick(F.coalesce(n("valid_at_basis"), F.lit("record_time")), stated, o("valid_at_basis"))
    if "projection_status" in kinds:
        out["projection_status"] = pick(F.coalesce(n("projection_status"), F.lit("live")), F.coalesce(n("projection_status"), o("projection_status"), F.lit("live")), o("projection_status"))
    if "pinned" in kinds:
        out["pinned"] = pick(F.coalesce(n("pinned"), F.lit(False)), F.coalesce(n("pinned"), F.lit(False)) | F.coalesce(o("pinned"), F.lit(False)), o("pinned"))
    for c in STATED:
        if c in kinds:
            out[c] = pick(n(c), F.coalesce(n(c), o(c)), o(c))
    return both.select(*[F.col(c) if c in KEY else (out[c] if out.get(c) is not None else (F.coalesce(n(c), o(c)) if c in one.columns and c != "_keys" else o(c))).alias(c) for c in facts.columns])


def _is_live(df: DataFrame) -> Column:
    projection = F.col("projection_status") if "projection_status" in df.columns else F.lit("live")
    return live(F.col("invalid_at"), F.col("assertion_status"), projection)


def archive(facts: DataFrame, which: Column, now: Column, until: Column | None = None, status: Column | None = None) -> DataFrame:
    """History rows of the facts that ``which`` picks: what was held until ``now``, and true until ``until``."""
    until = now if until is None else until
    seen = F.col("first_seen_at") if "first_seen_at" in facts.columns else F.col("valid_at")
    return facts.where(which).select(
        make_uid(F.lit("FactHistory"), F.col("fact_uid"), now.cast("string")).alias("uid"), "fact_uid", "from_uid", "to_uid", F.col("rel_type").alias("relation"),
        F.col("valid_at").alias("valid_from"), until.alias("valid_to"), seen.alias("observed_from"), now.alias("observed_to"), "source_record_keys", "confidence", (F.col("assertion_status") if status is None else status).alias("assertion_status"),
    )


def supersede(facts: DataFrame, relation: str, subjects: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Close every live fact of a relation from ``subjects(from_uid)``; (facts, new history)."""
    hit = subjects.select("from_uid").where("from_uid is not null").distinct().withColumn("_hit", F.lit(True))
    marked = facts.join(hit, "from_uid", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & (F.col("rel_type") == relation) & _is_live(facts))
    closed = marked.withColumn("invalid_at", F.when(F.col("_hit"), now).otherwise(F.col("invalid_at"))).select(*facts.columns)
    return closed, archive(marked, F.col("_hit"), now)


def remove_support(facts: DataFrame, records: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Take records away from what they support; a live fact without any support left ends: (facts, new history).

    ``records(record_key[, valid_to])`` may be many: only facts that name one of
    them are touched, by a join on their record keys.  ``valid_to`` says since
    when the record holds no longer; the history then ends there.
    """
    at = F.col("valid_to").cast("timestamp") if "valid_to" in records.columns else F.lit(None).cast("timestamp")
    gone = records.where("record_key is not null").groupBy("record_key").agg(F.max(at).alias("_to"))
    lost = facts.select("fact_uid", F.explode("source_record_keys").alias("record_key")).join(gone, "record_key").groupBy("fact_uid").agg(F.collect_set("record_key").alias("_lost"), F.max("_to").alias("_to"))
    rest = F.array_except("source_record_keys", "_lost")
    out = facts.join(lost, "fact_uid", "left").withColumn("_ends", F.col("_lost").isNotNull() & (F.size(rest) == 0) & F.col("invalid_at").isNull())
    history = archive(out, F.col("_ends"), now, F.coalesce("_to", now))
    out = out.withColumn("source_record_keys", F.when(F.col("_lost").isNotNull(), rest).otherwise(F.col("source_record_keys")))
    return out.withColumn("invalid_at", F.when(F.col("_ends"), now).otherwise(F.col("invalid_at"))).select(*facts.columns), history


class Refused(ValueError):
    """An order that names no live fact, or ends one before it began."""


def find_live(facts: DataFrame, orders: DataFrame) -> DataFrame:
    """``orders(fact_uid, ...)`` with ``live``: whether exactly one live fact has the id."""
    n = facts.where(_is_live(facts)).groupBy("fact_uid").agg(F.count(F.lit(1)).alias("_n"))
    return orders.join(n, "fact_uid", "left").withColumn("live", F.coalesce(F.col("_n") == 1, F.lit(False))).drop("_n")


def _checked(orders: DataFrame, strict: bool, why: str) -> None:
    if strict and not orders.isEmpty():
        raise Refused(why)


def close(facts: DataFrame, orders: DataFrame, now: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """End facts at a world time: ``orders(fact_uid, valid_to)``; (facts, new history).

    An order for no live fact, or for an end before the start, changes nothing;
    with ``strict`` it is ``Refused`` before anything is written.
    """
    one = orders.groupBy("fact_uid").agg(F.min("valid_to").alias("_to"))
    out = facts.join(one, "fact_uid", "left")
    fine = F.col("_to").isNotNull() & _is_live(facts) & F.coalesce(F.col("_to") >= F.col("valid_at"), F.lit(True))
    _checked(find_live(facts, one).where("not live"), strict, "an order names no live fact")
    _checked(out.where(F.col("_to").isNotNull() & _is_live(facts) & ~fine), strict, "a fact would end before it began")
    closed = out.withColumn("invalid_at", F.when(fine, F.col("_to")).otherwise(F.col("invalid_at"))).select(*facts.columns)
    return closed, archive(out, fine, now, F.col("_to"))


def correct(facts: DataFrame, wrong: DataFrame, now: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Facts that were never true: ``wrong(fact_uid)`` end where they began, as corrected; (facts, new history).

    Their history shows that they were held until ``now``.
    """
    one = wrong.select("fact_uid").distinct()
    _checked(find_live(facts, one).where("not live"), strict, "an order names no live fact")
    out = facts.join(one.withColumn("_w", F.lit(True)), "fact_uid", "left")
    hit = F.coalesce("_w", F.lit(False)) & _is_live(facts)
    history = archive(out, hit, now, F.col("valid_at"), F.lit("corrected"))
    out = out.withColumn("_hit", hit).withColumn("invalid_at", F.when(F.col("_hit"), F.col("valid_at")).otherwise(F.col("invalid_at")))
    return out.withColumn("assertion_status", F.when(F.col("_hit"), F.lit("corrected")).otherwise(F.col("assertion_status"))).select(*facts.columns), history


def confirm(facts: DataFrame, support: DataFrame, now: Column) -> DataFrame:
    """Restate live facts: ``support(fact_uid, record_key[, evidence, confidence])``; dates of the world stay.

    Stated evidence and confidence replace the old ones.  ``last_confirmed_at``
    moves only if something is new.
    """
    stated = [c for c in ("evidence", "confidence") if c in support.columns]
    one = support.groupBy("fact_uid").agg(F.array_sort(F.collect_set("record_key")).alias("_more"), *[F.max(c).alias(f"_{c}") for c in stated])
    out = facts.join(one, "fact_uid", "left").withColumn("_live", _is_live(facts) & F.col("_more").isNotNull())
    keys = F.coalesce("source_record_keys", F.array().cast("array<string>"))
    new = F.array_except("_more", keys)
    changed = F.size(new) > 0
    for c in stated:
        changed = changed | F.coalesce(F.col(f"_{c}") != F.col(c), F.lit(False))
    out = out.withColumn("_new", F.col("_live") & changed).withColumn("source_record_keys", F.when(F.col("_live"), F.concat(keys, new)).otherwise(F.col("source_record_keys")))
    for c in stated:
        out = out.withColumn(c, F.when(F.col("_live"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    if "last_confirmed_at" in facts.columns:
        out = out.withColumn("last_confirmed_at", F.when(F.col("_new"), now).otherwise(F.col("last_confirmed_at")))
    return out.select(*facts.columns)


def touch_metadata(facts: DataFrame, orders: DataFrame, now: Column) -> DataFrame:
    """Facts with ``metadata_revised_at``: ``orders(fact_uid[, at])`` set it, content clocks stay."""
    at = F.col("at") if "at" in orders.columns else F.lit(None).cast("timestamp")
    one = orders.groupBy("fact_uid").agg(F.max(F.coalesce(at, now)).alias("_at"))
    old = F.col("metadata_revised_at") if "metadata_revised_at" in facts.columns else F.lit(None).cast("timestamp")
    return facts.join(one, "fact_uid", "left").withColumn("metadata_revised_at", F.coalesce("_at", old)).drop("_at")


def reinforcement(keys: Column) -> Column:
    """How many records support a fact."""
    return F.size(F.coalesce(keys, F.array().cast("array<string>")))


def set_projection(facts: DataFrame, orders: DataFrame) -> DataFrame:
    """Facts live or waiting for review: ``orders(fact_uid, projection_status)``; other words are refused."""
    fine = orders.where(F.col("projection_status").isin("live", "pending_review")).groupBy("fact_uid").agg(F.max("projection_status").alias("_p"))
    old = F.col("projection_status") if "projection_status" in facts.columns else F.lit("live")
    return facts.join(fine, "fact_uid", "left").withColumn("projection_status", F.coalesce("_p", old)).drop("_p")


def invalidate(facts: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Close open facts named by their ends: ``pairs(from_uid, rel_type, to_uid)``."""
    hit = pairs.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    out = facts.join(hit, KEY, "left")
    return out.withColumn("invalid_at", F.when(F.col("_hit") & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at"))).select(*facts.columns)


def upsert_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    """History with ``rows`` of the same columns put in by ``uid``; known ones are overwritten."""
    rest = [c for c in history.columns if c != "uid"]
    one = rows.where("uid is not null").groupBy("uid").agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("s")).select("uid", "s.*")
    return history.join(one.select("uid"), "uid", "left_anti").select(*history.columns).unionByName(one.select(*history.columns))


def unlink_mentions(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """Mentions without those of ``records(record_key, primary_uid)`` but of their own node."""
    own = records.groupBy("record_key").agg(F.max("primary_uid").alias("_own"))
    return mentions.join(own, "record_key", "left").where(F.col("_own").isNull() | (F.col("_own") == F.col("uid"))).select(*mentions.columns)


def with_defaults(facts: DataFrame) -> DataFrame:
    """Facts from before the clocks: a missing basis is the record's time, a missing status live."""
    out = facts
    for c, word in (("valid_at_basis", "record_time"), ("assertion_status", "live")):
        out = out.withColumn(c, F.coalesce(F.col(c) if c in facts.columns else F.lit(None).cast("string"), F.lit(word)))
    return out


def fact_row(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Facts as readers get them, with names of both ends: ``(source, target, relation, evidence, valid_from, valid_to, documents, live, text)``."""
    named = nodes.groupBy("uid").agg(F.max("name").alias("name"))
    out = facts
    for end, name in (("from_uid", "source"), ("to_uid", "target")):
        out = out.join(named.select(F.col("uid").alias(end), F.col("name").alias(f"_{name}")), end, "left").withColumn(name, F.coalesce(f"_{name}", end))
    evidence = F.col("evidence") if "evidence" in facts.columns else F.lit(None).cast("string")
    unknown = F.coalesce(F.col("ended_unknown"), F.lit(False)) if "ended_unknown" in facts.columns else F.lit(False)
    note = interval_note(F.col("valid_at"), F.col("invalid_at"), unknown)
    text = F.concat(F.col("source"), F.lit(" "), F.col("rel_type"), F.lit(" "), F.col("target"), F.lit(" ("), note, F.lit(")"), F.when(F.coalesce(evidence, F.lit("")) != "", F.concat(F.lit(": "), evidence)).otherwise(""))
    return out.select(
        "fact_uid", "source", "target", F.col("rel_type").alias("relation"), evidence.alias("evidence"), F.col("valid_at").alias("valid_from"), F.col("invalid_at").alias("valid_to"), F.coalesce("source_record_keys", F.array().cast("array<string>")).alias("documents"), _is_live(facts).alias("live"), text.alias("text")
    )


def mark_ended_unknown(facts: DataFrame, orders: DataFrame) -> DataFrame:
    """Facts known to have ended, not when: ``orders(fact_uid, attested_from)``."""
    one = orders.groupBy("fact_uid").agg(F.min("attested_from").alias("_a"))
    out = facts.join(one, "fact_uid", "left")
    known = F.col("ended_unknown") if "ended_unknown" in facts.columns else F.lit(False)
    since = F.col("attested_from") if "attested_from" in facts.columns else F.lit(None).cast("timestamp")
    return out.withColumn("ended_unknown", F.col("_a").isNotNull() | F.coalesce(known, F.lit(False))).withColumn("attested_from", F.coalesce("_a", since)).drop("_a")


def upsert_nodes(nodes: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Merge entities by uid: a null never overwrites, first and last sight are kept."""
    rest = [c for c in batch.columns if c != "uid"]
    one = batch.where("uid is not null").groupBy("uid").agg(*[F.max(c).alias(c) for c in rest]).withColumn("_new", F.lit(True))
    both = nodes.alias("o").join(one.alias("n"), "uid", "full_outer")
    made = F.col("o.first_seen_at").isNull() & F.col("n._new").isNotNull()
    cols = []
    for c in nodes.columns:
        if c == "uid":
            cols.append(F.col("uid"))
        elif c == "first_seen_at":
            cols.append(F.when(made, now).otherwise(F.col("o.first_seen_at")).alias(c))
        elif c == "last_seen_at":
            cols.append(F.when(F.col("n._new").isNotNull(), now).otherwise(F.col("o.last_seen_at")).alias(c))
        else:
            cols.append((F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in rest else F.col(f"o.{c}")).alias(c))
    return both.select(*cols)


def stubs(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(uid, label)`` of ends that no node stands for yet."""
    ends = facts.select(F.col("from_uid").alias("uid"), F.col("from_label").alias("label")).unionByName(facts.select(F.col("to_uid").alias("uid"), F.col("to_label").alias("label")))
    return ends.where("uid is not null").groupBy("uid").agg(F.min("label").alias("label")).join(nodes.select("uid"), "uid", "left_anti")


def mentions(facts: DataFrame) -> DataFrame:
    """``(uid, record_key)``: which records mention a node, each pair once."""
    ends = facts.select(F.explode(F.array("from_uid", "to_uid")).alias("uid"), "source_record_keys")
    return ends.select("uid", F.explode("source_record_keys").alias("record_key")).where("uid is not null and record_key is not null").distinct()


def delete_nodes(nodes: DataFrame, facts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and every fact at either end of them."""
    uids = gone.select("uid").distinct()
    kept = facts.join(uids.withColumnRenamed("uid", "from_uid"), "from_uid", "left_anti").join(uids.withColumnRenamed("uid", "to_uid"), "to_uid", "left_anti")
    return nodes.join(uids, "uid", "left_anti"), kept.select(*facts.columns)


def orphans(nodes: DataFrame, mentioned: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Nodes of these labels that no record mentions."""
    return nodes.where(F.col("label").isin(*labels)).join(mentioned.select("uid").distinct(), "uid", "left_anti")
