"""History of changing attributes: a type-two dimension.

An *event* says that from an instant on an attribute of an entity has a value
(null: none).  A *version* is a value with the half-open period in which it
held.  Values are compared by hash.  Times are milliseconds since 1970 in UTC;
an open version has ``valid_to_ms`` -1.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.operators.sequence import HOT_ROWS, hot_groups, neighbours
from bitempo.session import cut

KEYS = ["entity_id", "attribute"]
_NEVER = -(1 << 62)
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|UTC|[+-]\d{2}:?\d{2})?)?$"


def instant_ms(text: Column) -> Column:
    """Milliseconds of a written time; null if unusable.

    Without an offset it is in the session's zone, which ``prepare`` sets to UTC.
    """
    s = F.trim(text)
    iso = F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(s.rlike(_ISO), F.unix_millis(iso.try_cast("timestamp")))


def ms(ts: Column) -> Column:
    """Milliseconds of a timestamp column (zone-less ones are UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def folded(text: Column) -> Column:
    """A value without case and spacing; null when blank."""
    bare = F.regexp_replace(F.lower(text), r"[\s\p{Z}​﻿]+", "")
    return F.when(bare != "", bare)


def hashed(value: Column) -> Column:
    """64 bits of an attribute value, null for no value; compared within one attribute of one entity only."""
    return F.when(value.isNotNull(), F.xxhash64(value))


def _states(events: DataFrame, hot_rows: int, carry: tuple[str, ...], sizes: DataFrame | None = None) -> DataFrame:
    """What held from when to when, "nothing" included: see ``versions`` and ``Dimension``.

    An event may say in ``since_ms`` from when its value has held already.
    """
    known = events.where(F.col("entity_id").isNotNull() & F.col("attribute").isNotNull() & F.col("at_ms").isNotNull())
    # Fixed-width values only, unless something is carried: aggregation then stays hash-based.
    told = ("value_hash", "ends_ms", *[c for c in ("since_ms",) if c in events.columns], *carry)
    one = known.groupBy(*KEYS, "at_ms").agg(*[F.max_by(c, F.coalesce("rank", F.lit(-2))).alias(c) for c in told])
    hot = hot_groups(known if sizes is None else sizes, KEYS, hot_rows)
    near = neighbours(one, KEYS, "at_ms", {"_ph": F.col("value_hash"), "_pe": F.col("ends_ms")}, {}, hot)
    gap = F.coalesce(F.col("_pe") < F.col("at_ms"), F.lit(False))
    starts = F.col("_first") | gap | ~F.col("value_hash").eqNullSafe(F.col("_ph"))
    # Starts, and the last row of each group, whose ends_ms may end the last version.
    kept = near.withColumn("_starts", starts).where(F.col("_starts") | F.col("_last")).drop("_first", "_last")
    until = F.when(F.col("_starts"), F.least("at_ms", F.coalesce("_pe", "at_ms"))).otherwise(F.col("ends_ms"))
    ended = neighbours(kept, KEYS, "at_ms", {}, {"_until": until, "_more": ~F.col("_starts"), "_at": F.col("at_ms"), "_ends": F.col("ends_ms")}, hot)
    end = F.when(F.col("_last"), F.col("ends_ms")).otherwise(F.col("_until"))
    more = F.coalesce("_more", F.lit(False))
    since = F.coalesce("since_ms", "at_ms") if "since_ms" in events.columns else F.col("at_ms")
    return ended.where("_starts").select(
        *KEYS, *carry, "value_hash", since.alias("valid_from_ms"), F.coalesce(end, F.lit(-1)).alias("valid_to_ms"),
        (F.col("_last") | more).alias("is_last"), F.when(more, F.col("_at")).otherwise(F.col("at_ms")).alias("last_at_ms"), F.when(more, F.col("_ends")).otherwise(F.col("ends_ms")).alias("last_ends_ms"),
    )


_KEPT = ("is_last", "last_at_ms", "last_ends_ms")


def held(states: DataFrame) -> DataFrame:
    """The versions among the states of a dimension, without what is kept for later batches."""
    return states.where(F.col("value_hash").isNotNull()).drop(*_KEPT)


def versions(events: DataFrame, hot_rows: int = HOT_ROWS, carry: tuple[str, ...] = ("value",), sizes: DataFrame | None = None) -> DataFrame:
    """All versions of ``events(entity_id, attribute, at_ms, rank, value_hash, ends_ms)`` in one pass.

    * Rows without key or time are left out; an empty table gives no rows.
    * Of events of one attribute at one instant the largest ``rank`` (a long)
      counts; repeated rows fall together there.
    * An event with the hash of the event before it starts nothing, unless that
      one's ``ends_ms`` lies before it.  A null hash ends the version.
    * A version ends at the next event that differs or at ``ends_ms`` of its
      last event, whichever is first.
    * Columns in ``carry`` come from the event that starts a version; others
      are ignored.  Groups above ``hot_rows`` are windowed in chunks, so one
      entity may hold any share of the rows.  ``sizes`` may give the keys of a
      cheaper frame with at least the rows of each group.
    """
    plain = events.drop("since_ms")
    return held(_states(plain, hot_rows, carry, sizes))


class Dimension(NamedTuple):
    """A type-two dimension between two batches.

    ``states`` are its versions and the spans between them in which an
    attribute had no value (a null hash).  The last one of an attribute
    (``is_last``) knows its last event (``last_at_ms``, ``last_ends_ms``), so
    that events that come in order are merged with it alone.  ``log`` has all
    events, each a few numbers; it is read for what comes late only.
    """

    states: DataFrame
    log: DataFrame


def merge(dimension: Dimension | None, events: DataFrame, hot_rows: int = HOT_ROWS, carry: tuple[str, ...] = ("value",)) -> Dimension:
    """Merge a batch of events into a type-two dimension.

    The hash of an event is compared with that of the current version: an
    equal one confirms it, another one closes it and inserts a new one.  All
    else stays as it is.  Of an attribute with an event that is not later than
    its last one, the versions from the one that the earliest such event falls
    into are told anew from the log.  So batches in any order give the versions
    of one pass (``held``), and merging a batch again changes no version.
    """
    known = events.where(F.col("entity_id").isNotNull() & F.col("attribute").isNotNull() & F.col("at_ms").isNotNull())
    batch = known.select(*KEYS, "at_ms", F.coalesce(F.col("rank").cast("long"), F.lit(-2)).alias("rank"), "value_hash", "ends_ms", *carry)
    if dimension is None:
        return Dimension(_states(batch, hot_rows, carry), batch)
    states, log = dimension
    touched = states.join(batch.groupBy(*KEYS).agg(F.min("at_ms").alias("_from")), KEYS)
    before = F.when(F.col("valid_from_ms") < F.col("_from"), F.col("valid_from_ms"))
    plan = touched.groupBy(*KEYS).agg((F.min("_from") <= F.max("last_at_ms")).alias("_late"), F.coalesce(F.max(before), F.lit(_NEVER)).alias("_anew"))
    plan = cut(plan)
    marked = states.join(plan, KEYS, "left")
    stays = F.col("_late").isNull() | F.when(F.col("_late"), F.col("valid_from_ms") < F.col("_anew")).otherwise(~F.col("is_last"))
    kept = marked.where(stays).drop("_late", "_anew")
    current = marked.where("is_last and not _late").select(*KEYS, F.col("last_at_ms").alias("at_ms"), F.lit(-2).cast("long").alias("rank"), "value_hash", F.col("last_ends_ms").alias("ends_ms"), *carry, F.col("valid_from_ms").alias("since_ms"))
    told = current.unionByName(batch, allowMissingColumns=True)
    late = plan.where("_late").drop("_late")
    if not late.isEmpty():
        again = log.join(late, KEYS).where("at_ms >= _anew").drop("_anew")
        told = told.unionByName(again, allowMissingColumns=True)
    return Dimension(kept.unionByName(_states(told, hot_rows, carry)), log.unionByName(batch))


def change_events(changes: DataFrame, fields: tuple[str, ...] = ("status", "assignee", "priority"), carry: bool = True) -> DataFrame:
    """Events of a change log: of one ``change_id`` the row ingested last counts.

    Rows with a null ``change_id`` all count.  Unusable times, null issues and
    other fields give no events.  ``seen_ms`` is when the row was delivered.
    """
    field = F.lower(F.trim("field"))
    rows = changes.select(
        F.col("change_id").alias("rank"),
        F.col("issue_id").alias("entity_id"),
        field.alias("attribute"),
        instant_ms(F.col("changed_at")).alias("at_ms"),
        hashed(folded(F.col("to_string"))).alias("value_hash"),
        F.trim("to_string").alias("value"),
        # Delivery time in microseconds, equal times told apart by content.
        (F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(0)) * 1024 + F.pmod(F.xxhash64("changed_at", "field", "to_string"), F.lit(1024))).alias("_order"),
    )
    kept = rows if carry else rows.drop("value")
    names = [c for c in kept.columns if c not in ("rank", "_order")]
    # Attributes are few and issues many: both travel as values of the id's latest row.
    latest = kept.where("rank is not null").groupBy("rank").agg(*[F.max_by(c, "_order").alias(c) for c in names], F.max("_order").alias("_order"))
    out = latest.unionByName(kept.where("rank is null").select("rank", *names, "_order")).where(F.col("attribute").isin(*fields))
    return out.withColumn("ends_ms", F.lit(None).cast("long")).withColumn("seen_ms", F.floor(F.col("_order") / 1_024_000)).drop("_order")


def edge_events(edges: DataFrame, relations: tuple[str, ...] = ("ASSIGNED_TO", "BELONGS_TO", "REPORTED_BY")) -> DataFrame:
    """Events of snapshots of functional relations; live rows with a start only."""
    return edges.where(F.col("rel_type").isin(*relations) & (F.col("assertion_status") == "live") & F.col("valid_at").isNotNull()).select(
        F.col("from_uid").alias("entity_id"),
        F.col("rel_type").alias("attribute"),
        ms(F.col("valid_at")).alias("at_ms"),
        (F.coalesce(ms(F.col("observed_at")), F.lit(0)) * 1024 + F.pmod(F.xxhash64("to_uid", "invalid_at"), F.lit(1024))).alias("rank"),
        F.col("to_uid").alias("value"),
        hashed(F.col("to_uid")).alias("value_hash"),
        ms(F.col("invalid_at")).alias("ends_ms"),
        F.coalesce(ms(F.col("observed_at")), F.lit(0)).alias("seen_ms"),
    )
