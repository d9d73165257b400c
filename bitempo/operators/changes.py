"""What changed between two states: records, chunks, change logs, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.operators.sequence import HOT_ROWS, hot_groups, neighbours, running

INSERT, UPDATE, KEEP, DELETE = "insert", "update", "keep", "delete"


def content_hash(*parts: Column) -> Column:
    """Hash of a record's content; null and empty differ, Windows line ends do not."""
    text = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), "\r\n?", "\n"), "\x00", "")
    return F.sha2(F.to_json(F.struct(*[text(p).alias(f"c{i}") for i, p in enumerate(parts)])), 256)


def plan(stored: DataFrame, present: DataFrame, key: str = "record_key", hashed: str = "content_hash") -> DataFrame:
    """``(key, action)`` for each record of either state: insert, update, keep or delete.

    Repeated keys count once, with their largest hash; a null key is left out;
    a present record without a hash is an update.
    """
    one = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(hashed).alias(name), F.lit(True).alias(f"{name}_there"))
    both = one(stored, "_old").join(one(present, "_now"), key, "full_outer")
    action = F.when(F.col("_now_there").isNull(), DELETE).when(F.col("_old_there").isNull(), INSERT).when(F.col("_old") == F.col("_now"), KEEP).otherwise(UPDATE)
    return both.select(key, action.alias("action"))


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(record_key, chunk_id, state)``: kept, added or superseded, of the records in ``new``.

    Superseded chunks are those that a re-read record no longer has.
    """
    keys = ["record_key", "chunk_id"]
    touched = new.select("record_key").distinct()
    a = old.join(touched, "record_key", "left_semi").select(*keys).distinct().withColumn("_old", F.lit(1))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_new").isNull(), "superseded").when(F.col("_old").isNull(), "added").otherwise("kept").alias("state"))


def value_spans(changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(item, value, start_at, end_at, first, from_value)``: from each change to the next one of its item.

    ``changes(item, at, seq, from_value, to_value)``; the last span is open, and
    an item may have any share of the changes.
    """
    known = changes.where("item is not null and at is not null").withColumn("seq", F.coalesce("seq", F.lit(-1)))
    near = neighbours(known, ["item"], "at", {}, {"end_at": F.col("at")}, hot_groups(known, ["item"], hot_rows), then=("seq",))
    return near.select("item", F.col("to_value").alias("value"), F.col("at").alias("start_at"), "end_at", F.col("_first").alias("first"), "from_value")


def field_intervals(items: DataFrame, changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(item, value, start_at, end_at)``: the periods of one field from its change log.

    ``items(item, created_at, current)`` and ``changes(item, at, seq, from_value,
    to_value)``.  The first period begins with the item's creation and has the
    first change's old value, or the current one when nothing changed.
    """
    spans = value_spans(changes, hot_rows)
    first = spans.where("first").select("item", F.col("from_value").alias("_v"), F.col("start_at").alias("end_at"), F.lit(True).alias("_moved"))
    opening = items.join(first, "item", "left").select("item", F.when(F.col("_moved"), F.col("_v")).otherwise(F.col("current")).alias("value"), F.col("created_at").alias("start_at"), "end_at")
    return opening.unionByName(spans.select("item", "value", "start_at", "end_at").join(items.select("item"), "item", "left_semi"))


def record_versions(states: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(record_key, version, content_hash, at)``: a version starts where the hash differs from the one before.

    ``states(record_key, at, content_hash)``; rows with a null among them are
    left out, repeated ones count once.
    """
    known = states.select("record_key", "at", "content_hash").dropna().distinct()
    hot = hot_groups(known, ["record_key"], hot_rows)
    moved = neighbours(known, ["record_key"], "at", {"_p": F.col("content_hash")}, {}, hot, then=("content_hash",)).where(~F.col("content_hash").eqNullSafe(F.col("_p")))
    return running(moved.select(*known.columns), ["record_key"], "at", F.lit(1).cast("long"), "version", hot, then=("content_hash",)).select("record_key", "version", "content_hash", "at")


def moved_from(records: DataFrame) -> DataFrame:
    """``(record_key, moved_from)``: an older record of the same connection with equal content.

    ``records(record_key, connection, content_hash, at)``.  Copies are not
    paired with each other: each names the oldest of its content.
    """
    first = records.groupBy("connection", "content_hash").agg(F.min_by("record_key", F.struct("at", "record_key")).alias("moved_from"))
    return records.join(first, ["connection", "content_hash"]).where(F.col("record_key") != F.col("moved_from")).select("record_key", "moved_from")


def missing(stored: DataFrame, present: DataFrame, prefix: str, key: str = "record_key") -> DataFrame:
    """Stored keys under a prefix that are not present any more."""
    return stored.where(F.col(key).startswith(prefix)).select(key).distinct().join(present.select(key).distinct(), key, "left_anti")
