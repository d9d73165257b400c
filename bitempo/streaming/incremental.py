"""Incremental sync: streams of records merged into snapshots, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitempo.operators import changes, history
from bitempo.operators.store import Store
from bitempo.session import cut

_STATE = "content_hash string, updates long"
_OUT = "record_key string, action string, updates long, priority long"


def record_actions(stream: DataFrame) -> DataFrame:
    """Insert, update or keep of each record in a stream of ``(record_key, content_hash)``.

    State is one hash and a counter per record.  The priority of a record is
    100 at first, then 200 and its number of updates, 300 at most.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, updates = state.get if state.exists else (None, -1)
        rows = []
        for batch in batches:
            for h in batch["content_hash"]:
                action = "insert" if updates < 0 else "keep" if h == found else "update"
                if action != "keep":
                    priority = 100 if updates < 0 else min(300, 200 + updates)
                    found, updates = h, updates + 1
                else:
                    priority = 0
                rows.append((key[0], action, updates, priority))
        state.update((found, updates))
        yield pd.DataFrame(rows, columns=["record_key", "action", "updates", "priority"])

    known = stream.where("record_key is not null").select("record_key", "content_hash")
    return known.groupBy("record_key").applyInPandasWithState(step, T.StructType.fromDDL(_OUT), T.StructType.fromDDL(_STATE), "append", GroupStateTimeout.NoTimeout)


def sync_history(stream: DataFrame, store: Store, checkpoint: str, table: str = "history"):
    """Merge a stream of attribute events into a type-two table, batch by batch.

    A batch that is delivered again changes no version, since merging is
    idempotent; the log of events only grows by each batch, and the snapshot
    is switched after both are complete.
    """

    def merge(batch: DataFrame, _: int) -> None:
        states = store.read(table)
        known = cut(batch)
        new = history.merge(None if states is None else history.Dimension(states, store.read(f"{table}_log")), known)
        store.write({table: new.states}, more={f"{table}_log": history.merge(None, known).log})

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_records(stream: DataFrame, store: Store, checkpoint: str, table: str = "records"):
    """Merge a stream of ``(record_key, content_hash, at)`` into the ledger, newest state first."""

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.where("record_key is not null").groupBy("record_key").agg(F.max_by(F.struct("content_hash", "at"), F.struct("at", "content_hash")).alias("s")).select("record_key", "s.*")
        old = store.read(table)
        if old is not None:
            new = old.unionByName(new).groupBy("record_key").agg(F.max_by(F.struct("content_hash", "at"), F.struct("at", "content_hash")).alias("s")).select("record_key", "s.*")
        store.write({table: new})

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, group: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(group..., start, end, n)``: tumbling windows; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *group).agg(F.count(F.lit(1)).alias("n")).select(*group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def plan_against(store: Store, present: DataFrame, table: str = "records") -> DataFrame:
    """What a full listing means for the ledger: insert, update, keep or delete of each record."""
    old = store.read(table)
    old = present.limit(0) if old is None else old
    return changes.plan(old, present)
