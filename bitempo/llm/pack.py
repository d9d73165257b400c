"""Filling containers of fixed capacity: bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows packed by one task; each task leaves at most ``open_bins`` bins unfinished.
TASK_ROWS = 50_000


class Bins:
    """At most ``most`` open bins, kept in a bitset whose bit f means free space f.

    ``place`` puts an item into the open bin where it leaves least space.  If
    none has room a new bin is opened; when that is one too many the fullest
    open bin closes first.  Full bins close at once.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # the bitset
        self.at: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        stack = self.at[space]
        found = stack.pop()
        if not stack:
            del self.at[space]
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def _put(self, number: int, space: int) -> None:
        if space:
            self.at.setdefault(space, []).append(number)
            self.free |= 1 << space
            self.open += 1

    def place(self, size: int) -> int:
        roomy = self.free >> size
        if roomy:
            space = size + (roomy & -roomy).bit_length() - 1
            number = self._take(space)
            self._put(number, space - size)
            return number
        number, self.made = self.made, self.made + 1
        if self.open >= self.most:
            self._take((self.free & -self.free).bit_length() - 1)
        self._put(number, self.capacity - size)
        return number


def fill(df: DataFrame, key: str, size: Column, capacity: int = 2048, open_bins: int = 64, task_rows: int = TASK_ROWS) -> DataFrame:
    """The container of each item: ``(key, part_no, from_unit, to_unit, bin_id)``.

    An item of at most ``capacity`` is one part.  A larger one, and only that,
    is split: whole containers of its own, then a rest that is packed like
    other items.  Items of size null or 0 take no space and come with the
    container filled then.  Repeated rows are packed as often as they come.

    Rows are dealt to buckets by a hash of key and size, whose number follows
    the number of rows; each bucket is packed in the order of keys, so a task
    that is run again gives the same.  Only keys and sizes are moved.
    """
    items = df.select(F.col(key).alias("k"), F.coalesce(size.cast("long"), F.lit(0)).alias("n"))
    buckets = max(1, -(-df.count() // task_rows))
    dealt = items.withColumn("b", F.pmod(F.xxhash64("k", "n"), F.lit(buckets))).repartition(buckets, "b").sortWithinPartitions("b", "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, bins = None, None
        for batch in batches:
            keys, part, start, end, where = [], [], [], [], []
            for k, n, b in zip(batch["k"].tolist(), batch["n"].tolist(), batch["b"].tolist(), strict=True):
                if b != bucket:
                    bucket, bins = b, Bins(capacity, open_bins)
                done = p = 0
                while True:
                    take = min(capacity, n - done)
                    keys.append(k)
                    part.append(p)
                    start.append(done)
                    end.append(done + take)
                    where.append((b << 32) + bins.place(take))
                    done, p = done + take, p + 1
                    if done >= n:
                        break
            yield pd.DataFrame({key: keys, "part_no": np.array(part, "int32"), "from_unit": start, "to_unit": end, "bin_id": where})

    kind = dict(df.dtypes)[key]
    return dealt.select("k", "n", "b").mapInPandas(run, f"`{key}` {kind}, part_no int, from_unit long, to_unit long, bin_id long")
