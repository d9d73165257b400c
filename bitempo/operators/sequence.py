"""Ordered neighbours within groups of any size.

A plain window puts a whole group into one task.  Here groups above
``hot_rows`` are cut along the order column at approximate quantiles; each
chunk is windowed by itself and only one summary row per chunk is windowed
over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 100_000
PIECES = 256


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys of groups above ``hot_rows``, or None when there are none.

    Give it the cheapest frame that has at least the rows of the groups.
    """
    hot = df.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys)
    return None if hot.isEmpty() else hot


def chunked(df: DataFrame, keys: list[str], order: str, hot: DataFrame, pieces: int) -> DataFrame:
    """``df`` with a column ``_chunk``: 0, but for ``hot`` groups cut into ``pieces``.

    Chunks of a group follow each other in ``order``, and equal values of it
    share a chunk.
    """
    cuts = (
        df.join(hot, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(order, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(100 * pieces)).alias("_cuts"))
    )
    below = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return df.join(cuts, keys, "left").withColumn("_chunk", F.coalesce(below, F.lit(0))).drop("_cuts")


def neighbours(df: DataFrame, keys: list[str], order: str, previous: dict[str, Column], following: dict[str, Column], hot: DataFrame | None = None, pieces: int = PIECES, then: tuple[str, ...] = ()) -> DataFrame:
    """Add values of the row before (``previous``) and the row after (``following``).

    Names map to expressions over a row.  ``order``, with the columns
    of ``then`` for ties, must be unique within ``keys``, and none of them may be
    null (callers filter).  The first row of a
    group gets nulls for the row before and the last for the row after;
    ``_first`` and ``_last`` mark them.  ``hot`` are the keys of large groups.
    """
    pack = lambda names: F.struct(F.lit(1).alias("_"), *[e.alias(n) for n, e in names.items()])
    df = df.withColumn("_p", pack(previous)).withColumn("_n", pack(following))
    if hot is None:
        near = Window.partitionBy(*keys).orderBy(order, *then)
        out = df.withColumn("_before", F.lag("_p").over(near)).withColumn("_after", F.lead("_n").over(near))
    else:
        parts = chunked(df, keys, order, hot, pieces)
        near = Window.partitionBy(*keys, "_chunk").orderBy(order, *then)
        inside = parts.withColumn("_before", F.lag("_p").over(near)).withColumn("_after", F.lead("_n").over(near))
        around = Window.partitionBy(*keys).orderBy("_chunk")
        ends = parts.groupBy(*keys, "_chunk").agg(F.max_by("_p", F.struct(order, *then)).alias("_end"), F.min_by("_n", F.struct(order, *then)).alias("_begin"))
        ends = ends.select(*keys, "_chunk", F.lag("_end").over(around).alias("_end"), F.lead("_begin").over(around).alias("_begin"))
        out = inside.join(ends, [*keys, "_chunk"], "left").withColumn("_before", F.coalesce("_before", "_end")).withColumn("_after", F.coalesce("_after", "_begin")).drop("_end", "_begin", "_chunk")
    return out.select(
        *[c for c in df.columns if c not in ("_p", "_n")],
        F.col("_before").isNull().alias("_first"),
        F.col("_after").isNull().alias("_last"),
        *[F.col(f"_before.{n}").alias(n) for n in previous],
        *[F.col(f"_after.{n}").alias(n) for n in following],
    )


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, hot: DataFrame | None = None, pieces: int = PIECES, then: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: the sum of ``value`` over a group's rows up to each row in ``order`` (see ``neighbours``)."""
    df = df.withColumn(name, value)
    upto = lambda by: Window.partitionBy(*by).orderBy(order, *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if hot is None:
        return df.withColumn(name, F.sum(name).over(upto(keys)))
    parts = chunked(df, keys, order, hot, pieces)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy(*keys, "_chunk").agg(F.sum(name).alias("_end")).select(*keys, "_chunk", F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("_end"))
    inside = parts.withColumn(name, F.sum(name).over(upto([*keys, "_chunk"])))
    return inside.join(ends, [*keys, "_chunk"], "left").withColumn(name, F.col(name) + F.col("_end")).drop("_end", "_chunk")
