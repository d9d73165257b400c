"""Keyed operational tables: upserts, queues, reviews, anchors and what they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitempo.session import small


def keyed_upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key.

    Columns in ``keep`` stay as they are on a known key, those in ``fill`` take
    a new value only if it is not null, all others are overwritten.  Of
    repeated new keys the largest row counts; null keys are left out.
    """
    rest = [c for c in old.columns if c not in key]
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in key)
    one = new.where(known).groupBy(*key).agg(F.max(F.struct(*rest)).alias("_n"))
    there = F.col("n._n").isNotNull()
    marked = old.withColumn("_old", F.lit(True)).alias("o").join(one.alias("n"), key, "full_outer")

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n._n.{c}")
        if c in keep:
            return F.when(F.col("o._old"), o).otherwise(n)
        return F.coalesce(n, o) if c in fill else F.when(there, n).otherwise(o)

    return marked.select(*[F.col(c) if c in key else value(c).alias(c) for c in old.columns])


def keyed_delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those to delete."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def queue(rows: DataFrame, k: int) -> DataFrame:
    """The next ``k`` rows by ``priority`` (highest first), then ``at``, then ``id``."""
    return rows.orderBy(F.col("priority").desc(), F.col("at").asc_nulls_last(), "id").limit(k)


def newest_run(rows: DataFrame, group: list[str], run: str, at: str) -> DataFrame:
    """All rows of the newest run of each group; of runs at one time the larger id."""
    newest = rows.groupBy(*group).agg(F.max_by(run, F.struct(at, run)).alias(run))
    return rows.join(newest, [*group, run], "left_semi")


def fresh_reviews(wanted: DataFrame, known: DataFrame, key: str = "identity") -> DataFrame:
    """Reviews to make: one for each identity that has none, pending or rejected."""
    one = wanted.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("payload").alias("payload"))
    return one.join(known.select(key).distinct(), key, "left_anti")


def anchored(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``(record_key, uid)``: targets of other providers that a record names exactly.

    ``records(record_key, provider, anchors)`` with an array of anchors,
    ``targets(anchor, uid, provider)``.  An anchor that begins with # is bare:
    it counts only if exactly one target ends with it.
    """
    named = records.select("record_key", F.col("provider").alias("_p"), F.explode(F.array_distinct("anchors")).alias("anchor"))
    full = named.where(~F.col("anchor").startswith("#")).join(targets, "anchor")
    tails = targets.select(F.concat(F.lit("#"), F.element_at(F.split("anchor", "#"), -1)).alias("anchor"), "uid", "provider", F.contains("anchor", F.lit("#")).alias("_h")).where("_h").drop("_h")
    lone = tails.groupBy("anchor").agg(F.count_distinct("uid").alias("_n"), F.min("uid").alias("uid"), F.min("provider").alias("provider")).where("_n = 1").drop("_n")
    bare = named.where(F.col("anchor").startswith("#")).join(lone, "anchor")
    return full.select("record_key", "_p", "uid", "provider").unionByName(bare.select("record_key", "_p", "uid", "provider")).where("_p <> provider").select("record_key", "uid").distinct()


def same_people(people: DataFrame) -> DataFrame:
    """``(a, b)``: people of equal address, each tied to the smallest of them.

    ``people(uid, email)``.  A star, not all pairs: an address that many share
    makes one link each.
    """
    known = people.select("uid", F.lower(F.trim("email")).alias("e")).where("e <> '' and uid is not null").distinct()
    return known.join(known.groupBy("e").agg(F.min("uid").alias("a")), "e").where("a <> uid").select("a", F.col("uid").alias("b")).distinct()


def modified(commits: DataFrame, present: DataFrame) -> DataFrame:
    """``(repository, commit_hash, path)``: changed files that exist, by their new or old path.

    ``commits(repository, commit_hash, files)``, ``present(repository, path)``.
    """
    touched = commits.select("repository", "commit_hash", F.explode("files").alias("f")).select("repository", "commit_hash", F.explode(F.array("f.path", "f.old_path")).alias("path"))
    return touched.where("coalesce(path, '') <> ''").distinct().join(present.select("repository", "path").distinct(), ["repository", "path"], "left_semi")


def first_known(rows: DataFrame, chain: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """``rows`` with ``found`` and ``via``: the first of several lookups ``(name, (key, uid))`` that knows the key."""
    found, via = F.lit(None).cast("string"), F.lit(None).cast("string")
    out = rows
    for i, (name, lookup) in reversed(list(enumerate(chain))):
        out = out.join(lookup.groupBy(key).agg(F.min("uid").alias(f"_u{i}")), key, "left")
        known = F.col(f"_u{i}").isNotNull()
        found, via = F.when(known, F.col(f"_u{i}")).otherwise(found), F.when(known, F.lit(name)).otherwise(via)
    return out.withColumn("found", found).withColumn("via", via).select(*rows.columns, "found", "via")


def mentionable(name: Column, stoplist: list[str]) -> Column:
    """Whether a term is worth a node: three characters, not stoplisted, not of stoplisted words only."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in stoplist]) if stoplist else F.array().cast("array<string>")
    return F.coalesce((F.length(F.trim(name)) >= 3) & ~F.array_contains(stop, F.lower(F.trim(name))) & (F.size(F.array_except(words, stop)) > 0), F.lit(False))


def shared_records(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(a, b, records)``: how many records mention both of ``pairs(a, b)``."""
    m = mentions.select("uid", "record_key").distinct()
    both = pairs.select("a", "b").distinct().join(m.withColumnRenamed("uid", "a"), "a").join(m.withColumnRenamed("uid", "b"), ["b", "record_key"])
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("records"))


def sweep(legs: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """``(constant, weight, q, id, rank)``: fusion of ``legs(q, leg, id, rank)`` for each point of a small stated ``grid(constant, weight)``."""
    if not small(grid, 1000):
        raise ValueError("a grid has at most 1000 points")
    points = [tuple(r) for r in grid.select("constant", "weight").distinct().collect()]
    each = F.array(*[F.struct(F.lit(c).alias("constant"), F.lit(float(w)).alias("weight")) for c, w in points])
    spread = legs.select("*", F.explode(each).alias("p")).select("p.*", "q", "id", (F.when(F.col("leg") == "vector", F.col("p.weight")).otherwise(1.0) / (F.col("p.constant") + F.col("rank"))).alias("s"))
    fused = spread.groupBy("constant", "weight", "q", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    near = Window.partitionBy("constant", "weight", "q").orderBy(F.col("score").desc(), "id")
    return fused.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
