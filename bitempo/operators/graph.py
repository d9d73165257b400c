"""Reads of the fact graph: complete lists, neighbours, paths, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitempo.session import cut

#: Relations that expansion follows, and labels that it never returns.
EXPAND_RELATIONS = ("IMPLEMENTS", "DOCUMENTS", "PARENT_OF", "REFERENCES", "MODIFIES", "APPLIES_TO", "DEFINES")
HUBS = ("Repository", "Project", "Workspace", "Person", "SourceRecord")
TIERS = {"unknown": 0, "derived": 1, "secondary": 2, "primary": 3}


def tier(method: Column) -> Column:
    """Authority of an extraction method."""
    return F.when(method.isin("deterministic", "exact_anchor", "changelog"), "primary").when(method == "llm", "secondary").when(method == "derived", "derived").otherwise("unknown")


def without(items: DataFrame, facts: DataFrame, relation: str, key: str = "uid") -> DataFrame:
    """Items that are the subject of no (live) fact of a relation; facts are filtered first."""
    return items.join(facts.where(F.col("rel_type") == relation).select(F.col("from_uid").alias(key)).distinct(), key, "left_anti")


def latest(rows: DataFrame, group: list[str], order: list[str], k: int = 1) -> DataFrame:
    """The ``k`` last rows of each group by ``order`` (give it a total order), with ``rank``.

    Groups of any size: rows beyond k leave before they are moved.
    """
    near = Window.partitionBy(*group).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def by_prefix(rows: DataFrame, column: str, prefixes: DataFrame, least: int = 4) -> DataFrame:
    """``(prefix, rows...)`` whose value begins with one of ``prefixes(prefix)``.

    Joined on the first ``least`` characters, so it stays an equi join; shorter
    prefixes are left out.
    """
    asked = prefixes.select(F.lower("prefix").alias("prefix")).where(F.length("prefix") >= least).distinct().withColumn("_k", F.substring("prefix", 1, least))
    return rows.withColumn("_k", F.substring(F.lower(F.col(column)), 1, least)).join(asked, "_k").where(F.lower(F.col(column)).startswith(F.col("prefix"))).drop("_k")


def window_activity(facts: DataFrame, mentions: DataFrame, start: Column, end: Column) -> DataFrame:
    """``(uid, activity)``: facts that began in ``[start, end)`` per subject, counted once for each record that mentions it."""
    begun = facts.where((F.col("valid_at") >= start) & (F.col("valid_at") < end)).groupBy(F.col("from_uid").alias("uid")).agg(F.count(F.lit(1)).alias("_f"))
    seen = mentions.groupBy("uid").agg(F.count(F.lit(1)).alias("_m"))
    return begun.join(seen, "uid").select("uid", (F.col("_f") * F.col("_m")).alias("activity"))


def clusters(edges: DataFrame, hops: int | None = None) -> DataFrame:
    """``(uid, cluster)``: connected nodes of undirected ``edges(a, b)`` share their smallest id.

    Labels spread along edges and jump along labels, so rounds follow the
    logarithm of the longest path; with ``hops`` labels spread that far and do
    not jump.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null and a <> b").distinct())
    state = cut(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("a"), F.min("b")).alias("cluster")) if hops is None or hops > 0 else both.select(F.col("a").alias("uid"), F.col("a").alias("cluster")).distinct())
    done = 1
    while hops is None or done < hops:
        spread = both.join(state.select(F.col("uid").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("cluster").alias("_c"))
        new = state.join(spread, "uid").select("uid", F.least("cluster", "_c").alias("cluster"), F.col("cluster").alias("_was"))
        if hops is None:
            up = new.select(F.col("uid").alias("cluster"), F.col("cluster").alias("_up"))
            new = new.join(up, "cluster", "left").select("uid", F.least("cluster", F.coalesce("_up", "cluster")).alias("cluster"), "_was")
        new = cut(new)
        moved = not new.where("cluster <> _was").isEmpty()
        state = new.drop("_was")
        done += 1
        if not moved:
            break
    return state


def path(facts: DataFrame, relations: list[str]) -> DataFrame:
    """Node paths along a list of relations: ``(n0, n1, ..., nk)``, distinct."""
    out = None
    for i, relation in enumerate(relations):
        step = facts.where(F.col("rel_type") == relation).select(F.col("from_uid").alias(f"n{i}"), F.col("to_uid").alias(f"n{i + 1}")).distinct()
        out = step if out is None else out.join(step, f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(relations) + 1)])


def expand(facts: DataFrame, labels: DataFrame, seeds: DataFrame, relations: tuple[str, ...] = EXPAND_RELATIONS, hubs: tuple[str, ...] = HUBS, per_seed: int = 4, floor: str = "derived") -> DataFrame:
    """``(seed, neighbour, rel_type, rank)``: one hop both ways, hubs left out, asserted facts first.

    ``facts(from_uid, rel_type, to_uid, derived[, extraction_method])`` are live
    ones; ``seeds(seed)``.  Facts by a method of less authority than ``floor``
    are not followed, nor those by an unknown one.  Ties go to the relation,
    then the neighbour.
    """
    some = facts.where(F.col("rel_type").isin(*relations))
    if "extraction_method" in facts.columns:
        some = some.where(tier(F.col("extraction_method")).isin(*[t for t, n in TIERS.items() if n >= TIERS[floor]]))
    out = some.select(F.col("from_uid").alias("seed"), F.col("to_uid").alias("neighbour"), "rel_type", "derived")
    back = some.select(F.col("to_uid").alias("seed"), F.col("from_uid").alias("neighbour"), "rel_type", "derived")
    near = out.unionByName(back).join(seeds.select("seed").distinct(), "seed").where("seed <> neighbour")
    near = near.join(labels.where(~F.col("label").isin(*hubs)).select(F.col("uid").alias("neighbour")), "neighbour", "left_semi")
    one = near.groupBy("seed", "neighbour").agg(F.min(F.struct("derived", "rel_type")).alias("m"))
    order = Window.partitionBy("seed").orderBy("m.derived", "m.rel_type", "neighbour")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_seed).select("seed", "neighbour", "m.rel_type", "rank")


def visible(nodes: DataFrame, facts: DataFrame, mentions: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that a visible record mentions, and facts with a visible record between two of them."""
    seen = mentions.join(records.select("record_key").distinct(), "record_key", "left_semi").select("uid").distinct()
    shown = nodes.join(seen, "uid", "left_semi")
    backed = facts.select("fact_uid", F.explode("source_record_keys").alias("record_key")).join(records.select("record_key").distinct(), "record_key", "left_semi").select("fact_uid").distinct()
    kept = facts.join(backed, "fact_uid", "left_semi")
    for end in ("from_uid", "to_uid"):
        kept = kept.join(shown.select(F.col("uid").alias(end)), end, "left_semi")
    return shown, kept


def two_hop(facts: DataFrame, centres: DataFrame, degree: int = 50, mentions: DataFrame | None = None) -> DataFrame:
    """``(a, b, shared)``: pairs that share a centre but no fact, each with how many centres.

    Centres with more than ``degree`` facts are hubs by definition and make no
    pairs, which bounds the pairs of one centre.  Mentions ``(uid, record_key)``
    are links of a centre too.
    """
    ends = facts.select(F.col("from_uid").alias("x"), F.col("to_uid").alias("z")).unionByName(facts.select(F.col("to_uid").alias("x"), F.col("from_uid").alias("z"))).where("x is not null and z is not null and x <> z")
    links = ends.select("z") if mentions is None else ends.select("z").unionByName(mentions.select(F.col("uid").alias("z")))
    count = links.groupBy("z").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= degree).select("z")
    arms = ends.join(centres.select(F.col("uid").alias("z")), "z", "left_semi").join(count, "z", "left_semi").distinct()
    pairs = arms.select("z", F.col("x").alias("a")).join(arms.select("z", F.col("x").alias("b")), "z").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    direct = ends.select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b")).distinct()
    return pairs.join(direct, ["a", "b"], "left_anti")


def path_support(pairs: DataFrame, minimum: float = 0.4) -> DataFrame:
    """``(path, support, low)``: the geometric mean of ``pairs(path, support)``, each .01 at least."""
    mean = F.exp(F.avg(F.ln(F.greatest(F.lit(0.01), F.col("support")))))
    return pairs.groupBy("path").agg(mean.alias("support")).withColumn("low", F.col("support") < minimum)
