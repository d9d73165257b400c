"""Reports: quality of the graph, of reviews and of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isolation(nodes: DataFrame, facts: DataFrame, relation: str, label: str) -> DataFrame:
    """``(label, total, isolated)``: nodes of a label without a live fact of a relation from them."""
    used = facts.where(F.col("rel_type") == relation).select(F.col("from_uid").alias("uid")).distinct().withColumn("_u", F.lit(True))
    some = nodes.where(F.col("label") == label).join(used, "uid", "left")
    return some.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("_u").isNull()).alias("isolated"))


def degree_one(nodes: DataFrame, facts: DataFrame, label: str, only: str) -> DataFrame:
    """``(label, total, isolated)``: nodes with one live fact in all, of relation ``only``; none at all is not isolated."""
    ends = facts.select(F.col("from_uid").alias("uid"), "rel_type").unionByName(facts.select(F.col("to_uid").alias("uid"), "rel_type"))
    degree = ends.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.max("rel_type").alias("r"))
    some = nodes.where(F.col("label") == label).join(degree, "uid", "left")
    return some.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("total"), F.count_if((F.col("n") == 1) & (F.col("r") == only)).alias("isolated"))


def cardinality_violations(facts: DataFrame, functional: tuple[str, ...]) -> DataFrame:
    """``(from_uid, rel_type, objects)``: subjects of a functional relation with several live objects."""
    some = facts.where(F.col("rel_type").isin(*functional) & F.col("from_uid").isNotNull())
    return some.groupBy("from_uid", "rel_type").agg(F.count_distinct("to_uid").alias("objects")).where("objects > 1")


def adoption_candidates(drops: DataFrame, known: DataFrame, dismissed: DataFrame, least_records: int = 2, least_facts: int = 3) -> DataFrame:
    """Refused shapes often enough to adopt: ``(subject_kind, relation, object_kind, records, facts, example)``.

    ``drops(record_key, subject_kind, relation, object_kind, subject_name,
    object_name)``; a drop that names one thing twice, or lacks a name, does
    not count, and neither do shapes known or dismissed.
    """
    shape = ["subject_kind", "relation", "object_kind"]
    real = drops.where(F.lower("subject_name") != F.lower("object_name"))
    counted = real.groupBy(*shape).agg(F.count_distinct("record_key").alias("records"), F.count(F.lit(1)).alias("facts"), F.min(F.concat_ws(" > ", "subject_name", "object_name")).alias("example"))
    return counted.where((F.col("records") >= least_records) & (F.col("facts") >= least_facts)).join(known.select(*shape).distinct(), shape, "left_anti").join(dismissed.select(*shape).distinct(), shape, "left_anti")


def would_skip(kind: Column, probability: Column) -> Column:
    """Whether triage would leave a piece of text out."""
    return F.coalesce(kind.isin("noise", "scheduling") | ((kind == "discussion") & (probability < 0.3)) | (probability < 0.15), F.lit(False))


def triage(chunks: DataFrame) -> DataFrame:
    """``(kind, chunks, skipped, lost_facts)`` of ``chunks(kind, probability, facts)``."""
    skip = would_skip(F.col("kind"), F.col("probability"))
    return chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(skip).alias("skipped"), F.coalesce(F.sum(F.when(skip, F.col("facts"))), F.lit(0)).cast("long").alias("lost_facts"))


def review_precision(reviews: DataFrame, least: int = 20) -> DataFrame:
    """``(kind, approved, rejected, precision, verdict)`` of ``reviews(kind, state)``."""
    counted = reviews.groupBy("kind").agg(F.count_if(F.col("state") == "approved").alias("approved"), F.count_if(F.col("state") == "rejected").alias("rejected"))
    n = F.col("approved") + F.col("rejected")
    precision = F.when(n > 0, F.col("approved") / n)
    verdict = F.when(n < least, "too few").when(precision >= 0.9, "trusted").when(precision >= 0.7, "usable").otherwise("weak")
    return counted.withColumn("precision", F.coalesce(precision, F.lit(-1.0))).withColumn("verdict", verdict)


def calibration_error(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """``(n, ece)``: the expected calibration error of ``pairs(confidence, correct)`` in equal bins."""
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins))
    some = pairs.where("confidence is not null and correct is not null").groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return some.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def retrieval_scores(cases: DataFrame) -> DataFrame:
    """Per question ``(q, precision, recall, reciprocal_rank)`` of ``cases(q, expected, retrieved)``, arrays in rank order."""
    hits = F.size(F.array_intersect("retrieved", "expected"))
    ranks = F.filter(F.transform("retrieved", lambda x, i: F.when(F.array_contains("expected", x), i + 1)), lambda r: r.isNotNull())
    return cases.select(
        "q",
        F.when(F.size("retrieved") > 0, hits / F.size("retrieved")).otherwise(0.0).alias("precision"),
        F.when(F.size("expected") > 0, hits / F.size(F.array_distinct("expected"))).otherwise(0.0).alias("recall"),
        F.when(F.size(ranks) > 0, 1 / F.array_min(ranks)).otherwise(0.0).alias("reciprocal_rank"),
    )


def retrieval_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("questions"), *[F.avg(c).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


def nearest_rank(rows: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """The value at rank ceil(share * n) of each group, by order statistics and without gathering a group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.expr(f"percentile_disc({share}) within group (order by `{value}`)").alias("value"))


def counters(old: DataFrame, events: DataFrame) -> DataFrame:
    """Add events to kept counters: ``(kind, key, n, first_at, last_at, example)``; the first example stays."""
    fresh = events.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min_by("example", F.struct("at", "example")).alias("example"))
    both = old.unionByName(fresh)
    return both.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min_by("example", F.struct("first_at", "example")).alias("example"))
