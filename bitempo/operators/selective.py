"""Which statements of a text still need reading, once its exact references are resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.functions.text import units

# Words of a plain reference, and words that make a claim.
REFERENCE = r"(?i)\b(see|refs?|related to|relates to|fixes|fixed|closes|closed|implements|mentioned in|linked|part of|commit|pull request|PR|issue)\b"
CLAIM = r"(?i)\b(because|decided|decision|deprecat\w*|must|should|breaking|caveat|risk|instead|replace[sd]?|supersede[sd]?|migrat\w*|owns?|depends)\b"
WORDS = 24


def covered(unit: Column, anchors: Column) -> Column:
    """Whether a statement only refers to something: an anchor, a word of reference, no claim, not long."""
    low = F.lower(unit)
    hit = F.filter(anchors, lambda a: (a != "") & F.contains(low, F.lower(a)))
    rest = F.aggregate(hit, low, lambda acc, a: F.replace(acc, F.lower(a), F.lit(" ")))
    return F.coalesce((F.size(hit) > 0) & unit.rlike(REFERENCE) & ~rest.rlike(CLAIM) & (F.regexp_count(rest, F.lit("[a-z0-9]+")) <= WORDS), F.lit(False))


def selective(df: DataFrame, key: str, text: str, anchors: str) -> DataFrame:
    """``(key, units, resolved, status, rest)``: deterministic, partial or unresolved, and the text left to read."""
    u = df.select(key, units(F.col(text)).alias("_u"), F.coalesce(anchors, F.array().cast("array<string>")).alias("_a"))
    left = F.filter("_u", lambda x: ~covered(x, F.col("_a")))
    out = u.withColumn("_l", left)
    n, m = F.size("_u"), F.size("_l")
    status = F.when(m == 0, "deterministic").when(m < n, "partial").otherwise("unresolved")
    return out.select(key, n.alias("units"), (n - m).alias("resolved"), status.alias("status"), F.array_join("_l", "\n\n").alias("rest"))
