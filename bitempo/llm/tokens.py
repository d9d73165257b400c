"""Tokens: a run of letters, digits and underscores, or one other visible character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
TOKEN = rf"{WORD}++|[^\p{{L}}\p{{N}}_{SPACE}]"


def n_tokens(text: Column) -> Column:
    """Number of tokens of a text (0 for null or blank)."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")
