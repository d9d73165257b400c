"""Cutting oversized texts at natural boundaries, inside SQL expressions.

A text becomes a *skeleton* with one character per token, which tells how
strong the boundary after that token is.  A regular expression of bounded
quantifiers, its alternatives ordered by boundary strength, consumes the
skeleton piece by piece; running sums of the match lengths are token offsets,
and a lookback of ``overlap`` tokens gives each piece its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.llm.tokens import SPACE, TOKEN, n_tokens

#: Boundaries after a token, strongest first: blank line, line, sentence, white space.
STRENGTHS = "plsw"
PIECE = ["piece_no", "n_pieces", "token_from", "token_to", "new_from", "piece"]


def _units(text: Column) -> Column:
    """Tokens with the white space after them; leading white space joins the first."""
    return F.regexp_extract_all(text, F.lit(rf"(?:^[{SPACE}]+)?(?:{TOKEN})[{SPACE}]*+"), F.lit(0))


def _boundary(unit: Column) -> Column:
    return (
        F.when(unit.rlike(r"\r\n?[^\S\r\n]*[\r\n]|\n[^\S\r\n]*[\r\n]"), "p")
        .when(unit.rlike(r"[\n\r  \u0085]"), "l")
        .when(unit.rlike(rf"[.!?。！？…][{SPACE}]+$"), "s")
        .when(unit.rlike(rf"[{SPACE}]$"), "w")
        .otherwise("c")
    )


def piece_pattern(limit: int, overlap: int, least: float = 0.5) -> str:
    """The expression that consumes one piece of new tokens from a skeleton.

    A boundary counts when the piece gets at least the share ``least`` of the
    room; after the kinds of boundary, strongest first, comes any token.
    """
    room = limit - overlap
    low = max(1, int(room * least))
    kinds = [f"(?:.{{{low - 1},{room - 1}}}{k})" for k in STRENGTHS]
    # What is left and fits is one piece, whatever it ends with.
    return "|".join([f"(?:.{{1,{room}}}$)", *kinds, f"(?:.{{1,{room}}})"])


def split_texts(df: DataFrame, text: str, keep: list[str], limit: int = 1500, overlap: int = 150, least: float = 0.5) -> DataFrame:
    """Pieces of at most ``limit`` tokens, neighbours sharing ``overlap`` tokens.

    Adds ``piece_no`` (from 0), ``n_pieces``, ``token_from`` and ``token_to``
    (half open), ``new_from`` (where the tokens begin that the piece before
    does not have) and ``piece``.  The pieces from ``new_from`` on, set one
    after the other, are the text: nothing is lost, white space included.

    A text within the limit is one piece, unchanged.  A null or blank text is
    one piece too, without tokens.  The first piece has ``limit`` tokens at
    most, later ones ``overlap`` old and ``limit - overlap`` new ones.  One
    token is never split, however long.  Columns not in ``keep`` are dropped.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    base = df.select(*keep, F.col(text).alias("_text"), n_tokens(F.col(text)).cast("int").alias("_n"))
    long = F.col("_n") > limit
    base = base.withColumn("_u", F.when(long, _units(F.col("_text"))))
    skeleton = F.array_join(F.transform("_u", _boundary), "")
    rest = F.regexp_extract_all(F.substr(F.col("_s"), F.length("_f") + 1), F.lit(piece_pattern(limit, overlap, least)), F.lit(0))
    cut = base.withColumn("_s", F.when(long, skeleton)).withColumn("_f", F.when(long, F.regexp_extract("_s", piece_pattern(limit, 0, least), 0)))
    sizes = F.when(long, F.concat(F.array(F.length("_f")), F.transform(rest, lambda m: F.length(m)))).otherwise(F.array(F.col("_n")))
    ends = F.aggregate(
        "_sizes",
        F.expr("array(cast(0 as int))"),
        lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)),
    )
    pieces = cut.withColumn("_sizes", sizes).withColumn("_ends", ends).withColumn("n_pieces", F.size("_sizes"))
    at = pieces.select("*", F.posexplode(F.slice("_ends", 2, F.size("_ends"))).alias("piece_no", "token_to"))
    at = at.withColumn("new_from", F.element_at("_ends", F.col("piece_no") + 1)).withColumn("token_from", F.greatest(F.lit(0), F.col("new_from") - F.when(F.col("piece_no") > 0, overlap).otherwise(0)))
    body = F.when(F.col("n_pieces") == 1, F.col("_text")).otherwise(F.array_join(F.slice("_u", F.col("token_from") + 1, F.col("token_to") - F.col("token_from")), ""))
    return at.select(*keep, "piece_no", "n_pieces", "token_from", "token_to", "new_from", body.alias("piece"))
