"""Text windows and fuzzy names: the operators that need Python, in Arrow batches."""

from __future__ import annotations

import difflib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+|[^\w\s]")


def best_window(text: str | None, terms: list[str], size: int = 300) -> str:
    """The window of ``size`` tokens that holds most of the terms; the earliest of equal ones."""
    spans = [m.span() for m in _TOKEN.finditer(text or "")]
    if len(spans) <= size:
        return text or ""
    best, found = -1, ""
    step = max(1, size // 2)
    for i in range(0, len(spans), step):
        part = text[spans[i][0] : spans[min(i + size, len(spans)) - 1][1]]
        low = part.lower()
        score = sum(t in low for t in terms)
        if score > best:
            best, found = score, part
        if i + size >= len(spans):
            break
    return found


def best_windows(text: Column, terms: Column, size: int = 300) -> Column:
    """``best_window`` over columns of texts and term arrays."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            yield pd.Series([best_window(t, [] if w is None else list(w), size) for t, w in zip(texts, wanted, strict=True)])

    return run(text, terms)


def pack_units(units: list[str], target: int) -> list[str]:
    """Units joined greedily up to ``target`` tokens; a larger unit stands alone."""
    out: list[str] = []
    held, used = [], 0
    for u in units:
        n = len(_TOKEN.findall(u))
        if held and used + n > target:
            out.append("\n\n".join(held))
            held, used = [], 0
        held.append(u)
        used += n
    return [*out, "\n\n".join(held)] if held else out


def chunks(df: DataFrame, key: str, units: Column, target: int = 500) -> DataFrame:
    """``(key, chunk_index, text, tokens)``: each text's units packed into chunks."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([pack_units([] if u is None else list(u), target) for u in b])

    out = df.select(key, F.posexplode(run(units)).alias("chunk_index", "text"))
    return out.withColumn("tokens", F.regexp_count("text", F.lit(r"(?U)\w+|[^\w\s]")))


def ratio(a: str, b: str) -> float:
    """Longest-matching-block similarity of two words."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def fuzzy_names(people: DataFrame, words: DataFrame, least: float = 0.82) -> DataFrame:
    """``(id, word, similarity)``: people with a name part like a word of the question.

    ``people(id, name)`` and ``words(word)``.  Parts and words are paired when
    they share two letters in a row, which a ratio of .82 needs from words of
    three letters on, and each distinct pair is compared once.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(F.col(c), i, F.lit(2))))
    parts = people.select("id", F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"([\p{L}]{3,})"), F.lit(1))).alias("part")).distinct()
    a = parts.select("part").distinct().select("part", F.explode(grams("part")).alias("g"))
    b = words.select(F.lower("word").alias("word")).where("length(word) > 2").distinct().select("word", F.explode(grams("word")).alias("g"))
    # Twice the shorter length bounds the ratio: pairs that cannot reach it are not compared.
    fits = 2 * F.least(F.length("part"), F.length("word")) >= least * (F.length("part") + F.length("word"))
    pairs = a.join(b, "g").select("part", "word").distinct().where(fits)

    @F.pandas_udf("double")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    alike = pairs.withColumn("similarity", compare("part", "word")).where(F.col("similarity") >= least)
    return parts.join(alike, "part").groupBy("id", "word").agg(F.max("similarity").alias("similarity"))


def split_tokens(text: str, most: int) -> list[str]:
    """A text in pieces of ``most`` tokens, trimmed; one that fits is left as it is."""
    starts = [m.start() for m in _TOKEN.finditer(text)]
    if len(starts) <= most:
        return [text] if text else []
    cuts = [*starts[::most], len(text)]
    return [p for a, b in zip(cuts, cuts[1:], strict=False) if (p := text[a:b].strip())]


def within_limit(texts: list[str], most: int) -> list[str]:
    """Texts trimmed, without empty ones; those above ``most`` tokens are split."""
    return [p for t in texts if t.strip() for p in split_tokens(t.strip(), most)]


def char_windows(text: str, size: int = 1200, overlap: int = 150) -> list[str]:
    """Windows of ``size`` characters that end at a space where there is one in their last third."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and (space := text.rfind(" ", at + size * 2 // 3, end)) > at:
            end = space
        if piece := text[at:end].strip():
            out.append(piece)
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk_records(records: DataFrame, target: int = 500, hard: int = 900) -> DataFrame:
    """``(record_key, chunk_index, chunk_id, content_hash, text, route)`` of ``records(record_key, content, language)``.

    Prose is packed from its sentences, code from its blocks of comments; code
    in an unknown language is taken whole.  No chunk has more than ``hard``
    tokens.  An id tells the record, the text and which of its equal texts it
    is, so an edit elsewhere keeps it.  Null and blank contents have no chunks.
    """
    from bitempo.functions.code import STYLES, comment_blocks
    from bitempo.functions.ids import uuid5
    from bitempo.functions.text import units

    known = F.lower("language").isin(*STYLES)
    body = F.trim(F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "\x00", ""))
    rows = records.where("record_key is not null").select("record_key", "language", body.alias("_t")).where("_t <> ''")
    route = F.when(F.coalesce(F.trim("language"), F.lit("")) == "", "prose").when(known, "comments").otherwise("code")
    parts = F.when(F.col("route") == "prose", units(F.col("_t"))).when(F.col("route") == "code", F.array("_t")).otherwise(comment_blocks(F.col("_t"), F.col("language")))

    @F.pandas_udf("array<string>")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([within_limit(pack_units([] if u is None else list(u), target), hard) for u in b])

    made = rows.withColumn("route", route).select("record_key", "route", packed(parts).alias("_p"))
    # Equal texts of a record are numbered inside its array: no shuffle.
    numbered = F.transform("_p", lambda t, i: F.struct(i.alias("chunk_index"), t.alias("text"), F.sha2(t, 256).alias("content_hash"), F.size(F.filter(F.slice(F.col("_p"), F.lit(1), i), lambda o: o == t)).alias("n")))
    out = made.select("record_key", "route", F.explode(numbered).alias("c")).select("record_key", "route", "c.*")
    return out.select("record_key", "chunk_index", uuid5(F.concat_ws(":", "record_key", "content_hash", F.col("n").cast("string")), uuid.NAMESPACE_URL).alias("chunk_id"), "content_hash", "text", "route")
