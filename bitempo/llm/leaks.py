"""Passages of test items inside training texts: a positional inverted index.

Training tokens that are also test terms are stored as postings (term, text,
position).  Each item is represented by the rarest term of every few words; the
offset-adjusted postings of these anchors tell which texts may hold the item.
Only those texts are read again, and exact phrases are chained in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitempo.session import broadcast_if_small, cut, spread

#: One anchor in each run of so many words: a phrase this long has one at least.
SPAN = 8
#: Least share of an item's words that must stand in the text.
SHARE = 0.4
#: How far apart two offset-adjusted anchors of one phrase may lie.
SLACK = 4
#: Words of the shortest phrase that counts.
PHRASE = 3
FOUND = ["words", "matched_words", "share", "longest_phrase", "kind"]


def words(text: Column) -> Column:
    """Words of a text in lower case, whatever the markup, escapes and spacing.

    Link targets, tags and character references are left out; null gives null.
    """
    s = F.regexp_replace(F.lower(text), r"[­​-‏⁠﻿]+", "")
    s = F.regexp_replace(s, r"\]\([^()\s]*\)|</?[a-z][^<>]{0,200}>|&#?[a-z0-9]{2,8};|\\+[nrt]|\\+u[0-9a-f]{4}", " ")
    return F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _runs(item: list[str], text: list[str], phrase: int) -> list[tuple[int, int, int]]:
    """Maximal equal runs (item position, text position, length) of ``phrase`` words or more."""
    at: dict[tuple, list[int]] = {}
    for i in range(len(item) - phrase + 1):
        at.setdefault(tuple(item[i : i + phrase]), []).append(i)
    found = []
    grown: dict[int, int] = {}  # diagonal -> where its last run ends in the text
    for j in range(len(text) - phrase + 1):
        for i in at.get(tuple(text[j : j + phrase]), ()):
            if grown.get(j - i, -1) > j:
                continue
            n = phrase
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]:
                n += 1
            grown[j - i] = j + n
            found.append((i, j, n))
    return found


def chain(item: list[str], text: list[str], phrase: int = PHRASE) -> tuple[int, int]:
    """Most item words in equal runs that follow each other in both, and the longest run.

    Single words between neighbouring runs that stand at the same place in
    both count too; overlapping runs count their words once.
    """
    runs = sorted(_runs(item, text, phrase), key=lambda r: (r[1], r[0]))
    best: list[int] = []
    for b, (i, j, n) in enumerate(runs):
        top = n
        for a in range(b):
            pi, pj, pn = runs[a]
            if pi >= i or pj >= j:
                continue
            overlap = max(0, pi + pn - i, pj + pn - j)
            if overlap < n:
                gain = best[a] + n - overlap
                between, there = i - pi - pn, j - pj - pn
                if 0 < between <= 6 and between == there:
                    gain += sum(item[pi + pn + k] == text[pj + pn + k] for k in range(between))
                top = max(top, gain)
        best.append(top)
    return max(best, default=0), max((n for _, _, n in runs), default=0)


def postings(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """``(term, doc, pos)``: where the given terms stand in the texts."""
    rows = spread(texts.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("_t")))
    tokens = rows.select("doc", F.posexplode(words(F.col("_t"))).alias("pos", "term"))
    return tokens.join(broadcast_if_small(terms.select("term").distinct()), "term").select("term", "doc", "pos")


def _anchors(item_terms: DataFrame, frequency: DataFrame, span: int) -> DataFrame:
    """``(item, ipos, term, n_anchors)``: the rarest term of each run of ``span`` words."""
    ranked = item_terms.join(frequency, "term", "left").select("item", "ipos", "term", F.coalesce("df", F.lit(0)).alias("df"))
    runs = ranked.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("ipos", "df", "term"))).alias("w"))
    start = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - span + 1))
    rarest = F.transform(start, lambda s: F.array_min(F.transform(F.slice("w", s, span), lambda x: F.struct(x["df"].alias("df"), x["ipos"].alias("ipos"), x["term"].alias("term")))))
    chosen = runs.select("item", F.array_distinct(rarest).alias("a")).withColumn("n_anchors", F.size("a"))
    return chosen.select("item", "n_anchors", F.explode("a").alias("x")).select("item", "n_anchors", "x.ipos", "x.term")


def leaks(
    texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, share: float = SHARE, span: int = SPAN, phrase: int = PHRASE, complete: bool = False
) -> DataFrame:
    """Which items stand in which texts: ``(key, item_key, words, matched_words, share, longest_phrase, kind)``.

    An item stands in a text that holds at least ``share`` of its words, in
    order, in phrases of ``phrase`` words or more.  ``kind`` is ``exact`` when
    the whole passage is one phrase, else ``proximity``.  Case, punctuation,
    markup and spacing do not matter.  Null and empty texts or passages have
    no rows; repeated rows of a text or item give one row, and of an item with
    several passages the best match counts.

    A text is a candidate when so many of the item's anchors stand in it as
    make up a third of the share, two at least, and two of them as far apart as
    in the item, give or take ``SLACK`` words.  A leak in phrases of fewer than
    ``span`` words only may be missed.  ``complete`` misses none, at the price
    of more candidates: the rarest term of every ``phrase`` words is an anchor,
    so every phrase that counts has one, and as phrases with up to five equal
    words between them make up the share, there are as many.
    """
    known = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("of"), words(F.col(passage)).alias("iw")).where("size(iw) > 0").distinct()
    item_words = known.select(F.xxhash64("of", "iw").alias("item"), "of", "iw")
    item_terms = cut(item_words.select("item", F.posexplode("iw").alias("ipos", "term")))
    index = cut(postings(texts, key, text, item_terms))
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    anchors = cut(_anchors(item_terms, frequency, phrase if complete else span))
    met = index.join(broadcast_if_small(anchors), "term").select("doc", "item", "n_anchors", "ipos", (F.col("pos") - F.col("ipos")).alias("at"))
    counted = met.groupBy("doc", "item", "ipos").agg(F.first("n_anchors").alias("of")).groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of"))
    if complete:
        size = item_words.select("item", F.size("iw").alias("size"))
        enough = F.greatest(F.lit(1), F.ceil((F.col("size") * share + 5) / (phrase + 5) / phrase))
        candidates = counted.join(broadcast_if_small(size), "item").where(F.col("n") >= enough)
    else:
        # Adjusted by their offset in the item, anchors of one phrase meet at one place in the text.
        # Bands of twice the slack, laid twice, hold any two that are at most the slack apart.
        band = F.explode(F.array(F.floor(F.col("at") / (2 * SLACK)) * 2, F.floor((F.col("at") + SLACK) / (2 * SLACK)) * 2 + 1))
        together = met.select("doc", "item", "ipos", band.alias("band")).groupBy("doc", "item", "band").agg((F.min("ipos") < F.max("ipos")).alias("two")).where("two").select("doc", "item").distinct()
        candidates = counted.where(F.col("n") >= F.greatest(F.lit(2), F.col("of") * (share / 3))).join(together, ["doc", "item"], "left_semi")
    asked = cut(candidates.select("doc", "item").join(broadcast_if_small(item_words), "item"))
    wanted = asked.select("doc").distinct()
    read = texts.select(F.col(key).alias("doc"), F.col(text).alias("_t")).join(broadcast_if_small(wanted), "doc", "left_semi").select("doc", words(F.col("_t")).alias("tw"))
    kinds = dict(asked.dtypes)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, item, iw, tw in zip(b["doc"], b["of"], b["iw"], b["tw"], strict=True):
                iw, tw = list(iw), list(tw)
                matched, longest = chain(iw, tw, min(phrase, len(iw)))
                if matched >= share * len(iw):
                    rows.append((doc, item, len(iw), matched, matched / len(iw), longest, "exact" if longest == len(iw) else "proximity"))
            yield pd.DataFrame(rows, columns=["doc", "item", *FOUND])

    found = asked.join(read, "doc").mapInPandas(verify, f"doc {kinds['doc']}, item {kinds['of']}, words int, matched_words int, share double, longest_phrase int, kind string")
    one = found.groupBy("doc", "item").agg(F.max(F.struct("share", *[c for c in FOUND if c != "share"])).alias("m"))
    return one.select(F.col("doc").alias(key), F.col("item").alias(item_key), *[F.col(f"m.{c}").alias(c) for c in FOUND])
