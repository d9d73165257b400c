"""Keyword and vector search, fusion of ranked lists, roles and selection of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitempo.session import broadcast_if_small, cut, spread

#: Fusion and ranking parameters.
RRF_K, VECTOR_WEIGHT, PER_METHOD, LIMIT = 10, 3.0, 30, 8
BM25_K1, BM25_B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Words of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, key, tf, dl)``: the inverted index, with the length of each text."""
    words = spread(docs.where(F.col(key).isNotNull()).select(key, text)).select(F.col(key), terms(F.col(text)).alias("_w")).withColumn("dl", F.size("_w"))
    return words.select(key, "dl", F.explode("_w").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def expand_prefixes(words: DataFrame, queries: DataFrame) -> DataFrame:
    """``(q, term)``: the vocabulary ``words(term)`` that begins with a query's words.

    Words meet the vocabulary on their first two letters, so it is an equi
    join; words of one letter match themselves only.
    """
    asked = queries.select("q", F.explode(F.array_distinct(terms(F.col("text")))).alias("w"))
    words = words.select("term").distinct()
    long = asked.where(F.length("w") > 1).withColumn("_k", F.substring("w", 1, 2)).join(words.withColumn("_k", F.substring("term", 1, 2)), "_k").where(F.col("term").startswith(F.col("w"))).select("q", "term")
    return long.unionByName(asked.where(F.length("w") == 1).select("q", F.col("w").alias("term"))).distinct()


def bm25_search(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """``(q, key, score)`` of ``queries(q, text)``, whose words may be prefixes; statistics over all texts.

    Texts are cut into words once.  Only the vocabulary and the postings of
    words that are asked for are moved, never the postings of the whole corpus.
    Texts without a word count for nothing; a null text or key has no rows.
    """
    words = cut(spread(docs.where(F.col(key).isNotNull()).select(key, text)).select(F.col(key), terms(F.col(text)).alias("_w")).where(F.size("_w") > 0))
    asked = cut(expand_prefixes(words.select(F.explode("_w").alias("term")), queries))
    found = words.select(key, F.size("_w").alias("dl"), F.explode("_w").alias("term")).join(broadcast_if_small(asked.select("term").distinct()), "term")
    index = cut(found.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf")))
    stats = words.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("_w")).alias("_avg"))
    return bm25(index, key, asked, stats)


def bm25(index: DataFrame, key: str, asked: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``(q, key, score)`` of ``asked(q, term)`` over postings; ``stats(_n, _avg)`` of the corpus come from a whole index by default."""
    if stats is None:
        stats = index.select(key, "dl").distinct().agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avg"))
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    hits = asked.join(df, "term").join(index, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.ln(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    norm = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("_avg")))
    return hits.groupBy("q", key).agg(F.sum(idf * norm).alias("score"))


def top(scored: DataFrame, group: list[str], key: str, k: int, score: str = "score") -> DataFrame:
    """The best ``k`` of each group with ``rank`` from 1; ties go to the smaller key."""
    near = Window.partitionBy(*group).orderBy(F.col(score).desc(), key)
    return scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def meet(queries: DataFrame, rows: DataFrame, query_block: int = 500, row_block: int = 20_000) -> DataFrame:
    """A stated set of ``queries(q, ...)`` against all ``rows(id, ...)``, in blocks.

    Both sides are cut into blocks of a bounded size, and each meeting of two
    blocks is one cell of an equi join, so neither side is sent whole.
    """
    nq, nr = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (rows, row_block)))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_qb", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int")).withColumn("_rb", number(nr))
    right = rows.withColumn("_rb", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("_qb", number(nq))
    return left.join(right, ["_qb", "_rb"]).drop("_qb", "_rb")


def nearest(queries: DataFrame, rows: DataFrame, k: int, least: float = -1.0, most: float = 2.0) -> DataFrame:
    """``(q, id, cosine, rank)``: exact k nearest for a stated set of unit vectors.

    ``queries(q, qv)`` meet ``rows(id, v)``.  A band ``[least, most)`` is
    applied before the limit.
    """
    scored = meet(queries, rows).select("q", "id", dot(F.col("qv"), F.col("v")).alias("cosine")).where((F.col("cosine") >= least) & (F.col("cosine") < most))
    return top(scored, ["q"], "id", k, "cosine")


def fuse_labels(scored: DataFrame, strategy: str, k: int) -> DataFrame:
    """``(q, id, label, rank)``: lists per label into one.

    ``global_score`` orders by score, ``normalized`` by the score's share of
    its label's best, ``per_label_rank`` goes round the labels.
    """
    label = Window.partitionBy("q", "label")
    if strategy == "global_score":
        order = [F.col("score").desc(), F.col("id")]
    elif strategy == "normalized":
        best = scored.groupBy("q", "label").agg(F.max("score").alias("_m"))
        scored = scored.join(best, ["q", "label"]).withColumn("_s", F.col("score") / F.col("_m")).drop("_m")
        order = [F.col("_s").desc(), F.col("score").desc(), F.col("id")]
    else:
        scored = scored.withColumn("_r", F.row_number().over(label.orderBy(F.col("score").desc(), "id")))
        order = [F.col("_r"), F.col("label"), F.col("id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).select("q", "id", "label", "rank")


def interleave(lists: DataFrame) -> DataFrame:
    """``(q, id, rank)`` of ``lists(q, channel, rank, id)``: round robin, the first place of an id counts."""
    first = lists.groupBy("q", "id").agg(F.min(F.struct("rank", "channel")).alias("m"))
    return first.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy("m.rank", "m.channel", "id")).alias("rank"))


def rrf(legs: DataFrame, k: int = LIMIT, constant: int = RRF_K) -> DataFrame:
    """``(q, id, score, rank)`` of ``legs(q, id, rank, weight)`` with ranks from 1: weights over constant plus rank."""
    fused = legs.groupBy("q", "id").agg(F.sum(F.col("weight") / (constant + F.col("rank"))).alias("score"))
    return top(fused, ["q"], "id", k)


def roles(scores: DataFrame, direct: float = 0.5, bridge: float = 0.2, bridges: int = 4) -> DataFrame:
    """``(q, id, score, role)`` of ``scores(q, id, score, methods)``.

    Hits of a time window are temporal, named ones and high scores direct; of
    the middle scores the best ``bridges`` are bridges, and rejected ones fill
    what places are left.
    """
    has = lambda *m: F.arrays_overlap("methods", F.array(*[F.lit(x) for x in m]))
    first = F.when(has("time_window"), "temporal").when(has("named_entity", "pair") | (F.col("score") >= direct), "direct").when(F.col("score") >= bridge, "bridge").otherwise("irrelevant")
    held = scores.withColumn("_r", first)
    near = Window.partitionBy("q", "_r").orderBy(F.col("score").desc(), "id")
    held = held.withColumn("_n", F.row_number().over(near)).withColumn("_b", F.count_if(F.col("_r") == "bridge").over(Window.partitionBy("q")))
    role = F.when((F.col("_r") == "bridge") & (F.col("_n") > bridges), "irrelevant").when((F.col("_r") == "irrelevant") & (F.col("_n") <= bridges - F.col("_b")), "bridge").otherwise(F.col("_r"))
    return held.select("q", "id", "score", role.alias("role"))


def select_final(scores: DataFrame, threshold: float = 0.5, min_keep: int = 3, max_keep: int = 12) -> DataFrame:
    """``(q, id, score, rank)``: what passes the threshold, at least the best ``min_keep``, at most ``max_keep``."""
    one = scores.groupBy("q", "id").agg(F.max("score").alias("score"))
    near = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    ranked = one.withColumn("rank", F.row_number().over(near))
    return ranked.where(((F.col("score") >= threshold) | (F.col("rank") <= min_keep)) & (F.col("rank") <= max_keep))


def merge_unique(groups: DataFrame) -> DataFrame:
    """``(q, id, rank)`` of ``groups(q, grp, pos, id)``: one group after the other, the first place of an id counts."""
    first = groups.groupBy("q", "id").agg(F.min(F.struct("grp", "pos")).alias("m"))
    return first.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy("m.grp", "m.pos", "id")).alias("rank"))


def cap(facts: DataFrame, most: int) -> DataFrame:
    """``facts(q, id, derived)`` asserted first, cut at ``most``, with how many were ``dropped``.

    Rows beyond ``most`` leave before they are moved; the count is a partial aggregate.
    """
    near = Window.partitionBy("q").orderBy("derived", "id")
    kept = facts.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= most)
    counts = facts.groupBy("q").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("dropped"))
    return kept.join(counts, "q")


def pack(hits: DataFrame, budget: int, least: int = 40) -> DataFrame:
    """``(q, id, tokens, taken)``: hits in rank order into a budget of tokens.

    A hit takes what is left when that is ``least`` or more, else it is skipped
    and later ones that fit are taken.  A fold over each question's hits, whose
    number the ranking bounds.
    """
    one = F.array_sort(F.collect_list(F.struct("rank", "id", "tokens")))

    def step(acc: Column, h: Column) -> Column:
        left = F.lit(budget) - acc["used"]
        take = F.when(h["tokens"] <= left, h["tokens"]).when(left >= least, left).otherwise(0).cast("int")
        return F.struct((acc["used"] + take).alias("used"), F.concat(acc["out"], F.array(F.struct(h["id"].alias("id"), h["tokens"].cast("int").alias("tokens"), take.alias("taken")))).alias("out"))

    kind = dict(hits.dtypes)["id"]
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<id:{kind},tokens:int,taken:int>>").alias("out"))
    return hits.groupBy("q").agg(one.alias("h")).select("q", F.explode(F.aggregate("h", start, step)["out"]).alias("x")).select("q", "x.*").where("taken > 0")


def hybrid(texts: DataFrame, vectors: DataFrame, per_leg: int = PER_METHOD, k: int = LIMIT) -> DataFrame:
    """``(q, id, score, rank)``: keyword hits and vector hits, both ``(q, id, score)``, in one list by rank.

    Each leg brings its best ``per_leg``; the vector leg weighs ``VECTOR_WEIGHT``.
    """
    leg = lambda hits, weight: top(hits, ["q"], "id", per_leg).select("q", "id", "rank", F.lit(weight).alias("weight"))
    return rrf(leg(texts, 1.0).unionByName(leg(vectors, VECTOR_WEIGHT)), k)


def reserved_first(hits: DataFrame, most: int) -> DataFrame:
    """``hits(q, id, score, methods)`` cut at ``most``: found by time or by name first, then by score, then by id."""
    held = F.arrays_overlap("methods", F.array(*[F.lit(m) for m in ("time_window", "named_entity", "pair")]))
    near = Window.partitionBy("q").orderBy(held.desc(), F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= most)


def shared_evidence(anchors: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(q, record_key)``: records that mention both of the first two things that a question names.

    ``anchors(q, uid, pos)``; a question that names one thing has no rows.
    """
    first = anchors.groupBy("q", "uid").agg(F.min("pos").alias("pos"))
    near = Window.partitionBy("q").orderBy("pos", "uid")
    two = first.withColumn("n", F.row_number().over(near)).where("n <= 2").select("q", "uid")
    met = two.join(mentions.select("uid", "record_key").distinct(), "uid")
    return met.groupBy("q", "record_key").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("q", "record_key")


def retrieve(lanes: list[DataFrame], expansion: DataFrame | None = None, k: int = LIMIT) -> DataFrame:
    """``(q, id, rank)``: hits of lanes one after the other, neighbours of them last; the first place of an id counts.

    Each lane is ``(q, id, rank)``: what is named, what shares evidence, what
    happened in the window asked for, hybrid search.  ``expansion(seed, id)``
    are neighbours.
    """
    out = None
    for i, lane in enumerate(lanes):
        part = lane.select("q", F.lit(i).alias("grp"), F.col("rank").alias("pos"), "id")
        out = part if out is None else out.unionByName(part)
    merged = merge_unique(out).where(F.col("rank") <= k)
    if expansion is None:
        return merged
    more = merged.join(expansion.select(F.col("seed").alias("id"), F.col("id").alias("_to")).distinct(), "id").select("q", F.lit(1).alias("grp"), F.col("rank").alias("pos"), F.col("_to").alias("id"))
    return merge_unique(merged.select("q", F.lit(0).alias("grp"), F.col("rank").alias("pos"), "id").unionByName(more))
