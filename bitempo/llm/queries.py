"""Queries of the operators for language-model data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.llm import leaks, match, neighbours, pack, secrets, split, subjects
from bitempo.llm.tokens import n_tokens
from bitempo.session import cut, table

#: Tokens of a piece, and tokens that neighbouring pieces share.
LIMIT, OVERLAP = 1500, 150
WINDOW = 2048
DIM = 64
#: (table, id, text, time that tells the newest state)
TEXTS = (("jira_issue", "issue_id", "content", "updated_at"), ("bitbucket_file", "file_id", "content", "ingested_at"), ("bitbucket_pull_request", "pr_ref", "description", "updated_on"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """All states of all texts that may be too long."""
    out = None
    for name, key, text, at in TEXTS:
        rows = table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("item_id"), F.struct(F.col(at).cast("timestamp").alias("at"), F.col("ingested_at").cast("timestamp").alias("seen")).alias("state"), F.col(text).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out.where("item_id is not null")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    names = ["author_name", "author_email"]
    bitbucket = table(spark, d, "bitbucket_commit").select(F.lit("bitbucket").alias("provider"), *names)
    github = table(spark, d, "github_commit").select(F.lit("github").alias("provider"), *names)
    return match.matches(table(spark, d, "jira_person"), bitbucket.unionByName(github))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Jira accounts and author identities of the same person."""
    return _matches(spark, d).select("account_id", "provider", "author_email")


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their calibrated confidence."""
    return _matches(spark, d).select("account_id", "provider", "author_email", F.round("confidence", 4).alias("confidence"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Texts that may hold credentials; repeated rows once."""
    files = table(spark, d, "bitbucket_file").select(F.lit("bitbucket_file").alias("table_name"), F.col("file_id").cast("string").alias("row_id"), F.col("content").alias("text"))
    commits = table(spark, d, "github_commit").select(F.lit("github_commit").alias("table_name"), F.col("sha").alias("row_id"), F.col("message").alias("text"))
    return files.unionByName(commits).where("row_id is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a usable credential begins."""
    hits = secrets.scan(_sources(spark, d), ["table_name", "row_id"], "text", redacted=False).where("n_finds > 0")
    return hits.select("table_name", "row_id", F.explode("finds.line_no").alias("line_no")).distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Texts with credentials, redacted: how many were cut out, of which kinds, and what is left."""
    hits = secrets.scan(_sources(spark, d), ["table_name", "row_id"], "text").where("n_finds > 0")
    return hits.select("table_name", "row_id", "n_finds", F.array_join(F.array_sort(F.array_distinct("finds.kind")), ",").alias("kinds"), "redacted").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose newest state is split into more than one piece."""
    pieces = split.split_texts(_texts(spark, d), "text", ["table_name", "item_id", "state"], LIMIT, OVERLAP)
    # Every state is split where it lies; only the number of pieces is moved to find the newest.
    newest = pieces.where("piece_no = 0").groupBy("table_name", "item_id").agg(F.max(F.struct("state", "n_pieces")).alias("m"))
    return newest.where("m.n_pieces > 1").select("table_name", "item_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every item's newest state, as offsets and text length."""
    pieces = split.split_texts(_texts(spark, d), "text", ["table_name", "item_id", "state"], LIMIT, OVERLAP)
    shape = F.struct("piece_no", "token_from", "token_to", "new_from", F.length("piece").alias("n_chars"), F.xxhash64("piece").alias("piece_hash"))
    states = pieces.groupBy("table_name", "item_id", "state").agg(F.array_sort(F.collect_set(shape)).alias("pieces"))
    newest = states.groupBy("table_name", "item_id").agg(F.max(F.struct("state", "pieces")).alias("m"))
    return newest.select("table_name", "item_id", F.explode("m.pieces").alias("p")).select("table_name", "item_id", "p.*")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The comparable vectors of the newest row of each entity, grouped by collection, channel and model."""
    rows = table(spark, d, "entity_embeddings").where("uid is not null")
    state = F.struct("updated_at", F.xxhash64("embedded_model", "content_embedding", "name_embedding").alias("h"), "embedded_model", "content_embedding", "name_embedding")
    newest = rows.groupBy("collection_name", "uid").agg(F.max(state).alias("s")).select("collection_name", "uid", "s.*")
    channel = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_embedding").alias("vec")) for c in ("content", "name")])).alias("c")
    long = newest.select("collection_name", "uid", "embedded_model", channel).select("collection_name", "uid", "embedded_model", "c.*")
    return neighbours.comparable(long, ["collection_name", "channel", "embedded_model"], "uid", "vec", DIM)


def p6_found(spark: SparkSession, d: str, bound: float = 0.9) -> DataFrame:
    """Pairs of entities of a collection whose vectors have cosine 0.90 or more."""
    part = F.split("g", "\x1f")
    pairs = neighbours.similar_pairs(_vectors(spark, d), bound, DIM)
    return pairs.select(part[0].alias("collection_name"), part[1].alias("channel"), F.col("k_a").alias("uid_a"), F.col("k_b").alias("uid_b"))


def p6_nearest(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The ten most similar entities of every entity, by channel."""
    part = F.split("g", "\x1f")
    fit = cut(_vectors(spark, d))
    found = neighbours.nearest_k(fit, fit, k, DIM)
    return found.select(part[0].alias("collection_name"), part[1].alias("channel"), F.col("k").alias("uid"), F.col("neighbour"), F.round("cosine", 5).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """The training window of each document, or of each part of one longer than a window."""
    docs = table(spark, d, "documents")
    return pack.fill(docs, "doc_id", n_tokens(F.col("text")), WINDOW).select("doc_id", "part_no", F.col("from_unit").alias("token_from"), F.col("to_unit").alias("token_to"), F.col("bin_id").alias("window_id"))


def p7_use(spark: SparkSession, d: str) -> DataFrame:
    """How full the windows are: windows, tokens and share of the room used."""
    windows = p7_windows(spark, d).groupBy("window_id").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"))
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), (F.sum("n") / (F.count(F.lit(1)) * WINDOW)).alias("used"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least two fifths of an evaluation passage."""
    found = leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "passage")
    return found.select("doc_id", "item_id")


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """The leaks with their share of words, longest phrase, and whether the whole passage stands there."""
    found = leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "passage")
    return found.select("doc_id", "item_id", "words", "matched_words", F.round("share", 4).alias("share"), "longest_phrase", "kind")


def p8_complete(spark: SparkSession, d: str) -> DataFrame:
    """``p8_found`` with candidates that miss no leak at all."""
    found = leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "passage", complete=True)
    return found.select("doc_id", "item_id")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), "doc_id", "text", "lang", table(spark, d, "subject_area"), table(spark, d, "doc_label"), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of each document."""
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus: documents and their sentences by subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {f.__name__: f for f in (p3_found, p3_matches, p4_found, p4_redacted, p5_found, p5_pieces, p6_found, p6_nearest, p7_windows, p7_use, p8_found, p8_matches, p8_complete, p9_found, p9_composition)}

_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{85}}]'))"
ORACLES = {
    "p5_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS item_id FROM (SELECT DISTINCT ON ({k}) {k}, {x} FROM {t} ORDER BY {k}, {a} DESC NULLS LAST, ingested_at DESC NULLS LAST) WHERE {_TOKENS.format(x)} > 1500"
        for t, k, x, a in TEXTS
    ),
    "p6_found": """
WITH latest AS (SELECT DISTINCT ON (collection_name, uid) * FROM entity_embeddings ORDER BY collection_name, uid, updated_at DESC NULLS LAST),
v AS (SELECT collection_name, 'content' AS channel, uid, embedded_model, content_embedding AS e FROM latest UNION ALL SELECT collection_name, 'name', uid, embedded_model, name_embedding FROM latest),
f AS (SELECT collection_name, channel, uid, embedded_model, CAST(e AS DOUBLE[64]) AS e FROM v WHERE len(e) = 64 AND list_count(e) = 64 AND list_sum([x * x for x in e]) > 0)
SELECT a.collection_name, a.channel, a.uid AS uid_a, b.uid AS uid_b FROM f a JOIN f b USING (collection_name, channel, embedded_model) WHERE a.uid < b.uid AND array_cosine_similarity(a.e, b.e) >= 0.9""",
}
