"""Subject areas of texts: a seeded non-negative factorisation.

The document-term matrix (words and word pairs, hashed to a fixed number of
columns) is factored into mixtures of one component per subject, anchored by
labelled texts and the subjects' own descriptions, one component of texts
labelled with no subject, and one background component per language, anchored
by the words that most texts of it use.  Alternating
multiplicative updates run over all texts: mixtures where a text lies, the
components from sums over all of them, until they settle.  A text's mixture
then says to which component each of its tokens belongs, and how surely: a
sentence bears the subject that it has most evidence for, if that is enough, and
a text gets the subjects that enough of its sentences bear.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.session import broadcast_if_small, cut, small, spread

COLUMNS = 1 << 16
LANGUAGES = ("en", "de", "fr", "es")
#: Updates of a text's mixture in a round; rounds end when the components move by less than ``SETTLED`` (half the
#: sum of differences, mean over components), after ``ROUNDS`` at most.
ROUNDS, INNER, SETTLED = 8, 3, 0.02
#: Updates of a mixture when texts are read: more of them draw it to the main subject and lose lesser ones.
READ = 1
#: Weight of the anchors against what all texts say of a component.
ANCHOR = 3.0
#: A sentence bears a subject when the chance that none of its tokens is the subject's is below exp(-EVIDENCE); a text
#: needs ``SHARE`` of such sentences.
EVIDENCE, SHARE = 8.0, 0.25
#: A word, or what ends a sentence.
_TOKEN = re.compile(r"[^\W\d_]+|[.!?]+(?=\s|$)|[\n\r]+|\\n")
#: The same for texts in lower case without other letters, which is read faster.
_ASCII = re.compile(r"[a-z]+|[.!?]+(?=\s|$)|[\n\r]+|\\n")
_CHUNK = 1 << 19


class Codes(dict):
    """Numbers of tokens, -1 for what ends a sentence; remembers those seen."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[token] = zlib.crc32(token.encode()) if token[0].isalpha() else -1
        return code


def sentence_columns(texts: list[str], seen: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word pairs of texts, and where their sentences end.

    Gives the columns of all texts, the number of each text's, the ends of all
    sentences within their text, and the number of each text's sentences.
    """
    ids: list[int] = []
    of_text = np.zeros(len(texts), "int64")
    code = seen.__getitem__
    for n, text in enumerate(texts):
        before = len(ids)
        ids.extend(map(code, (_ASCII if text.isascii() else _TOKEN).findall(text.lower())))
        ids.append(-1)
        of_text[n] = len(ids) - before
    flat = np.array(ids, "int64")
    text_of = np.repeat(np.arange(len(texts)), of_text)
    word = flat >= 0
    pair = word[:-1] & word[1:]
    both = np.full((len(flat), 2), -1, "int64")
    both[word, 0] = flat[word] % COLUMNS
    left, right = flat[:-1][pair], flat[1:][pair]
    both[:-1, 1][pair] = ((left * 2654435761 + right) % 4294967291) % COLUMNS
    there = both >= 0
    count = there.sum(axis=1)
    per_text = np.bincount(text_of, count, minlength=len(texts)).astype("int64")
    # A sentence ends at the last word before a mark.
    last = word.copy()
    last[:-1] &= ~word[1:]
    start = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    ends = np.cumsum(count)[last] - start[text_of[last]]
    return both[there].astype("int32"), per_text, ends.astype("int32"), np.bincount(text_of[last], minlength=len(texts))


def _tokens(texts: DataFrame, key: str, text: str, language: str) -> DataFrame:
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Codes()
        for b in batches:
            columns, n, ends, m = sentence_columns(b["t"].to_pylist(), seen)
            lists = lambda values, sizes: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"), values)
            yield pa.RecordBatch.from_arrays([b["k"], b["lang"], lists(columns, n), lists(ends, m)], ["k", "lang", "columns", "ends"])

    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.lower(F.col(language)).alias("lang"))
    return spread(rows).mapInArrow(run, f"k {kind}, lang string, columns array<int>, ends array<int>")


def _shares(columns: np.ndarray, lengths: np.ndarray, mask: np.ndarray, h: np.ndarray, inner: int) -> np.ndarray:
    """How the components share each token, after updating each text's mixture ``inner`` times.

    An update multiplies a mixture by the share of each component in what it
    tells of the tokens; its scale, the number of tokens, cancels out.
    """
    share = h[columns]
    at = 0
    for n, allowed in zip(lengths.tolist(), mask, strict=True):
        part = share[at : at + n]
        w, least = allowed / allowed.sum(), allowed * np.float32(1e-6 * n)
        for _ in range(inner):
            w *= (1 / (part @ w)) @ part  # no column of h is 0 for a component in use
            np.maximum(w, least, out=w)
        part *= (1 / (part @ w))[:, None]
        part *= w
        at += n
    return share


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with tokens, in chunks of about ``_CHUNK`` tokens: (rows, columns, their number in each row)."""
    lengths = b["columns"].value_lengths().to_numpy(zero_copy_only=False)
    if not lengths.all():
        b = b.filter(pa.array(lengths > 0))
        lengths = lengths[lengths > 0]
    if not len(lengths):
        return
    part = np.cumsum(lengths, dtype="int64") // _CHUNK
    cuts = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]])
    for x, y in zip(cuts, cuts[1:], strict=False):
        rows = b.slice(x, y - x)
        yield rows, rows["columns"].flatten().to_numpy(zero_copy_only=False), lengths[x:y]


def _mask(labels: pa.Array, n_subjects: int, n_all: int) -> np.ndarray:
    """Components that each text may use: all, or its labels', that of no subject and the background."""
    mask = np.ones((len(labels), n_all), "float32")
    for i, found in enumerate(labels.to_pylist()):
        if found:
            mask[i, :n_subjects] = 0
            for k in found:
                if k >= 0:
                    mask[i, k] = 1
    return mask


def _sums(tokens: DataFrame, n: int, add) -> np.ndarray:
    """(columns, n) sums over all texts of what ``add(batch, sums)`` puts into its partition's (n, columns)."""
    names = [f"c{i}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, COLUMNS))
        for b in batches:
            add(b, sums)
        used = np.nonzero(sums.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), *[pa.array(sums[i, used].astype("float32")) for i in range(n)]], ["term", *names])

    parts = tokens.mapInArrow(run, "term int, " + ", ".join(f"{c} float" for c in names))
    total = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # COLUMNS rows at most
    out = np.zeros((COLUMNS, n))
    out[total["term"].to_numpy()] = total[names].to_numpy(dtype=float)
    return out


def _anchors(tokens: DataFrame, subjects: list[str], described: list[str], languages: tuple[str, ...]) -> np.ndarray:
    """(columns, components) first components, from labelled texts, descriptions and languages."""
    k, m = len(subjects) + 1, len(languages)

    def add(b: pa.RecordBatch, sums: np.ndarray) -> None:
        number = {x: i for i, x in enumerate(languages)}
        for part, columns, lengths in _chunks(b):
            lang = np.array([number.get(x, -1) for x in part["lang"].to_pylist()])
            each = np.repeat(lang, lengths)
            for i in range(m):
                sums[k + i] += np.bincount(columns[each == i], minlength=COLUMNS)
                sums[k + m + i, 0] += (lang == i).sum()
            at = np.concatenate([[0], np.cumsum(lengths)])
            for j, found in enumerate(part["labels"].to_pylist()):
                for x in found or ():
                    np.add.at(sums[x if x >= 0 else k - 1], columns[at[j] : at[j + 1]], 1 / len(found))

    counts = _sums(tokens, k + 2 * m, add)
    labelled = counts[:, :k]
    seen = Codes()
    for i, words in enumerate(described):
        for c in sentence_columns([words], seen)[0]:
            labelled[c, i] += 3.0
    h = np.full((COLUMNS, k + m), 1e-3)
    share = labelled / np.maximum(labelled.sum(axis=0), 1e-12)
    special = np.where(labelled.sum(axis=1, keepdims=True) > 0.5, share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12), 0.1)
    h[:, :k] += labelled * special**2
    for i in range(m):
        texts = max(1.0, counts[0, k + m + i])
        h[:, k + i] += counts[:, k + i] * np.minimum(1.0, counts[:, k + i] / texts) ** 3
    return h / h.sum(axis=0)


def components(tokens: DataFrame, subjects: list[str], described: list[str], languages: tuple[str, ...] = LANGUAGES, rounds: int = ROUNDS, inner: int = INNER, anchor: float = ANCHOR, settled: float = SETTLED) -> np.ndarray:
    """The components of the factorisation, a column of shares each: of a fixed size, whatever the number of texts."""
    context = tokens.sparkSession.sparkContext
    first = _anchors(tokens, subjects, described, languages)
    h, n = first, first.shape[1]
    for _ in range(rounds):
        sent = context.broadcast(h.astype("float32"))

        def add(b: pa.RecordBatch, sums: np.ndarray) -> None:
            for part, columns, lengths in _chunks(b):
                mask = _mask(part["labels"], len(subjects), n)
                share = _shares(columns, lengths, mask, sent.value, inner)  # noqa: B023
                columns = columns.astype(np.intp)
                for c in range(n):
                    sums[c] += np.bincount(columns, share[:, c], minlength=COLUMNS)

        counts = _sums(tokens, n, add)
        last, h = h, counts + anchor * first * counts.sum(axis=0) + 1e-7
        h /= h.sum(axis=0)
        if np.abs(h - last).sum(axis=0).mean() / 2 < settled:
            break
    return h


def subjects_of(
    texts: DataFrame, key: str, text: str, language: str, areas: DataFrame, labels: DataFrame, label_key: str, share: float = SHARE, evidence: float = EVIDENCE
) -> DataFrame:
    """``(key, subject, sentences, share)``: subjects that at least ``share`` of a text's subject-bearing sentences bear.

    ``areas(subject, title, description)`` is a small list; ``labels(label_key,
    subject)`` are human labels, wrong ones among them, of some texts; a
    subject not in ``areas`` means none.  Null or empty texts, and texts
    without a subject, have no rows; neither has an empty table.  A language
    not in ``LANGUAGES`` (or null) gets no background of its own.  Repeated
    rows of a text give one row a subject.
    """
    listed = areas.where("subject is not null").select("subject", F.concat_ws(". ", "title", "description").alias("d")).distinct()
    if not small(listed, 1000):
        raise ValueError("subjects are columns of the factors: at most 1000")
    listed = listed.orderBy("subject").toPandas()
    subjects, described = listed["subject"].tolist(), listed["d"].tolist()
    kind = dict(texts.dtypes)[key]
    if not subjects:
        return texts.sparkSession.createDataFrame([], f"`{key}` {kind}, subject string, sentences long, share double")
    number = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subject")).cast("int") - 1, F.lit(-1))
    known = labels.where(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("k")).agg(F.array_sort(F.collect_set(number)).alias("labels"))
    tokens = cut(_tokens(texts, key, text, language).join(broadcast_if_small(known), "k", "left"))
    k = len(subjects)
    h = components(tokens, subjects, described)
    n_all = h.shape[1]
    sent = tokens.sparkSession.sparkContext.broadcast(h.astype("float32"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, columns, lengths in _chunks(b):
                base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                n_sentences = part["ends"].value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lengths)), n_sentences)
                ends = part["ends"].flatten().to_numpy(zero_copy_only=False) + base[row]
                # Labels are hints for the factors only: every text is read with all components.
                of_token = _shares(columns, lengths, np.ones((len(lengths), n_all), "float32"), sent.value, READ)[:, :k]
                sure = np.where(of_token > 0.5, -np.log1p(-np.minimum(of_token, np.float32(0.999))), np.float32(0))
                z = np.add.reduceat(sure, np.concatenate([[0], ends[:-1]]), axis=0)
                best = z.argmax(axis=1)
                bears = z[np.arange(len(z)), best] >= evidence
                n = np.bincount(row[bears] * k + best[bears], minlength=len(lengths) * k).reshape(-1, k)
                of = n.sum(axis=1, keepdims=True)
                i, j = np.nonzero((n > 0) & (n >= share * of))
                yield pa.RecordBatch.from_arrays([part["k"].take(pa.array(i)), pa.array([subjects[x] for x in j], pa.string()), pa.array(n[i, j]), pa.array(n[i, j] / of[i, 0])], [key, "subject", "sentences", "share"])

    found = tokens.mapInArrow(read, f"`{key}` {kind}, subject string, sentences long, share double")
    return found.groupBy(key, "subject").agg(F.max("sentences").alias("sentences"), F.max("share").alias("share"))
