"""Text expressions: identifiers in text, identities, units, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What identifiers look like in text.
ISSUE_KEY = r"\b([A-Z][A-Z0-9]{1,11}-[0-9]+)\b"
URL = r"(https?://[^\s<>\]\[\"']+)"
REPOSITORY = r"(?i)(?:github\.com/|\bRepository:\s*)([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
COMMIT = r"(?i)(?:github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/commit/|\bCommit:\s*)([0-9a-f]{7,40})\b"
PULL_LINK = r"(?i)(?:bitbucket\.org|github\.com)/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)/pull(?:-requests)?/([0-9]+)"
BARE_PULL = r"(?i)\bPR\s*#\s*([0-9]+)\b"
FILE_PATH = r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_-]+\.[A-Za-z0-9]{1,8})"
NEGATION = r"(?i)\b(not|no longer|don't|do not|never|instead of|rejected|avoid|deprecated|stop(ped)? using)\b"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _set(found: Column) -> Column:
    """Distinct values in order; null text gives an empty array."""
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def issue_keys(text: Column) -> Column:
    return _set(_all(text, ISSUE_KEY))


def normalize_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[.,;:!?)\"]+$", ""), "/+$", "")


def urls(text: Column) -> Column:
    return _set(F.transform(_all(text, URL), normalize_url))


def repository_names(text: Column) -> Column:
    return _set(F.transform(_all(text, REPOSITORY), lambda r: F.regexp_replace(F.lower(r), r"\.git$", "")))


def commit_shas(text: Column) -> Column:
    return _set(F.transform(_all(text, COMMIT), F.lower))


def pull_request_refs(text: Column) -> Column:
    """``owner/name#12`` of links and ``#12`` of bare mentions."""
    names, numbers = F.regexp_extract_all(text, F.lit(PULL_LINK), F.lit(1)), F.regexp_extract_all(text, F.lit(PULL_LINK), F.lit(2))
    linked = F.zip_with(names, numbers, lambda r, n: F.concat(F.regexp_replace(F.lower(r), r"\.git$", ""), F.lit("#"), n))
    return _set(F.concat(linked, F.transform(_all(text, BARE_PULL), lambda n: F.concat(F.lit("#"), n))))


def file_paths(text: Column) -> Column:
    return _set(_all(text, FILE_PATH))


def sha_prefixes(text: Column) -> Column:
    """Hex words of 7 to 40 characters, without those that begin a longer one."""
    found = _set(F.transform(_all(text, r"\b([0-9a-fA-F]{7,40})\b"), F.lower))
    return F.filter(found, lambda p: ~F.exists(found, lambda q: (q != p) & q.startswith(p)))


def identity(text: Column) -> Column:
    """Lower case, other characters than letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def polarity_conflict(a: Column, b: Column) -> Column:
    """Whether exactly one of two texts negates."""
    return F.coalesce(a, F.lit("")).rlike(NEGATION) != F.coalesce(b, F.lit("")).rlike(NEGATION)


def flat(text: Column) -> Column:
    """Lower case, white space runs as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quoted(evidence: Column, text: Column) -> Column:
    """Whether a text holds the evidence, both of them ``flat`` already."""
    return F.coalesce((evidence != "") & F.contains(text, evidence), F.lit(False))


def evidence_in(evidence: Column, text: Column) -> Column:
    """Whether a text contains the evidence, whatever case and spacing."""
    return quoted(flat(evidence), flat(text))


def excerpt(text: Column, anchor: Column, radius: int = 150) -> Column:
    """Up to ``radius`` characters on both sides of the first place of an anchor; the beginning where there is none.

    An ellipsis stands for what is left out.
    """
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    before = F.call_function("substring_index", F.lower(line), F.lower(anchor), F.lit(1))
    n, size = F.length(before), F.length(line)
    left, right = F.greatest(n - radius, F.lit(0)), n + F.length(anchor) + radius
    dots = lambda missing: F.when(missing, "…").otherwise("")
    around = F.concat(dots(left > 0), F.substr(line, left + 1, right - left), dots(right < size))
    return F.when(n == size, F.substring(line, 1, 2 * radius)).otherwise(around)


def query_terms(question: Column) -> Column:
    return _set(F.transform(_all(question, "([A-Za-z0-9_]{3,})"), F.lower))


def overlap_score(text: Column, terms: Column) -> Column:
    """How many of the terms the text contains."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def token_windows(n: Column, size: int, overlap: float = 0.5) -> Column:
    """Windows ``[from, to)`` over ``n`` tokens, neighbours sharing ``overlap`` of them."""
    step = max(1, int(size * (1 - overlap)))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).cast("int").alias("end")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays as sets, 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def units(text: Column) -> Column:
    """Paragraphs cut at sentence ends, trimmed, without empty ones."""
    parts = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.split(p, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, F.trim), lambda u: u != "")


def identifier(word: Column) -> Column:
    """A word as a label or relation name: letters, digits and underscores only."""
    return F.regexp_replace(word, "[^A-Za-z0-9_]", "")


def embedding_text(*parts: Column) -> Column:
    """The known parts of a thing in one line, for its vector; 32,768 characters at most are read by a model."""
    known = F.filter(F.array(*parts), lambda p: F.coalesce(F.trim(p), F.lit("")) != "")
    return F.substring(F.array_join(known, " — "), 1, 32_768)


def embedding_hash(text: Column) -> Column:
    """What tells whether a vector is of this text."""
    return F.sha2(text, 256)


def write_time_content(text: Column) -> Column:
    """What is embedded while a record is written: its first 4,096 characters."""
    return F.substring(text, 1, 4096)


def repository_hint(question: Column) -> Column:
    """The repository that a question names by "in"; null without one."""
    found = F.regexp_extract(question, r"(?i)\bin\s+(?:the\s+)?([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)?)", 1)
    return F.when(found != "", F.lower(found))


def summary(head: Column, text: Column, most: int) -> Column:
    """A line of facts about a thing, and its text cut to ``most`` characters."""
    return F.concat_ws("\n", head, F.substring(F.coalesce(text, F.lit("")), 1, most))


def name_used(name: Column, said: Column) -> Column:
    """Whether a source that was named is this one: equal, or either the other's beginning up to a dash or space."""
    a, b = F.lower(F.trim(name)), F.lower(F.trim(said))
    heads = lambda x, y: F.coalesce(x.startswith(F.concat(y, F.lit(" "))) | x.startswith(F.concat(y, F.lit("-"))) | x.startswith(F.concat(y, F.lit("—"))), F.lit(False))
    return F.coalesce((a != "") & (b != ""), F.lit(False)) & (F.coalesce(a == b, F.lit(False)) | heads(a, b) | heads(b, a))


def same_thing(kind: Column, a: Column, b: Column, least: int = 8) -> Column:
    """Whether two names of a kind may be of one thing.

    Equal identities are; so is one that contains the other, of ``least``
    characters or more, unless they state different versions or, for
    interfaces, different methods.
    """
    x, y = identity(a), identity(b)
    stated = lambda c, p: F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), p, 1)
    clash = lambda p: (stated(a, p) != "") & (stated(b, p) != "") & (stated(a, p) != stated(b, p))
    inside = ((F.length(x) >= least) & F.contains(y, x)) | ((F.length(y) >= least) & F.contains(x, y))
    methods = (F.lower(kind) == "api") & clash(r"\b(get|put|post|patch|delete)\b")
    return F.coalesce((x != "") & ((x == y) | inside) & ~clash(r"\bv?(\d+(?:\.\d+)+|\d+)\b") & ~methods, F.lit(False))
