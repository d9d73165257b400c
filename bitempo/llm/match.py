"""Matching accounts to author identities that share no key.

Names and mail addresses are parsed into given names, surnames, initials and
handles.  MinHash bands over the letter pairs of surnames, surnames less one
letter and the prefixes that handles are made of give candidates, pairs get similarity features, and a
logistic classifier trained on weak labels (equal addresses, which are no
feature) gives probabilities that are calibrated on held-out folds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.session import cut, spread

BANDS, ROWS = 24, 3
#: Most labelled pairs that the classifier is fitted on, taken by hash of the pair.
LABELLED = 20_000
#: Words and identities whose keys are made at once: each has tens of them.
SLICE = 500
#: Accounts that score so much less than an identity's best are not its author's.
MARGIN = 2.5
#: Mailboxes that no person writes from.
SHARED = {"admin", "bot", "build", "builds", "ci", "deploy", "deps", "dev", "info", "jenkins", "mail", "nobody", "noreply", "no-reply", "ops", "release", "renovate", "robot", "root", "support", "system", "team", "test", "unknown"}
FEATURES = ["surname", "given_same", "given_alias", "given_initial", "given_differs", "local_surname", "local_given", "handle", "initial_same", "initial_differs", "number_same", "number_differs", "typo", "namesakes"]
_PRIMES = np.array([(2654435761 * (i + 1) + 0x9E3779B9) % 4294967291 | 1 for i in range(BANDS * ROWS)], "uint64")
_SHIFTS = np.array([(40503 * (i + 7) * (i + 11)) % 4294967291 for i in range(BANDS * ROWS)], "uint64")


def folded(s: str, german: bool = False) -> str:
    """Lower-case Latin letters; umlauts as two letters if ``german``."""
    s = s.lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae")
    if german:
        s = s.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _plain(s: str) -> str:
    """One notation for umlauts and their two-letter forms."""
    return re.sub(r"(?<![aeiou])([aou])e", r"\1", re.sub("[^a-z]", "", folded(s)))


def remembered(f, most: int = 100_000):
    """``f`` of one argument with its results kept, in a plain dictionary that travels to workers."""
    known: dict = {}

    def call(x):
        if x not in known:
            if len(known) >= most:
                known.clear()
            known[x] = f(x)
        return known[x]

    return call


def _parse_name(name: str | None) -> list[tuple[str, str, str]]:
    if not name:
        return []
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name).strip()
    if "," in s:
        last, _, first = s.partition(",")
        order = [(first, last)]
    else:
        s = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", s) if " " not in s else s
        words = [w for w in re.split(r"[\s._]+", s) if w]
        if len(words) < 2 or re.search(r"\d", s):
            return []
        order = [(" ".join(words[:-1]), words[-1])]
        if len(words) == 2:
            order.append((words[1], words[0]))
    out = []
    for first, last in order:
        words = [_plain(w) for w in re.split(r"[\s._]+", first)]
        words = [w for w in words if w]
        given = words[0] if words else ""
        middle = next((w for w in words[1:] if len(w) == 1), "")
        if len(_plain(last)) > 1:
            out.append((given, _plain(last), middle))
    return out


_read_name = remembered(_parse_name)


def parse_name(name: str | None) -> list[tuple[str, str, str]]:
    """(given, surname, middle initial) readings of a written name, likeliest first."""
    return _read_name(name)


def _parse_mail(mail: str | None) -> tuple[list[str], list[str], str]:
    local = re.sub(r"^\d+\+", "", folded((mail or "").split("@")[0].strip()))
    tag = re.search(r"[._-]([a-z])(\d+)$", local)
    words = [w for w in re.split(r"[^a-z]+", local[: tag.start()] if tag else local) if w]
    return words, re.findall(r"\d+", local), tag[1] if tag else ""


_read_mail = remembered(_parse_mail)


def parse_mail(mail: str | None) -> tuple[list[str], list[str], str]:
    """(words, numbers, tag initial) of the local part; a number in front of a plus sign is left out."""
    return _read_mail(mail)


_known: dict[tuple[str, str], int] = {}


def distance(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours counting as one; 9 for words of very different length."""
    if abs(len(a) - len(b)) > 3:
        return 9
    found = _known.get((a, b))
    if found is None:
        if len(_known) > 100_000:
            _known.clear()
        found = _known[a, b] = _edits(a, b)
    return found


def _edits(a: str, b: str) -> int:
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def _bands(word: str) -> list[str]:
    w = f"^{word}$"
    grams = np.array([(ord(a) * 131 + ord(b)) * 2654435761 % 4294967291 for a, b in zip(w, w[1:], strict=False)], "uint64")
    low = ((grams[:, None] * _PRIMES + _SHIFTS) % np.uint64(4294967291)).min(axis=0)
    return [f"m{i}:" + "-".join(f"{v:x}" for v in low[i * ROWS : (i + 1) * ROWS]) for i in range(BANDS)]


_read_bands = remembered(_bands, 20_000)


def bands(word: str) -> list[str]:
    """MinHash bands over the letter pairs of a word."""
    return _read_bands(word)


def less_one(word: str) -> set[str]:
    """Keys that a word shares with every word one edit away, a swap of neighbours being one."""
    return {"d:" + word} | {"d:" + word[:i] + word[i + 1 :] for i in range(len(word))}


def _handles(names: list[str], words: list[str]) -> list[list[str]]:
    """Names of one word and local parts, as lists of letter runs."""
    out = [words] if words else []
    for n in names:
        if not parse_name(n) and n:
            out.append([w for w in re.split(r"[^a-z]+", folded(n)) if w])
    return [h for h in out if h]


def _given_level(given: str, aliases: set[str], other: str) -> str:
    """How a given name fits: same, typo, alias, initial or differs."""
    if not given or not other:
        return "none"
    if given == other:
        return "same"
    if len(given) == 1 or len(other) == 1:
        return "initial" if given[0] == other[0] else "differs"
    if other in aliases:
        return "alias"
    if min(len(given), len(other)) >= 5 and distance(given, other) <= 1:
        return "typo"
    short, long = sorted((given, other), key=len)
    if len(short) >= 2 and (long.startswith(short) or len(short) >= 3 and long.endswith(short)):
        return "alias"
    return "differs"


def features(given: str, surname: str, middle: str, aliases: list[str], mail: str | None, namesakes: int, names: list[str], author_mail: str) -> list[float]:
    """The features of an account's name and an author identity, in the order of ``FEATURES``."""
    f = dict.fromkeys(FEATURES, 0.0)
    known = set(aliases)
    words, numbers, tag = parse_mail(author_mail)
    own_words, own_numbers, own_tag = parse_mail(mail)
    best, level, seen_middle = 0.0, "none", set()
    for n in names:
        for g, s, m in parse_name(n):
            d = distance(surname, s)
            close = 1.0 if d == 0 else max(0.0, 1 - d / max(len(surname), len(s)))
            if d > max(1, len(surname) // 4):
                continue
            fit = _given_level(given, known, g)
            rank = close + {"same": 1, "typo": 0.8, "alias": 0.8, "initial": 0.5, "none": 0.2, "differs": -0.5}[fit]
            if rank > best or level == "none":
                best, level, f["surname"] = rank, fit, close
            if fit != "differs" and m:
                seen_middle.add(m)
    f["given_same"] = float(level in ("same", "typo"))
    f["typo"] = float(level == "typo" or 0 < f["surname"] < 1)
    f["given_alias"], f["given_initial"], f["given_differs"] = float(level == "alias"), float(level == "initial"), float(level == "differs")
    joined = "".join(words)
    plain = _plain(joined)
    long = re.sub("[^a-z]", "", folded(surname, True))
    if len(surname) >= 4 and (surname in plain or long in joined):
        f["local_surname"] = 1.0
        rest = plain.replace(surname, "", 1)
        fit = _given_level(given, known, rest) if rest else "none"
        f["local_given"] = {"same": 1.0, "typo": 1.0, "alias": 1.0, "initial": 0.5, "none": 0.0, "differs": -1.0}[fit]
    if given:
        firsts = {given, *known} if len(given) > 1 else set()
        for h in _handles(names, words):
            glued = "".join(h)
            if glued == surname[:5] + given[0] and len(surname) >= 5:
                f["handle"] = 1.0
            for first in firsts:
                for n in (3, 4):
                    part = surname[:n]
                    if len(part) == n and (glued == first + part or glued.endswith(part) and len(glued) - n >= 2 and first.startswith(glued[:-n])):
                        f["handle"] = max(f["handle"], 1.0 if n == 4 else 0.9)
    mine = {middle or own_tag} - {""}
    theirs = (seen_middle | {tag}) - {""}
    f["initial_same"], f["initial_differs"] = float(bool(mine & theirs)), float(bool(mine and theirs and not mine & theirs))
    if own_tag and own_numbers:
        theirs_numbers = [*numbers, *[x for n in names if n for x in re.findall(r"\d{2,}", n)]]
        own = own_numbers[-1]
        f["number_same"] = float(any(x == own or len(own) > 2 and x.endswith(own) for x in theirs_numbers))
        f["number_differs"] = float(namesakes > 1 and any(len(x) > 1 for x in theirs_numbers) and not f["number_same"])
    f["namesakes"] = float(np.log(max(1, namesakes)))
    return [f[k] for k in FEATURES]


#: What each feature says before any label is seen (constant last): for a match, against one, or nothing.  Weights are
#: drawn to twice these signs with a force of ``RIDGE``, so a feature that no label tells of keeps its meaning.
SIGNS = {"surname": 1, "given_same": 1, "given_alias": 1, "given_initial": 1, "given_differs": -1, "local_surname": 1, "local_given": 1, "handle": 1, "initial_same": 1, "initial_differs": -1, "number_same": 1, "number_differs": -1, "typo": 0, "namesakes": 0}
RIDGE = 1.0
PRIOR = 2.0 * np.array([*[SIGNS[f] for f in FEATURES], -1])


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> np.ndarray:
    """Weights of a logistic classifier (constant last), by damped Newton steps, drawn to ``prior``."""
    x1 = np.hstack([x, np.ones((len(x), 1))])

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * ((w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)), x1.T @ (y - p) - ridge * (w - prior))
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if new > now or np.abs(step).max() < 1e-8:
            break
        w, now = w + step, new
    return w


def score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))]) @ w


def train(x: np.ndarray, y: np.ndarray, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Classifier weights, and the slope and shift that calibrate its held-out scores."""
    held = np.zeros(len(y))
    for k in range(folds):
        out = np.arange(len(y)) % folds == k
        held[out] = score(fit(x[~out], y[~out], PRIOR), x[out])
    return fit(x, y, PRIOR), fit(held[:, None], y, np.array([1.0, 0.0]), ridge=1.0)


def _accounts(people: DataFrame) -> DataFrame:
    """One row per name and address: ``(given, surname, middle, mail, account_ids)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for a, n, e in zip(b["account_id"], b["display_name"], b["email"], strict=True):
                for g, s, m in parse_name(n)[:1]:
                    rows.append((a, g, s, m, e.strip().lower() if isinstance(e, str) and e.strip() else None))
            yield pd.DataFrame(rows, columns=["account_id", "given", "surname", "middle", "mail"])

    one = people.where("account_id is not null").select("account_id", "display_name", "email").distinct()
    return one.mapInPandas(run, "account_id string, given string, surname string, middle string, mail string")


def _identities(commits: DataFrame) -> DataFrame:
    """``(provider, mail, names)``: distinct addresses, trimmed and in lower case, with their names."""
    mail = F.lower(F.trim("author_email"))
    one = commits.select("provider", mail.alias("mail"), F.trim("author_name").alias("name")).where("mail like '%@%'")
    # Distinct names first: a robot's million commits become one row.
    names = one.distinct().groupBy("provider", "mail").agg(F.array_sort(F.collect_set("name")).alias("names"))
    # A mailbox is shared when every word of its local part is one of a robot or a role.
    local = F.filter(F.split(F.split("mail", "@")[0], r"[+.\-_\d]+"), lambda w: w != "")
    return names.where((F.size(F.array_except(local, F.array(*[F.lit(s) for s in sorted(SHARED)]))) > 0) & ~F.col("mail").rlike(r"@robots?\."))


def _forms(identities: DataFrame) -> DataFrame:
    """``(mail, given, surname)`` readings of an identity's names and address."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for mail, names in zip(b["mail"], b["names"], strict=True):
                words = [_plain(w) for w in parse_mail(mail)[0]]
                forms = {(g, s) for n in names for g, s, _ in parse_name(n)}
                if len(words) == 2:
                    forms |= {(words[0], words[1]), (words[1], words[0])}
                rows |= {(mail, g, s) for g, s in forms if len(g) > 2 and len(s) > 3}
            yield pd.DataFrame(sorted(rows), columns=["mail", "given", "surname"])

    return identities.select("mail", "names").mapInPandas(run, "mail string, given string, surname string")


def given_aliases(forms: DataFrame, accounts: DataFrame) -> DataFrame:
    """``(given, aliases)``: other given names that stand with the same surname.

    Learnt from all records: an alias needs two surnames, and one address or
    surname of its own that ties both names together.
    """
    by_mail = forms.alias("a").join(forms.alias("b"), (F.col("a.mail") == F.col("b.mail")) & (F.col("a.surname") == F.col("b.surname")) & (F.col("a.given") != F.col("b.given")))
    tied = by_mail.select(F.col("a.given").alias("given"), F.col("b.given").alias("alias"), F.col("a.surname").alias("surname"))
    seen = forms.select("given", "surname").distinct()
    alone = accounts.where("length(given) > 2").groupBy("surname").agg(F.min("given").alias("given"), F.max("given").alias("_g")).where("given = _g").drop("_g")
    crossed = alone.join(seen.withColumnRenamed("given", "alias"), "surname").where("given <> alias").select("given", "alias", "surname")
    both = tied.unionByName(crossed).distinct()
    both = both.unionByName(both.select(F.col("alias").alias("given"), F.col("given").alias("alias"), "surname")).distinct()
    sure = both.groupBy("given", "alias").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return sure.groupBy("given").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of at most ``SLICE`` rows; an empty one stays."""
    for b in batches:
        for i in range(0, max(1, len(b)), SLICE):
            yield b.iloc[i : i + SLICE]


def _keys_of_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _slices(batches):
        yield pd.DataFrame([(w, k) for w in b["word"] for k in {*bands(w), *less_one(w)}], columns=["word", "key"])


def _words_of_identities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _slices(batches):
        rows = []
        for provider, mail, names in zip(b["provider"], b["mail"], b["names"], strict=True):
            words = parse_mail(mail)[0]
            surnames = {s for n in names for _, s, _ in parse_name(n)} | {_plain(w) for w in words if len(w) > 3}
            surnames |= {s[1:] for s in list(surnames) if len(s) > 5 and len(words) == 1} | {s[:-1] for s in list(surnames) if len(s) > 5 and len(words) == 1}
            rows.extend((provider, mail, s) for s in surnames if len(s) > 2)
        yield pd.DataFrame(rows, columns=["provider", "mail", "word"])


def _handles_of_identities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _slices(batches):
        rows = []
        for provider, mail, names in zip(b["provider"], b["mail"], b["names"], strict=True):
            words = parse_mail(mail)[0]
            surnames = sorted({s for n in names for _, s, _ in parse_name(n)})
            joined = "".join(words)
            for glued in {"".join(h) for h in _handles(list(names), words)}:
                if len(glued) >= 5:
                    rows.extend((provider, mail, k, glued, joined, _plain(joined), surnames) for k in ("s3:" + glued[-3:], "s4:" + glued[-4:], "s5:" + glued[:6]))
        yield pd.DataFrame(rows, columns=["provider", "mail", "key", "glued", "joined", "plain", "surnames"])


def _candidates(classes: DataFrame, identities: DataFrame) -> DataFrame:
    """``(name_id, provider, mail)`` that have alike words, or a handle that the name makes."""
    # Few rows that cost much: over all cores.  Each word has its keys made once, whoever bears it.
    words = cut(spread(identities).mapInPandas(_words_of_identities, "provider string, mail string, word string"))
    keyed = lambda df: spread(df.distinct()).mapInPandas(_keys_of_words, "word string, key string")
    left, right = keyed(classes.select(F.col("surname").alias("word"))), keyed(words.select("word"))
    # Words that share a band by chance are told apart before Python sees the pair.
    alike = F.contains(F.col("word"), F.col("surname")) | (F.levenshtein("word", "surname") <= F.greatest(F.lit(2), F.floor(F.length("surname") / 4) + 1))
    # The size of the keys is guessed by that of the words, a hundredth of it: no such guess may send them to the driver.
    pairs = left.withColumnRenamed("word", "surname").hint("merge").join(right, "key").where(alike).select("surname", "word").distinct()
    by_word = pairs.join(classes.select("name_id", "surname"), "surname").join(words, "word").select("name_id", "provider", "mail")

    start = lambda n: F.substring("surname", 1, n)
    keys = F.array(F.concat(F.lit("s3:"), start(3)), F.concat(F.lit("s4:"), start(4)), F.concat(F.lit("s5:"), start(5), F.substring("given", 1, 1)))
    firsts = F.when(F.length("given") > 1, F.array_union(F.array("given"), F.coalesce("aliases", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    makers = classes.select("name_id", "surname", "given", F.col("mail").alias("own"), firsts.alias("firsts"), F.explode(keys).alias("key"))
    handles = spread(identities).mapInPandas(_handles_of_identities, "provider string, mail string, key string, glued string, joined string, plain string, surnames array<string>")
    # Three letters meet by chance, and such pairs grow by the square: only those go on that may have a feature which counts.
    rest = F.expr("substring(glued, 1, length(glued) - if(key like 's3:%', 3, 4))")
    made = F.when(F.col("key").startswith("s5:"), (F.length("surname") >= 5) & (F.col("glued") == F.concat(start(5), F.substring("given", 1, 1)))).otherwise(F.exists("firsts", lambda f: (f == rest) | ((F.length(rest) >= 2) & F.startswith(f, rest))))
    within = (F.length("surname") >= 4) & (F.contains(F.col("plain"), F.col("surname")) | F.contains(F.col("joined"), F.col("surname")))
    # A swap of neighbours is one edit there and two here.
    most = 2 * F.greatest(F.lit(1), F.floor(F.length("surname") / 4))
    close = F.exists("surnames", lambda s: (F.abs(F.length(s) - F.length("surname")) <= most) & (F.levenshtein(s, F.col("surname")) <= most))
    by_handle = makers.hint("merge").join(handles, "key").where(made | within | F.coalesce(F.col("own") == F.col("mail"), F.lit(False)) | close).select("name_id", "provider", "mail")
    return by_word.unionByName(by_handle).distinct()


def _lowest(rows: DataFrame, by: str, n: int) -> pd.DataFrame:
    """The ``n`` rows of lowest ``by``, in order; the executors choose them, else each partition sends the driver ``n``."""
    return cut(rows.orderBy(by).limit(n)).toPandas().sort_values(by, ignore_index=True)


def matches(people: DataFrame, commits: DataFrame, least: float = 0.5) -> DataFrame:
    """``(account_id, provider, author_email, confidence)`` of the same person.

    ``people(account_id, display_name, email)`` meet ``commits(provider,
    author_name, author_email)``.  Accounts of one name and address are one
    candidate, and so are all commits of one address, so repeated rows cost and
    change nothing.  Accounts without a name, commits without an address, robots
    and shared mailboxes match nobody; empty tables give no rows.

    Of the accounts that fit an identity those count whose probability is at
    least ``least`` and close to the best.  Account ids are no evidence.
    """
    accounts = cut(_accounts(people))
    identities = cut(_identities(commits))
    aliases = given_aliases(cut(_forms(identities)), accounts)
    shared_by = accounts.groupBy("given", "surname").agg(F.count_distinct("account_id").alias("namesakes"))
    classes = accounts.select("given", "surname", "middle", "mail").distinct().join(shared_by, ["given", "surname"]).join(aliases, "given", "left")
    classes = cut(classes.withColumn("name_id", F.xxhash64("given", "surname", "middle", F.coalesce("mail", F.lit("")))))
    pairs = _candidates(classes, identities)
    full = pairs.join(classes.withColumnRenamed("mail", "own_mail"), "name_id").join(identities, ["provider", "mail"])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [
                features(g, s, m, [] if a is None else list(a), e if isinstance(e, str) else None, n, list(names), mail)
                for g, s, m, a, e, n, names, mail in zip(b["given"], b["surname"], b["middle"], b["aliases"], b["own_mail"], b["namesakes"], b["names"], b["mail"], strict=True)
            ]
            near = np.array([v[0] > 0 or v[5] > 0 or v[7] > 0 for v in x], bool)
            out = b[["name_id", "provider", "mail"]].copy()
            out["same_mail"] = b["own_mail"] == b["mail"]
            out["x"] = x
            yield out[near | out["same_mail"].to_numpy()]

    described = cut(full.mapInPandas(describe, "name_id long, provider string, mail string, same_mail boolean, x array<double>"))
    # Weak labels: an address that an account has is its author's, and is no other name's.
    owned = described.where("same_mail").select("provider", "mail", F.col("name_id").alias("owner")).join(classes.select(F.col("name_id").alias("owner"), F.col("given").alias("og"), F.col("surname").alias("os")), "owner")
    labelled = described.join(owned, ["provider", "mail"]).join(classes.select("name_id", "given", "surname"), "name_id")
    other = (F.col("surname") != F.col("os")) | (F.col("x")[FEATURES.index("given_differs")] == 1)
    labelled = _lowest(labelled.where(F.col("same_mail") | other).select("same_mail", "x", F.xxhash64("name_id", "provider", "mail").alias("h")).distinct(), "h", LABELLED)
    x, y = np.array(labelled["x"].tolist()).reshape(-1, len(FEATURES)), labelled["same_mail"].to_numpy(dtype=float)
    weights, scale = train(x, y)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = score(weights, np.array(b["x"].tolist()))
                z = np.where(b["same_mail"], 30.0, np.clip(z * scale[0] + scale[1], -30, 29))
                b = b.assign(z=z, confidence=1 / (1 + np.exp(-z)))
            else:
                b = b.assign(z=np.zeros(0), confidence=np.zeros(0))
            yield b[["name_id", "provider", "mail", "z", "confidence"]]

    judged = described.mapInPandas(judge, "name_id long, provider string, mail string, z double, confidence double").where(F.col("confidence") >= least)
    named = judged.join(classes.select("name_id", "given", "surname", "middle", F.col("mail").alias("own")), "name_id")
    # An identity is one person: what fits far worse than the best is left, and rivals share the confidence.
    best = judged.where("z < 30").groupBy("provider", "mail").agg(F.max("z").alias("best"))
    near = named.join(best, ["provider", "mail"], "left").where((F.col("z") == 30) | (F.col("z") >= F.col("best") - MARGIN))
    rivals = near.where("z < 30").groupBy("provider", "mail").agg(F.size(F.collect_set(F.concat(F.substring("given", 1, 1), "surname"))).alias("rivals"))
    shared = F.when(F.col("z") == 30, F.col("confidence")).otherwise(F.col("confidence") / F.coalesce("rivals", F.lit(1)))
    kept = near.join(rivals, ["provider", "mail"], "left").withColumn("confidence", shared).where(F.col("confidence") >= least)
    out = kept.join(accounts.withColumnRenamed("mail", "own_"), (F.col("own").eqNullSafe(F.col("own_"))) & (kept["given"] == accounts["given"]) & (kept["surname"] == accounts["surname"]) & (kept["middle"] == accounts["middle"]))
    return out.groupBy("account_id", "provider", F.col("mail").alias("author_email")).agg(F.max("confidence").alias("confidence"))
