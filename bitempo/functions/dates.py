"""Dates that a text states, resolved against the day it was written, and the period that a question asks about."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, words before a start and before an end, lengths of units, phrases about what was known.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STARTS = ("since", "from", "starting", "started", "starts", "begin", "begins", "began", "effective", "as of")
ENDS = ("until", "till", "through", "end", "ends", "ended", "ending", "expire", "expires", "expired", "replaced", "supersede", "supersedes", "superseded", "terminate", "terminates", "terminated")
DAYS = {"day": 1, "week": 7, "month": 30}
OFFSETS = {"yesterday": -1, "today": 0, "last week": -7, "this week": 0, "next week": 7, "this sprint": 0, "next sprint": 14}
RECORD_PHRASES = ("what did we know", "what did we believe", "what did we have on record", "what did we learn", "on record", "as we understood", "as we believed", "did we get wrong")

_MONTH = "(?:" + "|".join(m if len(m) == 3 else f"{m[:3]}(?:{'t(?:ember)?' if m == 'september' else m[3:]})?" for m in MONTHS) + ")"
_NTH = r"\d{1,2}(?:st|nd|rd|th)?"
#: Every way to write a date, longer ones first; ids and paths that look like one are none.
_DATE = (
    r"(?<![\w/-])\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2})?(?:[Zz]|[+-]\d{2}:?\d{2})?)?(?![\w-])"
    rf"|\b{_NTH}\s+{_MONTH}\s+\d{{4}}\b|\b{_MONTH}\s+{_NTH},?\s+\d{{4}}\b|\b{_MONTH}\s+\d{{4}}\b"
    r"|\b\d{1,6}\s+(?:day|week|month)s?\s+ago\b|\b(?-i:Q)[1-4](?:\s+\d{4})?\b"
    r"|\b(?:yesterday|today|(?:last|this|next)\s+week|(?:this|next)\s+sprint)\b"
)


def _either(words: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _day(written: Column, reference: Column) -> Column:
    """The day that one written date means; null for days that do not exist."""
    x = F.regexp_replace(F.lower(written), r"\s+", " ")
    part = lambda pattern: F.regexp_extract(x, pattern, 1)
    year = F.when(part(r"(\d{4})") != "", part(r"(\d{4})")).otherwise(F.year(reference).cast("string"))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), part("(" + "|".join(m[:3] for m in MONTHS) + ")"))
    day = F.when(part(r"^(\d{1,2})[a-z ]") != "", part(r"^(\d{1,2})[a-z ]")).otherwise(F.when(part(r"^[a-z]+ (\d{1,2})(?!\d)") != "", part(r"^[a-z]+ (\d{1,2})(?!\d)")).otherwise("1"))
    named = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    quarter = F.concat_ws("-", year, F.lpad((part(r"^q(\d)").try_cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("01"))
    unit = F.create_map(*[F.lit(v) for kv in DAYS.items() for v in kv])[part("(day|week|month)s? ago")]
    offset = F.create_map(*[F.lit(v) for kv in OFFSETS.items() for v in kv])[x]
    return (
        F.when(x.rlike(r"^\d{4}-"), F.substring(x, 1, 10).try_cast("date"))
        .when(x.endswith("ago"), F.date_sub(reference, part(r"^(\d+)").try_cast("int") * unit))
        .when(x.rlike("^q[1-4]"), quarter.try_cast("date"))
        .when(offset.isNotNull(), F.date_add(reference, offset))
        .otherwise(named.try_cast("date"))
    )


def stated(text: Column, reference: Column) -> Column:
    """What a text states, as a struct of start, end and whether an end is stated that has no date.

    Between two dates lies what is said before the second.  The last word of a
    start or of an end there, in the sentence of the date, tells what it is;
    without one it is the start, or the end if a start is known.  Dates
    relative to ``reference`` need one.  Null and empty texts state nothing.
    """
    pattern = "(?i)" + _DATE
    written = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    said = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(written))
    before = F.transform(said, lambda s: F.lower(F.regexp_extract(F.regexp_extract(s, r"([^.!?;\n]*)$", 1), "(?is)^.*" + _either(STARTS + ENDS), 1)))
    dates = F.transform(F.arrays_zip(written.alias("written"), before.alias("word")), lambda p: F.struct(_day(p["written"], reference).alias("day"), p["word"].isin(*STARTS).alias("opens"), p["word"].isin(*ENDS).alias("closes")))
    none = F.lit(None).cast("date")

    def put(known: Column, d: Column) -> Column:
        opens = ~d["closes"] & (d["opens"] | known["start"].isNull())
        return F.struct(F.when(opens, F.coalesce(known["start"], d["day"])).otherwise(known["start"]).alias("start"), F.when(~opens, F.coalesce(known["end"], d["day"])).otherwise(known["end"]).alias("end"))

    found = F.aggregate(F.filter(dates, lambda d: d["day"].isNotNull()), F.struct(none.alias("start"), none.alias("end")), put)
    start, end = F.coalesce(found["start"], none), F.coalesce(found["end"], none)
    return F.struct(start.alias("start"), end.alias("end"), (end.isNull() & F.coalesce(text.rlike("(?i)" + _either(ENDS)), F.lit(False))).alias("unresolved"))


_ASKED = re.compile(
    rf"\b(?P<month>{_MONTH})\s*(?:['’]\s*(?P<short>\d\d)|(?P<year>\d{{4}}))\b"
    r"|(?<![\w-])(?P<y>(?:19|20)\d\d)(?:-(?P<m>\d\d)(?:-(?P<d>\d\d)(?:[T ](?P<clock>\d\d:\d\d))?)?)?\b",
    re.I,
)
_RECORD = re.compile("|".join(re.escape(p) for p in RECORD_PHRASES) + r"|\bbefore\b.+\barrived\b", re.I)


def query_window(question: str) -> tuple[str | None, str | None, str | None]:
    """(at, until, as of) of a question: as wide as the first date that it names.

    A month, a year or a day is a period, a day with a time an instant; phrases
    about what was known put its start on the record clock instead.
    """
    for found in _ASKED.finditer(question):
        g = found.groupdict()
        if g["month"]:
            year, given = int(g["year"] or "20" + g["short"]), [1 + [m[:3] for m in MONTHS].index(g["month"][:3].lower())]
        else:
            year, given = int(g["y"]), [int(g[k]) for k in "md" if g[k]]
        try:
            start = date(year, *(given + [1, 1])[:2])
        except ValueError:
            continue
        ends = {0: date(year + 1, 1, 1), 1: (start.replace(day=28) + timedelta(days=4)).replace(day=1), 2: start + timedelta(days=1)}
        at, until = (f"{start}T{g['clock']}:00", None) if g["clock"] else (str(start), str(ends[len(given)]))
        return (None, None, at) if _RECORD.search(question) else (at, until, None)
    return None, None, None
