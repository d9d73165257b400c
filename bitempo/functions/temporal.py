"""The clocks of a fact, as column expressions: when it was true, and when it was known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days until a fact of a decay class counts as stale.
DECAY_DAYS = {"fast": 21, "slow": 180, "durable": 365}
STALE_FACTOR = 0.7


def live(invalid_at: Column, assertion: Column, projection: Column) -> Column:
    """A fact that is open, not corrected and not waiting for review."""
    return invalid_at.isNull() & (F.coalesce(assertion, F.lit("live")) != "corrected") & (F.coalesce(projection, F.lit("live")) == "live")


def holds_at(start: Column, end: Column, at: Column, until: Column | None = None, temporal: str = "state", attested: Column | None = None, ended_unknown: Column | None = None) -> Column:
    """World time: whether a fact holds at an instant, or within ``[at, until)``.

    ``temporal`` is state, event or eternal.  A missing start is ``attested``;
    a fact that ended at an unknown time ends there too.  A fact without both
    ends holds at no point and overlaps no window; ``at`` null means always.
    """
    none = F.lit(None).cast("timestamp")
    attested = none if attested is None else attested
    begin = F.coalesce(start, attested)
    finish = F.when(F.coalesce(ended_unknown, F.lit(False)), F.coalesce(end, attested)).otherwise(end) if ended_unknown is not None else end
    dated = begin.isNotNull() | finish.isNotNull()
    if temporal == "eternal" and until is not None:
        return F.lit(True)
    if temporal == "event" and until is not None:
        inside = F.coalesce((begin >= at) & (begin < until), F.lit(False))
    elif until is not None:
        inside = dated & F.coalesce(begin < until, F.lit(True)) & F.coalesce(finish > at, F.lit(True))
    else:
        inside = dated & F.coalesce(begin <= at, F.lit(True)) & F.coalesce(finish > at, F.lit(True))
    return at.isNull() | inside


def held_at(observed_from: Column, observed_to: Column, as_of: Column) -> Column:
    """Record time: whether a fact was held at ``as_of``; null asks for what is held now."""
    then = F.coalesce(observed_from <= as_of, F.lit(True)) & F.coalesce(observed_to > as_of, F.lit(True))
    return F.when(as_of.isNull(), observed_to.isNull()).otherwise(then)


def disjoint(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open periods share no instant; null ends are open."""
    return F.coalesce(b_end <= a_start, F.lit(False)) | F.coalesce(a_end <= b_start, F.lit(False))


def freshness(decay: Column, confirmed: Column, now: Column, closed: Column | None = None) -> Column:
    """``fresh`` or ``stale``.  Tasks follow ``closed``; others the days since they were confirmed.

    An unknown class counts as slow; a fact never confirmed is stale.
    """
    days = F.coalesce(F.create_map(*[F.lit(x) for kv in DECAY_DAYS.items() for x in kv])[decay], F.lit(DECAY_DAYS["slow"]))
    aged = confirmed.isNull() | (F.unix_micros(now) - F.unix_micros(confirmed) >= days * F.lit(86_400_000_000))
    task = F.coalesce(closed, F.lit(False)) if closed is not None else F.lit(False)
    return F.when(F.when(decay == "task", task).otherwise(aged), "stale").otherwise("fresh")


def effective_confidence(confidence: Column, fresh: Column, pinned: Column) -> Column:
    """Confidence, lowered for stale facts that are not pinned."""
    return confidence * F.when((fresh == "stale") & ~F.coalesce(pinned, F.lit(False)), STALE_FACTOR).otherwise(1.0)


def interval_note(start: Column, end: Column, ended_unknown: Column) -> Column:
    """A period in words."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("from "), day(start), F.lit(" until "), day(end)))
        .when(start.isNotNull() & F.coalesce(ended_unknown, F.lit(False)), F.concat(F.lit("from "), day(start), F.lit(", ended at an unknown time")))
        .when(start.isNotNull(), F.concat(F.lit("since "), day(start)))
        .when(end.isNotNull(), F.concat(F.lit("until "), day(end)))
        .otherwise("undated")
    )
