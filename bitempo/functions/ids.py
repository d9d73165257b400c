"""Deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of this engine's ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "bitempo")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of a name, without leaving the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.create_map(*[F.lit(x) for d in "0123456789abcdef" for x in (d, "89ab"[int(d, 16) & 3])]), part(17, 1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def make_uid(label: Column, *parts: Column) -> Column:
    """The id of a node or fact from its label and identifying parts; null parts count as empty."""
    return uuid5(F.concat_ws("|", label, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
