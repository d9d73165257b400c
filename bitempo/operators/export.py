"""The graph as text: SKOS Turtle and N-Quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _literal(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _iri(uid: Column) -> Column:
    return F.concat(F.lit("<urn:bitempo:"), F.url_encode(uid), F.lit(">"))


def skos(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """``(line)``: a concept per ``nodes(uid, label, name)``, its live facts as related concepts."""
    concepts = nodes.select(F.concat(_iri(F.col("uid")), F.lit(" a skos:Concept ; skos:prefLabel "), _literal(F.col("name")), F.lit(" ; skos:inScheme <urn:bitempo:scheme:"), F.url_encode("label"), F.lit("> .")).alias("line"))
    broader = F.when(F.col("rel_type") == "PARENT_OF", "skos:broader").otherwise("skos:related")
    links = facts.where("invalid_at is null and coalesce(assertion_status, 'live') <> 'corrected'").select(F.concat_ws(" ", _iri(F.col("from_uid")), broader, _iri(F.col("to_uid")), F.lit(".")).alias("line"))
    return concepts.unionByName(links.distinct())


def nquads(nodes: DataFrame, facts: DataFrame, graph: str = "default") -> DataFrame:
    """``(line)``: label and name of each node, and each fact, in one named graph."""
    g = F.lit(f"<urn:bitempo:graph:{graph}> .")
    typed = nodes.select(F.concat_ws(" ", _iri(F.col("uid")), F.lit("<urn:bitempo:label>"), _literal(F.col("label")), g).alias("line"))
    named = nodes.where("name is not null").select(F.concat_ws(" ", _iri(F.col("uid")), F.lit("<urn:bitempo:name>"), _literal(F.col("name")), g).alias("line"))
    linked = facts.select(F.concat_ws(" ", _iri(F.col("from_uid")), F.concat(F.lit("<urn:bitempo:rel:"), F.url_encode("rel_type"), F.lit(">")), _iri(F.col("to_uid")), g).alias("line")).distinct()
    return typed.unionByName(named).unionByName(linked)


def checksum(lines: DataFrame) -> DataFrame:
    """``(lines, checksum)``: a sum of hashes that does not depend on order."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("checksum"))
