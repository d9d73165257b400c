"""Axioms of relations, and which extracted facts may enter the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.operators.state import add_missing

SHAPE = ["subject_kind", "relation", "object_kind"]
AXIOM = "subject_kind string, relation string, object_kind string, extractable boolean, functional boolean, is_transitive boolean, is_symmetric boolean, inverse_of string, sub_property_of string, temporal string, batch_id string"
# Shapes of relations between records, written without a model: (subject, relation, object, functional, transitive).
STRUCTURAL = (
    ("Repository", "CONTAINS", "Commit", False, True), ("Repository", "CONTAINS", "PullRequest", False, True), ("Repository", "CONTAINS", "SourceFile", False, True), ("Workspace", "CONTAINS", "Document", False, True),
    ("WorkItem", "ASSIGNED_TO", "Person", True, False), ("WorkItem", "BELONGS_TO", "Project", True, False), ("WorkItem", "REPORTED_BY", "Person", True, False), ("WorkItem", "PARENT_OF", "WorkItem", True, True), ("WorkItem", "BLOCKS", "WorkItem", False, False),
    ("Commit", "AUTHORED_BY", "Person", False, False), ("PullRequest", "AUTHORED_BY", "Person", False, False), ("Commit", "MODIFIES", "SourceFile", False, False), ("Document", "PARENT_OF", "Document", False, True),
)


def seed(spark: SparkSession) -> DataFrame:
    """The axioms of the structural relations."""
    rows = [(s, r, o, False, functional, transitive, False, None, None, "event" if r in ("AUTHORED_BY", "MODIFIES") else "state", None) for s, r, o, functional, transitive in STRUCTURAL]
    return spark.createDataFrame(rows, AXIOM)


def load(stored: DataFrame) -> DataFrame:
    """The stored axioms, with those of the code that are not among them."""
    return add_missing(stored, seed(stored.sparkSession).select(*stored.columns), SHAPE)


def allowed(shapes: DataFrame, axioms: DataFrame) -> DataFrame:
    """Shapes that an extractable axiom allows as they are."""
    return shapes.join(axioms.where("extractable").select(*SHAPE).distinct(), SHAPE, "left_semi")


def relations(axioms: DataFrame, trait: str) -> DataFrame:
    """``(relation)`` with a trait: functional, is_transitive or is_symmetric."""
    return axioms.where(F.coalesce(F.col(trait), F.lit(False))).select("relation").distinct()


def inverse_pairs(axioms: DataFrame) -> DataFrame:
    """``(relation, inverse_of)``."""
    return axioms.where("inverse_of is not null").select("relation", "inverse_of").distinct()


def temporal(axioms: DataFrame) -> DataFrame:
    """``(relation, temporal)``: the kind of time its axioms agree on, else state, which hides nothing."""
    kinds = axioms.groupBy("relation").agg(F.count_distinct(F.coalesce("temporal", F.lit("state"))).alias("n"), F.min(F.coalesce("temporal", F.lit("state"))).alias("t"))
    return kinds.select("relation", F.when(F.col("n") == 1, F.col("t")).otherwise("state").alias("temporal"))


def adopted_batch(shapes: DataFrame, axioms: DataFrame) -> DataFrame:
    """Shapes with the batch that let them in; null for those of the code."""
    return shapes.join(axioms.groupBy(*SHAPE).agg(F.min("batch_id").alias("adopted_batch")), SHAPE, "left")


def admit(facts: DataFrame, axioms: DataFrame, stopped: DataFrame, functional_open: DataFrame | None = None) -> DataFrame:
    """``facts`` with ``drop_reason``: the first gate that a fact fails, null if it enters.

    ``facts(subject_kind, subject, relation, object_kind, object, evidence,
    chunk_text, skipped, ...)`` are told by a model about a chunk.  The gates, in
    their order: the chunk was skipped by triage; the evidence does not stand in
    the chunk; an end is missing; a name is too general (``stopped(term)``);
    both ends are the same thing; no axiom allows the shape, either way round.
    A shape that is allowed the other way round is turned (``swapped``).
    """
    from bitempo.functions.text import evidence_in, identity
    from bitempo.operators.resolve import direction

    turned = direction(facts, axioms.where("extractable"))
    stop = stopped.select(identity(F.col("term")).alias("_t")).distinct()
    marked = turned.withColumn("_a", identity(F.col("subject"))).withColumn("_b", identity(F.col("object")))
    for end in ("_a", "_b"):
        marked = marked.join(stop.withColumnRenamed("_t", end).withColumn(f"_stop{end}", F.lit(True)), end, "left")
    gates = [
        ("triage_skip", F.coalesce("skipped", F.lit(False))),
        ("evidence_not_in_chunk", ~evidence_in(F.col("evidence"), F.col("chunk_text"))),
        ("unresolved_endpoint", (F.col("_a") == "") | (F.col("_b") == "")),
        ("generic_mention", F.col("_stop_a").isNotNull() | F.col("_stop_b").isNotNull()),
        ("self_reference", F.col("_a") == F.col("_b")),
        ("relation_not_allowed", F.col("direction") == "refused"),
    ]
    reason: Column = F.lit(None).cast("string")
    for word, fails in reversed(gates):
        reason = F.when(fails, word).otherwise(reason)
    return marked.select(*facts.columns, reason.alias("drop_reason"), (F.col("direction") == "swapped").alias("swapped"))


def unconnected(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities ``(record_key, name)`` that no fact of their record names: they are not written."""
    named = facts.select("record_key", F.explode(F.array("subject", "object")).alias("name")).distinct()
    return entities.join(named, ["record_key", "name"], "left_anti")


def endpoint(mentions: DataFrame, known: DataFrame, primary: DataFrame) -> DataFrame:
    """``(record_key, kind, name, uid, via)``: what an end of a fact stands for.

    The record's own node when kind and name are its own or the kind alone
    tells, else the one node of that kind and name in the record's namespace,
    else the one anywhere.  ``known(kind, name, namespace, uid)``,
    ``primary(record_key, kind, name, uid, namespace)``.
    """
    own = primary.select("record_key", F.col("kind").alias("_k"), F.col("name").alias("_n"), F.col("uid").alias("_own"), F.col("namespace").alias("_ns"))
    m = mentions.select("record_key", "kind", "name").distinct().join(own, "record_key", "left")
    lone = lambda df, keys, to: df.groupBy(*keys).agg(F.count_distinct("uid").alias("_c"), F.min("uid").alias(to)).where("_c = 1").drop("_c")
    m = m.join(lone(known, ["kind", "name", "namespace"], "_near").withColumnRenamed("namespace", "_ns"), ["kind", "name", "_ns"], "left")
    m = m.join(lone(known, ["kind", "name"], "_any"), ["kind", "name"], "left")
    mine = F.when((F.col("kind") == F.col("_k")) & ((F.col("name") == F.col("_n")) | F.col("name").isNull()), F.col("_own"))
    via = F.when(mine.isNotNull(), "record").when(F.col("_near").isNotNull(), "namespace").when(F.col("_any").isNotNull(), "anywhere")
    return m.select("record_key", "kind", "name", F.coalesce(mine, "_near", "_any").alias("uid"), via.alias("via"))
