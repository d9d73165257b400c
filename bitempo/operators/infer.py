"""Rules over facts: closure, symmetry, inverses, and hand-written derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitempo.session import Cut, cut

MAX_DEPTH = 8
_EDGE = ["from_uid", "to_uid", "valid_at", "invalid_at", "confidence"]


def transitive_closure(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pairs concluded from chains of asserted ``edges``: ``(from_uid, to_uid, valid_at, invalid_at, confidence, depth)``.

    A pair is concluded by a shortest chain whose periods share an instant; of
    equally short ones the most certain counts.  It has the common period and
    the least confidence of the chain.  Asserted pairs and loops are no
    conclusions, but chains lead through the former.  Rounds join pairs with
    their periods, not paths, and a period within one that a shorter chain of
    the pair has is left out, so undated cycles cost no more than their pairs;
    a round without a new period ends it.
    """
    pair, dates = ["from_uid", "to_uid"], ["valid_at", "invalid_at"]
    own = cut(edges.where("from_uid <> to_uid").groupBy(*pair, *dates).agg(F.max("confidence").alias("confidence")))
    frontier, seen, known = own, own.select(*pair, *dates), own.select(*pair).distinct()
    parts: list[DataFrame] = []
    step = own.select(F.col("from_uid").alias("to_uid"), F.col("to_uid").alias("_to"), F.col("valid_at").alias("_s"), F.col("invalid_at").alias("_e"), F.col("confidence").alias("_c"))
    for depth in range(2, max_depth + 1):
        grown = frontier.join(step, "to_uid").where("from_uid <> _to").select(
            "from_uid", F.col("_to").alias("to_uid"), F.greatest("valid_at", "_s").alias("valid_at"), F.least("invalid_at", "_e").alias("invalid_at"), F.least("confidence", "_c").alias("confidence")
        )
        grown = grown.where("invalid_at is null or valid_at is null or valid_at < invalid_at")
        best = grown.groupBy(*pair, *dates).agg(F.max("confidence").alias("confidence"))
        had = seen.select(F.col("from_uid").alias("_f"), F.col("to_uid").alias("_t"), F.col("valid_at").alias("_s"), F.col("invalid_at").alias("_e"))
        within = (F.col("_s").isNull() | (F.col("_s") <= F.col("valid_at"))) & (F.col("_e").isNull() | (F.col("_e") >= F.col("invalid_at")))
        new = Cut(best.join(had, (F.col("from_uid") == F.col("_f")) & (F.col("to_uid") == F.col("_t")) & within, "left_anti"))
        if new.df.isEmpty():
            break
        found = Cut(new.df.join(known, pair, "left_anti").groupBy(*pair).agg(F.max(F.struct("confidence", *dates)).alias("m")).select(*pair, "m.valid_at", "m.invalid_at", "m.confidence"))
        parts.append(found.df.withColumn("depth", F.lit(depth)))
        known, seen = known.unionByName(found.df.select(*pair)), seen.unionByName(new.df.select(*pair, *dates))
        frontier = new.df
    out = own.limit(0).withColumn("depth", F.lit(0))
    for p in parts:
        out = out.unionByName(p)
    return out


def symmetric_closure(edges: DataFrame) -> DataFrame:
    """Asserted edges turned round, where that is not asserted and no loop."""
    turned = edges.where("from_uid <> to_uid").select(F.col("to_uid").alias("from_uid"), F.col("from_uid").alias("to_uid")).distinct()
    return turned.join(edges.select("from_uid", "to_uid").distinct(), ["from_uid", "to_uid"], "left_anti")


def inverse(edges: DataFrame, name: str) -> DataFrame:
    """Edges under the name of the inverse relation."""
    return edges.select(F.col("to_uid").alias("from_uid"), F.lit(name).alias("rel_type"), F.col("from_uid").alias("to_uid"), "confidence").distinct()


def sub_property(edges: DataFrame, parent: str) -> DataFrame:
    """Edges under the relation that theirs is part of."""
    return edges.select("from_uid", F.lit(parent).alias("rel_type"), "to_uid", "confidence").distinct()


def lift(children: DataFrame, parents: DataFrame, asserted: DataFrame) -> DataFrame:
    """A child's fact becomes its parent's, where the parent has none: ``(from_uid, to_uid, premises)``.

    ``children(from_uid, to_uid, fact_uid)`` and ``asserted`` are facts of one
    relation, ``parents(from_uid, to_uid, fact_uid)`` go from child to parent.
    """
    up = parents.select(F.col("from_uid").alias("child"), F.col("to_uid").alias("parent"), F.col("fact_uid").alias("p1"))
    lifted = children.select(F.col("from_uid").alias("child"), F.col("to_uid").alias("target"), F.col("fact_uid").alias("p2")).join(up, "child")
    one = lifted.groupBy(F.col("parent").alias("from_uid"), F.col("target").alias("to_uid")).agg(F.count(F.lit(1)).alias("premises"))
    return one.join(asserted.select("from_uid").distinct(), "from_uid", "left_anti")


def via(first: DataFrame, second: DataFrame, asserted: DataFrame) -> DataFrame:
    """Two facts end to end make one, where it is not asserted: ``(from_uid, to_uid, premises)``."""
    a = first.select("from_uid", F.col("to_uid").alias("_m"))
    b = second.select(F.col("from_uid").alias("_m"), "to_uid")
    joined = a.join(b, "_m").where("from_uid <> to_uid").groupBy("from_uid", "to_uid").agg(F.count(F.lit(1)).alias("premises"))
    return joined.join(asserted.select("from_uid", "to_uid").distinct(), ["from_uid", "to_uid"], "left_anti")


def asserted(facts: DataFrame, relation: str | None = None) -> DataFrame:
    """Live facts that no rule concluded, of one relation if given."""
    live = facts.where("invalid_at is null and coalesce(assertion_status, 'live') <> 'corrected' and from_uid is not null and to_uid is not null")
    own = live.where(~F.coalesce(F.col("derived"), F.lit(False))) if "derived" in facts.columns else live
    return own if relation is None else own.where(F.col("rel_type") == relation)


def materialize(facts: DataFrame, axioms: DataFrame, cap: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """What all rules conclude from asserted facts: ``(from_uid, rel_type, to_uid, rule, valid_at, invalid_at, confidence, capped)``.

    Rules are run once, over asserted facts only, so that no conclusion feeds
    another rule.  A pair that is asserted is no conclusion; of several rules
    with one conclusion the first by name counts.  ``capped`` marks the
    relations of which more than ``cap`` was concluded, for a reader to refuse;
    nothing is left out.  Axioms are few and read by the driver.
    """
    known = asserted(facts)
    trait = {r["relation"]: r for r in axioms.groupBy("relation").agg(F.max("is_transitive").alias("t"), F.max("is_symmetric").alias("s"), F.max("inverse_of").alias("i"), F.max("sub_property_of").alias("p")).limit(1000).collect()}
    out = None
    for relation, r in sorted(trait.items()):
        own = known.where(F.col("rel_type") == relation)
        edges = own.select(*_EDGE)
        parts = []
        if r["t"]:
            parts.append(("transitive", relation, transitive_closure(edges, max_depth).select(*_EDGE)))
        turned = edges.select(F.col("to_uid").alias("from_uid"), F.col("from_uid").alias("to_uid"), *_EDGE[2:]).where("from_uid <> to_uid")
        if r["s"]:
            parts.append(("symmetric", relation, turned))
        if r["i"]:
            parts.append(("inverse", r["i"], turned))
        if r["p"]:
            parts.append(("sub_property", r["p"], edges))
        for rule, named, df in parts:
            made = df.select("from_uid", F.lit(named).alias("rel_type"), "to_uid", F.lit(rule).alias("rule"), *_EDGE[2:])
            out = made if out is None else out.unionByName(made)
    key = ["from_uid", "rel_type", "to_uid"]
    if out is None:
        return known.limit(0).select(*key, F.lit("").alias("rule"), *_EDGE[2:], F.lit(False).alias("capped"))
    one = out.groupBy(*key).agg(F.min_by(F.struct("rule", *_EDGE[2:]), F.struct("rule", -F.coalesce("confidence", F.lit(0.0)), "valid_at", "invalid_at")).alias("m")).select(*key, "m.*")
    new = one.join(known.select(*key).distinct(), key, "left_anti")
    if cap is None:
        return new.withColumn("capped", F.lit(False))
    much = new.groupBy("rel_type").agg((F.count(F.lit(1)) > cap).alias("capped"))
    return new.join(much, "rel_type")


def derived_facts(conclusions: DataFrame, confidence: float = 0.6) -> DataFrame:
    """Conclusions ``(from_uid, rel_type, to_uid, rule, premises)`` as facts to be merged: derived, of a set confidence, with what they rest on."""
    return conclusions.select("from_uid", "rel_type", "to_uid", F.lit(True).alias("derived"), F.col("rule").alias("derived_rule"), F.array_sort("premises").alias("premise_fact_uids"), F.lit(confidence).alias("confidence"), F.lit("derived").alias("extraction_method"))


def shared_concept(facts: DataFrame, labels: DataFrame, concepts: tuple[str, ...], a: str, b: str, relation: str, confidence: float = 0.5) -> DataFrame:
    """``(from_uid, to_uid, relation, shared, confidence)``: an ``a`` and a ``b`` that point to one concept, not yet related so.

    They are candidates for a review, not facts.  A concept that very many
    things point to would pair them all: what both sides of a concept have is
    counted first and the smaller side is sent to the larger.
    """
    known = asserted(facts)
    typed = known.join(labels.select(F.col("uid").alias("to_uid"), F.col("label").alias("_to")), "to_uid").where(F.col("_to").isin(*concepts))
    typed = typed.join(labels.select(F.col("uid").alias("from_uid"), F.col("label").alias("_from")), "from_uid").select("from_uid", "_from", F.col("to_uid").alias("concept")).distinct()
    left = typed.where(F.col("_from") == a).select(F.col("from_uid"), "concept")
    right = typed.where(F.col("_from") == b).select(F.col("from_uid").alias("to_uid"), "concept")
    pairs = left.join(right, "concept").where("from_uid <> to_uid").groupBy("from_uid", "to_uid").agg(F.count(F.lit(1)).alias("shared"))
    there = known.where(F.col("rel_type") == relation).select("from_uid", "to_uid").distinct()
    return pairs.join(there, ["from_uid", "to_uid"], "left_anti").withColumn("relation", F.lit(relation)).withColumn("confidence", F.lit(confidence))


def around(facts: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """The facts within ``hops`` of ``seeds(uid)``: all that rules about a changed node can rest on."""
    near = seeds.select("uid").distinct()
    for _ in range(hops):
        met = facts.join(near.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").select(F.col("to_uid").alias("uid")).unionByName(facts.join(near.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi").select(F.col("from_uid").alias("uid")))
        near = cut(near.unionByName(met).where("uid is not null").distinct())
    return facts.join(near.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").join(near.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi")
