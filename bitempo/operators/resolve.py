"""Telling things apart and putting them together: duplicates, merges, conflicts, ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitempo.functions.temporal import disjoint
from bitempo.functions.text import jaccard

#: Weights of the duplicate score, and the bands of the identity ladder.
WEIGHTS = {"vector": 0.4, "lexical": 0.2, "targets": 0.2, "records": 0.2}
AUTO, GRAY, PROBABILITY, MARGIN = 0.90, 0.75, 0.85, 0.15


def duplicate_score(vector: Column, lexical: Column, targets: Column, records: Column, veto: Column) -> Column:
    """The weighted score of a pair; null when its texts contradict each other."""
    return F.when(~veto, WEIGHTS["vector"] * vector + WEIGHTS["lexical"] * lexical + WEIGHTS["targets"] * targets + WEIGHTS["records"] * records)


def scored_pairs(pairs: DataFrame, things: DataFrame) -> DataFrame:
    """Score ``pairs(a, b, vector)`` of ``things(id, words, targets, records, negated)``."""
    side = lambda s: things.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("words", "targets", "records", "negated")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    j = lambda c: jaccard(F.col(f"{c}_a"), F.col(f"{c}_b"))
    return both.select("a", "b", duplicate_score(F.col("vector"), j("words"), j("targets"), j("records"), F.col("negated_a") != F.col("negated_b")).alias("score"))


def survivors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(survivor, absorbed)`` of ``pairs(a, b)``: more support, then older, then ``a`` stays.

    ``nodes(id, support, since)``.
    """
    rank = lambda s: F.struct(F.col(f"support_{s}").alias("x"), (-F.unix_micros(f"since_{s}")).alias("y"))
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("support").alias(f"support_{s}"), F.col("since").alias(f"since_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    keeps_a = rank("a") >= rank("b")
    return both.select(F.when(keeps_a, F.col("a")).otherwise(F.col("b")).alias("survivor"), F.when(keeps_a, F.col("b")).otherwise(F.col("a")).alias("absorbed"))


def rewire(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """Facts with absorbed ends replaced by ``merged(absorbed, survivor)``, equal ones joined, loops gone."""
    one = merged.groupBy("absorbed").agg(F.min("survivor").alias("survivor"))
    out = facts
    for end in ("from_uid", "to_uid"):
        out = out.join(one.select(F.col("absorbed").alias(end), F.col("survivor").alias("_s")), end, "left").withColumn(end, F.coalesce("_s", end)).drop("_s")
    return out.where("from_uid <> to_uid").groupBy("from_uid", "rel_type", "to_uid").agg(F.min("valid_at").alias("valid_at"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("facts"))


def ladder(items: DataFrame, exact: DataFrame, aliases: DataFrame, near: DataFrame) -> DataFrame:
    """``(item, uid, rung)``: exact name, else alias, else one sure neighbour, else the classifier's choice, else new.

    ``items(item, label, name)``, ``exact(label, name, uid)``, ``aliases(label,
    name, uid)``, ``near(item, uid, cosine, probability, veto)``.
    """
    by_name = lambda t, c: t.groupBy("label", "name").agg(F.min("uid").alias(c))
    kept = near.where("not veto")
    sure = kept.where(F.col("cosine") >= AUTO).groupBy("item").agg(F.count_distinct("uid").alias("_n"), F.min("uid").alias("_sure"))
    gray = kept.where(F.col("cosine") >= GRAY)
    order = Window.partitionBy("item").orderBy(F.col("probability").desc(), "uid")
    best = gray.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("probability").over(order)).where("_r = 1")
    chosen = best.where((F.col("probability") >= PROBABILITY) & (F.col("probability") - F.coalesce("_next", F.lit(0.0)) >= MARGIN)).select("item", F.col("uid").alias("_chosen"))
    all_ = items.join(by_name(exact, "_exact"), ["label", "name"], "left").join(by_name(aliases, "_alias"), ["label", "name"], "left").join(sure, "item", "left").join(chosen, "item", "left")
    one_sure = F.when(F.col("_n") == 1, F.col("_sure"))
    rung = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").when(one_sure.isNotNull(), "vector").when(F.col("_chosen").isNotNull(), "classifier").otherwise("new")
    return all_.select("item", F.coalesce("_exact", "_alias", one_sure, "_chosen").alias("uid"), rung.alias("rung"))


def text_fact_action(kind: Column, pinned: Column, old_from: Column, old_to: Column, new_from: Column, new_to: Column) -> Column:
    """What a newly stated fact does to an old one that it meets.

    ``kind`` is duplicate, extends, newer_state, corrects or contradicts.  A
    pinned fact is never changed: what would change it becomes a dispute.
    """
    dated = old_from.isNotNull() & new_from.isNotNull()
    newer = F.when(~dated, "ended_unknown").when(disjoint(old_from, old_to, new_from, new_to), "write_both").when(old_from < new_from, "close_old").otherwise("backfill_new")
    changes = F.when(kind == "newer_state", newer).when(kind == "corrects", "correct_old").otherwise("dispute")
    return F.when(kind == "duplicate", "confirm_old").when(kind == "extends", "write_both").when(F.coalesce(pinned, F.lit(False)), "dispute").otherwise(changes)


def direction(shapes: DataFrame, axioms: DataFrame) -> DataFrame:
    """``shapes(subject_kind, relation, object_kind, ...)`` with ``direction``: as_is, swapped or refused."""
    keys = ["subject_kind", "relation", "object_kind"]
    known = axioms.select(*keys).distinct()
    turned = known.select(F.col("object_kind").alias("subject_kind"), "relation", F.col("subject_kind").alias("object_kind"), F.lit(True).alias("_t"))
    out = shapes.join(known.withColumn("_a", F.lit(True)), keys, "left").join(turned, keys, "left")
    return out.withColumn("direction", F.when(F.col("_a"), "as_is").when(F.col("_t"), "swapped").otherwise("refused")).drop("_a", "_t")


def conflicts(new: DataFrame, facts: DataFrame, functional: tuple[str, ...]) -> DataFrame:
    """``(new_uid, fact_uid)``: live facts that a new one may contradict.

    Those of its relation about its object and, if the relation is functional,
    those about its subject.  Each pair once, never with itself.
    """
    n = new.select(F.col("fact_uid").alias("new_uid"), "rel_type", F.col("from_uid").alias("s"), F.col("to_uid").alias("o"))
    f = facts.select("fact_uid", "rel_type", "from_uid", "to_uid")
    a = n.join(f, (n["rel_type"] == f["rel_type"]) & (F.col("o") == F.col("to_uid"))).select("new_uid", "fact_uid")
    b = n.where(F.col("rel_type").isin(*functional)).alias("n").join(f.alias("f"), (F.col("n.rel_type") == F.col("f.rel_type")) & (F.col("s") == F.col("f.from_uid"))).select("new_uid", "fact_uid")
    return a.unionByName(b).where("new_uid <> fact_uid").distinct()


def merged_into(trace: DataFrame) -> DataFrame:
    """``(absorbed, survivor)``: the newest merge of each node, one step."""
    return trace.groupBy("absorbed").agg(F.max_by("survivor", F.struct("at", "survivor")).alias("survivor"))


#: How far a pair of nodes is supported by each signal.
SIGNALS = {"none": 0.01, "record": 0.5, "text": 0.7, "middle": 0.8, "fact": 1.0}


def pair_support(pairs: DataFrame, facts: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, support)`` of ``pairs(a, b)``: the strongest of what ties two nodes.

    A live fact, a node that both have a fact with, a name in the other's text,
    a record that mentions both.  ``nodes(uid, name, text)``.  Middle nodes meet
    through the pairs that are asked for, never as all pairs of a hub.
    """
    ends = facts.select(F.col("from_uid").alias("x"), F.col("to_uid").alias("y")).unionByName(facts.select(F.col("to_uid").alias("x"), F.col("from_uid").alias("y"))).where("x is not null and y is not null").distinct()
    asked = pairs.select("a", "b").distinct()
    direct = asked.join(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_semi").withColumn("s", F.lit(SIGNALS["fact"]))
    middle = asked.join(ends.select(F.col("x").alias("a"), F.col("y").alias("m")), "a").join(ends.select(F.col("x").alias("b"), F.col("y").alias("m")), ["b", "m"], "left_semi").select("a", "b").distinct().withColumn("s", F.lit(SIGNALS["middle"]))
    side = lambda s: nodes.select(F.col("uid").alias(s), F.lower(F.coalesce("name", F.lit(""))).alias(f"n_{s}"), F.lower(F.coalesce("text", F.lit(""))).alias(f"t_{s}"))
    told = asked.join(side("a"), "a").join(side("b"), "b")
    inside = ((F.col("n_a") != "") & F.contains("t_b", "n_a")) | ((F.col("n_b") != "") & F.contains("t_a", "n_b"))
    text = told.where(inside).select("a", "b").withColumn("s", F.lit(SIGNALS["text"]))
    m = mentions.select("uid", "record_key").distinct()
    record = asked.join(m.withColumnRenamed("uid", "a"), "a").join(m.withColumnRenamed("uid", "b"), ["b", "record_key"], "left_semi").select("a", "b").distinct().withColumn("s", F.lit(SIGNALS["record"]))
    every = asked.withColumn("s", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(SIGNALS["none"]))
    out = every
    for part in (direct, middle, text, record):
        out = out.unionByName(part)
    return out.groupBy("a", "b").agg(F.max("s").alias("support"))


def verified_links(supported: DataFrame, facts: DataFrame, minimum: float = 0.6) -> DataFrame:
    """Pairs of a cited path that are supported well and have no fact yet: candidates for a review."""
    direct = facts.select(F.least("from_uid", "to_uid").alias("_l"), F.greatest("from_uid", "to_uid").alias("_g")).distinct()
    pairs = supported.where((F.col("support") >= minimum) & (F.col("a") != F.col("b"))).withColumn("_l", F.least("a", "b")).withColumn("_g", F.greatest("a", "b"))
    return pairs.join(direct, ["_l", "_g"], "left_anti").groupBy(F.col("_l").alias("a"), F.col("_g").alias("b")).agg(F.max("support").alias("support"))


def link_facts(candidates: DataFrame) -> DataFrame:
    """Approved link candidates ``(from_uid, to_uid, relation, derived_rule, confidence, state)`` as derived facts.

    For ``facts.upsert`` without reviving: a closed fact stays closed.
    """
    some = candidates.where("state = 'approved' and from_uid is not null and to_uid is not null")
    one = some.groupBy("from_uid", F.col("relation").alias("rel_type"), "to_uid").agg(F.max(F.struct("confidence", "derived_rule")).alias("m"))
    return one.select("from_uid", "rel_type", "to_uid", F.lit(True).alias("derived"), F.col("m.derived_rule").alias("derived_rule"), F.col("m.confidence").alias("confidence"))


def absorb_mentions(mentions: DataFrame, merged: DataFrame) -> DataFrame:
    """Mentions of absorbed nodes become their survivors', each pair once."""
    one = merged.groupBy(F.col("absorbed").alias("uid")).agg(F.min("survivor").alias("_s"))
    return mentions.join(one, "uid", "left").select(F.coalesce("_s", "uid").alias("uid"), "record_key").distinct()


def disputes(actions: DataFrame) -> DataFrame:
    """``(from_uid, to_uid)``: pairs of things in dispute, once, the smaller first."""
    pairs = actions.where("action = 'dispute' and old_uid <> new_uid")
    return pairs.select(F.least("old_uid", "new_uid").alias("from_uid"), F.greatest("old_uid", "new_uid").alias("to_uid")).distinct()


def open_disputes(facts: DataFrame) -> DataFrame:
    """Live facts of dispute, each pair once."""
    live = facts.where("rel_type = 'DISPUTED_WITH' and invalid_at is null and coalesce(assertion_status, 'live') <> 'corrected'")
    return live.select(F.least("from_uid", "to_uid").alias("a"), F.greatest("from_uid", "to_uid").alias("b")).where("a is not null").distinct()


def apply_actions(facts: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Facts after decided ``actions(old, new, action, new_from, record_key)``.

    ``close_old`` ends the old fact where the new one begins, ``correct_old``
    takes it back, ``confirm_old`` adds the record, ``ended_unknown`` says that
    it has ended some time; ``write_both``, ``backfill_new`` and ``dispute``
    leave the old fact as it is.
    """
    from bitempo.operators import facts as writes

    of = lambda word: actions.where(F.col("action") == word)
    out, _ = writes.close(facts, of("close_old").select(F.col("old").alias("fact_uid"), F.col("new_from").alias("valid_to")), now)
    out, _ = writes.correct(out, of("correct_old").select(F.col("old").alias("fact_uid")), now)
    out = writes.confirm(out, of("confirm_old").select(F.col("old").alias("fact_uid"), "record_key"), now)
    return writes.mark_ended_unknown(out, of("ended_unknown").select(F.col("old").alias("fact_uid"), F.coalesce("new_from", now).alias("attested_from")))
