import inspect
import random

import numpy as np
from pyspark.sql import functions as F

from bitempo.llm import subjects

TOPICS = {
    "law": ["court", "clause", "plaintiff", "ruling", "attorney", "contract"],
    "sport": ["match", "referee", "goalkeeper", "league", "penalty", "sprint"],
    "energy": ["turbine", "meter", "battery", "grid", "voltage", "tariff"],
}
FILLER = ["please have a look at this again", "nothing to add from my side", "we shall talk about it next week"]


def sentence(r, topic):
    return f"the {r.choice(TOPICS[topic])} and the {r.choice(TOPICS[topic])} need the {r.choice(TOPICS[topic])}"


def corpus(seed=0, n=400):
    r = random.Random(seed)
    docs, truth, labels = [], {}, []
    for i in range(n):
        some = r.sample(sorted(TOPICS), r.choice([0, 1, 1, 1, 2]))
        parts = [sentence(r, t) for t in some for _ in range(r.randint(3, 5))] + r.sample(FILLER, r.randint(1, 3))
        r.shuffle(parts)
        docs.append((i, ". ".join(parts) + ".", "en"))
        truth[i] = set(some)
        if i % 5 == 0:
            labels += [(i, s) for s in some] or [(i, "none")]
    return docs, truth, labels


AREAS = [("law", "Law", "courts and contracts"), ("sport", "Sport", "matches and leagues"), ("energy", "Energy", "grids and meters")]


def run(spark, docs, labels, areas=AREAS):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("subject", F.lit("clash")).withColumn("k", F.lit(1))
    a = spark.createDataFrame(areas, "subject string, title string, description string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    out = {}
    for r in subjects.subjects_of(d, "doc_id", "text", "lang", a, lab, "doc_id", evidence=3.0).collect():
        assert (r["doc_id"], r["subject"]) not in out and 0.25 <= r["share"] <= 1
        out[r["doc_id"], r["subject"]] = r["share"]
    return out


def test_held_out_accuracy(spark):
    docs, truth, labels = corpus()
    got = run(spark, docs, labels)
    held = [i for i in truth if i % 5]
    want = {(i, s) for i in held for s in truth[i]}
    have = {k for k in got if k[0] in set(held)}
    assert len(have & want) >= 0.95 * len(want) and len(have & want) >= 0.95 * len(have)


def test_edges(spark):
    docs, truth, labels = corpus(1, 200)
    more = [(1000, None, "en"), (1001, "", "en"), (1002, "  \n", None), (1003, "12 34 !?", "xx"), (None, "court", "en"), (1004, (sentence(random.Random(1), "law") + ". ") * 3000, None), docs[0], docs[0]]
    got = run(spark, docs + more, [*labels, (None, "law"), (5000, "sport"), (1, "unheard of")])
    assert not any(k[0] in (1000, 1001, 1002, 1003, None) for k in got)
    assert (1004, "law") in got
    assert run(spark, docs[:5], [], []) == {}


def test_empty_corpus(spark):
    assert run(spark, [(1, None, "en")], [(1, "law")]) == {}


def test_columns_and_sentence_ends():
    columns, n, ends, m = subjects.sentence_columns(["One two. Three!\nfour five six", "", "7 8", "word"], subjects.Codes())
    assert n.tolist() == [3 + 1 + 5, 0, 0, 1] and m.tolist() == [3, 0, 0, 1] and ends.tolist() == [3, 4, 9, 1]
    assert len(columns) == n.sum() and columns.dtype == np.int32 and (columns >= 0).all() and (columns < subjects.COLUMNS).all()
    again, *_ = subjects.sentence_columns(["one TWO"], subjects.Codes())
    assert again.tolist() == columns[:3].tolist()


def test_mixtures_settle_before_they_are_summed():
    assert inspect.signature(subjects.components).parameters["inner"].default >= 3
    r = np.random.default_rng(2)
    h = r.random((50, 4)).astype("float32") + 0.1
    columns = r.integers(0, 50, 400).astype("int32")
    lengths, mask = np.full(20, 20), np.ones((20, 4), "float32")
    settled = subjects._shares(columns, lengths, mask, h, 200)
    off = [np.abs(subjects._shares(columns, lengths, mask, h, n) - settled).mean() for n in (2, subjects.INNER)]
    assert off[1] < off[0]
