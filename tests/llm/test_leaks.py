import random

from pyspark.sql import functions as F

from bitempo.llm import leaks

WORDS = [f"{a}{b}" for a in ("amber", "cedar", "delta", "fjord", "grove", "haven", "ivory") for b in ("gate", "loom", "mark", "port", "rise", "sail", "vault")]


def passage(r, n=60):
    return " ".join(r.choice(WORDS) for _ in range(n))


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash")).withColumn("item_id", F.lit(-1))
    i = spark.createDataFrame(items, "item_id long, passage string").withColumn("text", F.lit("clash"))
    return {(r["doc_id"], r["item_id"]): r for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "passage", **how).collect()}


def test_leaks(spark):
    r = random.Random(1)
    items = [(i, passage(r)) for i in range(20)] + [(90, None), (91, ""), (0, None)]
    p = items[3][1].split()
    filler = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(n))
    changed = [w if k % 9 else "other" for k, w in enumerate(p)]
    docs = [
        (1, filler(50) + " " + items[3][1] + " " + filler(50)),
        (2, items[3][1].upper().replace(" ", ",  ")),
        (3, "<p>" + " ".join(f"<em>{w}</em>" if k % 3 else f"[{w}](https://x.example/{k})" for k, w in enumerate(p)) + "</p>"),
        (4, " ".join(p[:30]) + "\n\n" + filler(40) + "\n" + " ".join(p[30:])),
        (5, filler(20) + " ".join(changed)),
        (6, " ".join(p[:27])),
        (7, " ".join(p[:12]) + " " + filler(30)),
        (8, filler(300)),
        (9, passage(r, 200)),
        (10, " ".join(reversed(p))),
        (11, None),
        (12, ""),
        (13, '{"gold": "' + items[3][1].replace(" ", "\\n") + '"}'),
        (14, filler(60_000) + " " + items[4][1] + " " + items[5][1]),
        (1, filler(50) + " " + items[3][1]),
        (None, items[3][1]),
    ]
    got = found(spark, docs, items)
    assert set(got) == {(d, 3) for d in (1, 2, 3, 4, 5, 6, 13)} | {(14, 4), (14, 5)}
    assert got[1, 3]["kind"] == got[2, 3]["kind"] == "exact" and got[4, 3]["kind"] == "proximity"
    assert got[6, 3]["matched_words"] == 27 and got[6, 3]["words"] == 60


def test_against_chaining_all_pairs(spark):
    r = random.Random(2)
    items = [(i, passage(r, 40)) for i in range(8)]
    docs = []
    for d in range(60):
        p = r.choice(items)[1].split()
        a = r.randrange(0, 30)
        part = p[a : a + r.randint(5, 40)]
        docs.append((d, " ".join(["lorem"] * r.randint(0, 20) + part + r.choice([[], p[:6]]) + ["ipsum"] * r.randint(0, 20))))
    want = set()
    for d, t in docs:
        for i, p in items:
            matched, _ = leaks.chain(p.split(), t.split())
            if matched >= 0.4 * len(p.split()):
                want.add((d, i))
    got = set(found(spark, docs, items))
    assert got <= want and len(got) >= 0.97 * len(want)


def test_complete_search_misses_nothing(spark):
    """Phrases of three to seven words only, words changed between them, two passages under one id."""
    r = random.Random(4)
    items = [(i // 2, passage(r, r.choice([3, 20, 40]))) for i in range(10)]
    docs = []
    for d in range(80):
        p = r.choice(items)[1].split()
        n = r.randint(3, 7)
        docs.append((d, " ".join(w if k % (n + 1) else r.choice(["lorem", w, "ipsum"]) for k, w in enumerate(p))))
    best = {}
    for d, t in docs:
        for i, p in items:
            iw = p.split()
            matched, _ = leaks.chain(iw, t.split(), min(3, len(iw)))
            if matched >= 0.4 * len(iw):
                best[d, i] = max(best.get((d, i), 0), matched / len(iw))
    got = found(spark, docs, items, complete=True)
    assert {k: round(r["share"], 9) for k, r in got.items()} == {k: round(v, 9) for k, v in best.items()}


def test_empty_tables(spark):
    docs, items = [(1, "some text")], [(1, passage(random.Random(3)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    assert leaks.leaks(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0
    assert leaks.leaks(d, "doc_id", "text", i.limit(0), "item_id", "passage").count() == 0


def test_chain():
    p = "a b c d e f g h i j".split()
    assert leaks.chain(p, p) == (10, 10)
    assert leaks.chain(p, "a b c d X f g h i j".split()) == (9, 5)
    assert leaks.chain(p, "f g h i j a b c d e".split())[0] == 5
    assert leaks.chain(p, []) == (0, 0)
