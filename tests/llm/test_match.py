import random

import numpy as np
from pyspark.sql import functions as F

from bitempo.llm import match

GIVEN = {"Josephine": "Josie", "Benedikt": "Ben", "Katarina": "Kata", "Henrike": "Rike", "Maximil": "Max", "Ulrika": "Ulla"}


def world(seed=0, n=60):
    r = random.Random(seed)
    surnames = sorted({"".join(r.choice(["bra", "de", "fi", "gro", "ha", "klo", "mu", "ne", "pri", "so", "tü", "wa"]) for _ in range(3)).capitalize() + r.choice(["k", "l", "n", "s"]) for _ in range(3 * n)})
    people, commits, truth = [], [], set()
    for i in range(n):
        given, last = r.choice(list(GIVEN)), surnames[i * 2 % len(surnames)]
        plain = last.lower().replace("ü", "u")
        account = f"acc:{i}"
        corporate = f"{given.lower()}.{plain}@corp.example"
        people.append((account, r.choice([f"{given} {last}", f"{last}, {given}", f"{given} X. {last}", f"{given}  {last} (external)"]), r.choice([None, None, corporate])))
        for provider in ("bitbucket", "github"):
            mail = r.choice([corporate, f"{plain}{r.randint(1, 9)}@mail.example", f"{GIVEN[given].lower()}.{plain}@mail.example"])
            for name in r.sample([f"{given} {last}", f"{GIVEN[given]} {last}", f"{last} {given}", f"{given.lower()} {plain}", None], 2):
                commits.append((provider, name, r.choice([mail, mail.upper(), f" {mail} "])))
            truth.add((account, provider, mail))
    for provider in ("bitbucket", "github"):
        commits += [(provider, "build-bot", "ci@corp.example")] * 50 + [(provider, "Somebody Unknownson", "somebody@elsewhere.example"), (provider, None, None), (provider, "Nobody", " ")]
    people += [("bot", "Automation", None), ("blank", None, None), ("blank2", " ", "")]
    return people, commits, truth


def test_matches(spark):
    people, commits, truth = world()
    p = spark.createDataFrame(people, "account_id string, display_name string, email string").withColumn("mail", F.lit("clash")).withColumn("given", F.lit("clash"))
    c = spark.createDataFrame(commits, "provider string, author_name string, author_email string").withColumn("names", F.lit("clash"))
    rows = match.matches(p, c).collect()
    got = {(r["account_id"], r["provider"], r["author_email"]) for r in rows}
    assert all(0.5 <= r["confidence"] <= 1 for r in rows) and len(got) == len(rows)
    assert len(got & truth) >= 0.9 * len(got) and len(got & truth) >= 0.9 * len(truth)
    assert not any("ci@" in m or "somebody" in m for _, _, m in got)


def test_empty_and_hot_names(spark):
    p = spark.createDataFrame([(f"a{i}", "Ulrika Grizibra", None) for i in range(50)] + [("x", "Ben Hofkran", None)], "account_id string, display_name string, email string")
    c = spark.createDataFrame([("github", "Ben Hofkran", "ben@mail.example")] * 300 + [("github", "Ulla Grizibra", "ulla.grizibra@mail.example")], "provider string, author_name string, author_email string")
    got = match.matches(p, c).collect()
    assert {r["account_id"] for r in got if r["author_email"].startswith("ben")} == {"x"}
    assert match.matches(p.limit(0), c).count() == 0 and match.matches(p, c.limit(0)).count() == 0


def test_parsing():
    assert match.parse_name("Grizibra, Ulrika")[0] == ("ulrika", "grizibra", "")
    assert match.parse_name("Ulrika C. Grizíbra (external)")[0] == ("ulrika", "grizibra", "c")
    assert ("gopika", "nunusesen", "") in match.parse_name("GopikaNunusésen")
    assert match.parse_name("ben-pri142") == [] and match.parse_name(None) == [] and match.parse_name("") == []
    assert match.parse_mail("1000379+fil-rar379@users.example") == (["fil", "rar"], ["379"], "")
    assert match.parse_mail("filippa.rarustol.h379@x.example") == (["filippa", "rarustol"], ["379"], "h")


def test_bands_and_distance():
    same = set(match.bands("grizibra")) & set(match.bands("grizibra"))
    assert len(same) == match.BANDS
    assert set(match.bands("sovegrasen")) & set(match.bands("svoegrasen"))
    assert match.distance("sovegrasen", "svoegrasen") == 1 and match.distance("abc", "abc") == 0 and match.distance("ab", "abcdefg") == 9


def test_one_edit_always_meets(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = "triporer"
    edits = {word[:i] + c + word[i + k :] for i in range(len(word)) for c in ("", *letters) for k in (0, 1)} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    own = match.less_one(word)
    assert all(own & match.less_one(e) for e in edits)
    p = spark.createDataFrame([("a", "Olumide Tirporer", None), ("b", "Ben Hofkran", None)], "account_id string, display_name string, email string")
    c = spark.createDataFrame([("github", "Olumide Triporer", "o.triporer@mail.example"), ("github", "Ben Hofkran", "ben.hofkran@mail.example")], "provider string, author_name string, author_email string")
    got = {(r["account_id"], r["author_email"]) for r in match.matches(p, c).collect()}
    assert got == {("a", "o.triporer@mail.example"), ("b", "ben.hofkran@mail.example")}
    assert match.BANDS >= 24 and match.ROWS <= 3


def test_calibration():
    rng = np.random.default_rng(1)
    x = (rng.random((2000, len(match.FEATURES))) < 0.4).astype(float)
    z = match.score(match.PRIOR, x) / 2
    y = (rng.random(2000) < 1 / (1 + np.exp(-z))).astype(float)
    w, scale = match.train(x[:1500], y[:1500])
    p = 1 / (1 + np.exp(-(match.score(w, x[1500:]) * scale[0] + scale[1])))
    bins = np.minimum(9, (p * 10).astype(int))
    error = sum(abs(p[bins == b].mean() - y[1500:][bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    assert error < 0.08


def test_little_goes_to_the_driver_and_at_once(spark):
    identities = spark.range(3000).selectExpr("'github' provider", "concat('u.grizibra', id, '@mail.example') mail", "array('Ulrika Grizibra') names").toPandas()
    for keys, b in ((match._keys_of_words, identities.assign(word=identities["mail"])), (match._words_of_identities, identities), (match._handles_of_identities, identities)):
        made = list(keys(iter([b])))
        assert len(made) == 6 and max(map(len, made)) < 50_000 and len(list(keys(iter([b[:0]])))) == 1
    names = spark.createDataFrame([(1, "ulrika", "grizibra", None, None)], "name_id long, given string, surname string, mail string, aliases array<string>")
    identities = spark.createDataFrame([("github", "ulrika.grizibra@mail.example", ["Ulrika Grizibra"])], "provider string, mail string, names array<string>")
    plan = match._candidates(names, identities)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [key") == 2  # where the keys meet
    rows = spark.range(0, 8000, 1, 8).selectExpr("id", "xxhash64(id) h")
    ids = [r["id"] for r in rows.orderBy("h").limit(100).collect()]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lowest", "")
    lowest = match._lowest(rows, "h", 100)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert lowest["id"].tolist() == ids
    sent = {tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(max(tracker.getJobIdsForGroup("lowest"))).stageIds}
    assert sent == {1}  # the job that sends rows to the driver reads the chosen ones only
