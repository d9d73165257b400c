import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitempo.llm import split, tokens

TOKEN = re.compile(r"\w+|[^\w\s]")


def pieces(spark, texts, limit, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("piece", F.lit("clash")).withColumn("_u", F.lit(1))
    out = {}
    for r in split.split_texts(df, "text", ["id"], limit, overlap).collect():
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def check(text, rows, limit, overlap):
    n = len(TOKEN.findall(text or ""))
    assert [r["piece_no"] for r in rows] == list(range(len(rows)))
    assert rows[0]["n_pieces"] == len(rows)
    if n <= limit:
        assert len(rows) == 1 and rows[0]["piece"] == text
        return
    assert len(rows) > 1
    whole = ""
    for before, r in zip([None, *rows], rows, strict=False):
        assert r["token_to"] - r["token_from"] <= limit
        assert len(TOKEN.findall(r["piece"])) == r["token_to"] - r["token_from"]
        if before is not None:
            assert r["new_from"] == before["token_to"]
            assert r["new_from"] - r["token_from"] == min(overlap, r["new_from"])
        skip = r["new_from"] - r["token_from"]
        spans = [m.span() for m in TOKEN.finditer(r["piece"])]
        whole += r["piece"] if not skip else r["piece"][spans[skip][0] :]
    assert rows[-1]["token_to"] == n
    assert re.sub(r"\s+", "", whole) == re.sub(r"\s+", "", text)


CASES = [None, "", "  \n ", "one", "a b c d e f g h", "x" * 5000, "word " * 400, "Para one is here.\n\nPara two follows. It has two sentences.\n\n" * 30, "no_break" + ",;" * 300, "äöü ß éè " * 60, "\n\n  lead " + "tail " * 50 + "\r\n\r\nend" * 20]


@pytest.mark.parametrize(("limit", "overlap"), [(10, 0), (10, 3), (7, 6), (100, 15), (1, 0)])
def test_pieces(spark, limit, overlap):
    got = pieces(spark, CASES, limit, overlap)
    for i, text in enumerate(CASES):
        check(text, got[i], limit, overlap)


def test_pieces_are_the_text_again(spark):
    text = "  First line.\n\nSecond, with more words in it.\tThird\n" * 20
    rows = pieces(spark, [text], 30, 0)[0]
    assert "".join(r["piece"] for r in rows) == text


def test_natural_boundaries(spark):
    text = "one two three four.\n\nfive six seven eight nine ten eleven twelve"
    rows = pieces(spark, [text], 8, 0)[0]
    assert rows[0]["piece"] == "one two three four.\n\n"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab1_ .,\n\té-", max_size=300), min_size=1, max_size=12))
def test_any_text(spark, texts):
    got = pieces(spark, texts, 9, 2)
    for i, t in enumerate(texts):
        check(t, got[i], 9, 2)


def test_counts_are_those_of_the_definition(spark):
    texts = ["a_b c-d", "Zürich 2024!", "日本 語", "", None, "tab\tnew\nline", "é"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.n_tokens(F.col("t"))).collect()]
    assert got == [len(TOKEN.findall(t or "")) for t in texts]


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        split.split_texts(spark.createDataFrame([("a",)], "t string"), "t", [], 10, 10)
