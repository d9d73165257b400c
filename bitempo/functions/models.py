"""Models behind a narrow interface: any callable over a batch becomes a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scorer(model: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A model that scores (question, text) pairs, as a column of doubles.

    The model is called once for each Arrow batch, never row by row.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            yield pd.Series(model(questions.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    return run


def embedder(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A model that makes vectors of texts, as a column of float arrays; null stays null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.notna()
            made = iter(model(texts[known].tolist()))
            yield pd.Series([next(made) if k else None for k in known])

    return run


def classifier(model: Callable[[list[str]], list[tuple[str, float]]]) -> Callable[[Column], Column]:
    """A model that gives each text a class and a probability, as a struct column."""

    @F.pandas_udf("kind string, probability double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(model(texts.fillna("").tolist()), columns=["kind", "probability"])

    return run


def overlap_model(questions: list[str], texts: list[str]) -> list[float]:
    """A stand-in reranker: the share of the question's words that the text holds."""
    out = []
    for q, t in zip(questions, texts, strict=True):
        words, low = {w for w in q.lower().split() if len(w) > 2}, t.lower()
        out.append(sum(w in low for w in words) / len(words) if words else 0.0)
    return out
