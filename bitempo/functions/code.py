"""Comments and docstrings of source code, line by line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# How languages write comments (line, block open, block close).
STYLES = {
    "docker": (("#",), None), "go": (("//",), ("/*", "*/")), "java": (("//",), ("/*", "*/")), "javascript": (("//",), ("/*", "*/")), "properties": (("#", "!"), None),
    "python": (("#",), ('"""', '"""')), "shell": (("#",), None), "sql": (("--",), ("/*", "*/")), "typescript": (("//",), ("/*", "*/")), "yaml": (("#",), None),
}


def comment_lines(text: str | None, language: str | None) -> list[str]:
    """The comment and docstring lines of a file, trimmed; none for an unknown language."""
    style = STYLES.get((language or "").lower())
    if not text or style is None:
        return []
    marks, block = style
    out, inside = [], False
    for line in text.splitlines():
        s = line.strip()
        if inside:
            out.append(s)
            inside = block[1] not in s
        elif any(s.startswith(m) for m in marks):
            out.append(s)
        elif block and block[0] in s:
            after = s.split(block[0], 1)[1]
            out.append(s)
            inside = block[1] not in after
    return out


def comments(text: Column, language: Column) -> Column:
    """``comment_lines`` over columns, as an array."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([comment_lines(t, x) for t, x in zip(texts, languages, strict=True)])

    return run(text, language)


def blocks_of(text: str | None, language: str | None) -> list[str]:
    """Comments of a file in blocks: comment lines without code between them."""
    wanted = comment_lines(text, language)
    out: list[list[str]] = []
    at = 0
    together = False
    for line in (text or "").splitlines():
        s = line.strip()
        if at < len(wanted) and s == wanted[at]:
            if not together:
                out.append([])
            out[-1].append(s)
            at, together = at + 1, True
        elif s:
            together = False
    return ["\n".join(b) for b in out if any(b)]


def comment_blocks(text: Column, language: Column) -> Column:
    """``blocks_of`` over columns, as an array."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([blocks_of(t, x) for t, x in zip(texts, languages, strict=True)])

    return run(text, language)
