"""Canonical forms of single definitions as vectorised functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clonewright.sources.frontends import FRONTENDS
from clonewright.sources.frontends.base import Definition, with_deep_stack

ANALYSED = "cluster_canonical string, xname_canonical string, type3_lines array<string>, size int"


def first_definition(lang: str, text: str) -> Definition | None:
    """The first body or callable of a text that holds one definition."""
    found = FRONTENDS[lang].scan("t.tsx" if lang == "ts" and "</" in text else "t", text)
    return next((d for d in found if d.canonical is not None), None)


def analyses(lang: str, texts: list[str]) -> list[tuple[str, str, list[str], int] | None]:
    """(canonical, renamed canonical, lines, size) of each text that is one callable, None for others; for Rust, functions, methods and trait methods alike."""

    def one(text: str) -> tuple | None:
        d = first_definition(lang, text)
        return None if d is None or d.analysis is None else (d.canonical, d.analysis.xname_canonical, d.analysis.type3_lines, d.analysis.size)

    return with_deep_stack(lambda: [one(t) for t in texts])


def renamed_forms(lang: str, texts: list[str]) -> list[tuple[str, list[str], int] | None]:
    """(renamed canonical, lines, size) of each text that is one callable, None for others."""
    return [None if a is None else a[1:] for a in analyses(lang, texts)]


def canonical(lang: str) -> Callable[[Column], Column]:
    """A column function: the structural form of each text, or the text itself where it holds no definition that parses; null stays null."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            d = first_definition(lang, text) if text is not None else None
            return text if d is None else d.canonical

        return with_deep_stack(texts.map, one)

    return apply


def analysed(lang: str) -> Callable[[Column], Column]:
    """A column function: the forms of each text that is one callable; null for all others."""

    @F.pandas_udf(ANALYSED)
    def apply(texts: pd.Series) -> pd.DataFrame:
        def one(text: str | None) -> tuple:
            d = first_definition(lang, text) if text is not None else None
            if d is None or d.analysis is None:
                return None, None, None, None
            return d.canonical, d.analysis.xname_canonical, d.analysis.type3_lines, d.analysis.size

        rows = with_deep_stack(lambda: [one(t) for t in texts])
        return pd.DataFrame(rows, columns=["cluster_canonical", "xname_canonical", "type3_lines", "size"]).astype({"size": "Int32"})

    return apply
