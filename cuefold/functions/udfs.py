"""The few measures that have no built-in form, as pandas functions over column batches."""

from __future__ import annotations

import html
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from cuefold.functions.language import LanguageModel


@lru_cache(maxsize=100_000)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by their matching blocks; 1.0 if both are empty, null counts as empty."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same over arrays of words."""
    return pd.Series([SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """All named and numbered entities."""
    return text.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def detect_language(detect=None):
    """A column function text -> language for `detect`: a `LanguageModel`, or a function text -> code; without one every text is `unknown`."""
    if detect is None:
        return lambda text: F.lit("unknown")
    if isinstance(detect, LanguageModel):
        return detect.column

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: detect(x or ""))

    return run
