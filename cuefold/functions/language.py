"""A language detector: log-likelihoods of the three-sign pieces of a text, trained from labelled rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: Places for pieces, which share one if their signs say so. A piece's place is a sum of its signs' numbers, which any engine works out alike.
PLACES, FACTORS = 4096, (961, 31, 1)
#: Texts of fewer pieces tell too little.
LEAST = 3


def _squeezed(text: str) -> str:
    """Runs of ASCII white space as one space."""
    for sign in "\t\n\x0b\f\r":
        text = text.replace(sign, " ")
    return re.sub("  +", " ", text) if "  " in text else text


def _places(text: str) -> np.ndarray:
    """The places of all pieces of three signs of a text in small letters, white space runs taken as one space."""
    signs = np.frombuffer(_squeezed(text).encode("utf-32-le", "surrogatepass"), "<u4")
    places = signs[:-2] * FACTORS[0]  # sums stay under 2 ** 31, whatever the signs
    places += signs[1:-1] * FACTORS[1]
    places += signs[2:] * FACTORS[2]
    places %= PLACES
    return places


def _sums(text: str, table: np.ndarray) -> np.ndarray:
    """The sum over a text's pieces of each row of the table, rows of equal numbers alike to the last bit."""
    return (table * np.bincount(_places(text), minlength=PLACES)).sum(axis=1)


@dataclass(frozen=True)
class LanguageModel:
    """For each language the log-likelihood of each place, in the order of the languages' names."""

    languages: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]

    def scores(self, text: Column) -> Column:
        """The log-likelihood of a text in each language."""
        table = np.array(self.weights).reshape(-1, PLACES)

        @F.pandas_udf(Y.ArrayType(Y.DoubleType()))
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([_sums(t, table) for t in texts], dtype=object)

        return run(F.lower(F.coalesce(text, F.lit(""))))

    def column(self, text: Column) -> Column:
        """The likeliest language of a text, the first by name among equals; `unknown` if it is null or has under `LEAST` pieces."""
        known = F.coalesce(text, F.lit("")).rlike(rf"^(?:\s++|\S){{{LEAST + 2}}}")  # that many signs, a run of white space as one
        names, table = np.array([*self.languages, None], object), np.array(self.weights).reshape(-1, PLACES)

        @F.pandas_udf(Y.StringType())
        def best(texts: pd.Series) -> pd.Series:
            own = [-1 if len(names) == 1 else int(np.argmax(_sums(t, table))) if t else 0 for t in texts]
            return pd.Series(names[own], dtype=object)

        return F.when(known, best(F.lower(F.coalesce(text, F.lit(""))))).otherwise("unknown")


def train(rows: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """A model of rows with their languages; those without one are left out. Counts are summed where the rows are, and `PLACES` numbers a language are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name not in own:
                    own[name] = np.zeros(PLACES, np.int64)
                own[name] += np.bincount(_places(plain), minlength=PLACES)
        for name, n in own.items():
            p = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(p), pa.string()), pa.array(p, pa.int64()), pa.array(n[p], pa.int64())], ["l", "p", "n"])

    known = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("l"), F.lower(F.col(text)).alias("t"))
    counts = known.mapInArrow(run, "l string, p long, n long").groupBy("l", "p").agg(F.sum("n").alias("count"))
    found: dict[str, list[int]] = {}
    for r in counts.collect():
        found.setdefault(r["l"], [0] * PLACES)[r["p"]] += r["count"]
    names = tuple(sorted(found))
    weight = lambda own: tuple(math.log((n + 1) / (sum(own) + PLACES)) for n in own)
    return LanguageModel(names, tuple(weight(found[k]) for k in names))
