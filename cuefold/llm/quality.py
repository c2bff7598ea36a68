"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm import terms
from cuefold.llm.common import OWN

#: A term's value is SCALE times its share of the text's terms.
SCALE = 32.0


@dataclass(frozen=True)
class Settings:
    """train_rows bounds the labelled rows that are read for training; 2**bits weights; shards train apart and are averaged."""

    bits: int = 18
    ngram: int = 2
    shape_ngram: int = 3
    train_rows: int = 12_000
    shards: int = 8
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(label, text, key) of at most `rows` labelled rows whose crc32(doc_id) mod `folds` is not `held_out`: those with the least hash of doc_id.

    Null ids and labels other than 0 and 1 are left out. `rows` bounds what is broadcast.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias(f"{OWN}id"), F.col(label).cast("int").alias(f"{OWN}label"))
    usable = usable.where(F.col(f"{OWN}id").isNotNull() & F.col(f"{OWN}label").isin(0, 1) & (fold(f"{OWN}id", folds) != held_out)).distinct()
    chosen = usable.withColumn(f"{OWN}key", F.xxhash64(f"{OWN}id")).orderBy(f"{OWN}key", f"{OWN}id", f"{OWN}label").limit(rows)
    joined = docs.select(F.col("doc_id").cast("long").alias(f"{OWN}doc"), "text").join(F.broadcast(chosen), F.col(f"{OWN}doc") == F.col(f"{OWN}id"))
    return joined.select(F.col(f"{OWN}label").alias("label"), F.col("text").cast("string").alias("text"), F.col(f"{OWN}key").alias("key"))


def fold(column: str, folds: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))


def features(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight index) of each n-gram of words and of word shapes, and the number of n-grams of each text."""
    text, words, shapes = terms.shaped_tokens(texts)
    owner, h = (np.concatenate(x) for x in zip(terms.ngrams(text, words, s.ngram), terms.ngrams(text, shapes, s.shape_ngram), strict=True))
    return owner, (h >> np.uint64(64 - s.bits)).astype(np.int64), np.bincount(owner, minlength=len(texts))


def long_features(text: bytes, s: Settings, size: int = terms.LONG) -> Iterator[np.ndarray]:
    """Weight indexes of the n-grams of one long text, part by part; a run's shape tells whether it is the one or two before, so two more runs go before each part."""
    most = max(s.ngram, s.shape_ngram)
    for part, known in terms.windows(text, most + 1, size):
        _, words, shapes = terms.shaped_tokens([part])
        h = np.concatenate([terms.later_ngrams(words, s.ngram, known), terms.later_ngrams(shapes, s.shape_ngram, known)])
        yield (h >> np.uint64(64 - s.bits)).astype(np.int64)


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def _train(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            y, keys, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for first, part in terms.slices(texts):
                if len(part[0]) > terms.LONG:
                    seen = sum(np.bincount(index, minlength=1 << s.bits) for index in long_features(part[0], s))
                    u = np.flatnonzero(seen)
                    rows.append((keys[first], y[first], u.astype(np.int32), (seen[u] * (SCALE / max(1, seen.sum()))).astype(np.float32)))
                    continue
                owner, index, count = features(part, s)
                order = np.argsort(owner, kind="stable")
                cuts = np.r_[0, np.cumsum(count)]
                index = index[order]
                for i in range(len(part)):
                    u, c = np.unique(index[cuts[i] : cuts[i + 1]], return_counts=True)
                    rows.append((keys[first + i], y[first + i], u.astype(np.int32), (c * (SCALE / max(1, count[i]))).astype(np.float32)))
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        size = (1 << s.bits) + 1  # the last is the bias
        z, n = np.zeros(size), np.zeros(size)
        for _ in range(s.epochs):
            for _, y, u, x in rows:
                u, x = np.r_[u, size - 1], np.r_[x, 1.0]
                w = _weights(z[u], n[u], s)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                more = n[u] + g * g
                z[u] += g - (np.sqrt(more) - np.sqrt(n[u])) / s.alpha * w
                n[u] = more
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([_weights(z, n, s).astype(np.float32).tobytes()], pa.binary())], ["rows", "weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, settings: Settings = Settings()) -> np.ndarray | None:  # noqa: B008
    """The averaged weights, bias last; None without labelled rows. What reaches the driver is at most `shards` models of a fixed size."""
    rows = labelled(docs, labels, label, folds, held_out, settings.train_rows)
    models = rows.repartition(settings.shards, "key").mapInArrow(_train(settings), "rows long, weights binary").collect()
    if not models:
        return None
    total = sum(m["rows"] for m in models)
    return sum(np.frombuffer(m["weights"], np.float32) * (m["rows"] / total) for m in models)


def score(docs: DataFrame, weights: np.ndarray | None, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, score) for each row's whole text: a sparse dot product. Empty and null texts get the bias alone; without a model all get 0.5.

    Texts of over a million bytes are read in parts, at white space; a run of one kind of signs that fills most of a part counts as several.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = []
            for _, part in terms.slices(batch.column(1).to_pylist()):
                if w is None:
                    out.append(np.full(len(part), 0.5))
                    continue
                if len(part[0]) > terms.LONG:
                    sums = np.array([(w[index].sum(dtype=float), len(index)) for index in long_features(part[0], settings)]).sum(axis=0)
                    out.append(1 / (1 + np.exp(-np.clip(np.array([sums[0] * SCALE / max(1, sums[1]) + float(w[-1])]), -35, 35))))
                    continue
                owner, index, count = features(part, settings)
                dots = np.bincount(owner, w[index], minlength=len(part)) * SCALE / np.maximum(count, 1) + float(w[-1])
                out.append(1 / (1 + np.exp(-np.clip(dots, -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, score, predicted) for each row. A null doc_id is scored too; its held_out is null. No rows give none."""
    scored = score(docs, train(docs, labels, "quality", folds, held_out, settings), settings)
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
