"""Toxicity: a factorisation machine over hashed terms."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm import terms
from cuefold.llm.common import drop_staged, staged
from cuefold.llm.quality import fold, labelled


@dataclass(frozen=True)
class Settings:
    """train_rows bounds the labelled rows read for training; 2**bits is the table of hashed terms, any of which may get weights.

    A term gets weights on its own evidence (chi-square of least_chi or more) or on that of its pairs: least_docs rows hold it, and what the
    machine without it leaves over there goes with the other such terms of these rows, by at least `sigmas` standard deviations over
    `sketch` random projections. A row that is explained counts as leaving over at least the share `noise` of the labels' variance.
    """

    bits: int = 20
    train_rows: int = 12_000
    least_chi: float = 12.0
    least_docs: int = 10
    sketch: int = 64
    sigmas: float = 12.0
    noise: float = 0.1
    stems: tuple[int, ...] = (4, 5, 6)
    factors: int = 8
    epochs: int = 30
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-4


@dataclass(frozen=True)
class Machine:
    terms: np.ndarray  # hashed terms, ascending
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # terms x factors

    def dots(self, owner: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """bias + sum of linear weights + sum over pairs of the product of their factors, for n texts with distinct (text, slot)."""
        out = np.bincount(owner, self.linear[slot], minlength=n) + self.bias
        for f in self.factors.T:
            v = f[slot]
            out += 0.5 * (np.bincount(owner, v, minlength=n) ** 2 - np.bincount(owner, v * v, minlength=n))
        return out


def _parts(text: bytes) -> Iterator[bytes]:
    return (part for part, _ in terms.windows(text, 0, terms.LONG // 2))  # no part is long by itself


def distinct_terms(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of each text's distinct hashed terms: words, and the stems that inflected forms share. A long text, which is alone, is read in parts."""
    if texts and len(texts[0]) > terms.LONG:
        found = np.unique(np.concatenate([distinct_terms([part], s)[1] for part in _parts(texts[0])]))
        return np.zeros(len(found), np.int64), found
    owner, h = terms.stems(texts, s.stems)
    both = np.unique((owner.astype(np.uint64) << np.uint64(s.bits)) | (h >> np.uint64(64 - s.bits)))
    return (both >> np.uint64(s.bits)).astype(np.int64), (both & np.uint64((1 << s.bits) - 1)).astype(np.int64)


def _terms_of(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in terms.slices(batch.column(1).to_pylist(), lower=True):
                owner, term = distinct_terms(part, s)
                starts = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(term.astype(np.int32)))
                own = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([own.column(2), own.column(0), lists], ["key", "label", "terms"])

    return run


def fit(rows: list[tuple[int, list[int]]], kept: np.ndarray, s: Settings) -> Machine:
    """Adaptive gradient steps on the log loss over (label, slots) rows, in the order given."""
    rng = np.random.default_rng(7)
    w, v, b = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), s.factors)), np.zeros(1)
    seen = [np.full_like(x, 1e-6) for x in (w, v, b)]
    y = np.array([r[0] for r in rows], float)
    b[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(s.epochs):
        for at in range(0, len(rows), s.batch):
            part = rows[at : at + s.batch]
            owner = np.repeat(np.arange(len(part)), [len(r[1]) for r in part])
            slot = np.concatenate([np.asarray(r[1], np.int64) for r in part]) if len(owner) else np.zeros(0, np.int64)
            sums = np.zeros((len(part), s.factors))
            np.add.at(sums, owner, v[slot])
            squares = np.zeros_like(sums)
            np.add.at(squares, owner, v[slot] ** 2)
            dots = b[0] + np.bincount(owner, w[slot], minlength=len(part)) + 0.5 * (sums**2 - squares).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(dots, -35, 35))) - y[at : at + s.batch]) / len(part)
            gw, gv = np.bincount(slot, g[owner], minlength=len(kept)) + s.decay * w, s.decay * v
            np.add.at(gv, slot, g[owner, None] * (sums[owner] - v[slot]))
            for x, grad, own in ((w, gw, seen[0]), (v, gv, seen[1]), (b, np.array([g.sum()]), seen[2])):
                own += grad**2
                x -= s.rate * grad / np.sqrt(own)
    return Machine(kept, float(b[0]), w, v)


def marginal_evidence(flat: np.ndarray, label: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n terms the chi-square, less one half, of its rows' labels against all labels `y`; `flat` has a term and `label` its row's label."""
    d = np.bincount(flat, minlength=n).astype(float)
    p = np.bincount(flat, label, minlength=n)
    expected = d * y.mean()
    return np.maximum(np.abs(p - expected) - 0.5, 0) ** 2 * (1 / (expected + 1e-9) + 1 / (d - expected + 1e-9))


def pair_evidence(rows: list[np.ndarray], left: np.ndarray, n: int, variance: float, s: Settings) -> np.ndarray:
    """For each of n terms how many standard deviations the covariance of `left` with its rows' other terms stands out.

    All other terms of a row are taken together, as `sketch` sums of random signs over the root of their number: a pair that tells the label
    moves every sum by its partner's sign. What a term's rows have in common cancels, so only pairs count, not the term alone.
    """
    signs = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (n, s.sketch))
    cross, plain = np.zeros((n, s.sketch), np.float32), np.zeros((n, s.sketch), np.float32)
    docs, first, second, squares = (np.zeros(n) for _ in range(4))
    for row, g in zip(rows, left.tolist(), strict=True):
        if len(row):
            sums = signs[row].sum(axis=0) / np.sqrt(len(row), dtype=np.float32)
            cross[row] += np.float32(g) * sums
            plain[row] += sums
            docs[row] += 1
            first[row] += g
            second[row] += g * g
            squares[row] += float(sums @ sums)
    m = np.maximum(docs, 1)
    spread = np.maximum((second - first**2 / m) / m, s.noise * variance) * (squares - np.einsum("ij,ij->i", plain, plain) / m) / s.sketch
    cross -= (first / m).astype(np.float32)[:, None] * plain
    told = np.einsum("ij,ij->i", cross, cross) / np.maximum(spread, 1e-9)
    return np.where(spread > 1e-6, (told / s.sketch - 1) * np.sqrt(s.sketch / 2), 0)


def learn(y: np.ndarray, flat: np.ndarray, lengths: np.ndarray, s: Settings) -> Machine:
    """The machine over all hashed terms of rows (labels, terms one row after the other, each row's number of them): fitted on terms that tell by themselves,
    then, if pairs of others do, on those as well."""
    owner = np.repeat(np.arange(len(y), dtype=np.int32), lengths)
    stops = np.cumsum(lengths)[:-1]

    def only(kept: np.ndarray) -> list[np.ndarray]:
        """Each row's terms among `kept`, as places in it."""
        place = np.full(1 << s.bits, -1, np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        at = place[flat]
        return [x[x >= 0] for x in np.split(at, stops)]

    def fitted(kept: np.ndarray) -> tuple[Machine, list[np.ndarray]]:
        slots = only(kept)
        return fit(list(zip(y.astype(int).tolist(), slots, strict=True)), kept, s), slots

    kept = np.flatnonzero(marginal_evidence(flat, y[owner], y, 1 << s.bits) >= s.least_chi)
    machine, slots = fitted(kept)
    dots = machine.dots(np.repeat(np.arange(len(y)), [len(x) for x in slots]), np.concatenate([np.zeros(0, np.int64), *slots]), len(y))
    left = 1 / (1 + np.exp(-np.clip(dots, -35, 35))) - y
    common = np.flatnonzero(np.bincount(flat, minlength=1 << s.bits) >= s.least_docs)
    more = common[pair_evidence(only(common), left, len(common), y.mean() * (1 - y.mean()), s) > s.sigmas]
    both = np.union1d(kept, more)
    return fitted(both)[0] if len(both) > len(kept) else machine


def _fitted(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32()))]))
        if not table.num_rows:
            return
        table = table.sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()
        lists = table.column("terms").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        m = learn(table.column("label").to_numpy().astype(float), lists.flatten().to_numpy(), lengths, s)
        data = [m.terms.astype("<i8").tobytes(), m.linear.astype("<f8").tobytes(), m.factors.astype("<f8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), *(pa.array([x], pa.binary()) for x in data)], ["bias", "terms", "linear", "factors"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, s: Settings = Settings()) -> Machine | None:  # noqa: B008
    """The machine; None without labelled rows. The bounded labelled sample is hashed where its rows lie and fitted by one executor; the driver gets the model alone.

    A doc_id with both labels has a row of each.
    """
    sample = staged(labelled(docs, labels, label, folds, held_out, s.train_rows).mapInArrow(_terms_of(s), "key long, label int, terms array<int>"), "terms")
    found = sample.coalesce(1).mapInArrow(_fitted(s), "bias double, terms binary, linear binary, factors binary").collect()
    drop_staged(sample)
    if not found:
        return None
    bias, known, linear, factors = found[0]
    return Machine(np.frombuffer(known, "<i8"), bias, np.frombuffer(linear, "<f8"), np.frombuffer(factors, "<f8").reshape(-1, s.factors))


def _scorer(m: Machine | None, s: Settings):
    """A function that gives the score of each of a list of texts."""
    place = np.full(1 << s.bits, -1, np.int32)
    if m is not None:
        place[m.terms] = np.arange(len(m.terms))

    def scores(texts: list[str | None]) -> np.ndarray:
        if m is None:
            return np.full(len(texts), 0.5)
        out = [np.zeros(0)]
        for _, part in terms.slices(texts, lower=True):
            if len(part[0]) > terms.LONG:
                owner, term = distinct_terms(part, s)
                slot = place[term]
            else:
                owner, h = terms.stems(part, s.stems)
                slot = place[(h >> np.uint64(64 - s.bits)).astype(np.int64)]
            known = max(1, len(m.terms))
            own = np.unique(owner[slot >= 0].astype(np.int64) * known + slot[slot >= 0])
            out.append(1 / (1 + np.exp(-np.clip(m.dots(own // known, own % known, len(part)), -35, 35))))
        return np.concatenate(out)

    return scores


def score(docs: DataFrame, machine: Machine | None, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, score) for each row's whole text. Empty and null texts get the bias alone; without a machine all get 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # terms of the bounded sample x factors numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value, s)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, held_out: int = 0, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, score, predicted) for each row. A null doc_id is scored too; its held_out is null. No rows give none."""
    scored = score(docs, train(docs, labels, "toxic", folds, held_out, s), s)
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """`docs` without those scored at or above the threshold; all columns kept. Texts are scored where they lie: no shuffle.

    Rows go by their own text, whatever their doc_id; null and empty texts get the bias alone. Without labelled rows all stay.
    """
    machine = train(docs, labels, s=s)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = _scorer(shared.value, s)
        for texts in batches:
            yield pd.Series(scores([None if x is None or x != x else x for x in texts]))

    return docs if machine is None else docs.where(toxic(F.col("text").cast("string")) < threshold)
