"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import OWN

#: Characters of test items that are searched for at once: a bound on what is broadcast and on the automaton in each worker.
BLOCK = 4_000_000
_automata: dict = {}


def normalised(text: str | None) -> str:
    """Lower case, with one space for each run of white space and none at the ends; null is empty."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, text) of edits + 1 pieces of nearly equal length: `edits` edits leave one of them as it is."""
    n = edits + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to any substring of the text, and where the first such one ends (Myers, 1999)."""
    m = len(pattern)
    if masks is None:
        masks = bit_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, ch in enumerate(text, 1):
        eq = masks.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, at
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return best, end


def bit_masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def _automaton(key: str, items: list[tuple[int, str]], rate: float):
    if key not in _automata:
        _automata.clear()
        words: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for offset, piece in pieces(text, budget(len(text), rate)):
                words.setdefault(piece, []).append((i, offset))
        found = ahocorasick.Automaton()
        for word, where in words.items():
            found.add_word(word, (len(word), where))
        found.make_automaton()
        _automata[key] = found, [bit_masks(t) for _, t in items]
    return _automata[key]


def matches(text: str, items: list[tuple[int, str]], rate: float, key: str) -> Iterator[tuple[int, int, int, int]]:
    """(item, distance, start, end) of each item within its budget in the normalised text: its best place, the first of equals."""
    automaton, masks = _automaton(key, items, rate)
    windows: dict[int, list[list[int]]] = {}
    for last, (length, where) in automaton.iter(text):
        at = last - length + 1
        for i, offset in where:
            size = len(items[i][1])
            slack = budget(size, rate)
            lo, hi = max(0, at - offset - slack), min(len(text), at - offset + size + slack)
            own = windows.setdefault(i, [])
            if own and lo <= own[-1][1] and own[-1][0] <= lo:
                own[-1][1] = max(hi, own[-1][1])
            else:
                own.append([lo, hi])
    for i, own in windows.items():
        item, best = items[i][1], None
        most = budget(len(item), rate)
        exact = text.find(item)
        if exact >= 0:
            best = (0, exact, exact + len(item))
        else:
            for lo, hi in own:
                distance, end = myers(item, text[lo:hi], masks[i])
                if distance <= most and (best is None or (distance, lo + end) < (best[0], best[2])):
                    back, length = myers(item[::-1], text[max(lo, lo + end - len(item) - most) : lo + end][::-1])
                    best = (distance, lo + end - length, lo + end)
        if best:
            yield (i, *best)


def _search(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = shared.value
        for batch in batches:
            rows = [(d, items[i][0], *rest) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, *rest in matches(normalised(t.as_py()), items, rate, key)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

    return run


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, empty ones left out, in blocks of at most `block` characters (one longer item is a block of its own)."""
    own, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct().toLocalIterator():
        item = normalised(row[1])
        if not item:
            continue
        if own and size + len(item) > block:
            yield own
            own, size = [], 0
        own.append((row[0], item))
        size += len(item)
    if own:
        yield own


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each row of `docs` and each item of `benchmark` that it holds within int(rate * length) edits.

    Texts and items are compared in lower case with single spaces; places count code points of that form. Pieces of each item are looked
    for in the whole text by one automaton, and each hit is verified by bit-parallel edit distance over its window. Items go out in
    blocks of bounded size, one pass over the documents for each block, so a benchmark of any size is searched whole. Null and empty
    texts hold nothing, null or empty items are nowhere; equal items of different ids are all reported, a null id as null; repeated
    rows are reported as often as they occur. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, distance int, start long, `end` long"
    out = None
    for n, items in enumerate(item_blocks(benchmark, block)):
        part = base.mapInArrow(_search(spark.sparkContext.broadcast((f"{id(items)}-{n}-{hash(tuple(items))}", items)), rate), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """`docs` without those rows whose doc_id holds a benchmark item; all columns kept. Rows with a null doc_id stay."""
    bad = contaminated(docs, benchmark, rate).select(F.col("doc_id").alias(f"{OWN}id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad[f"{OWN}id"], "left_anti")
