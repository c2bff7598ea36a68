"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuefold.llm.common import drop_staged, new_path, staged

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Parts of texts whose ids a worker remembers: the latest, and as many before them.
REMEMBERED = 600_000
#: Bytes of text that are worked on at once; a longer text is alone.
BLOCK = 8_000_000
#: Parts to one call of the tokenizer, with a line feed between them.
RUN = 512
#: A space before white space, a line feed or the end, or a line feed after other white space: such texts are not parted.
ODD = " (?:[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]|\\z)|[\\t\\f\\r\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]\n|\n(?:[\\t\\f\\r\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]|\\z)"
#: Letters that every version of Unicode calls so, and ASCII punctuation, which is a word of its own after them.
STOPPED = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]+)").fullmatch
#: White space, inside a part.
SPACE = re.compile(r"\s").search
BETWEEN = re.compile(r"(?<=\S) (?=\S)").search
#: Characters of a text that go to the tokenizer at once.
STRETCH = 1_000_000
#: For each control byte the lengths, 1 to 4, of the four numbers it stands for.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
_encoders: dict = {}
NAMES = ["doc_id", "n_tokens", "crc", "ids", "counts"]


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in `data`; `ends` begins with 0."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, data) of a binary column without nulls: what `_binary` makes one from."""
    wide = column.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], data


def _blocks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of about `size` bytes of one column; a longer value is alone."""
    total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(total // size)) + 1).tolist(), batch.num_rows]
    for first, stop in zip(cuts, cuts[1:], strict=False):
        if stop > first:
            yield batch.slice(first, stop - first)


class Encoder:
    """Ids of whole texts as the tokenizer gives them. A byte-level tokenizer never joins signs across a space that stands before a sign other
    than white space, nor a word and the line feeds after it, so texts are parted at both, and each distinct part goes to the tokenizer once.

    Texts with other spaces, or with added tokens such as <|endoftext|>, go to the tokenizer as they are, and so do all texts if it is
    of another kind. A text without any space is one part, and needs memory by its length.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        told = json.loads(self.tokenizer.to_str())
        before, added = told["pre_tokenizer"] or {}, told["added_tokens"]
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told["normalizer"]
        apart = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or SPACE(t["content"]) for t in added)
        self.feed = self._each(["\n"])[0]
        self.parted = byte_level and apart and len(self.feed) == self.kind.itemsize
        self.odd = "|".join([ODD, *(re.escape(t["content"]) for t in added)])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        """The ids of any text; a very long one goes to the tokenizer in stretches, cut where a space stands between other signs."""
        cuts = [0]
        for at in range(STRETCH, len(text) if self.parted else 0, STRETCH):
            if (found := BETWEEN(text, at)) and found.start() > cuts[-1]:
                cuts.append(found.start())
        return b"".join(self._each([text[a:b]])[0] for a, b in pairwise([*cuts, len(text)]))

    def _learn(self, new: list[str]) -> None:
        """Ids of parts with the space before them. Those with signs behind letters follow from both; those with white space inside go alone."""
        stopped, rest, known, before = [], {}, self.known, self.before
        for p in new:
            if p in before:
                known[p] = before[p]
            elif found := STOPPED(p):
                stopped.append((p, *found.groups()))
            else:
                rest[p] = None
        for _, base, _ in stopped:
            if base in before:
                known[base] = before[base]
            elif base not in known:
                rest[base] = None
        spaced = [p for p in rest if SPACE(p)]
        known.update(zip(spaced, self._each([p if p[0] == "\n" else " " + p for p in spaced]), strict=True))
        plain = [p for p in rest if not SPACE(p)] if spaced else list(rest)
        runs = [plain[at : at + RUN] for at in range(0, len(plain), RUN)]
        feed, size = np.frombuffer(self.feed, self.kind)[0], self.kind.itemsize
        for own, e in zip(runs, self.tokenizer.encode_batch_fast([" " + "\n ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = [*(np.flatnonzero(ids == feed) * size).tolist(), len(ids) * size]
            data, start = ids.tobytes(), 0
            for part, end in zip(own, ends, strict=True):
                known[part] = data[start:end]
                start = end + size
        signs = list({x for _, _, x in stopped})
        ids_of = dict(zip(signs, self._each(signs), strict=True))
        known.update((p, known[base] + ids_of[x]) for p, base, x in stopped)

    def _led(self, parts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        get = self.known.get
        out = list(map(get, parts))
        if new := [p for p, x in zip(parts, out, strict=True) if x is None]:
            self._learn(new)
            out = list(map(get, parts))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last one's end)."""
        texts = texts.fill_null("")
        n = len(texts)
        whole = pc.match_substring_regex(texts, self.odd) if self.parted else pa.array(np.ones(n, bool))
        lists = pc.split_pattern(pc.replace_substring_regex(pc.if_else(whole, "", texts), "(\n+)", r" \1"), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        parts = lists.values.dictionary_encode()
        at = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = self._each(lists.values.take(pa.array(starts[:-1])).to_numpy(zero_copy_only=False).tolist())  # what stands before a text's first space
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            heads[i] = self._whole(texts[i].as_py())
        at[starts[:-1]] = len(names) + np.arange(n)
        used = np.zeros(len(names) + n, bool)
        used[at] = True
        place = np.cumsum(used) - 1
        led = self._led([p for p, x in zip(names, used.tolist(), strict=False) if x])
        taken = pa.array(led + heads, pa.large_binary()).take(pa.array(place[at]))
        ends, data = _values(taken)
        return data.view(self.kind), ends[starts] // self.kind.itemsize


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number's code stands when every list begins a control byte of its own, and the control bytes of each list."""
    groups = -(-lengths // 4)
    shift = np.concatenate(([0], np.cumsum(groups * 4 - lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    return np.arange(int(lengths.sum())) + np.repeat(shift, lengths), groups


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def pack_all(numbers: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(control, data) of each list of `lengths` numbers: low-order bytes, as few as each number needs, and two bits of length for each, four to a control byte."""
    n = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (n > 0xFF).astype(np.uint8) + (n > 0xFFFF) + (n > 0xFFFFFF)
    place, groups = _padded(lengths)
    codes = np.zeros(int(groups.sum()) * 4, np.uint8)
    codes[place] = size - 1
    control = (codes.reshape(-1, 4) * np.array([1, 4, 16, 64], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = n.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]]
    return _binary(_ends(groups), control), _binary(_ends(size)[_ends(lengths)], data)


def unpack_all(control: pa.Array, data: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all lists, one after the other: lengths come from a table by control byte."""
    place, _ = _padded(lengths)
    size = LENGTHS[_values(control)[1]].reshape(-1)[place]
    out = np.zeros((len(size), 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < size[:, None]] = _values(data)[1]
    return out.reshape(-1).view("<u4")


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    control, data = pack_all(numbers, np.array([len(numbers)]))
    return control[0].as_py(), data[0].as_py()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    return unpack_all(pa.array([control]), pa.array([data]), np.array([n]))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = encoder(path), np.zeros(1, np.int64)
        for batch in batches:
            for sub in _blocks(batch, 1, BLOCK):
                plain, starts = own.encode(sub.column(1))
                ids = np.insert(plain, starts[1:], END_ID)
                ends = starts + np.arange(len(starts))
                counts = np.bincount(ids)
                total = np.pad(total, (0, max(0, len(counts) - len(total))))
                total[: len(counts)] += counts
                wide = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[a:b]) for a, b in pairwise((ends * 4).tolist())]
                n = sub.num_rows
                yield pa.RecordBatch.from_arrays([sub.column(0), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), _binary(ends * ids.itemsize, ids).cast(pa.binary()), pa.nulls(n, pa.binary())], NAMES)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], NAMES)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) sums of the count rows, one of which each encoding task left."""
    for batch in batches:
        for x in batch.column(0):
            total = np.frombuffer(x.as_py(), "<i8")
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def _rank(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, part, seq = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for sub in _blocks(batch, 2, BLOCK // 2):
                n = sub.column(1).to_numpy()
                size, (_, data) = sub.num_rows, _values(sub.column(2))
                packed = pack_all(rank[data.view("<u2" if len(data) == 2 * n.sum() else "<u4")], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, part, np.int32)), pa.array(np.arange(seq, seq + size)), sub.column(0), sub.column(1), *(x.cast(pa.binary()) for x in packed)],
                    ["part", "seq", "doc_id", "n_tokens", "control", "data"],
                )
                seq += size

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Writes `path`/ranks (rank, id) and `path`/tokens (part, seq, doc_id, n_tokens, control, data): each row's whole text, END_ID appended.

    Files follow each other by part, and rows in them by seq, in ascending doc_id order (null first; equal ones by length and checksum).
    Ids are ranked by their count over the whole corpus; the ranks have at most as many rows as the vocabulary has ids. Texts are encoded
    once; the ids, not the texts, are sorted by range.
    """
    spark = docs.sparkSession
    source = vocabulary or public_tokenizers.path(VOCABULARY)
    ids = staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(source), "doc_id long, n_tokens long, crc long, ids binary, counts binary"), "ids")
    counts = ids.where("counts is not null").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r["id"] for r in counts], np.int64)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ordered = ids.where("ids is not null").repartitionByRange("doc_id", "n_tokens", "crc").sortWithinPartitions("doc_id", "n_tokens", "crc").select("doc_id", "n_tokens", "ids")
    schema = "part int, seq long, doc_id long, n_tokens long, control binary, data binary"
    ordered.mapInArrow(_rank(spark.sparkContext.broadcast(rank)), schema).write.option("compression", "zstd").parquet(f"{path}/tokens")
    drop_staged(ids)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, doc_id, n_tokens, ids): each row's ids as little-endian unsigned 32-bit numbers."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # at most as many as the vocabulary has
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = shared.value
        for batch in batches:
            for sub in _blocks(batch, 5, BLOCK // 2):
                n = sub.column(3).to_numpy()
                ids = by_rank[unpack_all(sub.column(4), sub.column(5), n)].astype("<u4")
                yield pa.RecordBatch.from_arrays([*(sub.column(k) for k in range(4)), _binary(_ends(n * 4), ids).cast(pa.binary())], ["part", "seq", "doc_id", "n_tokens", "ids"])

    rows = spark.read.parquet(f"{path}/tokens").select("part", "seq", "doc_id", "n_tokens", "control", "data")
    return rows.mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids binary")


def encoded(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each row of `docs`, from the files that it is written to and read back from.

    A null text is empty and has the end id alone; repeated doc_ids are documents of their own. An empty table gives none.
    """
    from pyspark.sql import Window as W

    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary)
    light = staged(read_tokens(spark, path).select("part", "seq", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32")), "lengths")
    parts = light.groupBy("part").agg(F.sum("n_tokens").alias("n")).agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("all"))  # one row a file
    before = parts.select(F.explode(F.expr("transform(all, (x, i) -> struct(x.part AS part, aggregate(slice(all, 1, i), 0L, (s, y) -> s + y.n) AS offset))")).alias("p")).select("p.*")
    so_far = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return light.join(F.broadcast(before), "part").select("doc_id", (F.col("offset") + F.coalesce(so_far, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
