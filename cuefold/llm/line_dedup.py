"""Line dedup: hashes dealt out by range, first occurrences streamed, and the lines to keep told as a bitmap for each document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import OWN, drop_staged, staged, text_or_empty

#: Lines whose key has fewer code points stay wherever they are.
LEAST = 10
#: Lines whose rows a worker holds at once.
BLOCK = 200_000
#: A row's lines: the 128-bit hash of the key in two halves, and where the line stands. A document is an id; `tid` tells rows of one id apart.
PLACE = ["h1", "h2", "absent", "doc_id", "tid", "pos"]
LINES = "h1 long, h2 long, absent boolean, doc_id long, tid long, pos int"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line of a text in UTF-8: stripped of ASCII white space at both ends, A-Z lowered."""
    return [x.strip() for x in text.lower().split(b"\n")]  # bytes: A-Z only, and ASCII white space only


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in LINES.split(", ")]

        def told(batch: pa.RecordBatch, rows: list, pos: list, hashes: list) -> pa.RecordBatch:
            at, both = pa.array(rows, pa.int64()), np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            doc = batch.column(0).take(at)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), doc.is_null(), doc, batch.column(1).take(at), pa.array(pos, pa.int32())], names)

        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            rows, pos, hashes = [], [], []
            for i in range(batch.num_rows):
                for k, key in enumerate(line_keys(texts[i].as_py())):
                    if _counts(key, least):
                        rows.append(i)
                        pos.append(k)
                        hashes.append(xxhash.xxh3_128_digest(key))
                        if len(rows) >= BLOCK:
                            yield told(batch, rows, pos, hashes)
                            rows, pos, hashes = [], [], []
            if rows:
                yield told(batch, rows, pos, hashes)

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range partition, ordered by key, document and position, as a stream that keeps the current key and its first document.

    Told are, with `kind`: 0, lines of another document than the key's first one in this partition; 1, the other lines of the partition's
    first key, whose first document may stand in a partition before; 2, one row, the partition's last key and its first document here.
    """
    key, first, opening, begun = None, None, None, False

    def told(table: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
        yield from table.append_column("kind", pa.array(np.full(table.num_rows, kind, np.int8))).to_batches()

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        absent = batch.column(2).to_numpy(zero_copy_only=False)
        doc = np.where(absent, 0, batch.column(3).fill_null(0).to_numpy())
        n = batch.num_rows
        starts = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        if key == (h1[0], h2[0]):
            starts[0] = False
        group = np.cumsum(starts)  # 0: the key goes on from the batch before
        heads = np.flatnonzero(starts)
        head_doc, head_absent = doc[heads], absent[heads]
        if not starts[0]:
            head_doc, head_absent = np.r_[first[0], head_doc], np.r_[first[1], head_absent]
        else:
            group = group - 1
        other = (doc != head_doc[group]) | (absent != head_absent[group])
        if not begun:
            opening, begun = (h1[0], h2[0]), True
        yield from told(table.filter(pa.array(other)), 0)
        undecided = ~other & (h1 == opening[0]) & (h2 == opening[1])
        yield from told(table.filter(pa.array(undecided)), 1)
        key, first = (h1[n - 1], h2[n - 1]), (head_doc[-1], head_absent[-1])
        last = table.slice(n - 1, 1)
    if last is not None:
        doc = pa.array([None if first[1] else int(first[0])], pa.int64())
        last = last.set_column(3, "doc_id", doc).set_column(2, "absent", pa.array([bool(first[1])]))
        yield from told(last, 2)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for own in batch.column(2):
            at = own.values.to_numpy()
            bits = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)  # whole bytes: lines behind the last one dropped stay
            bits[at] = 0
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc_id", "tid", "keep"])


def kept_lines(keep: bytes | None, n: int) -> np.ndarray:
    """Which of `n` lines stay, from a document's bitmap; lines behind its end stay, and all do where there is none."""
    out = np.ones(n, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n]
        out[: len(bits)] = bits
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, tid, keep): for each row of `docs` (doc_id, text) that loses lines, one bit a line, 1 for those that stay, compressed by zlib.

    `tid` is the row's xxhash64 of its text. A line's key is the line without ASCII white space at its ends, A-Z lowered. Keys of `least` or
    more code points that stand in two or more documents keep their lines in the document of the smallest doc_id alone, all of them. Rows of
    one doc_id are one document; rows without an id are one document that comes after all others. A null text is one empty line. An empty
    table gives none. Columns other than these two are not read.

    Lines are dealt out by range of key, document and position, so that a key of any size is spread over as many partitions as its lines
    need; each partition tells its last key's first document, and lines of a key that goes on from one partition to the next are decided by
    those, at most one row a partition.
    """
    lines = staged(_keyed(docs).mapInArrow(_lines(least), LINES), "lines")
    told = staged(lines.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(_firsts, f"{LINES}, kind byte"), "told")
    drop_staged(lines)
    own = told.where("kind = 2").groupBy("h1", "h2").agg(F.min(F.struct("absent", "doc_id")).alias("first"))  # at most a row a partition
    heads = F.broadcast(own.select("h1", "h2", F.col("first.absent").alias("no_id"), F.col("first.doc_id").alias("head")))
    open_ = told.where("kind = 1").join(heads, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("head"))))
    gone = told.where("kind = 0").select("doc_id", "tid", "pos").unionByName(open_.select("doc_id", "tid", "pos"))
    return gone.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("at")).mapInArrow(_packed, "doc_id long, tid long, keep binary")


def _applied(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, maps = batch.column(1).cast(pa.large_binary()), batch.column(2)
            n_lines, n_dropped, out = [], [], []
            for i in range(batch.num_rows):
                data, keep = texts[i].as_py(), maps[i].as_py()
                n = data.count(b"\n") + 1
                left = data
                dropped = 0
                if keep is not None:
                    stay = kept_lines(keep, n)
                    dropped = n - int(stay.sum())
                    left = b"\n".join([x for x, y in zip(data.split(b"\n"), stay.tolist(), strict=True) if y])
                n_lines.append(n)
                n_dropped.append(dropped)
                out.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def _with_bitmaps(docs: DataFrame, least: int) -> DataFrame:
    """Each row with its bitmap. Texts move once, and are not sorted: the bitmaps of a partition are what is held."""
    maps = staged(keep_bitmaps(docs, least), "bitmaps").withColumnsRenamed({"doc_id": f"{OWN}id", "tid": f"{OWN}tid"})
    on = F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (F.col("tid") == F.col(f"{OWN}tid"))
    return _keyed(docs).join(maps.hint("shuffle_hash"), on, "left").select("doc_id", "text", "keep")


def deduped(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each row's text with the lines left that `keep_bitmaps` keeps, joined by line feeds."""
    rows = _with_bitmaps(docs, least).mapInArrow(_applied(False), "doc_id long, n_lines long, n_dropped long, kept string")
    return rows.withColumnRenamed("kept", "text")


def line_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): the same with the SHA-256 of the text that is left, in UTF-8 and lower-case hex."""
    rows = _with_bitmaps(docs, least).mapInArrow(_applied(True), "doc_id long, n_lines long, n_dropped long, kept string")
    return rows.withColumnRenamed("kept", "kept_sha256")


#: DuckDB SQL of `line_report` over `documents`.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.first IS NULL OR f.first = k.doc_id AS kept FROM keyed k LEFT JOIN firsts f ON f.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
