"""SimHash near-duplicates with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import OWN, staged
from cuefold.llm.components import components

#: 64 bits in five runs: fingerprints that differ in at most four bits agree in at least one run.
RUNS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Codes in a leaf of the index, and nodes below an upper node.
LEAF, FAN = 32, 8
#: A bucket of more codes is dealt out in chunks of about this many; each pair of chunks is one group.
BUCKET = 50_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64. No words: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return 0
    joined, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - width + 1
    first, last, digest = starts[:n].tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16_384):
        part = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first[at : at + 16_384], last[at : at + 16_384], strict=True)), np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row's whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _gray_rank(code):
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _buckets(codes: DataFrame, bucket: int) -> DataFrame:
    """(g, gray, fp): each code once for each of the five runs, in the group of codes that agree in that run.

    Groups over `bucket` codes are dealt out in chunks by hash, and each pair of chunks is a group; the table of such groups has at most
    5 * 2**13 rows, whatever the input, so it may be broadcast.
    """
    turned = F.array(*[
        F.struct(F.lit(k).alias("k"), (F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")).alias("code"), F.lit(64 - width).alias("rest"))
        for k, (at, width) in enumerate(RUNS)
    ])
    rows = codes.select("fp", F.explode(turned).alias("t")).select(
        "fp", _gray_rank(F.col("t.code")).alias("gray"),
        (F.col("t.k") * 8192 + F.expr("shiftrightunsigned(t.code, t.rest)")).cast("long").alias("b"),
    )
    hot = rows.groupBy("b").count().where(F.col("count") > bucket).select("b", F.ceil(F.col("count") / bucket).cast("int").alias("chunks"))
    rows = rows.join(F.broadcast(hot), "b", "left").withColumn("c", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("long"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    rows = rows.select("fp", "gray", "b", "c", other.alias("o"))
    return rows.select((F.shiftleft("b", 32) + F.least("c", "o") * 65536 + F.greatest("c", "o")).alias("g"), "gray", "fp")


def _levels(codes: np.ndarray, groups: np.ndarray) -> list[dict]:
    """The index, leaves first: for each node its first child, number of children, the bits all codes below share and which those are."""

    def cut(owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        at = np.flatnonzero(place % size == 0)
        return at, np.diff(np.r_[at, len(owner)])

    at, n = cut(groups, LEAF)
    both, any_ = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
    levels, owner = [{"at": at, "n": n, "bits": both, "mask": ~(both ^ any_), "any": any_}], groups[at]
    while len(np.unique(owner)) < len(owner):
        at, n = cut(owner, FAN)
        below = levels[-1]
        both, any_ = np.bitwise_and.reduceat(below["bits"], at), np.bitwise_or.reduceat(below["any"], at)
        levels.append({"at": at, "n": n, "bits": both, "mask": ~(both ^ any_), "any": any_})
        owner = owner[at]
    return levels


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; label keeps each code's least index of its component."""
    while len(a):
        x, y = label[a], label[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def near_pairs(codes: np.ndarray, groups: np.ndarray, most: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs of one group that are at most `most` bits apart and whose labels differ, some thousand pairs at a time.

    Codes come ordered by group and Gray rank. Pairs of index nodes are followed downwards; a pair is left as soon as the bits that each
    node's codes share differ in more than `most` places, or, at the leaves, once both are known to be of one label. Labels are looked
    up anew for each step, so the caller may join them meanwhile.
    """
    levels = _levels(codes, groups)
    top = len(levels[-1]["at"])
    stack = [(len(levels) - 1, np.arange(top), np.arange(top))]
    i, j = (x.ravel() for x in np.mgrid[0:FAN, 0:FAN])
    p, q = (x.ravel() for x in np.mgrid[0:LEAF, 0:LEAF])
    while stack:
        level, a, b = stack.pop()
        size = 8192 if level else 512
        if len(a) > size:
            stack += [(level, a[size:], b[size:])]
            a, b = a[:size], b[:size]
        node = levels[level]
        if not level:
            lo, hi = np.minimum.reduceat(label, node["at"]), np.maximum.reduceat(label, node["at"])
            keep = ~((lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b])) | (a == b) & (node["n"][a] > 1)
            a, b = a[keep], b[keep]
        ii, jj = (i, j) if level else (p, q)
        x, y = node["at"][a][:, None] + ii, node["at"][b][:, None] + jj
        ok = (ii < node["n"][a][:, None]) & (jj < node["n"][b][:, None]) & (x <= y if level else x < y)
        x, y = x[ok], y[ok]
        if level:
            low = levels[level - 1]
            near = np.bitwise_count((low["bits"][x] ^ low["bits"][y]) & low["mask"][x] & low["mask"][y]) <= most
            x, y = x[near], y[near]
            same = x == y
            stack += [(level - 1, u, v) for u, v in ((x[~same], y[~same]), (x[same], y[same])) if len(u)]
        else:
            near = (np.bitwise_count(codes[x] ^ codes[y]) <= most) & (label[x] != label[y])
            yield x[near], y[near]


def link_groups(codes: np.ndarray, groups: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, in each group, all codes which chains of pairs at `most` or fewer differing bits connect: one star for each component."""
    label = np.arange(len(codes))
    for x, y in near_pairs(codes, groups, most, label):
        _hook(label, x, y)
    far = np.flatnonzero(label != np.arange(len(codes)))
    return codes[far], codes[label[far]]


def _search(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(g, c):
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            n = np.diff(np.r_[first, len(g)])
            many = np.repeat(n > 1, n)
            u, v = link_groups(c[many], g[many], most) if many.any() else (c[:0], c[:0])
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            g = np.concatenate([g, batch.column(0).to_numpy(zero_copy_only=False)])
            c = np.concatenate([c, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(g) >= 50_000 and g[0] != g[-1]:  # all but the last group are whole
                cut = int(np.searchsorted(g, g[-1]))
                yield links(g[:cut], c[:cut])
                g, c = g[cut:], c[cut:]
        if len(g):
            yield links(g, c)

    return run


def fingerprint_links(codes: DataFrame, most: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between the distinct fingerprints of `codes` (fp), enough to connect all that are `most` (up to 4) or fewer bits apart by chains."""
    dealt = _buckets(codes, bucket).repartition("g").sortWithinPartitions("g", "gray")
    return dealt.select("g", "fp").mapInArrow(_search(most), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, fingerprint_docs) for each row of `docs` (doc_id, text).

    Equal fingerprints are one class and are linked once, whatever their number; component_id is the smallest doc_id reachable, the row's
    own included. Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null doc_id take part, and
    get the smallest doc_id of their component, or null if it has none. Repeated rows give repeated rows. An empty table gives none.
    """
    prints = staged(fingerprints(docs, words), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = staged(classes, "classes")
    roots = components(fingerprint_links(classes.select("fp"), most, bucket))
    member = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(ids, "root").select("fp", "component_id", F.col("n").alias("fingerprint_docs"))
    out = prints.join(member, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fingerprint_docs")


def keep_one(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """`docs` with one document of each near-duplicate component: that with the smallest doc_id, all its columns kept.

    Rows that share a doc_id count as one document and stay if any of them is that of its component. Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, words, most).where("doc_id is not null")
    gone = found.groupBy(F.col("doc_id").alias(f"{OWN}id")).agg(F.min(F.col("doc_id") != F.col("component_id")).alias(f"{OWN}gone")).where(f"{OWN}gone")
    return docs.join(gone, docs["doc_id"] == gone[f"{OWN}id"], "left_anti")
