"""SimHash near-duplicates by a similarity of word shingles: the Gray-order index finds candidates, exact sets decide.

A pair of Jaccard similarity 0.8 differs in 10 of 64 fingerprint bits on average and in up to 24: too many for buckets of equal bit runs. So
codes meet in buckets of equal MinHash bands instead, and the index searches each bucket for pairs of up to FAR bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import OWN, drop_staged, small, staged
from cuefold.llm.components import components
from cuefold.llm.simhash import BUCKET, _gray_rank, near_pairs

#: A pair of similarity s shares none of the bands with probability (1 - s ** ROWS) ** BANDS: 2.7e-5 at 0.8, 2e-10 at 0.9.
BANDS, ROWS = 20, 4
#: At 0.8 a pair's fingerprints differ in more than FAR of 64 bits, or fewer than ALIKE of its 80 MinHash values agree in four bits, with a probability below 1e-5.
FAR, ALIKE = 24, 48
#: Classes of a bucket that are checked on their texts in one group; larger ones are dealt out in chunks.
OPEN = 5_000
#: Bytes of shingle sets that a task of the exact check holds of either side, about.
BLOCK = 16 << 20
_random = np.random.default_rng(42)
_A = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, BANDS * ROWS, np.uint64)
_MIX = _random.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: For each byte how many of its two half bytes are zero.
_ZEROS = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)
DESCRIBED = "doc_id long, text string, code long, n long, fp long, bands array<long>, signs binary"


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of a text's runs of `words` words, ascending; one of all words for a shorter text, none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return np.empty(0, np.uint64)
    joined, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(tokens) - width + 1, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n))


def set_fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), 16_384):
        counts += np.unpackbits(own[at : at + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view(np.int64)[0])


def sketch(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(a hash of each MinHash band, four bits of each MinHash value) of a set that is not empty."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 512):  # blocks that stay in the cache
            np.minimum(least, (own[at : at + 512, None] * _A + _B).min(axis=0), out=least)
        mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        bands = (mixed.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    half = (mixed & np.uint64(15)).astype(np.uint8).reshape(-1, 2)
    return bands ^ (bands >> np.uint64(31)), (half[:, 0] | half[:, 1] << 4).tobytes()


def _described(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column(1)]
            told = [sketch(x) if len(x) else (np.empty(0, np.uint64), b"") for x in sets]
            code = [int(np.array(xxhash.xxh64_intdigest(x.tobytes(), words), np.uint64).view(np.int64)) for x in sets]
            bands = pa.array([b.view(np.int64).tolist() for b, _ in told], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(code, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(list(map(set_fingerprint, sets)), pa.int64()), bands, pa.array([s for _, s in told], pa.binary())],
                ["doc_id", "text", "code", "n", "fp", "bands", "signs"],
            )

    return run


def _dealt(classes: DataFrame, bucket: int) -> DataFrame:
    """(g, gray, fp, code, n, signs, root, k): each class once for each band k, in the group of an equal band.

    Groups over `bucket` classes are dealt out in chunks by hash, and each pair of chunks is a group. Of such groups there are fewer than
    classes * BANDS / bucket, a few dozen bytes each.
    """
    rows = classes.select("code", "n", "fp", "signs", "root", F.posexplode("bands").alias("k", "band")).withColumn("b", F.xxhash64("k", "band")).drop("band")
    hot = rows.groupBy("b").count().where(F.col("count") > bucket).select("b", F.ceil(F.col("count") / bucket).cast("int").alias("chunks"))
    rows = rows.join(F.broadcast(hot), "b", "left").withColumn("c", F.pmod(F.xxhash64("code"), F.coalesce("chunks", F.lit(1))).cast("long"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    rows = rows.withColumn("o", other).withColumn("g", F.xxhash64("b", F.least("c", "o"), F.greatest("c", "o")))
    return rows.select("g", _gray_rank(F.col("fp")).alias("gray"), "fp", "code", "n", "signs", "root", "k")


def _grouped(rows: DataFrame) -> DataFrame:
    """Groups whole in one task, each ordered by Gray rank."""
    return rows.repartition("g").sortWithinPartitions("g", "gray", "code")


def _alike(a: np.ndarray, b: np.ndarray, cols: dict, least: float) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) the sizes and the sketches leave possible."""
    n, signs = cols["n"], cols["signs"]
    ok = (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9) & (cols["root"][a] != cols["root"][b]) & (cols["code"][a] != cols["code"][b])
    ok[ok] = _ZEROS[signs[a[ok]] ^ signs[b[ok]]].sum(axis=1) >= ALIKE
    return ok


def _hub_pairs(cols: dict, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each code of a group with the group's hub: the one whose fingerprint is nearest to the majority of each bit."""
    cut = np.flatnonzero(np.r_[True, cols["g"][1:] != cols["g"][:-1], True])
    for first, stop in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if stop - first > 1:
            fp = cols["fp"][first:stop]
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            off = np.bitwise_count(fp ^ np.packbits(bits * 2 > len(fp), bitorder="little").view(np.uint64)[0])
            hub = first + int(np.lexsort((cols["code"][first:stop], off))[0])
            x = np.arange(first, stop)
            x = x[np.bitwise_count(cols["fp"][x] ^ cols["fp"][hub]) <= FAR]
            yield x, np.full(len(x), hub)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The columns of whole groups, some thousand rows together; a row's group is its first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        many = sum(b.num_rows for b in held) >= 50_000 or sum(b.nbytes for b in held) >= 32 << 20
        if many and held[0].column(0)[0] != held[-1].column(0)[-1]:  # all but the last group are whole
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column(0).to_numpy()
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1
            yield _columns(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield _columns(pa.Table.from_batches(held))


def _columns(table: pa.Table) -> dict:
    out = {name: table.column(name).to_numpy() for name in ("g", "code", "n", "root")}
    signs = np.frombuffer(b"".join(table.column("signs").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    out |= {"fp": np.ascontiguousarray(table.column("fp").to_numpy()).view(np.uint64), "signs": signs}
    if "text" in table.column_names:
        out |= {"text": table.column("text"), "bands": table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), "k": table.column("k").to_numpy()}
    return out


def _stars(least: float):
    """(u, v), u below v: the pairs of each group's hub that may reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_groups(batches):
            for x, y in _hub_pairs(cols, least):
                ok = _alike(x, y, cols, least)
                u, v = cols["code"][x[ok]], cols["code"][y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return run


def _open_members(least: float):
    """(g, code) of the members that may reach the similarity with another of their group, of another component: never the pairs themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_groups(batches):
            found = np.zeros(len(cols["g"]), bool)
            for x, y in near_pairs(cols["fp"], cols["g"], FAR, cols["root"]):
                ok = _alike(x, y, cols, least)
                found[x[ok]] = found[y[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(cols["g"][found]), pa.array(cols["code"][found])], ["g", "code"])

    return run


def _links_within(words: int, least: float):
    """(u, v): links of each group's members, checked on the whole sets, enough to join all that chains of such links connect. A pair is
    checked in the first band that its two have in common, and only while nothing joins it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_groups(batches):
            names, label = np.unique(cols["root"], return_inverse=True)
            sets: dict[int, np.ndarray] = {}
            out: list[tuple[int, int]] = []

            def own(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingles(cols["text"][i].as_py(), words)
                return sets[i]

            for x, y in near_pairs(cols["fp"], cols["g"], FAR, label):
                ok = _alike(x, y, cols, least)
                x, y = x[ok], y[ok]
                ok = (cols["bands"][x] == cols["bands"][y]).argmax(axis=1) == cols["k"][x]
                for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    if label[i] != label[j]:
                        one, two = own(i), own(j)
                        both = len(np.intersect1d(one, two, assume_unique=True))
                        if both >= least * (len(one) + len(two) - both) - 1e-9:
                            out.append((int(cols["code"][i]), int(cols["code"][j])))
                            label[label == label[j]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in out], pa.int64()) for f in (min, max)], ["u", "v"])

    return run


def _checked(words: int, least: float):
    def run(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        sets = {c: shingles(t, words) for c, t in zip(members["code"], members["text"], strict=True)}
        keep = []
        for u, v in zip(pairs["u"], pairs["v"], strict=True):
            one, two = sets[u], sets[v]
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(both >= least * (len(one) + len(two) - both) - 1e-9)
        return pairs.loc[np.array(keep, bool), ["u", "v"]]

    return run


def _verified(pairs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs whose sets reach the similarity. Codes are dealt out over blocks of about BLOCK bytes of sets; each pair of blocks that has
    pairs gets the texts of those codes once, however many pairs they are in, and so is of bounded size."""
    wanted = staged(pairs.select(F.explode(F.array("u", "v")).alias("code")).distinct(), "wanted")
    held = staged(rows.join(small(wanted), "code", "left_semi").groupBy("code").agg(F.first("text").alias("text"), F.first("n").alias("n")), "held")
    blocks = max(1, -(-(held.agg(F.sum("n")).first()[0] or 0) * 8 // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    dealt = pairs.select((block("u") * blocks + block("v")).alias("g"), "u", "v")
    members = dealt.select(F.col("g").alias("of"), F.explode(F.array("u", "v")).alias("code")).distinct().join(held.select("code", "text"), "code")
    links = dealt.groupBy("g").cogroup(members.groupBy("of")).applyInPandas(_checked(words, least), "u long, v long")
    out = staged(links, "links")
    drop_staged(wanted)
    drop_staged(held)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, code, component_id) for each row of `docs` (doc_id, text).

    Documents whose sets of `words`-word shingles have a Jaccard similarity of `least` (0.8 or more) are linked; component_id is the smallest
    doc_id that links reach. Equal sets are one class, which `code`, a hash of the set, names; texts without words are one class. First
    the classes of a bucket are compared with its hub, so that a large group of near copies is joined by a star. Then those that may still
    be like another of their bucket meet there with their texts, and pairs that nothing joins yet are compared. Pairs are never rows
    of a table, but those with a hub and the links found; each link is verified on the whole sets. Nulls and repeated rows are as in `simhash.near_duplicates`.
    """
    rows = staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_described(words), DESCRIBED), "shingles")
    same = [F.first(c).alias(c) for c in ("n", "fp", "bands", "signs")]
    classes = staged(rows.groupBy("code").agg(F.min("doc_id").alias("least"), *same), "classes")
    own = classes.withColumn("root", F.col("code"))
    stars = staged(_grouped(_dealt(own, bucket).drop("k")).mapInArrow(_stars(least), "u long, v long").distinct(), "stars")
    links = _verified(stars, rows, words, least)
    roots = staged(components(links), "roots")
    rooted = classes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    dealt = _dealt(rooted, min(bucket, OPEN))
    left = staged(_grouped(dealt.drop("k")).mapInArrow(_open_members(least), "g long, code long").distinct(), "open")
    wanted = left.select("code").distinct()
    held = rows.join(small(wanted), "code", "left_semi").groupBy("code").agg(F.first("text").alias("text"), F.first("bands").alias("bands"))
    members = dealt.join(left, ["g", "code"]).join(staged(held, "held"), "code").select("g", "gray", "fp", "code", "n", "signs", "root", "k", "bands", "text")
    more = _grouped(members).mapInArrow(_links_within(words, least), "u long, v long")
    roots = components(links.unionByName(staged(more, "links")))
    drop_staged(stars)
    drop_staged(left)
    member = classes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "code").join(member.join(ids, "root").select("code", "component_id"), "code").select("doc_id", "code", "component_id")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """`docs` with one document of each near-duplicate component: that with the smallest doc_id, all its columns kept.

    Rows that share a doc_id count as one document and stay if any of them is that of its component. Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, words, least).where("doc_id is not null")
    gone = found.groupBy(F.col("doc_id").alias(f"{OWN}id")).agg(F.min(F.col("doc_id") != F.col("component_id")).alias(f"{OWN}gone")).where(f"{OWN}gone")
    return docs.join(gone, docs["doc_id"] == gone[f"{OWN}id"], "left_anti")
