"""Cross-tokenizer alignment: two tokenizers' token ends intersected by galloping, groups cut at common ends, overlaps from rank differences."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cuefold.llm.common import staged
from cuefold.llm.token_output import _binary, _blocks, _ends

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts of texts that a worker remembers, and bytes of text that it works on at once; a longer text is alone.
REMEMBERED, BLOCK = 300_000, 4_000_000
#: Pairs that a task counts before it tells them, and pairs whose corpus counts go out to the tasks at once.
TOLD, SLICE = 2_000_000, 4_000_000
#: A space at an end of a text or beside other white space: such texts are parted by Python's rule alone.
ODD = "(?:\\A|[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]) | (?:[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]|\\z)"
BETWEEN = re.compile(r"(?<=\S) (?=\S)").split
LIGHT = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
SCHEMA = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, counted binary"
_aligners: dict = {}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at `starts` and have `sizes` places, one run after the other."""
    shift = starts - _ends(sizes)[:-1]
    return np.arange(int(sizes.sum())) + np.repeat(shift, sizes)


def _gallop(needles: np.ndarray, long: np.ndarray, lo: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each needle the first place in [lo, stop) of `long`, which rises there, that is no less: steps of doubled length, then halves of the last step."""
    lo, high = lo.copy(), lo.copy()
    step, open_ = 1, np.arange(len(needles))
    while len(open_):
        at = np.minimum(high[open_], stop[open_])
        less = (at < stop[open_]) & (long[np.minimum(at, len(long) - 1)] < needles[open_])
        high[open_] = at
        open_ = open_[less]
        lo[open_] = high[open_] + 1
        high[open_] += step
        step *= 2
    high = np.minimum(high, stop)
    open_ = np.flatnonzero(lo < high)
    while len(open_):
        mid = (lo[open_] + high[open_]) // 2
        less = long[mid] < needles[open_]
        lo[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < high[open_]]
    return lo


def ranks(short: np.ndarray, short_at: np.ndarray, long: np.ndarray, long_at: np.ndarray) -> np.ndarray:
    """For each end of the lists `short` (one after the other, `short_at` has where each begins and the last one's end) the first place in
    its list of `long` that is no less. An end gallops on from where an end before it was found: the first of a list from the list's
    begin, the others level by level, all lists at once."""
    sizes = np.diff(short_at)
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(short)) - short_at[:-1][of]
    found, stop = np.zeros(len(short), np.int64), long_at[1:][of]
    heads = np.flatnonzero(place == 0)
    found[heads] = _gallop(short[heads], long, long_at[:-1][of[heads]], stop[heads])
    step = 1 << int(sizes.max(initial=1) - 1).bit_length()
    while step:
        own = np.flatnonzero(place % (2 * step) == step)
        found[own] = _gallop(short[own], long, found[own - step], stop[own])
        step //= 2
    return found


def align(ends_a: np.ndarray, at_a: np.ndarray, ends_b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cut_a, cut_b, link_a, link_b): places of the tokens that end together, and of those whose ranges overlap, in order of A, then B.

    Lists of token ends come one after the other (`at_`: where each begins, and the last one's end); both lists of a pair end together.
    """
    cuts, links = [], []
    a_leads = np.diff(at_a) <= np.diff(at_b)
    for leads, short, short_at, long, long_at, turned in ((a_leads, ends_a, at_a, ends_b, at_b, False), (~a_leads, ends_b, at_b, ends_a, at_a, True)):
        sizes = np.diff(short_at)[leads]
        own = _spread(short_at[:-1][leads], sizes)
        if not len(own):
            continue
        own_at = _ends(sizes)
        # the lists of this turn by themselves; their partners keep their places
        long_sizes = np.diff(long_at)[leads]
        partner = _spread(long_at[:-1][leads], long_sizes)
        rank = ranks(short[own], own_at, long[partner], _ends(long_sizes))
        common = long[partner[rank]] == short[own]
        first = np.r_[0, (rank + common)[:-1]]
        first[own_at[:-1][sizes > 0]] = _ends(long_sizes)[:-1][sizes > 0]
        n = rank - first + 1
        pair = (np.repeat(own, n), partner[_spread(first, n)])
        cut = (own[common], partner[rank[common]])
        cuts.append(cut[::-1] if turned else cut)
        links.append(pair[::-1] if turned else pair)
    if not cuts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    (cut_a, cut_b), (link_a, link_b) = (tuple(np.concatenate(x) for x in zip(*all_, strict=True)) for all_ in (cuts, links))
    by_cut, by_link = np.argsort(cut_a), np.lexsort((link_b, link_a))
    return cut_a[by_cut], cut_b[by_cut], link_a[by_link], link_b[by_link]


def _byte_signs() -> dict[str, int]:
    """The byte of each sign of a byte-level vocabulary: printable bytes stand for themselves, the others for signs from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers' ids of whole texts, and their alignment. Neither tokenizer joins signs across a space between two signs that are no
    white space, so texts are parted there, and each distinct part is encoded and aligned once.

    A vocabulary of another kind, of which that is not known, gets whole texts. A part needs memory by its length.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        told, signs = json.loads(self.a.to_str()), _byte_signs()
        added = {t["id"]: t["content"] for t in told["added_tokens"]}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [added[i].encode() if i in added else bytes(signs[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        b, n = self.b, self.b.get_piece_size()
        pieces = [b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        before = told["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told["normalizer"]
        self.parted = byte_level and not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in all_], np.int64) for all_ in (self.bytes_a, self.bytes_b))
        self.wide = max(len(self.bytes_a), n) > 65_536
        self.kind, self.shift = (np.dtype("<u8"), 32) if self.wide else (np.dtype("<u4"), 16)
        ids = [b"%d" % i for i in range(max(len(self.bytes_a), n))]
        self.signs = [x + sign for sign in (b",", b"|", b";") for x in ids]  # an id inside a list, at the end of A's, at the end of B's
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers, self.pairs, self.told = [], [], []

    def _exact(self, parts: list[bytes], ids: np.ndarray, at: np.ndarray, size: np.ndarray, tokens: list[bytes]) -> np.ndarray:
        """Which parts their tokens' bytes give back."""
        got = list(map(tokens.__getitem__, ids.tolist()))
        long_as = np.add.reduceat(np.r_[size[ids], 0], at[:-1]) * (np.diff(at) > 0) == [len(p) for p in parts]
        if long_as.all() and b"".join(got) == b"".join(parts):
            return long_as
        return np.array([b"".join(got[i:j]) == p for i, j, p in zip(at[:-1].tolist(), at[1:].tolist(), parts, strict=True)])

    def _learn(self, new: list[str]) -> None:
        """Numbers (A tokens, B tokens, groups, links, whether exact), linked id pairs and the text of the groups of each new part."""
        spaced = [" " + p for p in new]
        lists_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        lists_b = self.b.encode(new, num_threads=1)  # which puts the space before each by itself
        (ids_a, at_a), (ids_b, at_b) = ((np.array([i for x in all_ for i in x], np.int64), _ends(np.array([len(x) for x in all_], np.int64))) for all_ in (lists_a, lists_b))
        data = [p.encode() for p in spaced]
        good = self._exact(data, ids_a, at_a, self.size_a, self.bytes_a) & self._exact(data, ids_b, at_b, self.size_b, self.bytes_b)
        if not good.all():  # parts that do not come back have no tokens
            keep_a, keep_b = (np.repeat(good, np.diff(at)) for at in (at_a, at_b))
            ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
            at_a, at_b = (_ends(np.diff(at) * good) for at in (at_a, at_b))
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])  # both run on alike from part to part
        cut_a, cut_b, link_a, link_b = align(ends_a, at_a, ends_b, at_b)
        owner_a = np.repeat(np.arange(len(new)), n_a)
        groups, links = (np.bincount(owner_a[x], minlength=len(new)) for x in (cut_a, link_a))
        pairs = (ids_a[link_a].astype(self.kind) << self.kind.type(self.shift)) | ids_b[link_b].astype(self.kind)
        # a group's A tokens, then its B tokens, each with the sign behind it
        group_a, group_b = (np.searchsorted(cut, np.arange(len(ids))) for cut, ids in ((cut_a, ids_a), (cut_b, ids_b)))
        n = len(self.signs) // 3
        sign_a, sign_b = ids_a.copy(), ids_b.copy()
        sign_a[cut_a] += n
        sign_b[cut_b] += 2 * n
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        texts = list(map(self.signs.__getitem__, np.concatenate([sign_a, sign_b])[order].tolist()))
        first = len(self.told)
        stops = _ends(n_a + n_b).tolist()
        self.told += [b"".join(texts[i:j]) for i, j in zip(stops, stops[1:], strict=False)]
        self.numbers.append(np.stack([n_a, n_b, groups, links, good.astype(np.int64)], axis=1))
        self.pairs.append(pairs)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def parts(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct parts, which of them each part of the texts is, where each text's parts begin and the last one's end). An empty text has none."""
        texts = texts.fill_null("")
        if not self.parted:
            lists = pa.array([[t] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(texts, " ")
            if odd.any():
                lists = pa.array([BETWEEN(t) if o else x for t, o, x in zip(texts.to_pylist(), odd.tolist(), lists.to_pylist(), strict=True)], pa.list_(pa.string()))
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        at, starts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts - starts[0]
        empty = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)  # split gives one empty part
        full = np.ones(len(at), bool)
        full[starts[empty][np.diff(starts)[empty] > 0]] = False
        return coded.dictionary.to_pylist(), at[full], np.r_[0, np.cumsum(full)][starts]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, hashes, text, pair, times): for each text its A tokens, B tokens, groups and links, and the SHA-256 of its groups; for
        each text and distinct linked pair, in order, how often the text holds it."""
        names, at, starts = self.parts(texts)
        if len(self.known) > REMEMBERED:
            self._forget()
        used = np.unique(at)
        if new := [names[i] for i in used.tolist() if names[i] not in self.known]:
            self._learn(new)
        if len(self.numbers) > 1:
            self.numbers, self.pairs = [np.concatenate(self.numbers)], [np.concatenate(self.pairs)]
        number = self.numbers[0] if self.numbers else np.zeros((0, 5), np.int64)
        of = np.zeros(len(names), np.int64)
        of[used] = [self.known[names[i]] for i in used.tolist()]
        part = of[at]
        n = len(starts) - 1
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(number[part], axis=0)])
        total = sums[starts[1:]] - sums[starts[:-1]]
        good = (total[:, 4] == np.diff(starts)) & (np.diff(starts) > 0)
        told = list(map(self.told.__getitem__, part.tolist()))
        hashes = [hashlib.sha256(b"".join(told[i:j])[:-1]).hexdigest() if g else "" for i, j, g in zip(starts[:-1].tolist(), starts[1:].tolist(), good.tolist(), strict=True)]
        # each text's distinct parts, then their pairs
        owner = np.repeat(np.arange(n), np.diff(starts))
        keep = good[owner]
        both, times = np.unique(owner[keep] * (len(number) + 1) + part[keep], return_counts=True)
        owner, part = both // (len(number) + 1), both % (len(number) + 1)
        links = number[:, 3]
        size = links[part]
        pair = self.pairs[0][_spread(_ends(links)[:-1][part], size)] if len(part) else np.zeros(0, self.kind)
        owner, times = np.repeat(owner, size), np.repeat(times, size)
        order = np.lexsort((pair, owner)) if self.wide else np.argsort((owner.astype(np.uint64) << np.uint64(32)) | pair)
        owner, pair, times = owner[order], pair[order], times[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])][: len(owner)])
        return total[:, :4] * good[:, None], hashes, owner[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rid = aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        seen, held = [], 0

        def counts() -> pa.RecordBatch:
            keys, place = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n for _, n in seen]), len(keys)).astype("<i8")
            values = [pa.nulls(1, pa.int64())] * 6 + [pa.nulls(1, pa.string()), pa.array([keys.astype("<i8").tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([n.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(values, [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for sub in _blocks(batch, 1, BLOCK):
                n = sub.num_rows
                numbers, hashes, owner, pair, times = own(sub.column(1))
                at = np.searchsorted(owner, np.arange(n + 1))
                values = [pa.array(np.arange(rid, rid + n)), sub.column(0), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(hashes, pa.string())]
                values += [_binary(at * x.itemsize, x.view(np.uint8)).cast(pa.binary()) for x in (pair, times.astype("<u4"))]
                rid += n
                yield pa.RecordBatch.from_arrays([*values, pa.nulls(n, pa.binary())], [x.split()[0] for x in SCHEMA.split(", ")])
                seen.append(np.unique(pair, return_counts=True))
                held += len(seen[-1][0])
                if held > TOLD:
                    yield counts()
                    seen, held = [], 0
        if held:
            yield counts()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, n in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), "<i8")) for x in (keys, n)], ["pair", "n"])


def _scored(shared, kind: np.dtype):
    """Each row's links among the pairs of one slice: how many have the highest count of their A id, and the sum of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shared.value
        for batch in batches:
            for sub in _blocks(batch, len(LIGHT), BLOCK):
                pair, times = (np.frombuffer(b"".join(sub.column(len(LIGHT) + k).to_pylist()), x) for k, x in ((0, kind), (1, np.dtype("<u4"))))
                sizes = pc.binary_length(sub.column(len(LIGHT))).to_numpy().astype(np.int64) // kind.itemsize
                owner, times = np.repeat(np.arange(sub.num_rows), sizes), times.astype(np.int64)
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                times = times * (keys[at] == pair)  # pairs of other slices
                sums = [np.zeros(sub.num_rows, np.int64) for _ in range(2)]
                for total, value in zip(sums, (times * best[at], times * count[at]), strict=True):
                    np.add.at(total, owner, value)
                yield pa.RecordBatch.from_arrays([*(sub.column(k) for k in range(len(LIGHT))), *map(pa.array, sums)], [*LIGHT, "n_best", "count_sum"])

    return run


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each linked pair of ids, from what the tasks counted."""
    return rows.where("counted is not null").select("pairs", "counted").mapInArrow(_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None, slice_: int = SLICE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of `docs` (doc_id, text).

    Both tokenizers encode a space and the text. A text that is null or empty, or that one of them does not give back byte for byte (such
    as one that holds U+2581), has no tokens: zeros, and '' as hash. Each row counts as one document, rows of one or of no doc_id too. An
    empty table gives none. Other columns are not read.

    Each text is encoded once; its distinct linked pairs are staged with it. Counts of pairs are summed within tasks before they meet. They
    go back to the rows in slices of A ids with about `slice_` pairs each, one broadcast at a time: a vocabulary of any size, and a table
    of any number of pairs, takes no more memory than a slice.
    """
    spark = docs.sparkSession
    path_a, path_b = vocabulary_a or public_tokenizers.path(A_VOCABULARY), vocabulary_b or public_tokenizers.path(B_VOCABULARY)
    own = aligner(path_a, path_b)
    rows = staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_aligned(path_a, path_b), SCHEMA), "aligned")
    counts = staged(pair_counts(rows), "pair_counts")
    id_a = F.shiftrightunsigned("pair", own.shift)
    sizes = counts.groupBy(id_a.alias("a")).count().orderBy("a").collect()  # at most as many as A has ids
    cuts, total = [], 0
    for r in sizes:
        if not cuts or total + r["count"] > slice_:
            cuts.append(r["a"])
            total = 0
        total += r["count"]
    rows = rows.where("counted is null").select(*LIGHT, "pairs", "times")
    parts = []
    for lo, hi in zip(cuts or [0], [*cuts[1:], None], strict=True):
        found = counts.where((id_a >= lo) if hi is None else (id_a >= lo) & (id_a < hi)).toArrow()
        pair, n = (found.column(k).to_numpy().astype(x) for k, x in ((0, own.kind), (1, np.int64)))
        order = np.argsort(pair)
        pair, n = np.r_[pair[order], own.kind.type(0)][: max(1, len(pair))], np.r_[n[order], 0][: max(1, len(n))]
        heads = np.flatnonzero(np.r_[True, (pair[1:] >> own.kind.type(own.shift)) != (pair[:-1] >> own.kind.type(own.shift))])
        best = n == np.repeat(np.maximum.reduceat(n, heads), np.diff(np.r_[heads, len(n)]))
        schema = SCHEMA[: SCHEMA.index(", pairs")] + ", n_best long, count_sum long"
        parts.append(rows.mapInArrow(_scored(spark.sparkContext.broadcast((pair, n, best)), own.kind), schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if len(parts) > 1:
        out = out.groupBy(*LIGHT).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
