"""Spelling variants: FM-index search schemes over a delimited vocabulary, one half exact and one error in the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import drop_staged, salted_join, small, staged, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Rows, four a word, that share one index; a half of more words has its words dealt out over several.
SHARD = 40_000


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur `least` or more times in all whole texts.

    A run of letters is lowered in A-Z. Let h be the CRC-32 of `<doc_id>:<run>`; if `every` divides h, the run loses its code point
    h % length. A row without a doc_id keeps its runs as they are; a null text has none. Rows of one doc_id count apart.
    """
    lowered = F.translate(text_or_empty(), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h")).where(F.length("run") >= shortest)
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = runs.withColumn("at", at).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of the rotations of `text`, none of which are equal: ranks by some first signs, then by twice as many each round."""
    n, bits = len(text), max(1, int(text.max(initial=0)).bit_length())
    width = 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | np.roll(text, -k)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.r_[False, ordered[1:] != ordered[:-1]]
        if n == 1 or new.sum() == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * n + np.roll(rank, -width)
        width *= 2


class Index:
    """FM-index of words in ascending order, each behind a delimiter of code 0: the suffixes that begin with a delimiter come first and in the order of
    the words, so an interval of them is an interval of words. Ranks of a sign are a count for each 64 places and a bit for each place."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, signs: int):
        k = len(sizes)
        text = np.zeros(len(codes) + k, np.int64)
        inside = np.ones(len(text), bool)
        inside[np.r_[0, np.cumsum(sizes + 1)[:-1]]] = False
        text[inside] = codes
        self.words, n = k, len(text)
        self.last = text[suffix_order(text) - 1].astype(np.min_scalar_type(signs))  # the sign before each suffix
        self.signs = signs
        self.begin = np.r_[0, np.cumsum(np.bincount(text, minlength=signs + 1))]
        blocks = n // 64 + 1
        self.bits = np.zeros((signs + 1, blocks), np.uint64)
        for c in range(signs + 1):
            packed = np.packbits(self.last == c, bitorder="little")
            self.bits[c].view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros((signs + 1, blocks), np.int64)
        self.before[:, 1:] = np.cumsum(np.bitwise_count(self.bits), axis=1)[:, :-1]

    def _rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[c, block] + np.bitwise_count(self.bits[c, block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def extended(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with c and go on with those of [lo, hi)."""
        return self.begin[c] + self._rank(c, lo), self.begin[c] + self._rank(c, hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, c): each sign, but the delimiter, that stands before a suffix of interval i. Narrow intervals are read, wide ones try every sign."""
        wide = hi - lo > self.signs
        own = np.flatnonzero(wide)
        i, c = np.repeat(own, self.signs), np.tile(np.arange(1, self.signs + 1), len(own))
        own = np.flatnonzero(~wide)
        size = (hi - lo)[own]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[own], size)
        both = np.unique(np.repeat(own, size) * (self.signs + 1) + self.last[place])
        both = both[both % (self.signs + 1) > 0]
        return np.concatenate([i, both // (self.signs + 1)]), np.concatenate([c, both % (self.signs + 1)])


def one_error(index: Index, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) pairs, each once: words of the index that have the last `exact` signs of a query and differ from it by one sign before these.

    Queries lie in `codes`. All go on together, backwards, a sign a round: states without an error (query, signs left, interval) branch
    into those with one, which may then only match; a state that has no sign left ends with the delimiter before the word.
    """
    q = np.arange(len(sizes))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.words)
    for k in range(1, int(exact.max(initial=0)) + 1):
        go = exact[q] >= k
        a, b = index.extended(codes[starts[q[go]] + sizes[q[go]] - k], lo[go], hi[go])
        lo[go], hi[go] = a, b
        keep = lo < hi
        q, lo, hi = q[keep], lo[keep], hi[keep]
    state = q, sizes[q] - exact[q], lo, hi
    wrong = tuple(np.zeros(0, np.int64) for _ in range(4))
    found = []
    while len(state[0]) or len(wrong[0]):
        # states with an error: at the end of the query the word has to begin, else the next sign has to match
        q, left, lo, hi = wrong
        a, b = index.extended(np.where(left > 0, codes[starts[q] + np.maximum(left, 1) - 1], 0), lo, hi)
        ended = (left == 0) & (a < b)
        found.append(q[ended] * index.words + a[ended])
        keep = (left > 0) & (a < b)
        moved = [(q[keep], left[keep] - 1, a[keep], b[keep])]
        # states without: a sign of the word too many, another one, or one too few
        q, left, lo, hi = state
        i, c = index.branches(lo, hi)
        a, b = index.extended(c, lo[i], hi[i])
        keep = a < b
        i, c, a, b = i[keep], c[keep], a[keep], b[keep]
        moved.append((q[i], left[i], a, b))
        next_ = codes[starts[q] + np.maximum(left, 1) - 1]
        other = (left[i] > 0) & (c != next_[i])
        moved.append((q[i][other], left[i][other] - 1, a[other], b[other]))
        more = left > 0
        moved.append((q[more], left[more] - 1, lo[more], hi[more]))
        a, b = index.extended(next_[more], lo[more], hi[more])
        keep = a < b
        state = q[more][keep], left[more][keep] - 1, a[keep], b[keep]
        wrong = tuple(np.concatenate(x) for x in zip(*moved, strict=True))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // max(1, index.words), both % max(1, index.words)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), sizes


def near_in_group(words: list[str], n: np.ndarray, is_text: np.ndarray, is_query: np.ndarray, front: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, near): places in `words`, which are distinct and ascending, of the pairs that one error parts, the query's first half (`front`) or second half being the same in both.

    Pairs whose first halves agree are left to the search by first halves. The index by first halves holds the words backwards.
    """
    turned = [w[::-1] for w in words] if front else words
    points, sizes = _codes(turned)
    signs, codes = np.unique(points, return_inverse=True)
    codes, starts = codes.astype(np.int64) + 1, np.cumsum(sizes) - sizes
    texts, queries = np.flatnonzero(is_text), np.flatnonzero(is_query)
    if front:
        texts = np.array(sorted(texts.tolist(), key=turned.__getitem__), np.int64)
    if not len(texts) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(own):
        size = sizes[own]
        return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[own], size)

    index = Index(codes[of(texts)], sizes[texts], len(signs))
    half = sizes[queries] // 2
    q, found = one_error(index, codes, starts[queries], sizes[queries], half if front else sizes[queries] - half)
    a, b = queries[q], texts[found]
    if not front and len(a):
        size = sizes[a] // 2
        pair, place = np.repeat(np.arange(len(a)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        apart = codes[starts[a][pair] + place] != codes[starts[b][pair] + place]
        keep = np.bincount(pair[apart], minlength=len(a)) > 0
        a, b = a[keep], b[keep]
    return a, b


def _search(key: tuple, group: pa.Table) -> pa.Table:
    """(word, n_near, best) of each query of a shard that has near words there: how many, and the one of largest n, ties by code point."""
    front = key[0].as_py() % 2 == 0
    group = group.group_by("word").aggregate([("n", "max"), ("is_text", "max"), ("is_query", "max")]).sort_by("word")
    words, n = group["word"].to_pylist(), group["n_max"].to_numpy()
    a, b = near_in_group(words, n, group["is_text_max"].to_numpy(), group["is_query_max"].to_numpy(), front)
    order = np.lexsort((b, -n[b], a))  # words ascend by code point, and so do their places
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    count = np.diff(np.r_[first, len(a)])
    own = group["word"].combine_chunks()
    return pa.table({"word": own.take(pa.array(a[first])), "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n[b[first]], pa.int64()), "best": own.take(pa.array(b[first]))})


def _shards(words: DataFrame, shard: int) -> DataFrame:
    """(g, word, n, is_text, is_query): each word in the shards of its halves, as a query and as a text, and in those of the halves of words one code point longer or shorter, as a text.

    A shard is a group of halves by hash; even ones hold first halves. A half of over `shard` words has shards of its own: its words are
    dealt out over them as texts, and each is a query in all of them. There are fewer such halves than 4 * words / `shard`.
    """
    size = F.length("word")
    cuts = [F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)]
    firsts, seconds = ([F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)], [F.ceil((size + d) / 2).cast("int") for d in (-1, 0, 1)])
    word = F.col("word")
    halves = [(0, word.substr(F.lit(1), k), k == firsts[1]) for k in firsts] + [(1, word.substr(size - k + 1, k), k == seconds[1]) for k in seconds]
    keys = F.array_distinct(F.array(*[F.struct(F.lit(side).alias("side"), half.alias("half"), own.alias("is_query")) for side, half, own in halves]))
    rows = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*")
    hot = small(rows.groupBy("side", "half").count().where(F.col("count") > shard).select("side", "half", F.ceil(F.col("count") / shard).cast("int").alias("parts")))
    groups = F.lit(max(1, -(-words.count() * 4 // shard)))
    rows = rows.join(hot, ["side", "half"], "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    plain = F.pmod(F.xxhash64("half"), groups)
    everywhere = F.when(F.col("is_query"), F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array("part"))
    rows = rows.withColumn("at", F.explode(everywhere))
    own = F.xxhash64("half", "at").bitwiseOR(F.lit(1 << 62))
    g = F.shiftleft(F.when(F.col("parts").isNull(), plain).otherwise(own), 1).bitwiseOR(F.col("side").cast("long"))
    return rows.select(g.alias("g"), "word", "n", (F.col("at") == F.col("part")).alias("is_text"), "is_query")


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, best_n, best) for each row of `words` (word, n; words distinct and not null): how many words one inserted, deleted or replaced code point makes of it, and
    the one of largest n among them, of equal ones the smallest in code-point order; null where there is none. An empty table gives none.

    If one error parts two words, the first or the second half of the one is an end of the other as it stands. So words meet in shards by
    halves, and each shard is searched through an FM-index of its own: from one end over the exact half, then over the other with one error.
    """
    found = _shards(words, shard).groupBy("g").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    none = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    both = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best").unionByName(words.select("word", F.col("n").cast("long").alias("n"), *none))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of `forms` (word, form), where forms make no circles: each pointer becomes its target's pointer, twice as far each round, until all point to roots."""
    now = staged(forms.select("word", F.col("form").alias("to")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        step = staged(salted_join(now, ahead, "to", F.col("word")).select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        drop_staged(now)
        now = step
        if not step.where("moved").limit(1).count():
            return step.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `vocabulary(docs)`.

    A word's form is the near word of largest n (ties: the smallest in code-point order) if that n is at least twice the word's; else null.
    Its root is where its form's form's form and so on ends, itself if it has none. Null texts have no words; an empty table gives none.
    """
    words = staged(vocabulary(docs, shortest, least, every), "vocabulary")
    return grouped(words, shard)


def grouped(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """The same of any vocabulary (word, n), words distinct and not null."""
    has = F.col("best_n") >= 2 * F.col("n")
    near = staged(near_words(words, shard).select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n")), "near_words")
    roots = _roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL of `variants` over `documents`: CRC-32 byte by byte from its polynomial; near words by what is left of them without one code point.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n, hex(concat(doc_id, ':', run)) AS data FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(data), 2), lambda i: ('0x' || data[i : i + 1])::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc_table
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cut AS (
  SELECT word, n, pos, word[1 : pos - 1] || word[pos + 1 :] AS rest FROM words, unnest(range(1, length(word) + 1)) r(pos)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.rest
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT k.word, k.root FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
