"""Pairs of alike titles of two tiles of a block, in numpy: bounds first, the sequence ratio of what is left."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Letters of the count bound, and signs of the sequence bound: others share one with a letter, which only loosens a bound.
LETTERS, SIGNS = 32, 128
#: Pairs of a block whose letters are compared at once, a few rows by many, and pairs that go through the sequence bound at once.
BLOCK, CHUNK = (8, 4_096), 8_192
#: Places of the sequence bound after which pairs that cannot reach it any more are left, and so on.
STEP = 8
#: Places of a key at which the halves of a pair may part, taken at once.
CELL = 4


class Titles:
    """Keys as sign codes, letter counts and, for each sign, the bits of the places where it stands."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        points = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(keys)), self.sizes)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.counts = np.bincount(row * LETTERS + points % LETTERS, minlength=len(keys) * LETTERS).reshape(-1, LETTERS)
        width = int(self.sizes.max(initial=1))
        self.letters = np.zeros((len(keys), width), np.uint8)
        self.letters[row, place] = points % LETTERS
        self.codes = np.full((len(keys), width), SIGNS, np.uint8)  # one code more, which stands nowhere
        self.codes[row, place] = points % SIGNS
        self.bits = np.zeros(((width + 63) // 64, len(keys) * (SIGNS + 1)), np.uint64)
        for p in range(width):
            own = np.flatnonzero(self.sizes > p)
            self.bits[p // 64, own * (SIGNS + 1) + self.codes[own, p]] |= np.uint64(1) << np.uint64(p % 64)


def _bits(shares: np.ndarray, most: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(letter, count) of each bit of letter counts in unary, up to `most`: bits that part most of the keys come first. shares[l, k - 1]: keys with k letters l at least, of n."""
    letter = np.repeat(np.arange(LETTERS), most)
    level = np.arange(len(letter)) - np.repeat(np.cumsum(most) - most, most) + 1
    order = np.argsort(np.abs(shares[letter, level - 1] / n - 0.5), kind="stable")
    return letter[order], level[order]


def _packed(counts: np.ndarray, letter: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The word of up to 64 such bits of each row of counts."""
    has = np.zeros((len(counts), 64), bool)
    has[:, : len(letter)] = counts[:, letter] >= level
    return np.packbits(has, axis=1).view(np.uint64)[:, 0]


def _shares(tiles: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    out = np.zeros((LETTERS, max(1, int(most.max(initial=0)))), np.int64)
    for counts in tiles:
        for x in range(LETTERS):
            has = np.bincount(counts[:, x], minlength=int(most[x]) + 1)
            out[x, : most[x]] += len(counts) - np.cumsum(has)[: most[x]]
    return out


def _signatures(a: Titles, b: Titles) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Letter counts in unary, as words of 64 bits. Two keys' words differ in as many bits as signs are not common."""
    tiles = [a] if a is b else [a, b]
    most = np.max([t.counts.max(axis=0, initial=0) for t in tiles], axis=0).astype(np.int64)
    letter, level = _bits(_shares([t.counts for t in tiles], most), most, sum(len(t.keys) for t in tiles))
    words = [[_packed(t.counts, letter[at : at + 64], level[at : at + 64]) for at in range(0, len(letter), 64)] for t in tiles]
    return words[0], words[-1]


def _slack(a: Titles, b: Titles, least: float) -> np.ndarray:
    """By the sum of two lengths: how many signs of both may not be common."""
    both = np.arange(int(a.sizes.max(initial=0) + b.sizes.max(initial=0)) + 1)
    return both - 2 * np.ceil(both * (least / 2) - 1e-9).astype(np.int64)


class _Halves:
    """The first half of each key of `a` against beginnings of those of `b`, the second half against their ends.

    A common subsequence parts both keys: what it has in a's first half lies before some place of b, the rest behind. That place is not
    known, but lies near the middle, as few signs may be missed; places are taken CELL at a time. The letters of each half are a word of 64 bits in unary, the bits that tell most.
    """

    def __init__(self, a: Titles, b: Titles):
        self.sizes, cells = b.sizes, b.codes.shape[1] // CELL + 1
        halves = _counts(a, np.zeros(len(a.keys), np.int64), a.sizes // 2), _counts(a, a.sizes // 2, a.sizes)
        bits = []
        for counts in halves:
            most = counts.max(axis=0, initial=0).astype(np.int64)
            bits.append([x[:64] for x in _bits(_shares([counts], most), most, max(1, len(a.keys)))])
        self.left = [_packed(counts, *own) for counts, own in zip(halves, bits, strict=True)]
        before = np.zeros_like(b.counts)
        self.begins, self.ends = [], []
        for cell in range(cells):
            start, last, stop = (np.minimum(b.sizes, cell * CELL + x) for x in (0, CELL - 1, CELL))
            self.ends.append(_packed(b.counts - before, *bits[1]))
            before = before + _counts(b, start, last)
            self.begins.append(_packed(before, *bits[0]))
            before = before + _counts(b, last, stop)

    def fits(self, size: int, i: np.ndarray, j: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Which pairs may be alike; all keys of `i` have the length `size`, and of a pair `slack` signs may be missed."""
        longer = self.sizes[j] - size
        low, high = size // 2 - int((slack - longer).max()) // 2, size // 2 + int((slack + longer).max()) // 2
        own = [x[i] for x in self.left]
        least = None
        for cell in range(max(0, low) // CELL, min(len(self.begins) - 1, high // CELL) + 1):
            off = np.bitwise_count(self.begins[cell].take(j) ^ own[0])
            off += np.bitwise_count(self.ends[cell].take(j) ^ own[1])
            least = off if least is None else np.minimum(least, off, out=least)
        return least <= slack + (CELL - 1)


def _counts(t: Titles, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Letters of each key from one place to before another."""
    long = np.maximum(stop - start, 0)
    row = np.repeat(np.arange(len(t.keys)), long)
    place = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long) + np.repeat(start, long)
    return np.bincount(row * LETTERS + t.letters[row, place], minlength=len(t.keys) * LETTERS).reshape(-1, LETTERS)


def _letter_pairs(a: Titles, b: Titles, least: float, halves: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs within the bound of common letters, and with `halves` within that of their halves, some at a time; of a pair within one tile (`b` is `a`) either (i, j) or (j, i) alone.

    Keys go by length, so that a block of rows has one length and meets those of fitting lengths only. Two words of all pairs are compared,
    the others of what these leave.
    """
    if not a.keys or not b.keys:
        return
    slack = _slack(a, b, least)
    ours, theirs = np.argsort(a.sizes, kind="stable"), np.argsort(b.sizes, kind="stable")
    left, right = _signatures(a, b)
    if not left:
        return
    halved = _Halves(a, b) if halves else None
    first, second = [x[ours] for x in left[:2]], [x[theirs] for x in right[:2]]
    sizes, widths = a.sizes[ours], b.sizes[theirs]
    differ, count, more = np.empty(BLOCK[0] * BLOCK[1], np.uint64), np.empty(BLOCK[0] * BLOCK[1], np.uint8), np.empty(BLOCK[0] * BLOCK[1], np.uint8)
    starts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]).tolist()
    for start, stop in zip(starts, [*starts[1:], len(sizes)], strict=True):
        size = int(sizes[start])
        fits = np.flatnonzero(np.abs(widths - size) <= slack[size + widths])
        if not len(fits):
            continue
        limit = np.clip(slack[size + widths], 0, 128).astype(np.uint8)
        low, high = int(fits[0]), int(fits[-1]) + 1
        kept, n = [], 0
        for at in range(max(low, start) if b is a else low, high, BLOCK[1]):
            wide = min(BLOCK[1], high - at)
            for row in range(start, min(stop, at + wide) if b is a else stop, BLOCK[0]):
                rows = min(BLOCK[0], stop - row)
                d, c, m = (x[: rows * wide].reshape(rows, wide) for x in (differ, count, more))
                np.bitwise_xor(first[0][row : row + rows, None], second[0][at : at + wide], out=d)
                np.bitwise_count(d, out=c)
                if len(first) > 1:
                    np.bitwise_xor(first[1][row : row + rows, None], second[1][at : at + wide], out=d)
                    np.bitwise_count(d, out=m)
                    c += m
                found = np.flatnonzero(c <= limit[at : at + wide])
                i, j = found // wide, found % wide
                i += row
                j += at
                if b is a:
                    later = i < j
                    i, j = i[later], j[later]
                kept.append((i, j))
                n += len(i)
                if n >= CHUNK:
                    yield _checked(a, b, *_joined(kept), ours, theirs, left, right, slack, halved)
                    kept, n = [], 0
        if n:
            yield _checked(a, b, *_joined(kept), ours, theirs, left, right, slack, halved)


def _checked(a: Titles, b: Titles, i: np.ndarray, j: np.ndarray, ours: np.ndarray, theirs: np.ndarray, left: list, right: list, slack: np.ndarray, halved: _Halves | None) -> tuple[np.ndarray, np.ndarray]:
    """What the other words, and the halves, leave of the pairs of keys of `a` of one length."""
    i, j = ours[i], theirs[j]
    size = int(a.sizes[i[0]])
    free = slack[size + b.sizes[j]]
    if len(left) > 2 and not halved:
        off = np.zeros(len(i), np.int64)
        for x, y in zip(left, right, strict=True):
            off += np.bitwise_count(x[i] ^ y[j])
        kept = off <= free
        i, j, free = i[kept], j[kept], free[kept]
    if halved and len(i):
        kept = halved.fits(size, i, j, free)
        i, j = i[kept], j[kept]
    return i, j


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def by_letters(a: Titles, b: Titles, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs whose common letters, counted as often as both have them, reach `least` / 2 of both lengths' sum; within one tile (`b` is `a`) in both orders, and each key with itself."""
    found = list(_letter_pairs(a, b, least))
    i, j = _joined(found) if found else (np.zeros(0, np.int64),) * 2
    if b is a:
        own = np.arange(len(a.keys))
        i, j = np.concatenate([i, j, own]), np.concatenate([j, i, own])
    return i, j


def by_sequence(a: Titles, i: np.ndarray, b: Titles, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs whose longest common subsequence reaches `least` / 2 of both lengths' sum: 64 places of one side at a time as the bits of a word (Hyyrö, 2004).

    Every few places of the other side, pairs that cannot reach it with all that is left are dropped.
    """
    need = np.ceil((a.sizes[i] + b.sizes[j]) * (least / 2) - 1e-9).astype(np.int64)
    width = int(b.sizes[j].max(initial=0))
    codes = np.ascontiguousarray(b.codes[:, :width].take(j, axis=0).T)
    base, after = i * (SIGNS + 1), b.sizes[j]
    rest = [np.full(len(i), np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in a.bits]
    for p in range(width):
        if p >= 2 * STEP and p % STEP == 0:
            found = sum(np.bitwise_count(~x).astype(np.int64) for x in rest)
            kept = np.flatnonzero(found + np.maximum(after - p, 0) >= need)
            if len(kept) < 0.8 * len(i):
                i, j, need, base, after, codes = i[kept], j[kept], need[kept], base[kept], after[kept], codes.take(kept, axis=1)
                rest = [x[kept] for x in rest]
                if not len(i):
                    break
        at, carry = base + codes[p], None
        for w, open_ in enumerate(rest):
            same = a.bits[w].take(at)
            same &= open_
            total = open_ + same
            if w + 1 < len(rest) or carry is not None:
                over = total < same
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            open_ ^= same  # the places without a match
            open_ |= total
    found = sum(np.bitwise_count(~x).astype(np.int64) for x in rest)
    kept = np.flatnonzero(found >= need)
    return i[kept], j[kept]


def near(a: Titles, b: Titles, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs that both bounds leave, some at a time.

    Matching blocks hold common letters in their order, so a pair below the bound of common letters, or of the longest common subsequence,
    cannot reach the ratio.
    """
    kept, n = [], 0
    for found in _letter_pairs(a, b, least, halves=True):
        kept.append(found)
        n += len(found[0])
        if n >= CHUNK:
            i, j = _joined(kept)
            yield by_sequence(a, i, b, j, least)
            kept, n = [], 0
    if n:
        i, j = _joined(kept)
        yield by_sequence(a, i, b, j, least)


def _tiles(left: list[str], right: list[str] | None) -> tuple[Titles, Titles]:
    a = Titles(left)
    return a, a if right is None else Titles(right)


def reaches(a: str, b: str, least: float) -> bool:
    return SequenceMatcher(None, a, b).ratio() >= least


def alike(left: list[str], right: list[str] | None, least: float) -> list[tuple[str, str, bool, bool]]:
    """(a, b, ab, ba), a < b, of the pairs of a key of `left` and one of `right` (None: of two of `left`) whose ratio reaches `least` in either order. What the bounds leave is compared as it stands."""
    a, b = _tiles(left, right)
    out = []
    for i, j in near(a, b, least):
        for s, t in zip(i.tolist(), j.tolist(), strict=True):
            p, q = sorted((a.keys[s], b.keys[t]))
            ab, ba = reaches(p, q, least), reaches(q, p, least)
            if ab or ba:
                out.append((p, q, ab, ba))
    return out


def followed(left: list[tuple[int, str]], right: list[tuple[int, str]] | None, least: float) -> Iterator[tuple[int, int]]:
    """(early, late): the places of the pairs of (place, key) whose later key, compared with the earlier one, reaches `least`."""
    a, b = _tiles([k for _, k in left], None if right is None else [k for _, k in right])
    others = left if right is None else right
    for i, j in near(a, b, least):
        for s, t in zip(i.tolist(), j.tolist(), strict=True):
            (early, first), (late, second) = sorted((left[s], others[t]))
            if reaches(second, first, least):
                yield early, late


def first_leaders(leaders: list[tuple[int, str]], rows: list[tuple[int, str]], least: float) -> dict[int, int]:
    """The place of each row that is like a leader, with that of the first such leader; pairs with a later leader than one found are not compared."""
    a, b = _tiles([k for _, k in leaders], [k for _, k in rows])
    places = np.fromiter((p for p, _ in leaders), np.int64, len(leaders))
    best = np.full(len(rows), np.iinfo(np.int64).max)
    for i, j in near(a, b, least):
        order = np.lexsort((places[i], j))
        for s, t in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if places[s] < best[t] and reaches(rows[t][1], leaders[s][1], least):
                best[t] = places[s]
    return {rows[t][0]: int(best[t]) for t in np.flatnonzero(best < np.iinfo(np.int64).max)}
