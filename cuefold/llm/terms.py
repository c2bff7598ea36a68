"""Hashed terms of whole texts, many at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes from which on a text is worked on in parts, so that memory does not go by its length.
LONG = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: 0 white space and controls, 1 letters (all bytes of other scripts), 2 digits, 3 the rest.
_CLASS = np.array([0 if b <= 32 else 2 if 48 <= b <= 57 else 1 if b >= 128 or chr(b).isalpha() else 3 for b in range(256)], np.uint8)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)], dtype=np.uint64) for x in (np.uint64(_BASE), np.uint64(_INVERSE)))
    return _powers[size]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _runs(texts: list[bytes]):
    """(text, start, end, class) of each run of one class but white space, and a function that hashes bytes from starts to ends."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[buf]
    edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    ends = np.r_[edge[1:], len(buf)]
    keep = kind[edge] > 0
    starts, ends = edge[keep], ends[keep]
    power, inverse = _tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], dtype=np.uint64)]

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[b] - sums[a]) * inverse[a]

    return np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right"), starts, ends, kind[starts], hashed


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of letters, digits or other signs, in order."""
    return shaped_tokens(texts)[:2]


def stems(texts: list[bytes], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run and of the first bytes of each longer run of letters, for each of `lengths`; a stem and a whole word never share a term on purpose."""
    owner, starts, ends, kind, hashed = _runs(texts)
    owners, out = [owner], [mixed(hashed(starts, ends))]
    for n in lengths:
        long = (ends - starts > n) & (kind == 1)
        owners.append(owner[long])
        out.append(mixed(hashed(starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(owners), np.concatenate(out)


def shaped_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with a hash of each run's shape: capital, capitals or small letters, digits, or the signs themselves; and whether it is the run one or two before over again."""
    owner, starts, ends, kinds, hashed = _runs(texts)
    hashes = mixed(hashed(starts, ends))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    upper = (buf >= 65) & (buf <= 90)
    kinds = kinds.astype(np.uint64)
    shape = kinds + np.uint64(4) * upper[starts] + np.uint64(8) * upper[np.minimum(starts + 1, ends - 1)]
    shape = np.where(kinds == 3, hashes, shape)
    for n, bit in ((1, 16), (2, 32)):
        same = np.zeros(len(hashes), bool)
        same[n:] = (hashes[n:] == hashes[:-n]) & (owner[n:] == owner[:-n])
        shape = shape ^ (np.uint64(bit) * (same & (kinds < 3)))
    return owner, hashes, mixed(shape + np.uint64(1))


def ngrams(owner: np.ndarray, hashes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the runs of 1 to `most` tokens within a text."""
    owners, out, h = [owner], [hashes], hashes
    for n in range(1, most):
        with np.errstate(over="ignore"):
            h = mixed(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[n:]) if len(h) else h
        same = owner[: len(h)] == owner[n:] if len(h) else np.zeros(0, bool)
        owners.append(owner[: len(h)][same])
        out.append(h[same])
    return np.concatenate(owners), np.concatenate(out)


def _cut(text: bytes, at: int, size: int) -> int:
    """Where a part that begins at `at` ends: at the last white space of its second half, else where the last run ends there, else after `size` bytes."""
    stop = at + size
    if stop >= len(text):
        return len(text)
    kind = _CLASS[np.frombuffer(text, np.uint8, size - size // 2, stop - (size - size // 2))]
    white = np.flatnonzero(kind == 0)
    edge = white if len(white) else np.flatnonzero(kind[1:] != kind[:-1])
    return stop - len(kind) + int(edge[-1]) + 1 if len(edge) else stop


def windows(text: bytes, back: int, size: int = LONG) -> Iterator[tuple[bytes, int]]:
    """(part, known): a long text in parts of about `size` bytes, each behind the last `back` runs before it, of which there are `known`.

    Runs are those of the whole text but for a run that fills most of a part: it counts as several.
    """
    at, before = 0, b""
    while at < len(text):
        stop = _cut(text, at, size)
        part, known = text[at:stop], 0
        if before:
            known = len(_runs([before])[1])
            part = before + b"\n" + part
        yield part, known
        starts = _runs([part])[1] if back else []
        before = part[int(starts[-min(back, len(starts))]) :] if len(starts) else b""
        at = stop


def later_ngrams(hashes: np.ndarray, most: int, known: int) -> np.ndarray:
    """The runs of 1 to `most` tokens of one text that hold a token after the first `known` ones; hashes as `ngrams` gives them."""
    out, h = [hashes[known:]], hashes
    for n in range(1, most):
        with np.errstate(over="ignore"):
            h = mixed(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[n:]) if len(h) else h
        out.append(h[max(0, known - n) :])
    return np.concatenate(out)


def slices(texts: list[str | None], lower: bool = False, size: int = LONG) -> Iterator[tuple[int, list[bytes]]]:
    """(first, texts): runs of texts of about `size` bytes together; a longer text is alone."""
    own, at, total = [], 0, 0
    for i, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "replace") if lower else (text or "").encode("utf-8", "replace")
        if own and total + len(data) > size:
            yield at, own
            own, at, total = [], i, 0
        own.append(data)
        total += len(data)
    if own:
        yield at, own
