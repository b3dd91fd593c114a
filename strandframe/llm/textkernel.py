"""Vectorised word and n-gram hashing over Arrow text buffers (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M = 0x9E3779B97F4A7C15 | 1
_MINV = pow(_M, -1, 1 << 64)
_PIECE = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of words: digits, lower-case letters and every byte of a non-ASCII code point.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words that end at ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    size = max(_PIECE, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        with np.errstate(over="ignore"):
            made = tuple(np.cumprod(np.insert(np.full(size - 1, x, dtype=np.uint64), 0, np.uint64(1)), dtype=np.uint64) for x in (_M, _MINV))
        if size > _PIECE:
            return made
        _powers[size] = made
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        h = h.astype(np.uint64, copy=True)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offset of each row in them, with the end at last."""
    wide = column.type in (pa.large_binary(), pa.large_string())
    offsets = np.frombuffer(
        column.buffers()[1],
        dtype=np.int64 if wide else np.int32,
    )[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: a 64-bit hash, first byte, byte after the last, row. Long data are worked on in pieces that end between words."""
    inside = table[data]
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets] = True
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1] & ~breaks[1:-1]])) if len(data) else np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~breaks[1:-1], [False]])) + 1 if len(data) else starts
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _PIECE, side="right")))
        stop = ends[to - 1]
        up, down = powers(int(stop - base))
        with np.errstate(over="ignore"):
            values = (data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base]
            values[~inside[base:stop]] = 0
            own = starts[at:to] - base
            hashes[at:to] = np.add.reduceat(values, own) * down[own]
        at = to
    return mix(hashes), starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the spans of these sizes that begin at a and at b have the same bytes, all of them."""
    at = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _PIECE, side="right")) - 1)
        if to == at + 1:
            same = np.array_equal(data[a[at] : a[at] + sizes[at]], data[b[at] : b[at] + sizes[at]])
        else:
            n = sizes[at:to]
            inner = np.arange(int(n.sum())) - np.repeat(total[at:to] - total[at], n)
            same = bool((data[np.repeat(a[at:to], n) + inner] == data[np.repeat(b[at:to], n) + inner]).all())
        if not same:
            return False
        at = to
    return True


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of spans that are equal just where their bytes are. Equal hashes are verified byte by byte; where one lies, the bytes alone decide."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(np.diff(hashes[order]) == 0)
    a, b, sizes = order[same], order[same + 1], ends - starts
    ids = np.empty(len(starts), dtype=np.int64)
    if np.array_equal(sizes[a], sizes[b]) and _equal(data, starts[a], starts[b], sizes[a]):
        new = np.ones(len(starts), dtype=np.int64)
        new[same + 1] = 0
        ids[order] = np.cumsum(new) - 1
    else:
        number: dict[bytes, int] = {}
        ids[:] = [number.setdefault(data[i:j].tobytes(), len(number)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    return ids


def repeated(ids: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each run of size neighbouring ids of one row, and whether the same run occurs again in the row."""
    n = len(ids) - size + 1
    first = np.flatnonzero(rows[:n] == rows[size - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    twice = np.zeros(len(first), dtype=bool)
    if len(first):
        key, _ = grams(mix(ids.astype(np.uint64)), rows, size)
        with np.errstate(over="ignore"):
            key = mix(key + rows[first].astype(np.uint64) * np.uint64(_M))
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        a, b = first[order[:-1][same]], first[order[1:][same]]
        if not (rows[a] == rows[b]).all() or not all((ids[a + k] == ids[b + k]).all() for k in range(size)):
            columns = [ids[first + k] for k in range(size)] + [rows[first]]
            order = np.lexsort(columns)
            same = np.logical_and.reduce([np.diff(c[order]) == 0 for c in columns])
        twice[order[:-1][same]] = twice[order[1:][same]] = True
    return first, twice


def grams(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of size neighbouring words of one row, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    total = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(total[first]), first
