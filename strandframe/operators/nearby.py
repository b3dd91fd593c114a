"""Nearest neighbours within rows that hold a structure's points each, in numpy over Arrow batches: graph.knn_graph's tasks for structures of one block.

Points are told apart by their place in the row, which is by id. All pairs of equally large structures are one array; or points are laid into cells and meet those in the cells
around their own, a level up while the k-th neighbour isn't sure, as graph's joins do for larger structures. Distances and their order are those of Spark's expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are held at once, about, and the deepest level of cells.
_PAIRS, _DEEPEST = 1 << 20, 12

#: src, dst (points of the batch), rank, dist.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def edges(batch: pa.RecordBatch, k: int, carried: tuple[str, ...], cells: bool) -> Iterator[pa.RecordBatch]:
    """name, src, dst, rank, dist, s_<carried>, d_<carried> of rows (name, pts: id, x, y, z and carried)."""
    pts = batch.column("pts")
    sizes = pc.fill_null(pc.list_value_length(pts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pts.flatten()
    fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    which = np.repeat(np.arange(len(sizes)), sizes)
    at = np.stack([fields[c].to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], axis=1)
    blank = np.any([pc.is_null(fields[c]).to_numpy(zero_copy_only=False) for c in "xyz"], axis=0)
    starts = np.cumsum(sizes) - sizes
    names = ["name", "src", "dst", "rank", "dist", *[s + c for s in ("s_", "d_") for c in carried]]
    for src, dst, rank, dist in _found(at, blank, sizes, starts, k, cells):
        ends, absent = (pa.array(src), pa.array(dst)), blank[src] | blank[dst]
        columns = [batch.column("name").take(pa.array(which[src])), *[fields["id"].take(e) for e in ends], pa.array(rank, pa.int32()), pa.array(dist, mask=absent)]
        yield pa.RecordBatch.from_arrays([*columns, *[fields[c].take(e) for e in ends for c in carried]], names=names)


def _found(at: np.ndarray, blank: np.ndarray, sizes: np.ndarray, starts: np.ndarray, k: int, cells: bool) -> Iterator[Found]:
    with np.errstate(invalid="ignore", over="ignore"):
        own = sizes > 0
        if cells and own.any():
            whole = np.zeros(len(sizes), bool)
            whole[own] = np.logical_and.reduceat(np.isfinite(at).all(axis=1), starts[own])
            yield from _by_cells(at, sizes[whole], starts[whole], k)
            own &= ~whole
        yield from _by_pairs(at, blank, sizes[own], starts[own], k)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = 0.0
    for c in range(3):
        e = a[..., c] - b[..., c]
        d = d + e * e
    return np.sqrt(d + 1e-6)


def _rounded(d: np.ndarray) -> np.ndarray:
    """d in millionths, as Spark's round gives it: halves of the shortest decimal number go up."""
    s = d * 1e6
    low = np.floor(s)
    r = low + (s - low >= 0.5)
    for i in np.flatnonzero(np.abs(s - low - 0.5).ravel() < np.maximum(1e-6, s * 4e-16).ravel()):
        r.flat[i] = float(Decimal(repr(float(d.flat[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return r


def _by_pairs(at: np.ndarray, blank: np.ndarray, sizes: np.ndarray, starts: np.ndarray, k: int) -> Iterator[Found]:
    for n in np.unique(sizes):
        first, step = starts[sizes == n], max(1, _PAIRS // int(n * n))
        for i in range(0, len(first), step):
            rows = first[i : i + step, None] + np.arange(n)
            p = at[rows]
            d = _distance(p[:, :, None], p[:, None])
            r = _rounded(d)
            if blank[rows].any():  # a distance that is null comes first
                r[blank[rows][:, :, None] | blank[rows][:, None]] = -np.inf
            order = np.argsort(r, axis=2, kind="stable")[:, :, :k]
            src = np.broadcast_to(rows[:, :, None], order.shape)
            dst = np.take_along_axis(np.broadcast_to(rows[:, None], d.shape), order, 2)
            rank = np.broadcast_to(np.arange(1, order.shape[2] + 1), order.shape)
            yield src.ravel(), dst.ravel(), rank.ravel(), np.take_along_axis(d, order, 2).ravel()


def _by_cells(at: np.ndarray, sizes: np.ndarray, starts: np.ndarray, k: int) -> Iterator[Found]:
    """A structure's cells begin at the level where points that fill their box evenly would have half of k points in one."""
    if not len(sizes):
        return
    which = np.repeat(np.arange(len(sizes)), sizes)
    points = np.repeat(starts, sizes) + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    p, begin = at[points], np.cumsum(sizes) - sizes
    low, high = np.minimum.reduceat(p, begin), np.maximum.reduceat(p, begin)
    wide = np.maximum((high - low).max(axis=1), 1e-3) * 1.0001
    level = np.clip(np.floor(np.log2(wide / np.cbrt(np.prod(high - low + 1, axis=1) * k / 2 / sizes))), 1, _DEEPEST).astype(np.int64)
    todo = np.arange(len(which))
    while len(todo):
        here = np.flatnonzero(np.isin(which, which[todo]))
        key, side = np.zeros(len(which), np.int64), (1 << int(level.max())) + 2
        key[here] = which[here]
        for c in range(3):  # the cells' rows along z follow one another
            key[here] = key[here] * side + 1 + np.floor((p[here, c] - low[which[here], c]) / wide[which[here]] * (1 << level[which[here]])).astype(np.int64)
        order = here[np.argsort(key[here], kind="stable")]
        sorted_keys = key[order]
        around = key[todo, None] + (np.repeat([-1, 0, 1], 3) * side + np.tile([-1, 0, 1], 3)) * side
        begins, ends = np.searchsorted(sorted_keys, around - 1), np.searchsorted(sorted_keys, around + 1, "right")
        # Beyond a cell's width there may be points that weren't met; with two cells a side all are.
        reach = np.where(level > 1, wide / (1 << level), np.inf)[which[todo]]
        unsure = np.zeros(len(todo), bool)
        met = np.cumsum((ends - begins).sum(axis=1))
        cuts = np.unique(np.searchsorted(met, np.arange(0, met[-1], _PAIRS), "left"))
        for i, j in zip(cuts, [*cuts[1:], len(todo)], strict=True):
            count = (ends[i:j] - begins[i:j]).ravel()
            at_key = np.repeat(begins[i:j].ravel() - (np.cumsum(count) - count), count) + np.arange(count.sum())
            src, dst = np.repeat(np.repeat(np.arange(i, j), 9), count), order[at_key]
            d = _distance(p[todo[src]], p[dst])
            kept = np.flatnonzero(d < reach[src])
            src, dst, d = src[kept], dst[kept], d[kept]
            by = np.lexsort((dst, _rounded(d), src))
            src, dst, d = src[by], dst[by], d[by]
            held = np.bincount(src - i, minlength=j - i)
            rank = np.arange(len(src)) - np.repeat(np.cumsum(held) - held, held) + 1
            best = rank <= k
            within = np.bincount(src[best] - i, d[best] < reach[src[best]] - 2e-6, j - i) == k  # with a margin for ties
            unsure[i:j] = ~within & np.isfinite(reach[i:j])
            best &= ~unsure[src]
            yield points[todo[src[best]]], points[dst[best]], rank[best], d[best]
        todo = todo[unsure]
        level = np.maximum(level - 1, 1)
