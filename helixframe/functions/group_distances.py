"""Arrow-batch kernel for the smallest distances between groups of points.

A row holds some groups of either side that a cell of a grid has in common.  Boxes are compared first, then points with boxes; the
points of two groups meet only where both are close, a slice of such pairs at a time, and a pair of groups gives one row at most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1024  # pairs of groups handled at a time; what they need stays in a core's cache
_AXES = "xyz"


def _points(groups: pa.StructArray, fill: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Coordinates (most points x groups, an axis each) and parts; ``fill`` where a group has fewer points."""
    lists = groups.field("points")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(size)), size)
    axes = []
    for a in _AXES:
        axes.append(np.full((size.max(), len(size)), fill))
        axes[-1][at] = flat.field(a).to_numpy(zero_copy_only=False)
    part = np.full(axes[0].shape, -1, np.int8)
    part[at] = flat.field("part").to_numpy(zero_copy_only=False)
    return axes, part


def _box(groups: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(groups.field(f"{n}_{a}").to_numpy(zero_copy_only=False) for n in ("lo", "hi")) for a in _AXES]


def _reaches(points: list[np.ndarray], i: np.ndarray, box: list, j: np.ndarray, far: float) -> np.ndarray:
    """Whether some point of group ``i`` is within ``far`` of the box of group ``j``."""
    gap2 = 0.0
    for x, (lo, hi) in zip(points, box, strict=True):
        own = x[:, i]
        gap = np.maximum(np.maximum(lo[j] - own, own - hi[j]), 0)
        gap2 = gap2 + gap * gap
    return (gap2 <= far * far).any(0)


def _least(p: list[np.ndarray], u: np.ndarray, q: list[np.ndarray], v: np.ndarray) -> np.ndarray:
    """Squared distance of each point of the groups ``v`` to the nearest one of ``u`` (points x pairs)."""
    own, (x, y, z) = [m[:, u] for m in p], [m[:, v] for m in q]
    least = np.full(x.shape, np.inf)
    for k in range(len(own[0])):
        d = x - own[0][k]
        d *= d
        for m, n in ((y, own[1][k]), (z, own[2][k])):
            e = m - n
            e *= e
            d += e
        np.minimum(least, d, out=least)
    return least


def _close(a: pa.StructArray, b: pa.StructArray, cell: list[int], far: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups whose boxes are within ``far``, where ``cell`` is the first that both lie in."""
    keep, gap2 = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)))
    first = lambda side, x: side.field(f"first_{x}").to_numpy(zero_copy_only=False)
    for x, c, (lo, hi), (low, high) in zip(_AXES, cell, _box(a), _box(b), strict=True):
        keep &= np.maximum(first(a, x)[:, None], first(b, x)) == c
        gap = np.maximum(lo[:, None] - high, low - hi[:, None])
        gap2 += np.maximum(gap, 0) ** 2
    return np.nonzero(keep & (gap2 <= far * far))


def least_distances(batches: Iterator[pa.RecordBatch], key: str, cutoff: float, far: float, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows ``key, a, b`` (what names the groups) and ``d0`` and so on: the smallest squared distance to points of each part of
    ``b``, NULL beyond the cutoff."""
    limit = cutoff * cutoff + 1e-6
    for batch in batches:
        for row in range(batch.num_rows):
            a, b = batch["a"][row].values, batch["b"][row].values
            i, j = _close(a, b, [batch[f"_c{x}"][row].as_py() for x in _AXES], far)
            if not len(i):
                continue
            (p, _), (q, part) = _points(a, np.inf), _points(b, -np.inf)
            box_a, box_b = _box(a), _box(b)
            for s in range(0, len(i), SLICE):
                u, v = i[s:s + SLICE], j[s:s + SLICE]
                near = _reaches(q, v, box_a, u, far) & _reaches(p, u, box_b, v, far)
                if not near.any():
                    continue
                u, v = u[near], v[near]
                least, kind = _least(p, u, q, v), part[:, v]
                found = [np.where(kind == k, least, np.inf).min(0) for k in range(parts)]
                hit = np.flatnonzero(np.min(found, 0) <= limit)
                names = pa.array([batch[key][row].as_py()] * len(hit), batch.schema.field(key).type)
                yield pa.RecordBatch.from_arrays(
                    [names, a.field("id").take(pa.array(u[hit])), b.field("id").take(pa.array(v[hit])),
                     *(pa.array(d[hit], mask=d[hit] > limit) for d in found)],
                    [key, "a", "b", *(f"d{k}" for k in range(parts))])
