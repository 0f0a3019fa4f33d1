"""Arrow-batch kernel for sliding-window scores.

Built-in array functions evaluate a lambda per motif row and letter, about a
microsecond each; here one NumPy step handles motif row j of every window of the
batch.  Spark still partitions the chains; a batch is a slice of one partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_WINDOWS = 1 << 16  # windows handled at a time, bounds the worker's memory
_CODE = np.zeros(256, dtype=np.int64)
for _k, _b in enumerate(b"ACGT"):
    _CODE[_b] = _k


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and where each row begins; no object is made for a row."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat if len(flat) else np.zeros(1), _starts(sizes)


def _score(b: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all placements of the rows of ``b``: (row, i, forward, reverse)."""
    codes = _CODE[np.frombuffer("".join(b["sequence"].to_pylist()).encode("ascii"), dtype=np.uint8)]
    code0 = _starts(pc.utf8_length(b["sequence"]).to_numpy(zero_copy_only=False).astype(np.int64))
    num, num0 = _flat(b["num"])
    den, den0 = _flat(b["den"])
    lp, lp0 = _flat(b["lp"])
    n = _numbers(b["n_place"])
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(n.sum()) - np.repeat(_starts(n), n)
    full = b["is_full"].to_numpy(zero_copy_only=False).astype(bool)[row]
    vis = _numbers(b["vis"])[row]
    at = code0[row] + np.where(full, i, 0)
    first = np.where(full, 0, i)
    fwd, rev, weight = np.zeros(len(row)), np.zeros(len(row)), np.zeros(len(row))
    for j in range(int(vis.max())):
        on = np.flatnonzero(vis > j)
        w = num0[row[on]] + 4 * (first[on] + j)
        fwd[on] += num[w + codes[at[on] + j]]
        rev[on] += num[w + 3 - codes[at[on] + vis[on] - 1 - j]]
        weight[on] += den[den0[row[on]] + first[on] + j]
    plain = np.flatnonzero(weight <= 1e-8)
    weight[plain] = 1.0
    # Windows without information: plain mean of the log terms.
    fwd[plain] = rev[plain] = 0.0
    for j in range(int(vis[plain].max(initial=0))):
        on = plain[vis[plain] > j]
        w = lp0[row[on]] + 4 * (first[on] + j)
        fwd[on] += lp[w + codes[at[on] + j]]
        rev[on] += lp[w + 3 - codes[at[on] + vis[on] - 1 - j]]
    weight[plain] = vis[plain]
    return row, i, fwd / weight, rev / weight


_COLUMNS = ("sequence", "num", "den", "lp", "is_full", "vis", "n_place")


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _part(columns: tuple, lo: int, hi: int) -> dict[str, pa.Array]:
    """Rows ``lo`` to ``hi`` of the columns, where they lie."""
    return {name: c.slice(lo, hi - lo) for name, c in zip(_COLUMNS, columns, strict=True)}


def _candidate_scores(
    sequence: pa.Array, num: pa.Array, den: pa.Array, lp: pa.Array, is_full: pa.Array, vis: pa.Array, n_place: pa.Array,
) -> pa.Array:
    """All scores of a row: forward placements 0..n-1, then reverse ones. They go into one flat array; a batch has no
    object a row but for its inputs, a slice at a time."""
    n = n_place.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(2 * n)])
    out = np.empty(at[-1])
    columns = (sequence, num, den, lp, is_full, vis, n_place)
    for lo, hi in _slices(n):
        row, i, fwd, rev = _score(_part(columns, lo, hi))
        first = at[lo:hi][row] + i
        out[first] = fwd
        out[first + n[lo:hi][row]] = rev
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out))


def _slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``MAX_WINDOWS`` windows."""
    group = np.cumsum(n) // MAX_WINDOWS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(n)]
    return ((lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi > lo)


def _best_candidate(
    sequence: pa.Array, num: pa.Array, den: pa.Array, lp: pa.Array, is_full: pa.Array, vis: pa.Array, n_place: pa.Array,
) -> pa.Array:
    """Best placement of a row; ties: forward first, then the smaller start on the
    oriented strand (for full reverse windows that is the larger i)."""
    out = [(np.zeros(0), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int32))]
    columns = (sequence, num, den, lp, is_full, vis, n_place)
    for lo, hi in _slices(n_place.to_numpy(zero_copy_only=False).astype(np.int64)):
        part = _part(columns, lo, hi)
        row, i, fwd, rev = _score(part)
        at = _starts(_numbers(part["n_place"]))
        full = part["is_full"].to_numpy(zero_copy_only=False).astype(bool)
        best = {}
        for name, raw in (("f", fwd), ("r", rev)):
            s = np.round(raw, 9)
            top = np.maximum.reduceat(s, at)
            hit = s == top[row]
            low = np.minimum.reduceat(np.where(hit, i, np.iinfo(np.int64).max), at)
            high = np.maximum.reduceat(np.where(hit, i, -1), at)
            pick = np.where(full, high, low) if name == "r" else low
            best[name] = (top, raw[at + pick], pick)
        use_rev = best["r"][0] > best["f"][0]
        out.append((
            np.where(use_rev, best["r"][0], best["f"][0]), np.where(use_rev, best["r"][1], best["f"][1]),
            use_rev, np.where(use_rev, best["r"][2], best["f"][2]).astype(np.int32)))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["score", "raw", "reverse", "i"])


def candidate_scores(*args: str) -> Column:
    return F.arrow_udf(_candidate_scores, "array<double>")(*args)


def best_candidate(*args: str) -> Column:
    return F.arrow_udf(_best_candidate, "score double, raw double, reverse boolean, i int")(*args)


# ------------------------------------------------------- many motifs, one segment
_COUNTS = ("base_pos", "backbone_pos", "contact_pos", "site_pos")
#: What ``constrained_best`` reads of a block of samples beside a segment, and gives for each sample.
BLOCK_ARGS = ["sequence", "m", "is_full", "vis", "n_place", "num", "den", "lp", "n_lp", "free", "w_i", *(f"w_{c}" for c in _COUNTS), "w_bad"]
BLOCK_RESULT = ("array<struct<n:bigint,n_ok:bigint,i:int,reverse_complement:boolean,raw:double," + ",".join(f"{c}:bigint" for c in _COUNTS)
                + ",any_i:int,any_reverse:boolean,any_raw:double>>")


def _block_scores(codes: np.ndarray, full: bool, m: int, vis: int, n: int, num: np.ndarray, den: np.ndarray, plain: list) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse scores (placements x motifs) of motifs of one length on one segment. ``num``: m x 4 x motifs, ``den``:
    m x motifs, ``plain``: (motif, its log terms, m x 4) of those that may hold no information. Terms are added in motif order."""
    fwd, rev = np.zeros((n, num.shape[2])), np.zeros((n, num.shape[2]))
    weight = np.zeros((1 if full else n, num.shape[2]))
    back = 3 - codes
    for j in range(vis):
        k = vis - 1 - j
        if full:
            fwd += num[j][codes[j:j + n]]
            rev += num[j][back[k:k + n]]
            weight += den[j]
        else:
            fwd += num[j:j + n, codes[j]]
            rev += num[j:j + n, back[k]]
            weight += den[j:j + n]
    empty = weight <= 1e-8
    weight[empty] = 1.0
    fwd, rev = fwd / weight, rev / weight
    # Windows without information: plain mean of the log terms.
    for q, terms in plain if empty.any() else ():
        at = np.flatnonzero(np.broadcast_to(empty[:, q], n))
        first = np.zeros(len(at), np.int64) if full else at
        begin = at if full else np.zeros(len(at), np.int64)
        f, r = np.zeros(len(at)), np.zeros(len(at))
        for j in range(vis):
            f += terms[first + j, codes[begin + j]]
            r += terms[first + j, back[begin + vis - 1 - j]]
        fwd[at, q], rev[at, q] = f / vis, r / vis
    return fwd, rev


def _pick(fwd: np.ndarray, rev: np.ndarray, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, reverse, raw) of each motif's best row; ties as in ``_best_candidate``. NaN counts as the largest."""
    f, r, motif = np.round(fwd, 9), np.round(rev, 9), np.arange(fwd.shape[1])
    at_f = np.argmax(f, 0)
    at_r = len(r) - 1 - np.argmax(r[::-1], 0) if full else np.argmax(r, 0)
    top_f, top_r = f[at_f, motif], r[at_r, motif]
    use = (top_r > top_f) | (np.isnan(top_r) & ~np.isnan(top_f))
    return np.where(use, at_r, at_f), use, np.where(use, rev[at_r, motif], fwd[at_f, motif])


def _constrained_best(min_base: int, min_contact: int, min_site: int):
    def best(*columns: pa.Array) -> pa.Array:
        length = [len(x) for x in columns[9]]
        total = sum(length)
        kinds = {"n": np.int64, "n_ok": np.int64, "i": np.int32, "reverse_complement": bool, "raw": np.float64, **dict.fromkeys(_COUNTS, np.int64),
                 "any_i": np.int32, "any_reverse": bool, "any_raw": np.float64}
        out = {c: np.zeros(total, t) for c, t in kinds.items()}
        lo = 0
        for row, k in enumerate(length):
            sequence, m, full, vis, n = (c[row].as_py() for c in columns[:5])
            num, den, lp, n_lp, free, at, *counts, bad = (c[row].values.to_numpy(zero_copy_only=False) if c[row].is_valid else np.zeros(0) for c in columns[5:])
            codes = _CODE[np.frombuffer(sequence.encode("ascii"), dtype=np.uint8)]
            ends = np.cumsum(n_lp, dtype=np.int64)
            plain = [(q, lp[ends[q] - n_lp[q]:ends[q]].reshape(m, 4)) for q in range(k) if n_lp[q]]
            by_motif = np.ascontiguousarray(num.reshape(k, m, 4).transpose(1, 2, 0)), np.ascontiguousarray(den.reshape(k, m).T)
            fwd, rev = _block_scores(codes, full, m, vis, n, *by_motif, plain)
            # A chain that lies inside its motif is one window, whatever the placement.
            places = n if full else 1
            held = np.zeros((4, places), np.int64)
            held[:, at.astype(np.int64)] = counts
            open_ = np.ones(places, bool)
            open_[bad.astype(np.int64)] = False
            passes = open_ & (held[2] >= min_contact) & (held[3] >= min_site) & (held[0] >= min_base)
            if not full:
                held, open_, passes = np.repeat(held, n, 1), np.repeat(open_, n), np.repeat(passes, n)
            rows, good, hi = np.flatnonzero(open_), np.flatnonzero(passes), lo + k
            free = free.astype(bool)
            if len(rows):
                i, reverse, raw = _pick(fwd[rows], rev[rows], full)
                i = rows[i]
                out["any_i"][lo:hi], out["any_reverse"][lo:hi], out["any_raw"][lo:hi] = i, reverse, raw
                if len(good) and not free.all():
                    j, reverse_ok, raw_ok = _pick(fwd[good], rev[good], full)
                    i, reverse, raw = np.where(free, i, good[j]), np.where(free, reverse, reverse_ok), np.where(free, raw, raw_ok)
                out["i"][lo:hi], out["reverse_complement"][lo:hi], out["raw"][lo:hi] = i, reverse, raw
                for c, x in zip(_COUNTS, held):
                    out[c][lo:hi] = x[i]
            out["n"][lo:hi] = 2 * len(rows)
            out["n_ok"][lo:hi] = np.where(free, 2 * len(rows), 2 * len(good))
            lo = hi
        values = pa.StructArray.from_arrays([pa.array(x) for x in out.values()], list(out))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), values)
    return best


def constrained_best(min_base: int, min_contact: int, min_site: int, *args: str) -> Column:
    """Of every sample of a block on its segment: candidates, those that pass, the best of these with its counts, the best of all.
    What is named by ``i`` counts only where ``n_ok``, and by ``any_i`` where ``n`` is above 0."""
    return F.arrow_udf(_constrained_best(min_base, min_contact, min_site), BLOCK_RESULT)(*args)
