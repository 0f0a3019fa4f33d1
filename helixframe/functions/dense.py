"""Arrow-batch kernel for the residue x slot matrices of stored samples."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Arrays that are made: matrices, and vectors with the field of the slots that they are.
MATRICES = ["base_label", "base_mask", "backbone_label", "contact_label"]
VECTORS = {"site_label": None, "pwm_mask": "pwm_mask", "slot_to_dna_index": "dna_idx"}
#: Samples whose matrices are held at a time.
SAMPLES = 16


def _ints(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int32)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(size: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))


def dense(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """Matrices and vectors of all samples of a batch; a cell is where its residue and slot are, 0 unless its slot names the residue."""
    n = _sizes(batch["residues"]) if "residues" in batch.schema.names else _ints(batch["n_res"]).astype(np.int64)
    slots = batch["slots"]
    m, slot = _sizes(slots), slots.flatten()
    cells = n * m
    begin = np.cumsum(cells) - cells
    sample = np.repeat(np.arange(len(m)), m)
    place = np.arange(len(slot)) - (np.cumsum(m) - m)[sample]

    def marked(lists: pa.Array, owner: np.ndarray, first: np.ndarray, step: np.ndarray, total: int) -> np.ndarray:
        """1 at ``first`` + residue x ``step`` for each residue in a list."""
        size, res = np.repeat(np.arange(len(owner)), _sizes(lists)), _ints(lists.flatten()).astype(np.int64)
        known = (res >= 0) & (res < n[owner[size]])
        out = np.zeros(total, np.int32)
        out[first[size[known]] + res[known] * step[size[known]]] = 1
        return out

    of = lambda name: marked(slot.field(name), sample, begin[sample] + place, m[sample], int(cells.sum()))
    base, backbone = of("base_res"), of("backbone_res")
    mask = np.split(_ints(slot.field("base_mask")), np.cumsum(m)[:-1])
    value = {"base_label": base, "backbone_label": backbone, "contact_label": base | backbone,
             "base_mask": np.concatenate([np.tile(x, k) for x, k in zip(mask, n, strict=True)]) if len(n) else base}
    rows, inside, slots_at = _offsets(n), _offsets(np.repeat(m, n)), _offsets(m)
    out = {c: pa.ListArray.from_arrays(rows, pa.ListArray.from_arrays(inside, pa.array(value[c]))) for c in MATRICES}
    each = np.arange(len(n))
    site = marked(batch["site_res"], each, np.cumsum(n) - n, np.ones(len(n), np.int64), int(n.sum()))
    return out | {"site_label": pa.ListArray.from_arrays(rows, pa.array(site)),
                  **{c: pa.ListArray.from_arrays(slots_at, slot.field(f)) for c, f in VECTORS.items() if f}}


def _total(lists: pa.Array) -> pa.Array:
    """Sum over all numbers of each row."""
    flat, ends = lists.flatten(), np.cumsum(_sizes(lists))
    if pa.types.is_list(flat.type):
        ends = np.concatenate([[0], np.cumsum(_sizes(flat))])[ends]
        flat = flat.flatten()
    sums = np.concatenate([[0], np.cumsum(_ints(flat), dtype=np.int64)])[np.concatenate([[0], ends])]
    return pa.array(np.diff(sums))


def dense_rows(batches: Iterator[pa.RecordBatch], names: Sequence[str], totals: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Columns ``names`` of the samples and their arrays; of ``totals`` the sum over all cells only."""
    for batch in batches:
        for at in range(0, batch.num_rows, SAMPLES):
            some = batch.slice(at, SAMPLES)
            made = dense(some)
            have = {c: _total(a) if c in totals else a for c, a in made.items()}
            yield pa.RecordBatch.from_arrays([have[c] if c in have else some[c] for c in names], list(names))
