"""Small groups in numpy, many of them a batch: rows are dealt by key and sorted, so that a group costs no frame of its own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _heads(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which the keys change; null equals null."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = pc.fill_null(t[k].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def by_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], dict], schema: str) -> DataFrame:
    """``work`` gets a table of whole groups, sorted by keys and order, and their bounds (one more than groups); it gives columns by name."""
    kinds = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        kept: list[pa.RecordBatch] = []  # of the group that may go on

        def made(t: pa.Table, heads: np.ndarray):
            out = work(t, heads)
            rows = pa.table([out[k] for k in kinds], names=kinds)
            return rows.combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            heads = _heads(t, keys)
            same = kept and all(kept[-1].column(k)[-1] == b.column(k)[0] or not (kept[-1].column(k)[-1].is_valid or b.column(k)[0].is_valid) for k in keys)
            if same and len(heads) == 1:
                kept.append(b)
                continue
            whole = pa.Table.from_batches([*kept, b])
            heads = heads + whole.num_rows - t.num_rows
            if kept:
                heads = np.append(0, heads[1:] if same else heads)
            last = int(heads[-1])
            if last:
                yield from made(whole.slice(0, last), heads)
            kept = [r for r in whole.slice(last).to_batches() if r.num_rows]
        if kept:
            t = pa.Table.from_batches(kept)
            yield from made(t, np.array([0, t.num_rows]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
