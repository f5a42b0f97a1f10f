"""Groups of rows in a sorted stream of Arrow batches, for jobs with very many small groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole runs of rows with equal keys, and where each run begins and how long it is; rows must come sorted by keys, which must not be null."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        differs = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            differs |= x[1:] != x[:-1]
        at = np.r_[0, np.flatnonzero(differs) + 1]
        held = t.slice(int(at[-1]))
        if len(at) > 1:
            yield t.slice(0, int(at[-1])), at[:-1], np.diff(at)
    if held is not None:
        yield held, np.array([0]), np.array([held.num_rows])
