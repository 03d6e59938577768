"""Reading sorted Arrow batches of a partition group by group, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from the row before (null equals null); the first row is True."""
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
    for k in keys:
        col = table.column(k).combine_chunks()
        a, b = col.slice(1), col.slice(0, max(0, len(col) - 1))
        same = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return new


def slabs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows of a stream sorted by ``keys``, cut only between groups.

    While one group fills all that is held, the next look for a cut comes at twice its size.
    """
    held: list[pa.RecordBatch] = []
    count, wanted = 0, rows
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= wanted:
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(group_starts(table, keys))
            cut = int(starts[-1])
            wanted = 2 * count
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut)
                held, count, wanted = rest.to_batches(), rest.num_rows, max(rows, 2 * rest.num_rows)
    if count:
        yield pa.Table.from_batches(held)
