"""Small helpers for frames of any columns and for Arrow batches of long texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that a Python worker turns into objects at a time.
SLICE_ROWS = 500


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, or one like it that no column in ``taken`` has in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows at most, without a copy; the session's own batch size stays as it is.

    At the end what Arrow's pool holds for batches to come goes back to the system, as the worker may wait for long.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()
