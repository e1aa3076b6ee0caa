"""Arrow batches in smaller parts, so that a worker holds little besides its input."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """All rows in order, ``rows`` at a time; nothing is copied."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
