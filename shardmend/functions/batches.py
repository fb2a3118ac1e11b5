"""Arrow batches of whole payloads, small enough for a Python task to hold what it makes of one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and bytes at which an Arrow batch ends. A Python task holds a batch, what is made of it and their copies at once.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of at most BATCH_ROWS rows and BATCH_BYTES bytes; a longer row is a piece by itself.

    Pieces are views. So a task makes copies of a piece only, whatever bounds the session sets for its batches.
    """
    for batch in batches:
        n = batch.num_rows
        if n > BATCH_ROWS or n > 1 and batch.nbytes > BATCH_BYTES:
            yield from small((batch.slice(0, n // 2), batch.slice(n // 2)))
        else:
            yield batch
