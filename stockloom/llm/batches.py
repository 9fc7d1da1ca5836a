"""Arrow batches in pieces of bounded text, so that a worker's memory follows the longest text and not the batch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes in ``column``; a longer single text is a slice of its own."""
    if not batch.num_rows:
        return
    length = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
    ends = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: White space at which texts may be cut.
GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
SLAB_BYTES = 1 << 20


def slabs(text: bytes, gap: re.Pattern = GAP, most: int = SLAB_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``most`` bytes that end at a gap, so that a long text is never a list of all its words."""
    start = 0
    while start < len(text):
        found = gap.search(text, start + most) if start + most < len(text) else None
        stop = found.end() if found else len(text)
        yield text[start:stop]
        start = stop
