"""Arrow batches in pieces: Spark's hold up to 10,000 rows, whatever these hold."""

from __future__ import annotations

import pyarrow as pa


def slices(batch: pa.RecordBatch, column: str, most: int):
    """The batch in slices of whole rows, none with more than ``most`` bytes (strings) or elements (lists) in ``column``
    but those of one row, so that what a task makes of its rows in Python doesn't grow with the batch."""
    import numpy as np

    if not batch.num_rows:
        return
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int64 if pa.types.is_large_string(batch.schema.field(column).type) or pa.types.is_large_list(batch.schema.field(column).type) else np.int32)
    offsets = offsets[batch.column(column).offset :][: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
