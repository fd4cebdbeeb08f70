"""What Python functions give back to Spark: Arrow batches of a bounded number of rows, however many rows one batch read makes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa

ROWS = 1 << 13


def out(rows: Iterable[tuple], schema: pa.Schema, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most so many; only one batch is held at a time."""
    for part in batched(rows, most):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches as Python values, one at a time."""
    for part in batches:
        for at in range(0, part.num_rows, 64):  # few at a time, as texts may be long
            yield from zip(*(c.to_pylist() for c in part.slice(at, 64).columns), strict=True)
