"""Groups of rows in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal `keys`, of batches sorted by them; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                if values[start] != now:
                    if held:
                        yield now, pa.Table.from_batches(held)
                    held, now = [], values[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield now, pa.Table.from_batches(held)
