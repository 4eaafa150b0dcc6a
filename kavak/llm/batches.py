"""Arrow batches cut to a bounded number of signs, so that numpy work on them has a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Signs of text handled at once in a Python worker; one longer text is a batch of its own.
SIGNS = 1_000_000


def by_size(batches: Iterator[pa.RecordBatch], text: str, most: int = SIGNS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about ``most`` signs in column ``text``."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lens = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
        at = start = size = 0
        for at, n in enumerate(lens.tolist()):
            if size and size + n > most:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += n
        if len(lens) > start:
            yield batch.slice(start)


def mapped(text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = SIGNS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that applies ``work`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, text, most):
            yield work(part)

    return run
