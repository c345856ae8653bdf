"""What functions over Arrow batches share: small runs of texts, and memory given back when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from quarryline.llm.hashing import SLICE, slices

#: Rows of a batch that become Python objects together.
ROWS = 256


def runs(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of at most ROWS texts and about ``most`` characters; null counts as empty, a longer text stands alone."""
    empty = b"" if pa.types.is_binary(column.type) else ""
    for lo in range(0, len(column), ROWS):
        done = lo
        for run in slices([t or empty for t in column.slice(lo, ROWS).to_pylist()], most):
            yield done, run
            done += len(run)


def give_back() -> None:
    """Returns free memory to the system; Python workers outlive tasks and stages and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function, giving memory back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
