"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give back to the system what NumPy and Arrow have freed; else it stays with the worker, beside whatever runs next on the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def freed(run: Callable) -> Callable:
    """A function of mapInArrow that gives back at its end what it has freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def freed_group(run: Callable) -> Callable:
    """The same of applyInArrow, for groups of some MB."""

    def whole(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return whole
