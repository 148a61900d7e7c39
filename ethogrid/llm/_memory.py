"""Python workers live on between stages: what a stage no longer needs goes back to the system."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release(cycles: bool = True) -> None:
    """Free what allocators keep for reuse."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def released(run: Callable, sides: int) -> Callable:
    """The function of a group (sides: its number of arguments, by which Spark tells their meaning), after which memory is freed."""
    if sides == 2:

        def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            try:
                return run(key, table)
            finally:
                release()

        return one

    def two(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(key, left, right)
        finally:
            release()

    return two


def freed(run: Callable) -> Callable:
    """The function of a partition's batches, after which memory is freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release(cycles=False)

    return whole
