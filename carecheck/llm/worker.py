"""What Python workers keep.

Spark gives the tasks of later stages the same worker processes, so what an operator leaves in them adds to the
memory of every stage that follows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """The one large helper object (a model) that a worker keeps for its later tasks; it takes the place of any other."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    if _held:
        _held.clear()
        gc.collect()


def give_back() -> None:
    """Return memory that is free, but still kept by Arrow's pool or by malloc, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for a ``run`` that needs no kept object: what earlier operators left goes
    first, and its own free memory is returned when it ends."""
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)
