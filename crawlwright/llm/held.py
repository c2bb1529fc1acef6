"""What a worker process keeps from task to task: one cache at a time, given back when other work begins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_MADE: dict[tuple, Any] = {}


def once(key: tuple, make: Callable[[], Any]) -> Any:
    """A worker makes what key stands for once and keeps it for later tasks of the same operator."""
    if key not in _MADE:
        _MADE.clear()
        trim()
        _MADE[key] = make()
    return _MADE[key]


def release() -> None:
    """For operators that keep nothing: a reused worker gives back what an earlier operator left."""
    if _MADE:
        _MADE.clear()
        trim()


def trim() -> None:
    """Gives memory that is free inside this process back to the machine, so that neither Arrow's pool nor the
    C library's heap keeps the size of its largest batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after each the worker gives back what it needed for it."""
    for batch in batches:
        yield batch
        trim()
