"""Python workers live on between tasks: what a task no longer needs goes back to the system.

Workers take Arrow's memory from the C library, which gives blocks of 1 MB or more back as soon as they are free; importing
this module sees to both.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1  # fixed values of mallopt
_C = ctypes.CDLL(None)
pa.set_memory_pool(pa.system_memory_pool())


def _limits(mapped: int, kept: int) -> None:
    if hasattr(_C, "mallopt"):
        _C.mallopt(_MMAP_THRESHOLD, mapped)
        _C.mallopt(_TRIM_THRESHOLD, kept)


def roomy() -> None:
    """Until ``release``, keep up to 64 MB of free memory for the arrays to come, which saves the system's work on them."""
    _limits(32 << 20, 64 << 20)


def release(*caches: dict) -> None:
    """Empty the caches, and return free memory of Python, Arrow and the C library."""
    for cache in caches:
        cache.clear()
    _limits(1 << 20, 1 << 20)
    gc.collect()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


_limits(1 << 20, 1 << 20)
