"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
import ctypes.util
from functools import lru_cache

import pyarrow as pa


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns free memory to the system, where there is one."""
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def give_back() -> None:
    """Return what a task no longer uses, so that a waiting worker holds little."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)
