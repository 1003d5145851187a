"""What a Python worker keeps between tasks.

Spark reuses workers, so a table that was built for one operator would stay in memory while the next operator runs.
A worker keeps one operator's tables at a time.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_held: dict = {}


def held(owner: str, key, build: Callable):
    """``build()``, kept under (owner, key) until another owner or key asks."""
    own = (owner, key)
    if own not in _held:
        if _held:
            _held.clear()
            _give_back()
        _held[own] = build()
    return _held[own]


def _give_back() -> None:
    """Return freed memory to the machine, where the C library can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
