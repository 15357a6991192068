"""Memory of Python workers, which live on from task to task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa


#: What this process holds from one task to the next.
_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """What make gives, made once in this process and held until a task runs that does not ask for it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def given_back(rows: Iterable, keeps: Hashable = None) -> Iterator:
    """The items of rows; at their end, what Arrow and the C library hold without need goes back to the system. Before them,
    whatever is kept under another key than `keeps` goes: workers serve all stages in turn."""
    for key in [k for k in _KEPT if k != keeps]:
        del _KEPT[key]
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # other C libraries have no such call
            pass
