"""What a Python worker keeps between tasks.

Workers outlive tasks and run whatever comes next, so tables that one operator keeps would add up with those of others.
An operator claims its worker, and what another one had kept there is let go. Memory that is free goes back to the system
before a task begins: an executor's workers share a limit with its JVM.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Says that operator ``name`` runs here now; ``clear`` is called when another one claims the worker."""
    others = [k for k in _kept if k != name]
    for k in others:
        _kept.pop(k)()
    if others:
        gc.collect()
    give_back()
    _kept[name] = clear


def give_back() -> None:
    """Returns free memory to the system: also at a task's end, since an idle worker's share is the JVM's meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: the memory goes back later
