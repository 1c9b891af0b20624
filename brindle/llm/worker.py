"""What a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
from typing import Any

import pyarrow as pa
from pyspark import TaskContext

_HELD: dict[Any, dict] = {}


def stage_cache() -> dict:
    """A dict that lives in this worker as long as its tasks are of one stage.

    Workers are used again, also by other operators: the first call in a task of
    another stage lets go what the last one held, and gives its memory back to the
    system, which free lists would keep.
    """
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage not in _HELD:
        _HELD.clear()
        _release()
        _HELD[stage] = {}
    return _HELD[stage]


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)
