"""Memory of Python workers, given back when a task ends.

Workers are kept for later tasks, of other stages too. What a task leaves in allocators
would add to what the next stage needs, so each task ends by handing it back.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free pages; None where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def at_end(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; ``forget`` empties what the module remembers once the task is over."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            release()

    return whole


def after_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` over the rows of a group."""

    def whole(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            release()

    return whole


def after_groups(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``run`` over the rows of a group on both sides."""

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return whole
