"""What a Python worker keeps between tasks. Spark uses a worker again for whatever runs next, so what one stage leaves in it stands beside the next one's data."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

_model: list = []  # this process's one model, behind what it was built of


def held(build: Callable, *args):
    """``build(*args)``, kept for the worker's next tasks; one model at a time, so another operator's takes its place."""
    if not _model or _model[0] != (build, args):
        drop()
        _model[:] = [(build, args), build(*args)]
    return _model[1]


def drop() -> None:
    """Let go of the model, if there is one."""
    if _model:
        _model.clear()
        give_back()


@functools.lru_cache(1)
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone


def give_back() -> None:
    """Freed memory goes back to the system; allocators keep most of it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run: Callable[[Iterable], Iterator], model: bool = False) -> Callable[[Iterable], Iterator]:
    """``run`` for mapInArrow, without a model of another operator beside it unless it has its own (``model``: by :func:`held`), and with its memory given back at the end."""

    def whole(batches):
        if not model:
            drop()
        yield from run(batches)
        give_back()

    return whole
