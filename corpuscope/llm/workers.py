"""What Python workers hold between tasks: they are used again, by the same step and by others."""

import ctypes
import functools

import pyarrow as pa

_kept = {}


def kept(key, make):
    """`make()`, once per worker for as long as its tasks ask for this key: a worker keeps one such object, for one key."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def _drop():
    _kept.clear()


def _give_back():
    """Free memory goes back to the system; elsewhere than with glibc it stays for the worker's next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def tidy(run, keeps=False):
    """The function of a Python task, so that the worker is small after it.

    What tasks of other steps have kept is dropped before it begins, unless it `keeps` something itself."""
    @functools.wraps(run)
    def tidied(batches):
        if not keeps:
            _drop()
        try:
            yield from run(batches)
        finally:
            _give_back()
    return tidied
