"""Vectorised hashing of words, windows and bytes (numpy, 64-bit arithmetic modulo 2**64)."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_M = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered for the short words seen lately (some 20 MB at most)."""

    LIMIT, LONGEST = 100_000, 40

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


_kept: dict[object, object] = {}


def kept(owner: object, make: Callable[[], object]) -> object:
    """What one operator keeps in a Python worker from task to task. Workers are used again by other operators, so what
    those kept is let go first: a worker never holds the caches of two."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(owner: object = None) -> Callable:
    """For a function over a task's Arrow batches: free memory goes back to the system when the task ends, and what
    operators other than ``owner`` kept goes when it begins."""

    def around(run: Callable) -> Callable:
        @functools.wraps(run)
        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if owner not in _kept:
                _kept.clear()
            try:
                yield from run(batches)
            finally:
                _trim()

        return inner

    return around


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def windows(h: np.ndarray, width: int, multiplier: int = _M) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive numbers; one less than ``width`` fewer than h. By doubling."""
    if len(h) < width:
        return np.empty(0, U)
    power, size, cur = multiplier, 1, h
    out, done = None, 0
    bits = width
    while True:
        if bits & 1:
            n = len(h) - (done + size) + 1
            out = cur[:n].copy() if out is None else out[: len(h) - (done + size) + 1] * U(power) + cur[done : done + n]
            done += size
        bits >>= 1
        if not bits:
            return out
        n = len(cur) - size
        cur = cur[:n] * U(power) + cur[size : size + n]
        power, size = power * power % (1 << 64), size * 2


def batched(ids: pa.Array, texts: pa.Array, limit: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, the texts as UTF-8) of runs of rows of about ``limit`` bytes; null is empty. A long text is a run of its own."""
    data = texts.cast(pa.large_binary()).to_pylist()
    at, total, run = 0, 0, []
    for i, x in enumerate(data):
        run.append(x or b"")
        total += len(run[-1])
        if total >= limit:
            yield at, run
            at, total, run = i + 1, 0, []
    if run:
        yield at, run
