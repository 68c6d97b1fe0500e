"""Words, 64-bit word hashes and word shingles of texts, for the Arrow-batched operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_A, _B, _C = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x + _C
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered; forgets everything at ``bound`` words, so memory is bounded."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at spaces and the controls 9 to 13; nothing else separates."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence if it is shorter; else empty."""
    w = words(text)
    if not w:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, w), U, len(w))
    n = len(h)
    if n < width:
        acc = mix64(np.array([n], U))
        for i in range(n):
            acc = mix64(acc * _A + h[i : i + 1])
        return acc
    acc = h[: n - width + 1].copy()
    for j in range(1, width):
        acc = acc * _A + h[j : n - width + 1 + j]
    return np.unique(mix64(acc))


def shingle_sets(texts: list[str | None], hashes: WordHashes, width: int = 5) -> list[np.ndarray]:
    """``shingles`` of each text, hashed in one go."""
    found = [words(t) for t in texts]
    sizes = [len(w) for w in found]
    ends = np.cumsum(sizes).tolist()
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(found)), U, ends[-1] if ends else 0)
    acc = h.copy()
    for j in range(1, width):
        acc *= _A
        acc[: max(0, len(h) - j)] += h[j:]
    acc = mix64(acc)
    out = []
    for t, n, end in zip(texts, sizes, ends, strict=True):
        if n < width:
            out.append(shingles(t, hashes, width))
            continue
        own = np.sort(acc[end - n : end - width + 1])
        new = np.empty(len(own), bool)
        new[0] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
    return out


def release() -> None:
    """Give back what a reused worker process has left of its earlier tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator, max_bytes: int = 4 << 20) -> Iterator:
    """Arrow batches cut into slices of about ``max_bytes``, at least one row each: bounds what a step holds."""
    release()
    for b in batches:
        step = max(1, int(b.num_rows * max_bytes / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    b = None
    release()
