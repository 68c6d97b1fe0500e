"""Periodic runs of words by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are the same) that no neighbouring
word extends, of at least ``REPEATS`` periods and ``LEAST`` words.

1. Words become numbers.  For each text, the matches of every lag (places ``i`` with the same word at ``i`` and ``i + lag``)
   are counted exactly: for frequent ("heavy") words by the FFT autocorrelation of their places, for all others by the
   differences of their pairs of places, all texts of a batch together.  A word is heavy where its pairs would cost more
   than the transform, so a text of n words takes at most about n ** 1.5 steps.
2. A run of period ``q`` has at least ``max(REPEATS * q, LEAST) - q`` matches of lag ``q``, so only lags with as many are
   scanned for islands of consecutive matches; an island is a run unless a divisor of ``q`` is a period of it, too.

Runs of one text are found in the task that reads it, so nothing is shuffled; a batch's memory is bounded by ``chunks``, and a
very long text is a batch of its own.

Defined results: a null text has no words and no runs and collapses to the empty text; texts of any length are read whole;
rows that repeat are treated alike; an empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.shared import bounded_batches
from lodestone.llm.words import chunks

REPEATS, LEAST = 4, 6
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Times the steps of a transform (n log n) that its numbers take, against those of a pair of places.
FFT_COST = 4

RUN = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def cut(text: bytes) -> Iterator[list[bytes]]:
    """Words between blanks and the controls 9 to 13, some at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def numbered(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number in order of first places, and the words by number."""
    of: dict[bytes, int] = {}
    parts = [np.array([of.setdefault(w, len(of)) for w in words], np.int32) for words in cut(text or b"")]
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), list(of)


def lag_matches(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text of word numbers: how many matches the lags 0 to n // REPEATS have (lag 0 counts none)."""
    sizes = np.array([len(w) for w in texts], np.int64)
    room = sizes // REPEATS + 1
    base = np.concatenate([[0], np.cumsum(room)])
    counts = np.zeros(base[-1], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    kinds = np.array([int(w.max()) + 1 if len(w) else 0 for w in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(kinds)])
    word = np.concatenate([w.astype(np.int64) + o for w, o in zip(texts, offset, strict=False)] or [np.empty(0, np.int64)])
    often = np.bincount(word, minlength=int(offset[-1]))
    cost = FFT_COST * sizes * np.log2(2 * sizes + 2)
    heavy = often * (often - 1) / 2 > np.repeat(cost, kinds)
    for t in np.unique(np.searchsorted(offset, np.flatnonzero(heavy), side="right") - 1):
        own = texts[t]
        width = 1 << int(2 * len(own) - 1).bit_length()
        power = np.zeros(width // 2 + 1)
        for w in np.flatnonzero(heavy[offset[t] : offset[t + 1]]):
            f = np.fft.rfft(own == w, width)
            power += f.real**2 + f.imag**2
        counts[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, width)[: room[t]]).astype(np.int64)
    # light words: places by word; pairs k places apart in that order, as long as word and reach hold
    order = np.argsort(word, kind="stable")
    order = order[~heavy[word[order]]]
    text_of = np.repeat(np.arange(len(texts)), sizes)[order]
    group = word[order]
    reach, lag_base = room[text_of], base[text_of]
    left, k = np.arange(len(order)), 0
    while len(left):
        k += 1
        left = left[: np.searchsorted(left, len(order) - k)]
        lag = order[left + k] - order[left]
        ok = (group[left + k] == group[left]) & (lag < reach[left])
        left, lag = left[ok], lag[ok]
        counts += np.bincount(lag_base[left] + lag, minlength=len(counts)) if 4 * len(left) > len(counts) else 0
        if 4 * len(left) <= len(counts):
            np.add.at(counts, lag_base[left] + lag, 1)
    counts[base[:-1]] = 0
    return [counts[a:b] for a, b in pairwise(base)]


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + ([n] if n > 1 else [])


def runs_of(word: np.ndarray, matches: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start, then period."""
    lags = np.arange(len(matches))
    out = []
    for q in np.flatnonzero((lags > 0) & (matches >= np.maximum(REPEATS * lags, LEAST) - lags)).tolist():
        same = np.zeros(len(word) - q + 2, bool)
        np.equal(word[q:], word[:-q], out=same[1:-1])
        turns = np.flatnonzero(same[1:] != same[:-1])
        first, last = turns[::2], turns[1::2]
        wide = last - first + q >= max(REPEATS * q, LEAST)
        for a, b in zip(first[wide].tolist(), (last[wide] + q).tolist(), strict=True):
            part = word[a:b]
            if not any(np.array_equal(part[q // p :], part[: -(q // p)]) for p in prime_factors(q)):
                out.append((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(word: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those in any run after its first period."""
    keep = np.ones(len(word), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join(map(words.__getitem__, word[keep].tolist()))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Callable[[object, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``key``, n_words, ``runs`` (array of start, length, period; by start, then period) and ``collapsed`` (the text without
    repetitions).  ``edit(key, word numbers)`` may rearrange a text's words before they are searched."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(f"n_words long, runs {RUN}, collapsed string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            keys = b.column(0).to_pylist() if edit else []
            words, names = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                w, own = numbered(t)
                words.append(edit(keys[i], w) if edit else w)
                names.append(own)
            found = [runs_of(w, m) for w, m in zip(words, lag_matches(words), strict=True)]
            texts = [collapsed(w, own, r) for w, own, r in zip(words, names, found, strict=True)]
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            made = [pa.array([len(w) for w in words], pa.int64()), pa.array(rows, _RUN), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=[key, "n_words", "runs", "collapsed"])

    return docs.select(docs[key], docs[text].cast("binary").alias("_body")).mapInArrow(run, schema)


def repeat_tail(key: object, words: np.ndarray) -> np.ndarray:
    """Op12's edit: one text in ten, by its id's checksum, ends in a repeated stretch; a null id's text stays as it is."""
    import zlib

    h = 1 if key is None else zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    i = np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return np.concatenate([words[:a], words[a + i]])
