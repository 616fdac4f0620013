"""Words of whole texts as flat numpy arrays, computed per Arrow batch inside a task.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Those six
are single bytes in UTF-8 and never part of another character, so splitting bytes and splitting characters agree. A null
or empty text has no words. Words are compared by a 64-bit hash of their bytes and length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words of letters and digits, and between words of letters alone; bytes of other alphabets are letters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1_000_000


def tidied(run: Callable) -> Callable:
    """A function over Arrow batches that, when its task ends, gives the memory it has freed back to the system. Python workers
    live on between tasks, and what their allocators keep adds up beside the next stage's."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finishing steps of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the hash base, kept between calls while they are few."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024), _BASE, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if n > 1 << 20:
            return p
        _POWERS = p
    return _POWERS


@dataclass
class Words:
    """Some whole texts of a batch: text ``first + i`` has bytes ``text[i]:text[i + 1]`` and words ``word[i]:word[i + 1]``.

    ``raw`` are the bytes as they are, ``data`` may be lower-cased.
    """

    first: int
    raw: np.ndarray
    data: np.ndarray
    text: np.ndarray
    word: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.text) - 1

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.word))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte offsets of a string array; a null has length zero."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def segment_sum(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; an empty stretch sums to zero."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[starts[1:n + 1]] - total[starts[:n]]


def chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK, gaps: np.ndarray = SPACE) -> Iterator[Words]:
    """Words of all texts, some texts at a time. ``gaps`` marks the bytes, after lower-casing, that part words."""
    data, at = buffers(texts)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield _words(i, data[at[i]:at[j]], at[i:j + 1] - at[i], lower, gaps)
        i = j


def _words(first: int, data: np.ndarray, text: np.ndarray, lower: bool, spaces: np.ndarray) -> Words:
    raw = data
    if lower:
        data = LOWER[data]
    size = len(data)
    inside = ~spaces[data]
    edge = np.zeros(size + 1, bool)
    edge[text] = True
    before = np.concatenate([[False], inside[:-1]]) if size else inside
    starts = np.flatnonzero(inside & (~before | edge[:size]))
    after = np.concatenate([inside[1:], [False]]) if size else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if len(starts):
        lengths = ends - starts
        x = _BYTE[data[starts[0]:]]
        x[~inside[starts[0]:]] = 0
        gaps = np.diff(np.append(starts, size))
        place = np.arange(starts[0], size) - np.repeat(starts, gaps)
        longest = int(lengths.max())
        np.minimum(place, longest, out=place)
        x *= powers(longest + 1)[place]
        hashes = mix(np.add.reduceat(x, starts - starts[0]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(first, raw, data, text, np.searchsorted(starts, text), starts, ends, hashes)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, across text borders too: the caller leaves those out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k: k + len(out)]
    return mix(out)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles of one text, sorted; a text of fewer words is one shingle, one without words has none."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(n, len(hashes))))
