"""Token ids of whole texts, with each distinct piece of a batch encoded once.

Byte-level BPE never merges across the borders its pattern sets. One such border lies before the last white-space byte of
every run that is followed by a word, another before ASCII punctuation that follows a letter or digit. A text is cut there,
the distinct pieces of a batch are encoded once, and their ids are gathered again. Texts that hold white space outside
ASCII, where the pattern may group otherwise, are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .words import SPACE, buffers, mix, powers, _BYTE

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1_000_000
#: Distinct pieces whose ids a Python worker keeps between chunks; beyond, it starts again.
KEPT = 1_200_000
#: Pieces encoded at once: the library's encodings are large.
SLICE = 4096
#: White space outside ASCII, in UTF-8.
_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
_MAY_START = np.zeros(256, bool)
_MAY_START[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_MARK, _WORD, _LATIN = (np.zeros(256, bool) for _ in range(3))
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True  # behind 0xC3: letters with accents


class Encoder:
    """Ids of texts by a tokenizers file; special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        """Known pieces lie in two sorted runs, a long one and a recent one that is merged into it as it grows; their ids lie in
        one array that doubles. So learning costs in proportion to what is new."""
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.runs = [none, none]
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0

    def __len__(self) -> int:
        return sum(len(run[0]) for run in self.runs)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and number of the ids of each piece, and which pieces are not known."""
        begin, count, new = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32), np.ones(len(hashes), bool)
        for known, starts, counts in self.runs:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                begin[hit], count[hit], new[hit] = starts[at[hit]], counts[at[hit]], False
        return begin, count, new

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces that are new; begin and number of their ids."""
        counts, ids = [], []
        for k in range(0, len(pieces), SLICE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k:k + SLICE], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int32, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(counts[-1].sum())))
        count, size = np.concatenate(counts), sum(map(len, ids))
        begin = self.used + np.cumsum(count, dtype=np.int64) - count
        if self.used + size > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(self.used, size) + size, np.int32)])
        np.concatenate(ids, out=self.flat[self.used:self.used + size])
        self.used += size
        self.runs[1] = self._merged(self.runs[1], (hashes, begin, count))
        if len(self.runs[1][0]) > max(1 << 16, len(self.runs[0][0]) // 4):
            self.runs = [self._merged(*self.runs), tuple(x[:0] for x in self.runs[1])]
        return begin, count

    @staticmethod
    def _merged(one: tuple, other: tuple) -> tuple:
        both = [np.concatenate(pair) for pair in zip(one, other)]
        order = np.argsort(both[0], kind="stable")  # two sorted runs: linear
        return tuple(x[order] for x in both)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (first text, ids of some texts, offsets of each text's ids); a null text has no ids."""
        data, at = buffers(texts)
        n, i = len(at) - 1, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            yield i, *self._some(data[at[i]:at[j]], at[i:j + 1] - at[i])
            i = j

    def _some(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        size = len(data)
        if not size:
            return np.zeros(0, np.int32), np.zeros(len(text), np.int64)
        odd = [m.start() for m in _OTHER_SPACE.finditer(raw)] if _MAY_START[data].any() else []
        odd = np.unique(np.searchsorted(text, odd, "right") - 1)
        space = SPACE[data]
        cut = np.zeros(size, bool)
        cut[:-1] = space[:-1] & ~space[1:]
        cut[text[1:][text[1:] > 0] - 1] = False  # white space that ends a text stays together
        cut[text[:-1][text[:-1] < size]] = True
        mark = np.flatnonzero(_MARK[data[1:]] & (_WORD[data[:-1]] | _LATIN[data[:-1]])) + 1
        mark = mark[_WORD[data[mark - 1]] | (data[np.maximum(mark - 2, 0)] == 0xC3)]
        cut[mark] = True
        for k in odd:
            cut[text[k] + 1:text[k + 1]] = False
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, size))
        x = _BYTE[data]
        place = np.arange(size) - np.repeat(starts, lengths)
        x *= powers(int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(x, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        del x, place
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self) + len(distinct) > KEPT:
            self._forget()
        begin, count, new = self._find(distinct)
        new = np.flatnonzero(new)
        if len(new):
            a = starts[one[new]]
            begin[new], count[new] = self._learn(distinct[new], [raw[x:y].decode() for x, y in zip(a.tolist(), (a + lengths[one[new]]).tolist())])
        own = count[which].astype(np.int64)
        ends = np.cumsum(own)
        out = self.flat[np.repeat(begin[which] - (ends - own), own) + np.arange(ends[-1])]
        piece_ends = np.concatenate([np.zeros(1, np.int64), ends])
        return out, piece_ends[np.searchsorted(starts, text)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
