r"""Quality rules: a linear-chain conditional random field marks the lines of a document as content or boilerplate.

Lines with a word form a sequence of two states. Their features are length, shares of symbols, capitals, digits, marks and
repeats, and whether the line came before. Weights are fitted by maximum likelihood (forward-backward gradients) on
documents labelled for quality, every line carrying its document's label; the number of documents is bounded by
``sample``, all whole texts. Viterbi decoding then labels the lines of every document, and the share of words on content lines
decides: it is kept if the share reaches ``least`` and the base rules hold (50 words at least, and at most half of the
words in repeated three-word windows).

Defined cases: a null, empty or blank text has zero counts, content share 0 and fails the base rule; without labelled
documents all lines are content; repeated rows are judged alike; an empty table gives no rows; other columns are kept by
``kept_documents`` and ignored by ``judged``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .words import SPACE, Words, chunks, mix, segment_sum, tidied, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
FEATURES = 10
_SYMBOL, _UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_MARK[list(b"!?|")] = True


def measured(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text (columns as COUNTS), and for all lines with a word: features, words, and the offsets of each text's lines."""
    size, n, doc = len(w.data), len(w), w.doc()
    continued = (w.data & 0xC0) == 0x80
    chars = np.concatenate([np.zeros(1, np.int64), np.cumsum(~continued & ~SPACE[w.data], dtype=np.int64)])
    symbols = np.concatenate([np.zeros(1, np.int64), np.cumsum(_SYMBOL[w.data], dtype=np.int64)])

    triple = windows(w.hashes, 3)
    inside = doc[:len(triple)] == doc[2:] if len(triple) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    _, which, times = np.unique(triple[at] + mix(doc[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    repeated = np.zeros(len(w.hashes) + 2, bool)
    for k in range(3):
        repeated[at[times[which] > 1] + k] = True
    repeated = repeated[:len(w.hashes)]

    breaks = np.flatnonzero(w.data == 10) + 1
    begin = np.union1d(breaks, w.text[:-1])
    begin = begin[begin < size]
    end = np.append(begin[1:], size)
    word = np.searchsorted(w.starts, np.append(begin, size))
    words = np.diff(word)
    some = words > 0
    begin, end, first, words = begin[some], end[some], word[:-1][some], words[some]
    line_doc = doc[first] if len(first) else np.zeros(0, np.int32)
    own = np.repeat(np.arange(len(begin)), words)
    picked = np.repeat(first, words) + np.arange(len(own)) - np.repeat(np.cumsum(words) - words, words)
    same = mix(w.hashes[picked] ^ mix((w.starts[picked] - begin[own]).astype(np.uint64)))
    length = end - begin - (w.data[end - 1] == 10 if len(end) else 0)
    key = mix(length.astype(np.uint64)) + (np.add.reduceat(same, np.cumsum(words) - words) if len(same) else np.zeros(0, np.uint64))
    odd = np.flatnonzero(SPACE[w.data] & (w.data != 32) & (w.data != 10))
    if len(odd) and len(begin):
        line = np.searchsorted(begin, odd, "right") - 1
        ok = (line >= 0) & (odd < end[line])
        np.add.at(key, line[ok], mix((odd[ok] - begin[line[ok]]).astype(np.uint64) * np.uint64(256) + w.data[odd[ok]]))
    _, earliest, which = np.unique(key + mix(line_doc.astype(np.uint64) + np.uint64(1 << 40)), return_index=True, return_inverse=True)
    again = earliest[which] != np.arange(len(key)) if len(key) else np.zeros(0, bool)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
        return total[end] - total[begin]

    line_chars = np.maximum(chars[end] - chars[begin], 1)
    twice = np.zeros(len(w.hashes), bool)
    twice[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    by_word = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([repeated, twice], 1), axis=0, dtype=np.int64)])
    in_words = (by_word[first + words] - by_word[first]) / np.maximum(words, 1)[:, None]
    features = np.stack([
        np.ones(len(begin)), np.log1p(words) / 4, np.minimum(8 * per_line(_SYMBOL[w.data]) / line_chars, 2), per_line(_UPPER[w.data]) / np.maximum(per_line(_LETTER[w.data]), 1),
        per_line(_DIGIT[w.data]) / line_chars, np.minimum(8 * per_line(_MARK[w.data]) / line_chars, 2), in_words[:, 0], in_words[:, 1], again,
        np.minimum(line_chars / np.maximum(words, 1) / 10, 2)], axis=1).astype(np.float32) if len(begin) else np.zeros((0, FEATURES), np.float32)

    lines = np.searchsorted(line_doc, np.arange(n + 1))
    counts = np.stack([np.diff(w.word), chars[w.text[1:]] - chars[w.text[:-1]], symbols[w.text[1:]] - symbols[w.text[:-1]],
                       segment_sum(again, lines, n), segment_sum(repeated, w.word, n)], axis=1)
    return counts, features, words, lines


class Chain:
    """A two-state chain (0 content, 1 boilerplate): emission weights of state 1 against state 0, and transition scores."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps

    def decode(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Viterbi: the best state of every line; content where scores tie. Sequences advance together, longest first."""
        scores = features @ self.weights
        sizes = np.diff(lines)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        states = np.zeros(len(scores), bool)
        if not len(order):
            return states
        begin, sizes = lines[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        best = np.stack([np.zeros(len(order)), scores[begin]], 1)
        back = np.zeros((len(scores), 2), bool)
        for t in range(1, sizes[0]):
            m = active[t]
            at = begin[:m] + t
            way = best[:m, :, None] + self.steps[None]
            back[at] = way[:, 1] > way[:, 0]
            best[:m] = way.max(1)
            best[:m, 1] += scores[at]
        now = best[:, 1] > best[:, 0]
        for t in range(sizes[0] - 1, -1, -1):
            m = active[t]
            at = begin[:m] + t
            states[at] = now[:m]
            now[:m] = back[at, now[:m].astype(np.int64)]
        return states

    def fit(self, features: np.ndarray, lines: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.5, penalty: float = 1e-3) -> Chain:
        """Maximum likelihood by gradient ascent with momentum; ``labels`` has a state for every line."""
        sizes = np.diff(lines)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        begin, sizes = lines[order], sizes[order]
        if not len(order):
            return self
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        n, y = len(labels), labels.astype(np.float64)
        seen = np.zeros((2, 2))
        pair = np.ones(n, bool)
        pair[begin] = False
        np.add.at(seen, (labels[np.flatnonzero(pair) - 1].astype(int), labels[pair].astype(int)), 1)
        speed_w, speed_s = np.zeros(FEATURES), np.zeros((2, 2))
        for _ in range(rounds):
            scores = features @ self.weights
            emit = np.stack([np.zeros(n), scores], 1)
            ahead = np.zeros((n, 2))
            ahead[begin] = emit[begin]
            for t in range(1, sizes[0]):
                at = begin[:active[t]] + t
                ahead[at] = np.logaddexp(ahead[at - 1, 0, None] + self.steps[0], ahead[at - 1, 1, None] + self.steps[1]) + emit[at]
            behind = np.zeros((n, 2))
            for t in range(sizes[0] - 1, 0, -1):
                at = begin[:active[t]] + t
                x = emit[at] + behind[at]
                behind[at - 1] = np.logaddexp(x[:, 0, None] + self.steps[:, 0], x[:, 1, None] + self.steps[:, 1])
            whole = np.repeat(np.logaddexp(*(ahead[begin + sizes - 1].T)), sizes)
            place = np.concatenate([np.arange(b, b + s) for b, s in zip(begin, sizes)])
            z = np.empty(n)
            z[place] = whole
            p = np.exp(ahead[:, 1] + behind[:, 1] - z)
            at = np.flatnonzero(pair)
            joint = np.exp(ahead[at - 1][:, :, None] + self.steps[None] + (emit[at] + behind[at])[:, None, :] - z[at][:, None, None]).sum(0)
            speed_w = 0.9 * speed_w + features.T @ (y - p) / n - penalty * self.weights
            speed_s = 0.9 * speed_s + (seen - joint) / n - penalty * self.steps
            self.weights = self.weights + rate * speed_w
            self.steps = self.steps + rate * speed_s
        return self


def labelled_lines(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Line features of labelled documents: (quality, n_lines, features as bytes). The first ``sample`` by a hash of doc_id."""
    own = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            quality = batch.column(names.index("quality"))
            for w in chunks(batch.column(names.index("text")), size=1_000_000):
                _, features, _, lines = measured(w)
                blobs = [features[a:b].tobytes() for a, b in zip(lines[:-1].tolist(), lines[1:].tolist())]
                yield pa.RecordBatch.from_arrays([quality.slice(w.first, len(w)).cast(pa.int32()), pa.array(np.diff(lines)), pa.array(blobs, pa.binary())],
                                                 names=["quality", "n_lines", "features"])

    return small_batches(docs.select("doc_id", "text")).join(own, "doc_id").select("quality", "text").mapInArrow(tidied(run), "quality int, n_lines long, features binary")


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> Chain:
    """The chain fitted on at most ``sample`` labelled documents (a bound of the fit only; every document is judged)."""
    rows = sorted((r["n_lines"], r["quality"], bytes(r["features"])) for r in labelled_lines(docs, labels, sample).collect())
    rows = [r for r in rows if r[0]]
    if not rows:
        return Chain()
    sizes = np.array([r[0] for r in rows])
    features = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    junk = np.repeat(np.array([r[1] == 0 for r in rows]), sizes)
    return Chain().fit(features, np.concatenate([[0], np.cumsum(sizes)]), junk)


def _verdicts(w: Words, chain: Chain, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts, features, words, lines = measured(w)
    content = ~chain.decode(features, lines)
    share = segment_sum(words * content, lines, len(w)) / np.maximum(counts[:, 0], 1)
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    return counts, failed, ~failed & (share >= least), share


def judged(docs: DataFrame, chain: Chain, least: float = 0.5) -> DataFrame:
    """Counts, base verdict, verdict and content share of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id"))
            for w in chunks(batch.column(batch.schema.names.index("text")), size=1_000_000):
                counts, failed, kept, share = _verdicts(w, chain, least)
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, len(w)).cast(pa.int64()), *[pa.array(counts[:, k]) for k in range(5)],
                                                  pa.array(failed), pa.array(kept), pa.array(share)], names=[x.split()[0] for x in JUDGED.split(", ")])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidied(run), JUDGED)


def kept_documents(docs: DataFrame, chain: Chain, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_verdicts(w, chain, least)[2] for w in chunks(batch.column(batch.schema.names.index("text")), size=1_000_000)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return small_batches(docs).mapInArrow(tidied(run), docs.schema)
