"""Language-model scoring: a Katz backoff bigram model, counted and evaluated in buckets of histories.

Model. Good-Turing discounts counts up to ``K``; larger ones give up ``ABOVE`` of a count, so every history keeps mass for
words it was not seen with. Every training word is a class of its own and a history of its own; words never seen are a class
that has what the unigram discounts leave, and is never seen after any history. (With a ``vocabulary``, a smaller model: only
so many of the most frequent words are classes; all others share one, inside which they keep their own discounted unigram
probability.) For a history h and class w

    p(w | h) = (c(h, w) - discount) / c(h)              if the pair was seen
             = alpha(h) * p(w)                          otherwise, p(w) itself if h was never seen

    alpha(h) = (sum of discounts after h / c(h)) / (1 - sum of p(w) over the classes seen after h)

so probabilities after any history sum to one. Logarithms have base 10.

Counting and scoring. Counts are exact and cover all training documents. Word counts are an aggregate; the ``TABLE`` most
frequent words have numbers that every task knows. Then each block of documents sends its tokens once, sorted and packed, to
buckets: pairs of numbered words by history (pairs of the few very frequent histories by the pair, so none is one task's
load), pairs with any other, rare word by that word, the second one if both are rare. A bucket holds every occurrence of its
pairs, so it counts them and looks up what each document needs there; it returns, per block, how many tokens of each document
had count 1..K, and sums of logarithms for the rest. What depends on totals of the whole corpus (discounts, alpha) is applied
at the end, when the parts of a block meet; the discounts after a rare history come from several buckets and are joined to the
tokens that back off from it. Buckets are sized by the number of tokens; as one very frequent pair may have far more, parts are cut
to ``PART_TOKENS``, a bucket keeps the distinct pairs only, and its parts beyond ``HELD_BYTES`` wait in a temporary file until
the counts are known. What it returns names the documents it met, so its size goes with the tokens, not with documents times
buckets. The count tables and the parts are written to the shared folder; the driver sees totals and the tables of the numbered words.

Defined cases: null, empty or blank texts are the end token alone; a document that repeats is scored on each row; a null
doc_id is a training document; without training documents all scores are 0; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches, stored
from .words import chunks, mix, tidied

K, ABOVE = 5, 0.5
#: Bytes of text and documents of one block, tokens of one bucket, and a history's share of all tokens that makes it frequent.
BLOCK_BYTES, BLOCK_DOCS, BUCKET_TOKENS, FREQUENT = 5_000_000, 60_000, 2_500_000, 1e-3
#: Rows that a bucket gives out at once.
OUT_ROWS = 2_000
#: Tokens of one part, bytes of parts of one kind that a task holds, and distinct pairs that it gathers before it combines them.
PART_TOKENS, HELD_BYTES, GATHERED = 20_000, 32_000_000, 1_000_000
#: Words with a number that every task knows; all others go by their hashes.
TABLE = 400_000
_SHIFT, _RARE = np.uint64(24), np.uint64(1 << 63)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def packed(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sq", a.dtype.str.encode(), a.size) for a in arrays)
    return head + b"".join(a.tobytes() for a in arrays)


def unpacked(data: bytes) -> list[np.ndarray]:
    n, at, out = data[0], 1, []
    heads = [struct.unpack_from("<3sq", data, at + 11 * k) for k in range(n)]
    at += 11 * n
    for kind, size in heads:
        kind = np.dtype(kind.decode())
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


class Parts:
    """Numbered parts of a bucket, to be read more than once; those beyond ``HELD_BYTES`` are in a temporary file of the task."""

    def __init__(self):
        self.kept, self.size, self.file = [], 0, None

    def append(self, number: int, data: bytes) -> None:
        self.kept.append((number, data))
        self.size += len(data)
        if self.size > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            for number, data in self.kept:
                self.file.write(struct.pack("<qq", number, len(data)) + data)
            self.kept, self.size = [], 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        if self.file:
            self.file.seek(0)
            while head := self.file.read(16):
                number, size = struct.unpack("<qq", head)
                yield number, self.file.read(size)
        yield from self.kept


def discounted(totals: np.ndarray) -> np.ndarray:
    """What counts 0..K are worth: Good-Turing with Katz's renormalisation. ``totals[r]`` types have count r = 1..K+1.

    Where a discount leaves (0, 1), as in small corpora, all counts give up n1 / (n1 + 2 n2) instead (half a count if n1 is 0).
    """
    n = totals.astype(np.float64)
    worth = np.zeros(K + 1)
    if (n[1:K + 2] > 0).all():
        lost = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        d = ((r + 1) * n[2:K + 2] / n[1:K + 1] / r - lost) / (1 - lost) if lost < 1 else np.zeros(K)
        if ((d > 0) & (d < 1)).all():
            worth[1:] = d * r
            return worth
    step = n[1] / (n[1] + 2 * n[2]) if n[1] else ABOVE
    worth[1:] = np.arange(1, K + 1) - min(max(step, 0.05), 0.95)
    return worth


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, train, tokens): occurrences of each word, by its hash, in training documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            words, train, total = [], [], []
            for w in chunks(batch.column(0), lower=True):
                distinct, which = np.unique(w.hashes, return_inverse=True)
                words.append(distinct)
                train.append(np.bincount(which, weights=~held[w.first + w.doc()], minlength=len(distinct)).astype(np.int64))
                total.append(np.bincount(which, minlength=len(distinct)))
            if words:
                distinct, which = np.unique(np.concatenate(words), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *[pa.array(np.bincount(which, weights=np.concatenate(x), minlength=len(distinct)).astype(np.int64)) for x in (train, total)]],
                                                 names=["word", "train", "tokens"])

    rows = docs.select("text", held_out().alias("held")).mapInArrow(tidied(run), "word long, train long, tokens long")
    return stored(rows.groupBy("word").agg(F.sum("train").alias("train"), F.sum("tokens").alias("tokens")), "word-counts")


class Totals:
    """Corpus totals and the numbered words: sorted hashes, their training counts, and what the unigram level needs."""

    def __init__(self, counts: DataFrame, docs: DataFrame, vocabulary: int | None):
        self.whole = vocabulary is None  # every word is a class
        t = counts.agg(F.sum("train"), F.sum("tokens"), F.count(F.when(F.col("train") > 0, 1)), *[F.count(F.when(F.col("train") == r, 1)) for r in range(1, K + 2)]).first()
        d = docs.agg(F.count(F.lit(1)), F.count(F.when(~held_out(), 1))).first()
        self.docs, self.train_docs = d[0], d[1]
        self.n, self.all, self.v = (t[0] or 0) + self.train_docs, (t[1] or 0) + self.docs, (t[2] or 0) + (self.train_docs > 0)
        top = counts.where("train > 0").orderBy(F.desc("train"), "word").limit(TABLE if self.whole else vocabulary).toArrow()
        words, own = top.column("word").to_numpy().view(np.uint64), top.column("train").to_numpy()
        order = np.argsort(words)
        self.words, self.counts = words[order], own[order].astype(np.int64)
        self.size = len(self.words)
        self.other, self.end, self.begin = self.size, self.size + 1, self.size + 2
        types = np.array([0, *t[3:]], np.int64)
        if 0 < self.train_docs <= K + 1:
            types[self.train_docs] += 1
        self.worth = discounted(types)
        r = np.arange(K + 1)
        freed = ((r - self.worth) * types[:K + 1]).sum() + ABOVE * (self.v - types[:K + 1].sum())
        self.unknown = freed / self.n if self.n else 1.0  # probability of words never seen
        self.classes = np.concatenate([self.counts, [max(self.n - self.train_docs - int(self.counts.sum()), 0), self.train_docs, self.train_docs]])

    def value(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > K, counts - ABOVE, self.worth[np.minimum(counts, K)])

    def class_chances(self) -> np.ndarray:
        """Unigram probability of every class but that of words never seen."""
        p = np.zeros(self.size + 2)
        if self.n:
            p[:self.size] = self.value(self.counts) / self.n
            p[self.end] = self.value(np.array([self.train_docs]))[0] / self.n
        p[self.other] = max(1 - p.sum() - self.unknown, 0)
        return p


PARTS = "kind int, bucket int, block long, data binary"
COUNTED = "kind int, block long, data binary, h long, " + ", ".join(f"n{r} long" for r in range(1, K + 2)) + ", seen double, others long"
_INFO, _PAIRS, _WORDS, _TYPES, _TAILS, _HEADS, _UNSEEN, _KNOWN = range(8)


def _blocks(docs: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """The tokens of all documents, packed by block and bucket, and one row of document facts per block."""
    vocabulary, base = totals.words, np.log10(np.append(totals.counts, totals.train_docs) + 1) - np.log10(totals.n + totals.v + 1)
    other, end, begin, whole = totals.other, totals.end, totals.begin, totals.whole
    frequent = totals.classes > FREQUENT * max(totals.n, 1)

    def block(number: int, ids: list, held: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        n = len(ids)
        doc = np.repeat(np.arange(n), sizes)
        at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
        sums = np.bincount(doc, weights=np.where(known, base[at] if len(vocabulary) else 0.0, 0.0), minlength=n) + base[-1]
        facts = packed(np.array([_INFO], np.int64), np.array([-1 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]), held, sizes + 1,
                       np.bincount(doc, weights=known, minlength=n).astype(np.int64) + (totals.train_docs > 0), sums)
        yield _INFO, number % buckets, number, facts
        flags = np.packbits(held)
        # pairs: each document is its words and the end, each after the one before or the beginning
        ends = np.cumsum(sizes + 1)
        w = np.empty(len(words) + n, np.uint64)
        w[ends - 1] = end
        rest = np.ones(len(w), bool)
        rest[ends - 1] = False
        w[rest] = np.where(known, at.astype(np.uint64), words | _RARE if whole else np.uint64(other))
        h = np.concatenate([np.array([begin], np.uint64), w[:-1]])
        h[ends[:-1]] = begin
        of = np.repeat(np.arange(n), sizes + 1).astype(np.uint16)
        new, after = w >= _RARE, h >= _RARE
        both = np.flatnonzero(~(new | after))
        pair = (h[both] << _SHIFT) | w[both]
        yield from cut(_PAIRS, number, pair, to_bucket(np.where(frequent[h[both].astype(np.int64)], pair, h[both])), of[both], flags, n)
        if whole:
            yield from cut(_WORDS, number, w[new], to_bucket(w[new]), of[new], flags, n, h[new])
            tail = after & ~new
            yield from cut(_TAILS, number, h[tail], to_bucket(h[tail]), of[tail], flags, n, w[tail].astype(np.uint32))
        else:
            rare = np.flatnonzero(~known)
            yield from cut(_WORDS, number, words[rare], to_bucket(words[rare]), doc[rare].astype(np.uint16), flags, n, h[rest][rare].astype(np.uint32))

    def to_bucket(keys: np.ndarray) -> np.ndarray:
        return (mix(keys) % np.uint64(buckets)).astype(np.int32)

    def cut(kind: int, number: int, keys: np.ndarray, bucket: np.ndarray, of: np.ndarray, flags: np.ndarray, n: int, heads: np.ndarray = np.zeros(0, np.uint32)) -> Iterator[tuple]:
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        keys, bucket, of, heads = keys[order], bucket[order], of[order], heads[order] if len(heads) else heads
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
        edge = np.unique(np.concatenate([edge, np.arange(0, len(keys), PART_TOKENS)])) if len(keys) else edge
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            first = np.concatenate([[0], np.flatnonzero(np.diff(keys[a:b])) + 1])
            own = keys[a:b][first]
            step = np.diff(own, prepend=own[:1])
            times = np.diff(np.append(first, b - a))
            small = step.max() < 1 << 32
            yield kind, int(bucket[a]), number, packed(np.array([n], np.int64), flags, own[:1], step.astype(np.uint32 if small else np.uint64),
                                                       times.astype(np.uint8 if times.max() < 256 else np.uint32), of[a:b], heads[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, held, words, sizes, text = [], [], [], [], 0

        def flush():
            nonlocal number, text
            rows = list(block(number, ids, np.array(held, bool), np.concatenate(words), np.concatenate(sizes)))
            number, text = number + 1, 0
            for x in (ids, held, words, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                                               pa.array([r[3] for r in rows], pa.binary())], names=["kind", "bucket", "block", "data"])

        for batch in batches:
            own, out = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for w in chunks(batch.column(1), lower=True):
                for a in range(0, len(w), BLOCK_DOCS // 2):
                    b = min(a + BLOCK_DOCS // 2, len(w))
                    ids += own[w.first + a:w.first + b]
                    held += out[w.first + a:w.first + b].tolist()
                    words.append(w.hashes[w.word[a]:w.word[b]])
                    sizes.append(np.diff(w.word[a:b + 1]))
                    text += int(w.text[b] - w.text[a])
                    if text > BLOCK_BYTES or len(ids) >= BLOCK_DOCS // 2:
                        yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(tidied(run), PARTS)


def _counted(parts: DataFrame, totals: Totals) -> DataFrame:
    """What the buckets tell: per block and document the counts met, per history its discounts, and counts of counts."""
    chances, log_class = totals.class_chances(), np.log10(np.maximum(totals.classes, 1))
    base = np.log10(totals.n + totals.v + 1)

    def tokens_of(data: bytes) -> tuple:
        """Documents of the block, its held-out ones, distinct keys of a part, and the key, the document and the other word of each token."""
        head, flags, first, step, times, of, heads = unpacked(data)
        own = first[0] + np.cumsum(step.astype(np.uint64))
        return int(head[0]), np.unpackbits(flags, count=int(head[0])).astype(bool), own, np.repeat(np.arange(len(own), dtype=np.int32), times), of, heads

    def counts_of(parts: Parts) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of a bucket, and the training count of each."""
        keys, use, size = [], [], 0

        def combined() -> tuple[np.ndarray, np.ndarray]:
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            return distinct, np.bincount(back, weights=np.concatenate(use), minlength=len(distinct)).astype(np.int64)

        for _, data in parts:
            _, held, own, which, of, _ = tokens_of(data)
            keys.append(own)
            use.append(np.bincount(which, weights=~held[of], minlength=len(own)))
            size += len(own)
            if size > GATHERED:
                keys, use = ([x] for x in combined())
                size = 0
        return combined()

    def by_doc(of: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The documents met, which of them each token belongs to, and for each the tokens of count 0..K and the sum of logarithms
        of larger counts."""
        docs, of = np.unique(of, return_inverse=True)
        hist = np.bincount(of * (K + 2) + np.minimum(own, K + 1), minlength=len(docs) * (K + 2))
        big = own > K
        return docs, of, [docs, hist.astype(np.uint16 if hist.max() < 1 << 16 else np.uint32), np.bincount(of[big], weights=np.log10(own[big] - ABOVE), minlength=len(docs))]

    def with_rare(kind: int, parts: Parts) -> Iterator[tuple | pa.RecordBatch]:
        """Of the pairs whose second word is rare, by that word (_WORDS), or whose first is and second is not, by the first (_TAILS)."""
        names, count = counts_of(parts)
        tokens = []
        for number, data in parts:
            _, held, own, which, of, heads = tokens_of(data)
            tokens.append((number, np.searchsorted(names, own).astype(np.int32)[which], of, heads, held))
        others, other = np.unique(np.concatenate([t[3] for t in tokens]), return_inverse=True)
        pairs, pair = np.unique(np.concatenate([t[1] for t in tokens]).astype(np.int64) * len(others) + other, return_inverse=True)
        times = np.bincount(pair, weights=np.concatenate([~held[of] for *_, of, _, held in tokens]), minlength=len(pairs)).astype(np.int64)
        key, other = pairs // len(others), pairs % len(others)
        if kind == _WORDS:
            heads, chance = others[other], np.where(count > 0, totals.value(count) / max(totals.n, 1), totals.unknown)[key]
        else:
            heads, chance = names[key], chances[others[other].astype(np.int64)]
        some = np.flatnonzero(times)
        types = np.bincount(np.minimum(times[some], K + 2), minlength=K + 3)[1:K + 2]
        yield (_TYPES, _PAIRS, b"", None, *types.tolist(), None, None)
        own, which = np.unique(heads[some], return_inverse=True)
        hist = np.bincount(which * (K + 1) + np.minimum(times[some], K + 1) - 1, minlength=len(own) * (K + 1)).reshape(-1, K + 1)
        yield from columns(kind=np.where(own >= _RARE, _HEADS, _PAIRS), h=own.view(np.int64), seen=np.bincount(which, weights=chance[some], minlength=len(own)), others=np.zeros(len(own), np.int64),
                           **{f"n{r + 1}": hist[:, r] for r in range(K + 1)})
        at = 0
        for number, key, of, _, _ in tokens:
            at, which = at + len(of), pair[at:at + len(of)]
            own, h = times[which], heads[which]
            # each rare word is the history of one token, which its count divides, seen with it or not
            rest = -np.log10(np.maximum(count[key], 1)) if kind == _WORDS else np.zeros(len(of))
            met = np.flatnonzero((own > 0) & (h < _RARE))
            rest[met] -= log_class[h[met].astype(np.int64)]
            unseen = own == 0
            rest[unseen] += np.log10(np.maximum(chance[which[unseen]], 1e-300))
            late, unseen = np.flatnonzero(unseen & (h >= _RARE)), np.flatnonzero(unseen & (h < _RARE))
            docs, row, parts = by_doc(of, own)
            parts += [np.bincount(row, weights=rest, minlength=len(docs)), of[unseen], h[unseen].astype(np.uint32)]
            yield (_INFO, number, packed(np.array([_PAIRS], np.int64), *parts), None, *[None] * (K + 1), None, None)
            yield from columns(kind=np.full(len(late), _UNSEEN), block=np.full(len(late), number), h=h[late].view(np.int64), n1=of[late])
            if kind == _WORDS:
                parts = [docs, np.bincount(row, weights=count[key] > 0, minlength=len(docs)).astype(np.int64), np.bincount(row, weights=np.log10(count[key] + 1) - base, minlength=len(docs))]
                yield (_INFO, number, packed(np.array([_KNOWN], np.int64), *parts), None, *[None] * (K + 1), None, None)

    def finished(kind: int, parts: Parts) -> Iterator[tuple | pa.RecordBatch]:
        if totals.whole and kind != _PAIRS:
            yield from with_rare(kind, parts)
            return
        distinct, count = counts_of(parts)
        some = np.flatnonzero(count)
        types = np.bincount(np.minimum(count[some], K + 2), minlength=K + 3)[1:K + 2]
        yield (_TYPES, kind, b"", None, *types.tolist(), None, None)
        if kind == _PAIRS:
            h, w = (distinct[some] >> _SHIFT).astype(np.int64), (distinct[some] & np.uint64((1 << 24) - 1)).astype(np.int64)
            heads, which = np.unique(h, return_inverse=True)
            hist = np.bincount(which * (K + 1) + np.minimum(count[some], K + 1) - 1, minlength=len(heads) * (K + 1)).reshape(-1, K + 1)
            seen = np.bincount(which, weights=chances[w], minlength=len(heads))
            others = np.bincount(which, weights=count[some] * (w == totals.other), minlength=len(heads)).astype(np.int64)
            for k in range(len(heads)):
                yield (_PAIRS, None, None, int(heads[k]), *hist[k].tolist(), float(seen[k]), int(others[k]))
        for number, data in parts:
            _, _, own, which, of, after = tokens_of(data)
            key = np.searchsorted(distinct, own)[which]
            own = count[key]
            docs, row, out = by_doc(of, own)
            unseen = np.flatnonzero(own == 0)
            if kind == _PAIRS:
                head = (distinct >> _SHIFT).astype(np.uint32)[key]
                last = (distinct[key[unseen]] & np.uint64((1 << 24) - 1)).astype(np.int64)
                rest = -log_class[head]
                rest[unseen] = np.log10(np.maximum(chances[last], 1e-300))
                out += [np.bincount(row, weights=rest, minlength=len(docs)), of[unseen], head[unseen]]
            else:
                out += [np.bincount(row, weights=np.log10(own + 1) - base, minlength=len(docs)), of[unseen], after[unseen]]
            yield (_INFO, number, packed(np.array([kind], np.int64), *out), None, *[None] * (K + 1), None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple, Parts] = {}
        now = None

        def done():
            for kind in [kind for _, kind in rows]:
                some = []
                for x in finished(kind, rows.pop((now, kind))):
                    if isinstance(x, pa.RecordBatch):
                        yield x
                        continue
                    some.append(x)
                    if len(some) >= OUT_ROWS:
                        yield _rows(some)
                        some = []
                if some:
                    yield _rows(some)

        for batch in batches:
            for kind, bucket, number, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                data = data.as_py()  # one part at a time: a batch may hold all parts of several buckets
                if bucket != now:
                    yield from done()
                    now = bucket
                if kind == _INFO:
                    yield _rows([(_INFO, number, data, None, *[None] * (K + 1), None, None)])
                else:
                    rows.setdefault((bucket, kind), Parts()).append(number, data)
        yield from done()

    names = [x.split()[0] for x in COUNTED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), *[pa.int64()] * (K + 1), pa.float64(), pa.int64()]

    def _rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def columns(**own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(own["kind"]), OUT_ROWS):
            n = len(own["kind"][a:a + OUT_ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(own[c][a:a + n].astype(t.to_pandas_dtype())) if c in own else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names)

    return parts.mapInArrow(tidied(run), COUNTED)


def scored(docs: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Without a ``vocabulary`` every training word is a class; with one, only so many of the most frequent words are."""
    docs = small_batches(docs.select("doc_id", "text"))
    totals = Totals(word_counts(docs), docs, vocabulary)
    buckets = max(1, -(-totals.all // BUCKET_TOKENS))
    parts = _blocks(docs, totals, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counted = stored(_counted(parts, totals), "katz-counts")

    types = counted.where(F.col("kind") == _TYPES).where(F.col("block") == _PAIRS).agg(*[F.sum(f"n{r}") for r in range(1, K + 2)]).first()
    worth = discounted(np.array([0, *[x or 0 for x in types]], np.int64))
    heads = counted.where(F.col("kind") == _PAIRS).groupBy("h").agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, K + 2)], F.sum("seen").alias("seen"), F.sum("others").alias("others")).toArrow()  # the numbered words at most
    freed = sum(heads.column(f"n{r}").to_numpy() * (r - worth[r] if r <= K else ABOVE) for r in range(1, K + 2))
    weight = np.zeros(totals.size + 3)  # log10 of alpha(h); a history never seen leaves the unigram probability
    if heads.num_rows:
        h = heads.column("h").to_numpy()
        weight[h] = np.log10(freed / np.maximum(1 - heads.column("seen").to_numpy(), 1e-12) / np.maximum(totals.classes[h], 1))
    # a word never seen has been counted as one of the other words, which its history may have been seen with
    other = weight + np.log10(max(totals.class_chances()[totals.other], 1e-300))
    if heads.num_rows:
        x = heads.column("others").to_numpy()
        some = h[x > 0]
        other[some] = np.log10(np.where(x > K, x - ABOVE, worth[np.minimum(x, K)])[x > 0]) - np.log10(totals.classes[some])
    instead = weight + np.log10(max(totals.unknown, 1e-300)) - other
    n, log_n = totals.n, np.log10(max(totals.n, 1))
    log_worth, log_uni = np.log10(np.maximum(worth, 1e-300)), np.log10(np.maximum(totals.worth, 1e-300)) - log_n
    log_other = np.log10(max(totals.class_chances()[totals.other], 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, docs_late, late = None, [], [], []

        def done():
            own = [unpacked(p) for p in pieces]
            ids, null, held, tokens, known, base = next(x[1:] for x in own if x[0][0] == _INFO)
            size = len(ids)
            score, known, base = np.zeros(size), known.copy(), base.copy()
            for kind, *x in own:
                if kind[0] == _PAIRS:
                    at, hist, logs, chance, of, h = x
                    hist = hist.reshape(len(at), K + 2)
                    score[at] += hist[:, 1:K + 1] @ log_worth[1:] + logs + chance
                    np.add.at(score, of, weight[h])
                elif kind[0] == _KNOWN:
                    known[x[0]] += x[1]
                    base[x[0]] += x[2]
                elif kind[0] == _WORDS:
                    at, hist, logs, extra, of, h = x
                    hist = hist.reshape(len(at), K + 2).astype(np.int64)
                    known[at] += hist[:, 1:].sum(1)
                    base[at] += extra
                    score[at] += hist[:, 1:K + 1] @ log_uni[1:] + logs - hist[:, K + 1] * log_n - hist[:, 1:].sum(1) * log_other
                    np.add.at(score, of, instead[h])
            score += np.bincount(np.array(docs_late, np.int64), weights=np.array(late, np.float64), minlength=size)
            return ids, null, held, tokens, known, base, score

        def frame(out):
            ids, null, held, tokens, known, base, score = out
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(held), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), n)), pa.array(base),
                                               pa.array(score if n else np.zeros(len(ids)))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for number, data, doc, add in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if number != now:
                    if pieces:
                        yield frame(done())
                    now, pieces, docs_late, late = number, [], [], []
                if data is None:
                    docs_late.append(doc)
                    late.append(add)
                else:
                    pieces.append(data)
        if pieces:
            yield frame(done())

    own = counted.where(F.col("kind") == _INFO).select("block", "data", F.lit(None).cast("int").alias("doc"), F.lit(None).cast("double").alias("add"))
    if totals.whole:  # what tokens unseen after a rare history back off with
        after = counted.where(F.col("kind") == _HEADS).groupBy("h").agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, K + 2)], F.sum("seen").alias("seen"))
        left = sum((F.col(f"n{r}") * float(r - worth[r] if r <= K else ABOVE) for r in range(1, K + 2)), F.lit(0.0))
        after = after.select("h", F.log10(left / F.greatest(1 - F.col("seen"), F.lit(1e-12))).alias("add"))
        unseen = counted.where(F.col("kind") == _UNSEEN).select("block", "h", F.col("n1").cast("int").alias("doc")).join(after, "h").groupBy("block", "doc").agg(F.sum("add").alias("add"))
        own = own.unionByName(unseen.withColumn("data", F.lit(None).cast("binary")))
    own = own.repartition("block").sortWithinPartitions("block")
    return own.mapInArrow(tidied(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
