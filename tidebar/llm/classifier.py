"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated output.

Random indexing gives every word a sparse random index vector and adds up, over all documents, the index vectors of the
words around it; that sum is the word's context vector. Words are hashed to ``BUCKETS`` rows, and each word also counts
as a pseudo-word that tells its shape (capitals, digits, marks, and whether it repeats the word before), so words never
seen still have a vector. The table has a fixed size; tasks add up their own and send it once, and blocks of rows are
summed as streams.

A document is the mean of its words' vectors, the mean of its shapes' vectors and its length. A network with one hidden
layer, written in numpy, is trained on at most ``sample`` labelled rows; a fifth of them, kept out of the training, sets the
temperature that calibrates its probabilities. Only the text is an input.

Defined cases: null, empty or blank texts pool to zeros and get the network's score for that; without two classes of
labelled rows all scores are 0.5; repeated rows get equal scores; a null doc_id is not held out; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches, stored
from .words import Words, chunks, mix

BUCKETS, SHAPES, WIDTH, SPAN = 16384, 128, 32, 2
ROWS, BLOCKS = BUCKETS + SHAPES, 16
INPUTS = 2 * WIDTH + 1
_GROUP = np.zeros((256, 5), bool)  # capitals, small letters and other scripts, digits, symbols, marks
_GROUP[65:91, 0] = _GROUP[97:123, 1] = _GROUP[128:, 1] = _GROUP[48:58, 2] = True
_GROUP[list(b"#*$%&|<>@^~_=+/\\{}[]"), 3] = True
_GROUP[list(b"!?"), 4] = True


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The dimension of the +1 and of the -1 of every row's index vector."""
    h = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    plus = (h % np.uint64(WIDTH)).astype(np.int64)
    minus = (plus + 1 + ((h >> np.uint64(32)) % np.uint64(WIDTH - 1)).astype(np.int64)) % WIDTH
    return plus, minus


def rows_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word row, shape row and text number of every word. ``w`` holds lower-cased words."""
    n = len(w.hashes)
    counts = np.zeros((n, 5), np.int64)
    for k in range(5):
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(_GROUP[w.raw, k], dtype=np.int32)])
        counts[:, k] = total[w.ends] - total[w.starts]
    doc = w.doc()
    again = np.zeros(n, bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    upper, lower, digit, symbol, mark = (counts > 0).T
    shape = (upper * 1 + (upper & ~lower & (w.ends - w.starts > 2)) * 2 + digit * 4 + symbol * 8 + mark * 16 + (w.ends - w.starts > 12) * 32 + again * 64)
    return (w.hashes % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape.astype(np.int64), doc


def context_sums(docs: DataFrame) -> np.ndarray:
    """Context vectors of all rows, summed over all documents."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = _index_vectors()
        total = np.zeros(ROWS * WIDTH, np.int64)
        for batch in batches:
            for w in _chunks_for(batch, 2_000_000):
                word, shape, doc = rows_of(w)
                for gap in range(1, SPAN + 1):
                    near = doc[gap:] == doc[:-gap]
                    left, right = (word[:-gap][near], shape[:-gap][near]), (word[gap:][near], shape[gap:][near])
                    for here, there in ((left, right), (right, left)):
                        for row in here:
                            for other in there:
                                total += np.bincount(row * WIDTH + plus[other], minlength=len(total))
                                total -= np.bincount(row * WIDTH + minus[other], minlength=len(total))
        yield _blocks(dict(enumerate(total.reshape(BLOCKS, -1))))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(part.as_buffer()), np.int64)
                sums[block] = sums[block] + x if block in sums else x
        yield _blocks(sums)

    parts = small_batches(docs.select("text")).mapInArrow(own, "block int, sums binary")
    rows = parts.repartition(BLOCKS, "block").mapInArrow(added, "block int, sums binary").collect()  # a table of fixed size
    out = np.zeros((BLOCKS, ROWS * WIDTH // BLOCKS), np.int64)
    for r in rows:
        out[r["block"]] = np.frombuffer(zlib.decompress(bytes(r["sums"])), np.int64)
    return out.reshape(ROWS, WIDTH)


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Compressed, as most sums of one task are small."""
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], names=["block", "sums"])


def _chunks_for(batch: pa.RecordBatch, size: int) -> Iterator[Words]:
    return chunks(batch.column(batch.schema.names.index("text")), lower=True, size=size)


def vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors at unit length, after taking off their common mean direction."""
    x = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)
    seen = np.abs(sums).sum(1) > 0
    x[seen] -= x[seen].mean(0) if seen.any() else 0
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) * seen[:, None]).astype(np.float32)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, inputs): the network's inputs of every document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id"))
            for w in _chunks_for(batch, 1_000_000):
                word, shape, _ = rows_of(w)
                n = np.diff(w.word)
                some = np.flatnonzero(n)
                x = np.zeros((len(w), INPUTS), np.float32)
                if len(some):
                    for k, rows in enumerate((word, shape)):
                        x[some, k * WIDTH:(k + 1) * WIDTH] = np.add.reduceat(table[rows], w.word[some], axis=0) / n[some, None]
                x[:, -1] = np.log1p(n) / 5
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, len(w)).cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "inputs"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, inputs binary")


class Network:
    """inputs -> hidden (tanh) -> one logit, divided by the temperature."""

    def __init__(self, inputs: int = INPUTS, hidden: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w1, self.b1 = r.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden)
        self.w2, self.b2 = np.zeros(hidden), np.zeros(1)
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 128, rate: float = 3e-3, penalty: float = 1e-4) -> Network:
        """Adam on the log loss; the last fifth of the shuffled rows sets the temperature."""
        r = np.random.default_rng(11)
        order = r.permutation(len(y))
        cut = len(y) - len(y) // 5
        fit, held = order[:cut], order[cut:]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(rounds):
            for own in np.array_split(r.permutation(fit), max(1, len(fit) // batch)):
                z = (x[own] - self.mean) / self.scale
                h = np.tanh(z @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2[0], -30, 30)))
                d = (p - y[own]) / len(own)
                back = d[:, None] * self.w2 * (1 - h * h)
                t += 1
                for k, g in enumerate((z.T @ back + penalty * self.w1, back.sum(0), h.T @ d + penalty * self.w2, np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        if len(held):
            z = self.logits(x[held])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.logaddexp(0, -np.where(y[held] > 0, z, -z) / g).mean() for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(inputs: DataFrame, labels: DataFrame, sample: int = 20000) -> Network | None:
    """The network fitted on at most ``sample`` labelled documents that are not held out, the first by a hash of doc_id."""
    own = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = sorted((r["doc_id"], r["quality"], bytes(r["inputs"])) for r in inputs.join(own, "doc_id").select("doc_id", "quality", "inputs").collect())
    y = np.array([float(r[1] == 1) for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return Network().fit(np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, INPUTS).astype(np.float64), y)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 20000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    inputs = stored(pooled(docs, vectors(context_sums(docs))), "pooled")
    network = train(inputs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, INPUTS).astype(np.float64)
            s = network.scores(x) if network else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = inputs.select("doc_id", "inputs").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
