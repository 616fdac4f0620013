"""Best-two-fit packing of token sequences into bins of fixed capacity.

A document is its token ids and one end id. Only a document longer than the capacity is cut, into full pieces behind a
first piece of what remains; full pieces are bins of their own. All other pieces are packed by the best-two-fit rule:
fill a bin greedily with the largest pieces that fit, then take its smallest piece back if two unpacked pieces fit the
gap so expanded more tightly.

The rule looks at sizes only, so it runs on the histogram of sizes, which has at most ``capacity`` entries however many
documents there are. Equal bins are made together: a pattern of sizes is repeated while its pieces last, so the plan has
a few thousand rows at most. Pieces then take their places by their rank among the pieces of their size. Ranks come from
counts per task and size, so no group of equal sizes meets in one task, and documents never pass through the driver.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each on its own; extra columns are
ignored; an empty table gives no rows. The packing needs as many bins as tokens at least; ``waste`` in the tests measures it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import small_batches, stored
from .tokens import encoder
from .words import tidied

ROWS = ("doc_id long, n_full int, rest int, rest_crc long, full_crcs array<long>, task int, rest_rank long, full_rank long")
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (sizes of one bin, number of such bins) that use ``counts[s]`` pieces of each size s = 0..capacity."""
    left = np.asarray(counts, np.int64).copy()
    left[0] = 0
    plan: list[tuple[list[int], int]] = []
    while True:
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return plan
        pattern: list[int] = []
        room = capacity
        spare = left.copy()
        while room:
            fits = np.flatnonzero(spare[1:room + 1])
            if not len(fits):
                break
            size = int(fits[-1]) + 1
            pattern.append(size)
            spare[size] -= 1
            room -= size
        if room and len(pattern) > 1:
            smallest = pattern[-1]
            pair = _tightest_pair(spare, room + smallest)
            if pair and sum(pair) > smallest:
                pattern = [*pattern[:-1], *pair]
        used, need = np.unique(pattern, return_counts=True)
        times = int((left[used] // need).min())
        left[used] -= times * need
        plan.append((pattern, times))


def _tightest_pair(spare: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two sizes still unpacked with the largest sum up to room; the larger first, of equal sums the most unequal."""
    sizes = np.flatnonzero(spare[:room + 1])
    if not len(sizes):
        return None
    before = np.maximum.accumulate(np.where(spare[:room + 1] > 0, np.arange(room + 1), 0))
    larger = sizes[::-1]
    partner = before[np.minimum(larger, room - larger)]
    same = partner == larger
    if same.any():  # two of one size need two of them, else the next smaller size
        single = same & (spare[larger] < 2)
        partner[single] = before[np.maximum(larger[single] - 1, 0)]
    sums = np.where(partner > 0, larger + partner, 0)
    k = int(sums.argmax())
    return (int(larger[k]), int(partner[k])) if sums[k] else None


def slots(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per size the places of its pieces in rank order: rows (first rank, first bin, offset in the bin)."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    first = 0
    for pattern, times in plan:
        offset = 0
        for size in pattern:
            rank = taken.get(size, 0)
            out.setdefault(size, []).append((rank, first, offset))
            taken[size] = rank + times
            offset += size
        first += times
    return {s: np.array(v, np.int64) for s, v in out.items()}


def lengths(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Per document: number of full pieces, length of the first piece (if not full), checksums, and its rank in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        full = 0
        for batch in batches:
            names = batch.schema.names
            for first, ids, at in enc.batches(batch.column(names.index("text"))):
                n = len(at) - 1
                n_full, rest, rest_crc, full_crcs = [], [], [], []
                for k in range(n):
                    own = np.append(ids[at[k]:at[k + 1]], end_id).astype("<u4")
                    whole, size = divmod(len(own), capacity)
                    n_full.append(whole)
                    rest.append(size)
                    rest_crc.append(zlib.crc32(own[:size]) if size else 0)
                    full_crcs.append([zlib.crc32(own[p:p + capacity]) for p in range(size, len(own), capacity)])
                size, whole = np.array(rest), np.array(n_full)
                order = np.argsort(size, kind="stable")
                sorted_sizes = size[order]
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n) - np.searchsorted(sorted_sizes, sorted_sizes) + seen[sorted_sizes]
                seen += np.bincount(size, minlength=capacity + 1)
                full_rank = full + np.cumsum(whole) - whole
                full += int(whole.sum())
                ids_of = batch.column(names.index("doc_id")).slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [ids_of.cast(pa.int64()), pa.array(n_full, pa.int32()), pa.array(rest, pa.int32()), pa.array(rest_crc, pa.int64()),
                     pa.array(full_crcs, pa.list_(pa.int64())), pa.array(np.full(n, task), pa.int32()), pa.array(rank), pa.array(full_rank)],
                    names=["doc_id", "n_full", "rest", "rest_crc", "full_crcs", "task", "rest_rank", "full_rank"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidied(run), ROWS)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, checksum of its ids, sequence_id and offset inside the sequence.

    Bins of packed pieces are numbered from 0, full pieces follow. The token lengths are written once to the shared folder.
    """
    rows = stored(lengths(docs, tokenizer, capacity, end_id), "pack-lengths")
    per_task = rows.groupBy("task", "rest").agg((F.max("rest_rank") + 1).alias("n"), F.max(F.col("full_rank") + F.col("n_full")).alias("full"))
    per_task = stored(per_task, "pack-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` sizes
        histogram[r["rest"]] = r["n"]
    plan = best_two_fit(histogram, capacity)
    places, bins = slots(plan), sum(t for _, t in plan)

    earlier = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.withColumn("rank_base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("task", "rest", "rank_base")
    tasks = per_task.groupBy("task").agg(F.max("full").alias("full"))
    full_base = tasks.select("task", F.coalesce(F.sum("full").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base"))
    placed = rows.join(before.join(full_base, "task"), ["task", "rest"])
    placed = placed.select("doc_id", "n_full", "rest", "rest_crc", "full_crcs", (F.col("rest_rank") + F.col("rank_base")).alias("rank"),
                           (F.col("full_rank") + F.col("full_base") + bins).alias("full_from"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rest, rank, n_full, full_from = (col[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("rest", "rank", "n_full", "full_from"))
            sequence, offset = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            for size in np.unique(rest[rest > 0]).tolist():
                own = np.flatnonzero(rest == size)
                table = places[size]
                k = np.searchsorted(table[:, 0], rank[own], "right") - 1
                sequence[own] = table[k, 1] + rank[own] - table[k, 0]
                offset[own] = table[k, 2]
            some = np.flatnonzero(rest > 0)
            doc = np.repeat(np.arange(len(rest)), n_full)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
            at = np.concatenate([some, doc])
            yield pa.RecordBatch.from_arrays([
                col["doc_id"].take(pa.array(at)),
                pa.array(np.concatenate([np.zeros(len(some), np.int64), nth + (rest[doc] > 0)]), pa.int32()),
                pa.array(np.concatenate([np.zeros(len(some), np.int64), rest[doc] + nth * capacity])),
                pa.array(np.concatenate([rest[some], np.full(len(doc), capacity)])),
                pa.array(np.concatenate([col["rest_crc"].to_numpy()[some], np.asarray(col["full_crcs"].flatten().to_numpy(zero_copy_only=False), np.int64)])),
                pa.array(np.concatenate([sequence[some], full_from[doc] + nth])),
                pa.array(np.concatenate([offset[some], np.zeros(len(doc), np.int64)])),
            ], names=[x.split()[0] for x in PACKED.split(", ")])

    return placed.mapInArrow(tidied(run), PACKED)
