"""Filter interaction audit: what each of five filters removes in every order, read off sorted lists of failing rows.

Rows are measured once inside the tasks. A posting row then holds, for one part (source) and one range of row numbers, the
sorted numbers of the rows that fail each filter, and of those labelled good and toxic. Ranges bound every list, so a part of
any size is spread over many posting rows. For each filter and each set of filters applied before it, the failing rows that
are left are the filter's list without the union of the others': unions by a k-way merge and differences by galloping search,
range by range; the sizes are summed. These 80 sums of a part give all steps of all 120 orders.

Filters: A under 200 words; B under half of the words distinct; C over two percent of the code points in A-Z; D any of
``#$%&*|``; E the same text as a row with a smaller doc_id, anywhere in the table, removed or not.

E compares SHA-256 digests. The digests that most rows share (over one in ``HOT`` of all rows, so fewer than ``HOT`` digests)
find their smallest doc_id by a broadcast, all others by a shuffle in which no key has more rows than that.

Defined cases: a null text counts as empty, a null source as the empty string. Every row is a document, also a repeated one; a row without
doc_id neither fails E nor makes another row fail it, nor has it labels. Rows that repeat a doc_id do not fail E by each other. Several
labels of one doc_id count as good or toxic if one of them is. Only doc_id, text and source are read, and doc_id, quality and
toxic of the labels. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sorted_ids import merged, shared, without
from .store import small_batches, stored
from .words import chunks, segment_sum

FILTERS = "ABCDE"
SUMS = ["removed", "good_lost", "toxic_lost", "gone"]
#: Row numbers of one range; copies of a text are broadcast if they are more than one in HOT of all rows.
RANGE = 1 << 16
HOT = 5000
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(x) for x in "#$%&*|"]] = True


def _failing(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
    for w in chunks(batch.column(batch.schema.names.index("text"))):
        n = len(w)
        words, doc = np.diff(w.word), w.doc()
        order = np.lexsort((w.hashes, doc))
        h, d = w.hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d[new], minlength=n)
        chars = segment_sum((w.raw & 0xC0) != 0x80, w.text, n)
        fails = [words < 200, 100 * distinct < 50 * words, 100 * segment_sum(_CAPITAL[w.raw], w.text, n) > 2 * chars, segment_sum(_MARK[w.raw], w.text, n) > 0]
        yield w.first, fails, [hashlib.sha256(w.raw[a:b]).digest() for a, b in zip(w.text[:-1].tolist(), w.text[1:].tolist())]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fail_A to fail_D, digest) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, fails, digests in _failing(batch):
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(first, len(digests)) for k in (0, 1)], *map(pa.array, fails), pa.array(digests, pa.binary())],
                                                 names=["doc_id", "part", *[f"fail_{f}" for f in "ABCD"], "digest"])

    rows = small_batches(docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), "text"))
    return rows.mapInArrow(run, "doc_id long, part string, fail_A boolean, fail_B boolean, fail_C boolean, fail_D boolean, digest binary")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, part, fail_A to fail_E, good, toxic): every row with a number of its own, all filters and its labels."""
    rows = stored(measured(docs), "audit-measured")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stored(copies, "audit-copies")
    most = rows.count() / HOT
    hot = F.broadcast(copies.where(F.col("n") > most).select("digest", F.col("first").alias("hot_first")))
    few = copies.where(F.col("n") <= most).select(F.col("digest").alias("key"), "first")
    rows = rows.join(hot, "digest", "left")
    # A row of a hot digest needs no partner in the second join: a key of its own spreads such rows over all tasks.
    key = F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("doc_id").cast("string")).cast("binary"))
    rows = rows.withColumn("key", key).join(few, "key", "left")
    rows = rows.withColumn("fail_E", F.coalesce(F.col("doc_id") > F.coalesce("hot_first", "first"), F.lit(False)))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(known, "doc_id", "left")
    flags = [f"fail_{f}" for f in FILTERS]
    rows = stored(rows.select("part", *flags, *[F.coalesce(k, F.lit(False)).alias(k) for k in ("good", "toxic")]), "audit-flagged")
    return rows.withColumn("row", F.monotonically_increasing_id())


def postings(rows: DataFrame, width: int = RANGE) -> DataFrame:
    """(part, range, n_rows, A to E, good, toxic): sorted row numbers that fail each filter or bear each label."""
    lists = {**{f: f"fail_{f}" for f in FILTERS}, "good": "good", "toxic": "toxic"}
    return (rows.groupBy("part", F.expr(f"row div {width}").alias("range"))
            .agg(F.count(F.lit(1)).alias("n_rows"), *[F.array_sort(F.collect_list(F.when(F.col(flag), F.col("row")))).alias(k) for k, flag in lists.items()]))


def left_over(lists: dict[str, np.ndarray]) -> list[tuple[str, str, int, int, int, int]]:
    """Per filter and set of filters before it: failing rows that are left, how many of them are good and toxic, and all
    rows that are gone after it."""
    unions = {"": np.zeros(0, np.int64)}
    for k in range(1, len(FILTERS)):
        for names in combinations(FILTERS, k):
            unions["".join(names)] = merged([lists[f] for f in names])
    out = []
    for before, earlier in unions.items():
        for f in FILTERS:
            if f not in before:
                new = without(lists[f], earlier)
                out.append((f, before, len(new), *[len(shared(new, lists[k])[0]) for k in ("good", "toxic")], len(earlier) + len(new)))
    return out


def removals(lists: DataFrame) -> DataFrame:
    """(part, filter, before, removed, good_lost, toxic_lost, gone) summed over all ranges; ``before`` is a sorted set of filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                rows = left_over({k: cols[k][i].values.to_numpy() for k in (*FILTERS, "good", "toxic")})
                yield pa.RecordBatch.from_arrays([pa.array([cols["part"][i].as_py()] * len(rows)), *map(pa.array, zip(*rows))],
                                                 names=["part", "filter", "before", *SUMS])

    rows = lists.select("part", *FILTERS, "good", "toxic").mapInArrow(run, "part string, filter string, before string, " + ", ".join(f"{k} long" for k in SUMS))
    return rows.groupBy("part", "filter", "before").agg(*[F.sum(k).alias(k) for k in SUMS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module for what each filter is."""
    spark = docs.sparkSession
    lists = stored(postings(flagged(docs, labels)), "audit-postings")
    sizes = lists.groupBy("part").agg(F.sum("n_rows").alias("n_docs"), *[F.sum(F.size(f)).alias(f) for f in FILTERS])
    failing = sizes.select("part", "n_docs", F.expr(f"stack({len(FILTERS)}, {', '.join(f'''\"{f}\", {f}''' for f in FILTERS)}) AS (filter, failing)"))
    gone = stored(removals(lists), "audit-removals")
    alone = gone.where(F.length("before") == len(FILTERS) - 1).select("part", "filter", F.col("removed").alias("unique_fails"))
    steps = [("".join(o), k + 1, o[k], "".join(sorted(o[:k]))) for o in permutations(FILTERS) for k in range(len(FILTERS))]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before string"))
    weights = steps.groupBy("filter", "before").agg(F.count(F.lit(1)).alias("orders"))
    shapley = gone.join(F.broadcast(weights), ["filter", "before"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    per_filter = failing.join(alone, ["part", "filter"]).join(shapley, ["part", "filter"])
    rows = gone.join(steps, ["filter", "before"]).join(per_filter, ["part", "filter"])
    return rows.select("part", "filter_order", "step", (F.col("n_docs") - F.col("gone")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
                       "unique_fails", "good_lost", "toxic_lost", "shapley")
