"""Source divergence audit: how far the word shares of the sources of a language lie apart, and which words set one off.

Terms are maximal runs of ASCII letters (lower-cased) and characters beyond ASCII. A language keeps the terms that at least
``min_docs`` of its documents have. A group is one (lang, source). Its price of a term is one plus the floored share, in
billionths, of the term among the group's kept occurrences, after adding ``SMOOTH`` to every kept term; prices are exact
integers. Two groups differ by the sum, over all kept terms, of the difference of their prices.

Terms are counted inside the tasks, some megabytes of text at a time, and summed by Spark. The kept counts of a group form
sorted arrays of (term id, count), one per range of about ``RANGE`` terms (by a hash of the term), so no array grows with
the vocabulary. For every unordered pair of groups of a language the two arrays of a range are co-grouped into one task
unit: a galloping intersection prices the terms that both have, what is left of either side is priced against a count of
zero, and terms that neither has all cost the same and are only counted. The sum stands for both directions.

Numbers are exact while a language has fewer than 9e15 kept occurrences. A pair's arrays travel once per partner, as the
method asks; the number of pairs is that of the rows asked for.

Defined cases: null text, lang or source count as empty strings. Every row is a document, also a repeated one or one
without doc_id. A group without kept terms still stands in all pairs: with prices of zero counts, or with value 0 where the
language keeps no term at all. A language with one source has no pairs. Ties rank by the item's UTF-8 bytes. Columns other
than text, lang and source are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sorted_ids import shared
from .store import small_batches, stored
from .words import LOWER, NO_LETTER, buffers

SMOOTH = 5
#: Terms of one range of ids, and bytes of text whose terms are combined in a task before they leave it.
RANGE = 1 << 16
GATHER = 6_000_000


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + s) / (total + s terms)) by long division to the base 1000, so that nothing overflows."""
    rest, whole = count + SMOOTH, total + SMOOTH * terms
    out = F.lit(0)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, whole)
        rest = rest % whole
    return out + 1


def prices(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same of an array of counts."""
    rest, whole = count.astype(np.int64) + SMOOTH, total + SMOOTH * terms
    out = np.zeros(len(rest), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _split(data: np.ndarray, text: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, and the text of each."""
    inside = ~NO_LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[text] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]]))
    return terms, np.repeat(np.arange(len(text) - 1), np.diff(np.searchsorted(starts, text)))


def _counted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    data, at = buffers(table["text"])
    terms, doc = _split(data[at[0]:at[-1]], at - at[0])
    coded = terms.dictionary_encode()
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    names = list(zip(table["lang"].to_pylist(), table["source"].to_pylist()))
    number = {x: k for k, x in enumerate(dict.fromkeys(names))}
    group = np.array([number[x] for x in names], np.int64)
    rows = pa.array(group[doc] * size + code).dictionary_encode()
    row, keys = rows.indices.to_numpy(), rows.dictionary.to_numpy()
    # Codes are given in the order of first sight, so a word is new to its document where the highest code so far rises.
    seen = pa.array(doc * size + code).dictionary_encode().indices.to_numpy()
    new = np.diff(np.maximum.accumulate(seen), prepend=-1) > 0
    n, docs = (np.bincount(x, minlength=len(keys)) for x in (row, row[new]))
    order = np.argsort((keys // size).astype(np.uint16 if len(number) < 65536 else np.int64), kind="stable")  # rows of a group together
    keys, n, docs = keys[order], n[order], docs[order]
    named = [pa.array([x[k] for x in number], pa.string()).take(pa.array(keys // size)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*named, coded.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(n), pa.array(docs)],
                                      names=["lang", "source", "term", "n", "docs"])


def _slices(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of every term of every group: (lang, source, term, n, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GATHER:
                yield from _slices(_counted(held))
                held, size = [], 0
        if held:
            yield from _slices(_counted(held))

    texts = docs.select(*[F.coalesce(k, F.lit("")).alias(k) for k in ("lang", "source", "text")])
    rows = small_batches(texts).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Audit:
    """Kept terms and their counts, written once: ``terms`` (lang, term, id, total), ``counts`` (lang, source, term, id,
    total, n) and ``groups`` (lang, source, size, terms, total), one row per occurring group."""

    def __init__(self, docs: DataFrame, min_docs: int = 30):
        all_counts = stored(term_counts(docs), "divergence-all")
        kept = all_counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        self.terms = stored(kept.select("lang", "term", F.monotonically_increasing_id().alias("id"), "total"), "divergence-terms")
        self.counts = stored(all_counts.drop("docs").join(self.terms, ["lang", "term"]), "divergence-counts")
        langs = self.terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("total"))
        own = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        occurring = docs.select(*[F.coalesce(k, F.lit("")).alias(k) for k in ("lang", "source")]).distinct()
        self.groups = stored(occurring.join(own, ["lang", "source"], "left").join(langs, ["lang"], "left").na.fill(0, ["size", "terms", "total"]),
                             "divergence-groups")


def _merged(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The part of one pair's difference that the terms of one range make, and how many terms either group has there."""
    own = left if left.num_rows else right
    v, *sizes = (own[k][0].as_py() for k in ("terms", "size_a", "size_b"))

    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not t.num_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(t[k].combine_chunks().flatten().to_numpy() for k in ("ids", "counts"))

    (a, m), (b, n) = side(left), side(right)
    p, q = prices(m, sizes[0], v), prices(n, sizes[1], v)
    x, y = shared(a, b)
    none_a, none_b = (int(prices(np.zeros(1, np.int64), s, v)[0]) for s in sizes)
    only_a, only_b = np.delete(p, x), np.delete(q, y)
    value = np.abs(p[x] - q[y]).sum() + np.abs(only_a - none_b).sum() + np.abs(only_b - none_a).sum()
    names = [k.as_py() for k in key[:3]]
    return pa.table([*[pa.array([k], pa.string()) for k in names], pa.array([int(value)], pa.int64()), pa.array([len(a) + len(b) - len(x)], pa.int64())],
                    names=["lang", "a", "b", "value", "seen"])


def pair_divergence(audit: Audit) -> DataFrame:
    """One row per unordered pair of sources of a language: (lang, a, b, value), a before b in UTF-8 order."""
    spark = audit.groups.sparkSession
    g = audit.groups
    ranges = max(1, math.ceil(audit.terms.count() / RANGE))
    lists = (audit.counts.groupBy("lang", "source", F.pmod(F.xxhash64("term"), F.lit(ranges)).alias("part"))
             .agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("x"))
             .select("lang", "source", "part", F.col("x.id").alias("ids"), F.col("x.n").alias("counts")))
    pairs = (g.select("lang", F.col("source").alias("a"), F.col("size").alias("size_a"), "terms")
             .join(g.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b")), "lang").where("a < b"))
    pairs = stored(pairs, "divergence-pairs")
    lists = stored(lists, "divergence-lists")
    left, right = (pairs.join(lists.withColumnRenamed("source", k), ["lang", k]) for k in ("a", "b"))
    left, right = (x.select(*[F.col(k).alias(k) for k in pairs.columns + ["part", "ids", "counts"]]) for x in (left, right))
    keys = ["lang", "a", "b", "part"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_merged, "lang string, a string, b string, value long, seen long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    zero = F.lit(0).cast("long")
    gap = F.abs(price(zero, F.col("size_a"), F.col("terms")) - price(zero, F.col("size_b"), F.col("terms")))
    absent = F.col("terms") - F.coalesce("seen", zero)
    value = F.when(F.col("terms") > 0, F.coalesce("value", zero) + absent * gap).otherwise(zero)
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", value.alias("value"))


def excess_terms(audit: Audit, top: int = 50) -> DataFrame:
    """The kept terms that a group has and prices above its language, the largest differences first, ``top`` of each group."""
    rows = audit.counts.join(audit.groups.drop("total").join(audit.groups.groupBy("lang").agg(F.max("total").alias("whole")), "lang"), ["lang", "source"])
    value = price(F.col("n"), F.col("size"), F.col("terms")) - price(F.col("total"), F.col("whole"), F.col("terms"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (rows.where(F.col("n") > 0).select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """Both parts in one table: (lang, source, part, item, value, rank)."""
    audit = Audit(docs, min_docs)
    pairs = stored(pair_divergence(audit), "divergence-values")
    both = (pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
            .union(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    names = ["lang", "source", "part", "item", "value", "rank"]
    return (both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).select(*names)
            .union(excess_terms(audit, top).withColumn("part", F.lit("term")).select(*names)))
