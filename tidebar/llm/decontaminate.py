"""Benchmark decontamination: SimHash of item-sized windows, a multi-index Hamming search, and exact verification.

1. Seeds. A window can only reach the wanted similarity of five-word shingles if it shares a shingle with the item, so the
   shingles of every document are joined to those of the items (runs of as many words as the item has for shorter items). Every window of the item's size is a candidate, wherever
   its shared shingles stand in the item, if their weight is ``similarity`` of the item's at least. The similarity can't
   be reached with less, so no window that would be verified is lost by this.
2. Fingerprints. A window and an item have a 64-bit SimHash of their words, each weighted by its length.
3. Multi-index search. Fingerprints are cut into four blocks of 16 bits. If two differ in at most ``radius`` bits, some block
   differs in at most radius / 4; all variants of the items' blocks within that many flips are indexed, and windows of the
   same size meet them by equal block values. So every pair within the radius is found.
4. Verification. The weighted Jaccard similarity of the shingle sets (weight: the letters of a shingle) decides.

Only DataFrame functions are used. The seed index and the documents to fetch are broadcast after their rows were counted,
up to ``BROADCAST_ROWS``; beyond, the joins shuffle. Words are runs of letters and digits, lower-cased, so case and
punctuation do not hide a passage.

Defined cases: null, empty or wordless texts and items match nothing; an item of fewer words than a shingle is one shingle
and matches every document that has just these words in a row; repeated documents each match; an empty benchmark leaves all
documents; a null doc_id counts as an id; extra columns are ignored by ``matches`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

BROADCAST_ROWS = 300_000
BLOCKS, BLOCK_BITS = 4, 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(name: str, n: int) -> Column:
    """Hashes of the n-word shingles of the word array in column ``name``; fewer words are one shingle."""
    picked = ", ".join(f"{name}[i + {k}]" for k in range(n))
    return F.expr(f"CASE WHEN size({name}) >= {n} THEN transform(sequence(0, size({name}) - {n}), i -> xxhash64({picked})) "
                  f"WHEN size({name}) > 0 THEN array(xxhash64(concat_ws(' ', {name}))) ELSE CAST(array() AS ARRAY<BIGINT>) END")


def shingle_texts(name: str, n: int) -> Column:
    return F.expr(f"CASE WHEN size({name}) >= {n} THEN array_distinct(transform(sequence(1, size({name}) - {n - 1}), i -> concat_ws(' ', slice({name}, i, {n})))) "
                  f"WHEN size({name}) > 0 THEN array(concat_ws(' ', {name})) ELSE CAST(array() AS ARRAY<STRING>) END")


def simhash(name: str) -> Column:
    """64-bit SimHash of the word array in column ``name``, words weighted by their length."""
    marks = f"transform({name}, x -> named_struct('h', xxhash64(x), 'w', length(x)))"
    return F.expr(f"aggregate(array({marks}), 0L, (z, m) -> aggregate(sequence(0, 63), 0L, (fp, b) -> fp | CASE WHEN aggregate(m, 0L, "
                  "(s, x) -> s + CASE WHEN (shiftrightunsigned(x.h, b) & 1L) = 1L THEN x.w ELSE -x.w END) > 0 THEN shiftleft(1L, b) ELSE 0L END))")


def block(fingerprint: str, number: int) -> Column:
    return F.expr(f"CAST(shiftrightunsigned({fingerprint}, {number * BLOCK_BITS}) & {2 ** BLOCK_BITS - 1}L AS INT)")


def flips(most: int) -> list[int]:
    """All masks of a block with at most ``most`` bits."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(BLOCK_BITS), k)]


def weight(shingles: str) -> Column:
    return weight_of(F.col(shingles))


def weight_of(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda s, x: s + F.length(F.replace(x, F.lit(" "), F.lit(""))))


def checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table if it has few rows, counted just now."""
    return F.broadcast(df) if df.count() <= most else df


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): each document and item with a similar window, the best one."""
    items = benchmark.select("item_id", words(F.col("text")).alias("iw")).where("size(iw) > 0").withColumn("n", F.size("iw"))
    items = stored(items.withColumn("ifp", simhash("iw")), "items")
    # an item of fewer words than a shingle is sought by runs of its own number of words; there are shingle - 1 such numbers at most
    sizes = [shingle, *sorted(r["n"] for r in items.where(F.col("n") < shingle).select("n").distinct().collect())]

    def runs(df: DataFrame, name: str, k: int, *kept: str) -> DataFrame:
        return df.select(*kept, F.lit(k).alias("k"), F.posexplode(shingle_hashes(name, k)).alias("p", "h"))

    need = (weight_of(shingle_texts("iw", shingle)) * similarity - 1e-6).alias("need")
    index = _together([runs(items.where(F.col("n") >= k if k == shingle else F.col("n") == k), "iw", k, "item_id", "n", "iw", need) for k in sizes])
    index = stored(index.select("item_id", "n", "need", "k", "h", F.expr("length(concat_ws('', slice(iw, p + 1, k)))").alias("letters")).distinct(), "item-shingles")

    seen = docs.select("doc_id", words(F.col("text")).alias("dw"))
    seeds = _together([runs(seen.where(F.size("dw") >= k), "dw", k, "doc_id") for k in sizes]).join(checked(index), ["k", "h"])
    # a shared shingle is in all windows that start at most n - shingle words before it
    met = seeds.groupBy("doc_id", "item_id", "n", "need").agg(F.sum("letters").alias("total"), F.collect_list(F.struct("p", "letters")).alias("at")).where("total >= need")
    met = met.select("doc_id", "item_id", "n", "need", F.explode("at").alias("x"))
    met = met.select("doc_id", "item_id", "n", "need", "x.letters", F.explode(F.expr(f"sequence(greatest(x.p - greatest(n - {shingle}, 0), 0), x.p)")).alias("start"))
    starts = met.groupBy("doc_id", "item_id", "n", "need", "start").agg(F.sum("letters").alias("total")).where("total >= need").select("doc_id", "start", "n").distinct()
    starts = stored(starts, "windows")
    per_doc = stored(starts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("places")).withColumnRenamed("doc_id", "found_id"), "window-docs")

    d = docs.select("doc_id", "text")
    d = d.join(checked(per_doc), d["doc_id"].eqNullSafe(F.col("found_id"))).select("doc_id", "places", words(F.col("text")).alias("dw"))
    w = d.select("doc_id", F.explode(F.expr("transform(places, x -> named_struct('start', x.start, 'n', x.n, 'w', slice(dw, x.start + 1, x.n)))")).alias("x"))
    w = w.select("doc_id", F.col("x.start").alias("start"), F.col("x.n").alias("n"), F.col("x.w").alias("w")).where("size(w) > 0")
    # equal windows of many documents are fingerprinted and verified once
    w = stored(w.withColumn("wid", F.xxhash64("n", F.concat_ws(" ", "w"))), "window-words")
    one = w.groupBy("wid").agg(F.first("n").alias("n"), F.first("w").alias("w"))
    one = stored(one.withColumn("fp", simhash("w")), "fingerprints")

    masks = F.array(*[F.lit(m) for m in flips(radius // BLOCKS)])
    near = items.select("item_id", "n", "ifp", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block("ifp", b).alias("v")) for b in range(BLOCKS)])).alias("x"))
    near = near.select("item_id", "n", "ifp", "x.b", F.explode(masks).alias("m"), F.col("x.v").alias("v0")).select("item_id", "n", "ifp", "b", F.col("v0").bitwiseXOR(F.col("m")).alias("v"))
    here = one.select("wid", "n", "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block("fp", b).alias("v")) for b in range(BLOCKS)])).alias("x")).select("wid", "n", "fp", "x.b", "x.v")
    pairs = here.join(near, ["n", "b", "v"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))).where(F.col("hamming") <= radius)
    pairs = pairs.select("wid", "item_id", "hamming").distinct()

    both = pairs.join(one.select("wid", "w"), "wid").join(items.select("item_id", "iw"), "item_id")
    both = both.withColumns({"ws": shingle_texts("w", shingle), "is": shingle_texts("iw", shingle)})
    both = both.withColumns({"shared": F.array_intersect("ws", "is"), "all": F.array_union("ws", "is")})
    good = both.withColumn("similarity", weight("shared") / weight("all")).where(F.col("similarity") >= similarity).select("wid", "item_id", "hamming", "similarity")
    found = w.select("doc_id", "start", "n", "wid").join(good, "wid")
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("start"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.start").alias("start_word"), F.col("m.n").alias("n_words"), F.col("m.hamming").alias("hamming"),
                       F.round("m.similarity", 6).alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of the benchmark."""
    hit = stored(matches(docs, benchmark, **options).select(F.col("doc_id").alias("__hit_id")).distinct(), "contaminated")
    return docs.join(checked(hit), docs["doc_id"].eqNullSafe(F.col("__hit_id")), "left_anti")
