"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's set holds its distinct n-word shingles. SuperMinHash gives every element its own random permutation of the
signature's slots: in step j the element offers ``j + r`` (r uniform in 0..1) to the j-th slot of its permutation. Steps
of later rank offer larger values only, so a document stops as soon as all its slots are filled, and the ranks of one
element are spread over the slots, which lowers the variance.

1. One pass over the texts gives set size, a 128-bit key of the set, band keys and the signature's slots cut to 16 bits.
   Documents of equal sets form a class, found by an aggregate; from here on a class is one row, so thousands of copies
   cost nothing more.
2. Classes meet in bands. In each band bucket every class is compared with the bucket's hub only, the class that shares most
   buckets; a hub's classes are spread over blocks of bounded size, each with the hub's text. Confirmed links are grouped by
   union-find, and buckets whose classes are all in one group are done.
3. In the other buckets the classes meet in blocks of bounded size with signatures and full sets. A class of the bucket's
   largest group is in one block, the others visit all and ask there, so every pair of different groups meets. Where
   signatures agree well enough and no link of this task has joined the two groups already, the sets are intersected there.
   Only confirmed links leave a task, fewer than the groups it has seen, so no rows grow with the square of a group.
4. Links are confirmed on the full sets. The smallest doc_id of a group is its component. Groups are merged by large-star
   and small-star steps on the edge table; nothing is collected.

Documents link when 100 * intersection >= threshold * union. A pair at similarity 0.8 shares none of 32 bands of 4 rows
with probability (1 - 0.8 ** 4) ** 32 < 5e-8, and its signatures agree in fewer slots than ``_agreeing`` asks (4.4 standard
deviations below the mean) with probability 6e-6.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows of one doc_id are one document of the group, each row kept in the output; an empty
table gives no rows; extra columns are ignored by ``components`` and kept by ``kept_documents``; a row without a doc_id is
never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, stored
from .words import chunks, mix, tidied, windows

SIGNED = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, slots binary"
#: Classes of one block of a bucket, and of one block of a hub.
BUCKET_BLOCK, GROUP_BLOCK = 1024, 256
BROADCAST_ROWS = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _distinct(hashes: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a chunk, sorted per text, and their offsets."""
    runs = windows(hashes, n)
    sets = []
    for a, b in zip(word[:-1].tolist(), word[1:].tolist()):
        if b - a >= n:
            sets.append(np.unique(runs[a:b - n + 1]))
        elif b > a:
            sets.append(windows(hashes[a:b], b - a))
        else:
            sets.append(hashes[:0])
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else hashes[:0]), at


def super_minhash(elements: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    """Signatures of the sets elements[at[i]:at[i + 1]], one row each; an empty set keeps the largest value.

    Value and step are joined in one integer (step in the high bits), so slots compare by integers.
    """
    n = len(at) - 1
    out = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    table = out.reshape(n, slots)
    doc = np.repeat(np.arange(n), np.diff(at))
    unfilled = np.arange(n)
    live = elements.copy()
    perm = None
    for step in range(slots):
        if not len(live):
            break
        draw = mix(live + np.uint64((step + 1) * int(_GOLD) % 2**64))
        place = step + ((draw & np.uint64(0xFFFF)) % np.uint64(slots - step)).astype(np.int64)
        rank = (draw >> np.uint64(16)) | (np.uint64(step) << np.uint64(48))
        if perm is None:
            slot = place
        else:
            rows = np.arange(len(live))
            slot = perm[rows, place].astype(np.int64)
            perm[rows, place] = perm[:, step]
            perm[:, step] = slot
        np.minimum.at(out, doc * slots + slot, rank)
        unfilled = unfilled[table[unfilled].max(axis=1) >> np.uint64(48) > step]
        waits = np.zeros(n, bool)
        waits[unfilled] = True
        keep = waits[doc]
        if step == 0:
            perm = np.tile(np.arange(slots, dtype=np.uint16), (int(keep.sum()), 1))
            rows, first = np.arange(len(perm)), place[keep]
            perm[rows, first] = 0
            perm[:, 0] = first
        else:
            perm = perm[keep]
        live, doc = live[keep], doc[keep]
    return table


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One key per band, made of its rows and its number."""
    n, slots = signature.shape
    rows = signature.reshape(n, bands, slots // bands)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (n, 1))
    for k in range(rows.shape[2]):
        key = mix(key + rows[:, :, k])
    return key


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Set size, 128-bit key of the set and band keys per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            ids = batch.column(names.index("doc_id"))
            for w in chunks(batch.column(names.index("text")), lower=True, size=1_000_000):
                elements, at = _distinct(w.hashes, w.word, n)
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                keys = np.zeros((len(w), 2), np.uint64)
                begin = at[some]
                if len(some):
                    keys[some, 0] = mix(np.add.reduceat(mix(elements), begin) + sizes[some].astype(np.uint64))
                    keys[some, 1] = mix(np.add.reduceat(mix(elements ^ _GOLD), begin) + sizes[some].astype(np.uint64))
                signature = super_minhash(elements, np.append(begin, at[-1]), bands * rows)
                flat = np.zeros((len(w), bands), np.uint64)
                flat[some] = band_keys(signature, bands)
                cut = np.zeros((len(w), bands * rows), np.uint16)
                cut[some] = (signature & np.uint64(0xFFFF)).astype(np.uint16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * bands, pa.int32()), pa.array(flat.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.first, len(w)).cast(pa.int64()), pa.array(sizes), pa.array(keys[:, 0].view(np.int64)),
                     pa.array(keys[:, 1].view(np.int64)), lists, pa.array([c.tobytes() for c in cut], pa.binary())],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "bands", "slots"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidied(run), SIGNED)


def group_edges(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) rows: one row (node, root) per node, root the smallest node reachable.

    Large-star and small-star steps until the edge table stays the same; each step is written to the shared folder.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = stored(small.select("x.a", "x.b").where("a <> b").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _agreeing(slots: int, threshold: int) -> int:
    """Slots that the signatures of a linked pair agree in, but for one pair in 150,000 at the threshold."""
    j = threshold / 100
    return int(slots * j - 4.4 * (slots * j * (1 - j)) ** 0.5)


class _Joined:
    """Union-find over group roots: what the links given out so far have joined."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.version = 0

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)
        self.version += 1


class _Block:
    """The own classes of one block: signatures, groups, and an index from shingles to the sets that hold them."""

    def __init__(self, slots: int):
        self.ids, self.roots, self.sets, self.sigs = [], [], [], np.zeros((64, slots), np.uint16)
        self.index, self.seen = None, -1

    def add(self, own: int, root: int, elements: np.ndarray, sig: np.ndarray) -> None:
        if len(self.ids) == len(self.sigs):
            self.sigs = np.concatenate([self.sigs, np.zeros_like(self.sigs)])
        self.sigs[len(self.ids)] = sig
        self.ids.append(own)
        self.roots.append(root)
        self.sets.append(elements)

    def ask(self, own: int, root: int, elements: np.ndarray, sig: np.ndarray, joined: _Joined, need: int, threshold: int, links: list) -> None:
        """Add to ``links`` one class of each group, not joined yet, that has a set similar enough."""
        if self.seen != joined.version:
            self.tops, self.seen = np.array([joined.find(r) for r in self.roots], np.int64), joined.version
        near = (self.tops != joined.find(root)) & ((self.sigs[:len(self.ids)] == sig).sum(1) >= need)
        if not near.any():
            return
        if self.index is None:
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            sizes = np.array([len(x) for x in self.sets], np.int64)
            self.index = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        flat, owner, sizes = self.index
        low, high = np.searchsorted(flat, elements, "left"), np.searchsorted(flat, elements, "right")
        count = high - low
        hit = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        common = np.bincount(owner[hit], minlength=len(sizes))
        for k in np.flatnonzero(near & (common * 100 >= threshold * (sizes + len(elements) - common))).tolist():
            if joined.find(self.roots[k]) != joined.find(root):
                joined.join(self.roots[k], root)
                links.append((own, self.ids[k]))


def _links_in_blocks(rows: DataFrame, need: int, threshold: int) -> DataFrame:
    """Confirmed links (a, b) between classes of different groups that meet in a block of a bucket.

    ``rows`` (band, key, block, visits, asks, class_id, root, slots, elements) are sorted by the first four: a block's own
    classes come first and are held, then those that only visit it. Each class outside the bucket's largest group asks the
    held ones: signatures say whether it may have a partner in a group that the task's earlier links have not joined to its
    own, and then its full set is intersected with all held sets at once. A task gives out fewer links than it has groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, now, block, waiting = _Joined(), None, None, []

        def settle(links: list) -> None:
            for x in waiting:
                block.ask(*x, joined, need, threshold, links)
            waiting.clear()

        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = list(zip(*(col[k].to_pylist() for k in ("band", "key", "block"))))
            visits, asks, ids, roots = (col[k].to_pylist() for k in ("visits", "asks", "class_id", "root"))
            sigs = np.frombuffer(b"".join(col["slots"].to_pylist()), np.uint16).reshape(len(keys), -1)
            links: list[tuple[int, int]] = []
            for r, key in enumerate(keys):
                if key != now:
                    settle(links)
                    now, block = key, _Block(sigs.shape[1])
                x = ids[r], roots[r], np.frombuffer(col["elements"][r].as_py(), np.uint64), sigs[r]
                if not visits[r]:
                    block.add(*x)
                    if asks[r]:
                        waiting.append(x)
                else:
                    settle(links)
                    if block.ids:
                        block.ask(*x, joined, need, threshold, links)
            yield _link_rows(links)
        links = []
        settle(links)
        yield _link_rows(links)

    return rows.mapInArrow(tidied(run), "a long, b long")


def _link_rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
    cols = list(zip(*links)) if links else [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(class_id, elements): the sorted distinct shingles of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunks(batch.column(1), lower=True, size=1_000_000):
                elements, at = _distinct(w.hashes, w.word, n)
                blobs = [elements[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(w)), pa.array(blobs, pa.binary())], names=["class_id", "elements"])

    return small_batches(texts).select("doc_id", "text").mapInArrow(tidied(run), "class_id long, elements binary")


def _against_hubs(rows: DataFrame, n: int, threshold: int) -> DataFrame:
    """Links (a, b): the classes asked in a block of a hub that are similar enough to it.

    ``rows`` (root, block, asked, id, text) are sorted by root, block and asked, so the hub's set comes before what is checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, ids, index = None, [], [], None
        for batch in batches:
            root, block, asked, own = (batch.column(k).to_pylist() for k in range(4))
            links = []
            for w in chunks(batch.column(4), lower=True, size=1_000_000):
                elements, at = _distinct(w.hashes, w.word, n)
                for k in range(len(w)):
                    r, s = w.first + k, elements[at[k]:at[k + 1]]
                    if now != (root[r], block[r]):
                        now, sets, ids, index = (root[r], block[r]), [], [], None
                    if not asked[r]:
                        sets.append(s.copy())
                        ids.append(own[r])
                        continue
                    if index is None:
                        sizes = np.array([len(x) for x in sets], np.int64)
                        flat = np.concatenate(sets) if sets else s[:0]
                        order = np.argsort(flat, kind="stable")
                        index = flat[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
                    if not len(index[2]):
                        continue
                    low, high = np.searchsorted(index[0], s, "left"), np.searchsorted(index[0], s, "right")
                    count = high - low
                    hit = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    common = np.bincount(index[1][hit], minlength=len(index[2]))
                    union = index[2] + len(s) - common
                    good = np.flatnonzero(common * 100 >= threshold * union)
                    if len(good):
                        b = good[int((common[good] / union[good]).argmax())]
                        links.append((own[r], ids[b]))
            cols = list(zip(*links)) if links else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return rows.mapInArrow(tidied(run), "a long, b long")


def components(docs: DataFrame, n: int = 5, threshold: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id (smallest doc_id of the same set) per row of docs."""
    marks = stored(signed(docs, n, bands, rows), "signatures")
    some = marks.where("n_shingles > 0")
    reps = some.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("class_id"), F.min_by(F.struct("bands", "slots"), "doc_id").alias("s"))
    reps = stored(reps.select("key_a", "key_b", "class_id", "s.*"), "classes")
    buckets = reps.select("class_id", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(buckets.join(shared, ["band", "key"]), "buckets")
    degree = members.groupBy("class_id").agg(F.sum("size").alias("degree"))
    members = stored(members.join(degree, "class_id").select("band", "key", "size", "class_id", "degree"), "members")
    wanted = stored(members.select(F.col("class_id").alias("doc_id")).distinct(), "candidates")
    texts = stored(docs.select("doc_id", "text").join(checked(wanted), "doc_id", "left_semi"), "texts")

    hub = members.groupBy("band", "key").agg(F.max_by("class_id", F.struct("degree", -F.col("class_id"))).alias("hub"))
    pairs = stored(members.join(hub, ["band", "key"]).where("class_id <> hub").select("hub", "class_id").distinct(), "pairs")
    stars = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("blocks"))
    asked = pairs.join(stars, "hub").select(F.col("hub").alias("root"), F.expr("CAST(pmod(xxhash64(class_id), blocks) AS INT)").alias("block"), F.lit(True).alias("asked"), F.col("class_id").alias("doc_id"))
    work = asked.unionByName(stars.select(F.col("hub").alias("root"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asked"), F.col("hub").alias("doc_id")))
    work = work.join(texts.hint("merge"), "doc_id").select("root", "block", "asked", "doc_id", "text").repartition("root", "block").sortWithinPartitions("root", "block", "asked")
    links = stored(_against_hubs(work, n, threshold), "links")

    roots = group_edges(links).withColumnRenamed("node", "class_id")
    grouped = stored(reps.select("class_id").distinct().join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id")), "groups")
    labelled = stored(members.join(grouped, "class_id"), "labelled")
    undone = labelled.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "key").agg(F.max_by("root", "n").alias("largest"), F.count(F.lit(1)).alias("groups"))
    undone = stored(labelled.join(undone.where("groups > 1").drop("groups"), ["band", "key"]).select("band", "key", "size", "class_id", "root", "largest"), "undone")
    left = stored(undone.select("class_id").distinct().withColumnRenamed("class_id", "doc_id"), "left")
    facts = _sets(texts.join(checked(left), "doc_id", "left_semi"), n).join(reps.select("class_id", "slots"), "class_id")
    undone = undone.withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")).withColumn("home", F.expr("CAST(pmod(xxhash64(class_id), blocks) AS INT)"))
    visits = F.when(F.col("root") == F.col("largest"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    undone = undone.withColumn("block", F.explode(visits)).select("band", "key", "block", (F.col("block") != F.col("home")).alias("visits"), (F.col("root") != F.col("largest")).alias("asks"), "class_id", "root")
    undone = undone.join(stored(facts, "sets"), "class_id").select("band", "key", "block", "visits", "asks", "class_id", "root", "slots", "elements")
    undone = undone.repartition("band", "key", "block").sortWithinPartitions("band", "key", "block", "visits")
    links = links.unionByName(stored(_links_in_blocks(undone, _agreeing(bands * rows, threshold), threshold), "links"))

    roots = group_edges(links).withColumnRenamed("node", "class_id")
    top = reps.select("class_id", "key_a", "key_b").join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    out = marks.select("doc_id", "n_shingles", "key_a", "key_b").join(top, ["key_a", "key_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
                      F.coalesce("class_id", "doc_id").alias("class_id"))


def checked(ids: DataFrame) -> DataFrame:
    """Broadcast a stored table of ids if it has at most BROADCAST_ROWS rows, counted just now; a shuffle join otherwise."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that ``components`` keeps; rows without a doc_id stay."""
    gone = stored(components(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id")).distinct(), "copies")
    return docs.join(checked(gone), docs["doc_id"] == gone["__gone_id"], "left_anti")
