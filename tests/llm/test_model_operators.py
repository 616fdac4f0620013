"""Packing, language-model scoring, the classifier and the pipeline."""

import collections
import math
import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import ODD, SF, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebar.llm import classifier, katz, packing
from tidebar.llm.tokens import Encoder
from tidebar.llm.words import chunks

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@given(st.lists(st.text(alphabet=" \n\t 　\x1cab'1é😀<|endoftxt>.\r", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_pieces_encode_as_whole_texts(values):
    encoder = test_pieces_encode_as_whole_texts.__dict__.setdefault("encoder", Encoder(VOCABULARY))
    want = [e.ids for e in encoder.tokenizer.encode_batch(values, add_special_tokens=False)]
    got = [ids[at[k]:at[k + 1]].tolist() for _, ids, at in encoder.batches(pa.array(values, pa.string())) for k in range(len(at) - 1)]
    assert got == want


def check_packing(rows, texts, tokenizer, capacity):
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
        if r["doc_id"] is None:
            continue
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r["ids_crc32"] and len(own) == r["length"]
    for k, own in by_bin.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return ids, by_doc, len(by_bin)


def test_packing(docs, texts, tokenizer, odd, none):
    rows = packing.pack(docs.repartition(5), VOCABULARY, capacity=256).collect()
    ids, by_doc, bins = check_packing(rows, texts, tokenizer, 256)
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids[k])
        assert all(r["length"] == 256 for r in own[1:]) and (len(own) == 1 or len(ids[k]) > 256)
    assert bins <= -(-sum(map(len, ids.values())) // 256) * 1.02 + 2  # waste
    rows = packing.pack(odd, VOCABULARY).collect()
    check_packing(rows, {i: t for i, t in ODD if i is not None}, tokenizer, 1024)
    assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == collections.Counter(i for i, _ in ODD)
    assert packing.pack(none, VOCABULARY).count() == 0


def test_best_two_fit_uses_every_piece_and_beats_greedy():
    r = np.random.default_rng(5)
    counts = np.bincount(r.integers(1, 101, 5000), minlength=101)
    plan = packing.best_two_fit(counts, 100)
    used = np.zeros(101, int)
    for pattern, times in plan:
        assert sum(pattern) <= 100
        for s in pattern:
            used[s] += times
    assert (used == counts).all()
    # size 6, gap 4: two fives fill the gap that taking the six back leaves
    counts = np.zeros(11, int)
    counts[[4, 3, 2]] = [1, 1, 1]
    counts[6] = 1
    assert packing.best_two_fit(counts, 10)[0][0] == [6, 4]
    counts = np.zeros(21, int)
    counts[[11, 7, 5, 4]] = 1
    assert sorted(packing.best_two_fit(counts, 20)[0][0]) == [4, 5, 11]


def plain_katz(texts, held, vocabulary):
    """The model of katz.py in plain Python: scores, and the sum of probabilities after some histories."""
    end, begin, other = ("end",), ("begin",), ("other",)
    tokens = {i: [*words(t), end] for i, t in texts.items()}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)

    def worth(counts):
        sizes = collections.Counter(counts)
        w = katz.discounted(np.array([0, *[sizes[r] for r in range(1, katz.K + 2)]]))
        return lambda x: w[x] if x <= katz.K else x - katz.ABOVE

    value = worth(c.values())
    p1 = {w: value(x) / n for w, x in c.items()}
    unknown = 1 - sum(p1.values())
    hashes = {}
    for w in [w for w in c if w != end]:
        hashes[w] = int(next(chunks(pa.array([w]))).hashes.view(np.int64)[0])
    top = set(sorted(hashes, key=lambda w: (-c[w], hashes[w]))[:vocabulary])
    new = ("new",)
    kind = lambda w: w if w in top or w == end else other if w in c else new
    past = lambda w: w if w in top or w == begin else other
    classes = collections.Counter({new: unknown})
    for w, p in p1.items():
        classes[kind(w)] += p
    pairs, seen = collections.Counter(), collections.Counter()
    for i, ws in tokens.items():
        for h, w in zip([begin, *map(past, ws)], ws):
            if not held[i]:
                pairs[h, kind(w)] += 1
                seen[h] += 1
    of_pair = worth(pairs.values())
    freed, mass = collections.Counter(), collections.Counter()
    for (h, w), x in pairs.items():
        freed[h] += x - of_pair(x)
        mass[h] += classes[w]
    alpha = {h: freed[h] / seen[h] / (1 - mass[h]) for h in seen}
    chance = lambda h, w: of_pair(pairs[h, w]) / seen[h] if (h, w) in pairs else alpha.get(h, 1) * classes[w]
    rows = {}
    for i, ws in tokens.items():
        score = base = 0.0
        for h, w in zip([begin, *map(past, ws)], ws):
            p = chance(h, kind(w))
            score += math.log10(p * (p1[w] / classes[other] if kind(w) == other else 1))
            base += math.log10((c[w] + 1) / (n + v + 1))
        rows[i] = len(ws), sum(c[w] > 0 for w in ws), n, base, score
    return rows, [sum(chance(h, w) for w in classes) for h in list(seen)[:20]]


@pytest.mark.parametrize("vocabulary", [50, 400_000])
def test_katz(docs, texts, vocabulary, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 20_000)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 100_000)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    want, sums = plain_katz(texts, held, vocabulary)
    assert max(abs(s - 1) for s in sums) < 1e-9
    got = katz.scored(docs.repartition(3), vocabulary).collect()
    assert len(got) == len(texts)
    for r in got:
        n, known, train, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], n, known, train)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6
    some = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)


@pytest.mark.parametrize("table", [0, 50, 3_000])
def test_katz_of_every_word(docs, texts, table, monkeypatch):
    """Words without a number in the table are classes and histories of their own all the same."""
    monkeypatch.setattr(katz, "TABLE", table)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 20_000)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 100_000)
    want, sums = plain_katz(texts, {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}, 10 ** 9)
    assert max(abs(s - 1) for s in sums) < 1e-9
    got = katz.scored(docs.repartition(3)).collect()
    assert len(got) == len(texts)
    for r in got:
        _, known, _, base, score = want[r["doc_id"]]
        assert r["n_known"] == known and abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6


def test_katz_in_little_memory(docs, texts, monkeypatch):
    """Buckets give out their rows piece by piece, and every task on texts or buckets returns the memory it has freed."""
    wrapped, inner = [], katz.tidied
    monkeypatch.setattr(katz, "tidied", lambda run: wrapped.append(run) or inner(run))
    monkeypatch.setattr(katz, "OUT_ROWS", 7)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 50_000)
    want, _ = plain_katz(texts, {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}, 50)
    got = katz.scored(docs.repartition(3), 50).collect()
    assert len(wrapped) == 4
    assert all(abs(r["score"] - want[r["doc_id"]][4]) < 1e-6 for r in got) and len(got) == len(texts)


def test_katz_of_one_very_frequent_pair(docs, texts, spark, monkeypatch):
    """Nearly all tokens are one pair, so its bucket has many parts; none of them, and no reply, grows with that."""
    for name, value in (("BUCKET_TOKENS", 20_000), ("BLOCK_BYTES", 20_000), ("PART_TOKENS", 500), ("HELD_BYTES", 3_000), ("GATHERED", 400)):
        monkeypatch.setattr(katz, name, value)
    own = {**{k: v for k, v in list(texts.items())[:60]}, **{10 ** 6 + k: "la " * 700 + f"end{k}" for k in range(80)}}
    d = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(3)
    wrapped, inner = [], katz.tidied
    monkeypatch.setattr(katz, "tidied", lambda run: wrapped.append(run) or inner(run))
    totals = katz.Totals(katz.word_counts(d), d, None)
    rows = katz._blocks(d, totals, 40).collect()
    assert max(len(r["data"]) for r in rows if r["kind"] == katz._PAIRS) < 8_000
    hot = [r for r in rows if r["kind"] != katz._INFO]
    assert max(collections.Counter(r["bucket"] for r in hot).values()) > 50
    replies = katz._counted(spark.createDataFrame(rows).repartition(4, "bucket").sortWithinPartitions("bucket"), totals).where(f"kind = {katz._INFO} AND data IS NOT NULL").collect()
    size = sum(len(r["data"]) for r in replies if katz.unpacked(r["data"])[0][0] != katz._INFO)
    assert size < 200 * len(replies) + 64 * totals.all  # goes with tokens, not with documents times buckets
    want, _ = plain_katz(own, {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in own}, 10 ** 9)
    got = katz.scored(d).collect()
    assert len(got) == len(own)
    assert all(abs(r["score"] - want[r["doc_id"]][4]) < 1e-6 and r["n_known"] == want[r["doc_id"]][1] for r in got)


def test_katz_of_odd_texts(odd, none, spark):
    got = katz.scored(odd).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in ODD)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 and r["n_tokens"] >= 1 for r in got)
    assert katz.scored(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = katz.scored(spark.createDataFrame([(held, "a b c")], "doc_id long, text string")).collect()[0]
    assert (only["train_tokens"], only["n_known"], only["base_score"], only["score"]) == (0, 0, 0.0, 0.0)


def test_classifier(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in classifier.scored(docs, labels).collect()}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in got}
    held = [(q, got[i]["predicted"]) for i, q in marked.items() if got[i]["held_out"]]
    assert held and sum(q == p for q, p in held) >= 0.85 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    scores = classifier.scored(odd, spark.createDataFrame([(5, 1), (10, 0), (11, 1), (9, 0), (None, 1)], "doc_id long, quality int")).collect()
    assert collections.Counter(r["doc_id"] for r in scores) == collections.Counter(i for i, _ in ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert {r["score"] for r in classifier.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert classifier.scored(none, labels).count() == 0


def test_context_sums_by_hand(spark):
    sums = classifier.context_sums(spark.createDataFrame([("aa bb",), (None,), ("",)], "text string"))
    word, shape, _ = classifier.rows_of(next(chunks(pa.array(["aa bb"]), lower=True)))
    plus, minus = classifier._index_vectors()
    want = np.zeros_like(sums)
    for here, there in ((0, 1), (1, 0)):
        for row in (word[here], shape[here]):
            for other in (word[there], shape[there]):
                want[row, plus[other]] += 1
                want[row, minus[other]] -= 1
    assert (sums == want).all()


def test_pipeline(spark, docs, tokenizer):
    import corpus_pipeline
    from test_pair_operators import brute_components, brute_matches
    from test_text_operators import base_counts, base_spans

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = stages["quality_rules"](spark, docs, SF)
    kept = {r["doc_id"] for r in one.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i in rows:
        n, _, _, _, again = base_counts(rows[i])
        assert i not in kept or n >= 50 and 100 * again <= 50 * n
    clean = [i for i in rows if labels.get(i) == 1 and base_counts(rows[i])[0] >= 50 and 100 * base_counts(rows[i])[4] <= 50 * base_counts(rows[i])[0]]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    two = stages["near_dedup"](spark, docs, SF)
    groups = brute_components(sorted(rows.items()), 5, 80)
    assert {r["doc_id"] for r in two.collect()} == {i for i, (_, c) in groups.items() if c == i}
    three = stages["decontamination"](spark, docs, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in three.collect()} == set(rows) - {i for i, _ in brute_matches(rows.items(), items)}
    four = stages["pii"](spark, docs, SF)
    for r in four.collect():
        assert r["n_chars"] == len(r["text"]) and not any(rows[r["doc_id"]][s:e] in r["text"] for k, s, e in base_spans(rows[r["doc_id"]]) if k == "email")
    for frame in (one, two, three, four):
        assert frame.columns == docs.columns
    if os.environ.get("TIDEBAR_ALL"):
        assert corpus_pipeline.run(spark, SF).count() > 0
