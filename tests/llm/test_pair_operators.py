"""Near-duplicates, decontamination and repeated passages against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, words

from tidebar.llm import decontaminate, near_dup, substrings
from tidebar.llm.words import chunks, windows


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, threshold):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def crowd(seed=5):
    """Near copies of one text, most of them linked through others only, and bystanders."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    out = [" ".join(base)]
    for k in range(60):
        own = list(r.choice(out).split())
        for _ in range(r.randint(1, 9)):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        out.append(" ".join(own))
    out += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) for _ in range(20)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("n", [2, 5])
def test_components_of_a_crowd(spark, n):
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.components(docs, n=n).collect()}
    assert got == brute_components(rows, n, 80)


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dup, "GROUP_BLOCK", 4)
    rows = crowd(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.components(docs, n=2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_components_of_odd_texts(spark, odd, none):
    got = near_dup.components(odd, n=2).collect()
    assert len(got) == len(ODD)
    want = brute_components(list({i: (i, t) for i, t in ODD if i is not None}.values()), 2, 80)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert near_dup.components(none).count() == 0
    kept = near_dup.kept_documents(odd, n=2)
    assert kept.columns == odd.columns and 11 not in {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_super_minhash_estimates_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2 ** 63, 3000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = 600
        common = int(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate([pool[:common], pool[2000:2000 + n - common]])
        s = near_dup.super_minhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 1024)
        assert abs((s[0] == s[1]).mean() - share) < 0.06
    one = near_dup.super_minhash(pool[:1], np.array([0, 1]), 64)
    assert sorted((one[0] >> np.uint64(48)).tolist()) == list(range(64))  # an element's ranks are a permutation


def test_group_edges(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {x["node"]: x["root"] for x in near_dup.group_edges(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert got == {k: find(k) for k in root if any(k in e and e[0] != e[1] for e in edges)}
    assert near_dup.group_edges(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seven wizards brew a potion of invisible ink beside the frozen river at midnight"), (2, "short item"), (3, None), (4, "..."),
         (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and all of them again in one line")]


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_matches(docs, items):
    out = set()
    for i, text in docs:
        w = plain_words(text)
        for item, t in items:
            x = plain_words(t)
            if not x or not w:
                continue
            sh = lambda v: {tuple(v[k:k + 5]) for k in range(len(v) - 4)} if len(v) >= 5 else {tuple(v)}
            size = lambda s: sum(len("".join(k)) for k in s)
            for start in range(max(1, len(w) - len(x) + 1)):
                a, b = sh(w[start:start + len(x)]), sh(x)
                if size(a & b) >= 0.8 * size(a | b):
                    out.add((i, item))
    return out


def test_decontamination(spark, odd, none):
    passage = ITEMS[0][1]
    changed = passage.replace("midnight", "noon")
    broken = " ".join(w if k % 4 else "zzz" for k, w in enumerate(passage.split()))
    texts = [f"before {passage.upper()} after", f"x, {changed}!", broken, "short item", "a short item here", passage[:60], "word " * 3000 + passage, None, "", ITEMS[4][1] + " " + passage]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(0, texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_matches([(i, t) for i, t, _ in rows], ITEMS)
    assert {(3, 2), (4, 2)} <= want  # an item of two words, alone and inside a text
    got = decontaminate.matches(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.clean_documents(odd, items.limit(0)).count() == odd.count()



def test_decontamination_by_short_items(spark):
    items = [(1, "alpha beta gamma delta"), (2, "alpha"), (3, "beta, gamma"), (4, "gamma"), (5, "one two three four five")]
    texts = ["x alpha BETA gamma delta y", "alpha", "beta-gamma", "beta x gamma", "alpha beta gamma", "one two three four", "zero one two three four five six", "", None, "alpha " * 50 + "beta gamma delta"]
    rows = list(enumerate(texts))
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_matches(rows, items)
    assert {r["start_word"] for r in got if (r["doc_id"], r["item_id"]) == (9, 1)} == {49}


def test_decontamination_finds_parts_in_another_order(spark):
    r = random.Random(6)
    item = [f"i{k:02d}" for k in range(40)]
    swapped, third = item[20:] + item[:20], item[30:] + item[:30]
    noise = lambda n: [f"n{r.randrange(10 ** 6):06d}" for _ in range(n)]
    texts = [noise(60) + swapped + noise(60), swapped + noise(9), noise(9) + third, noise(30) + item[:33] + noise(30), noise(30) + item[:30] + noise(30), noise(200), item[:10] * 50]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    items = [(1, " ".join(item))]
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == brute_matches(rows, items) >= {(0, 1), (1, 1), (2, 1)}
    assert (got[0, 1]["start_word"], got[0, 1]["similarity"]) == (60, 0.8)


def test_hamming_blocks_find_all_within_radius():
    r = random.Random(4)
    masks = set(decontaminate.flips(3))
    for _ in range(500):
        bits = r.sample(range(64), r.randint(0, 15))
        diff = sum(1 << b for b in bits)
        assert any((diff >> 16 * k) & 0xFFFF in masks for k in range(4))


def test_passages(spark, odd, none):
    r = random.Random(8)
    fresh = iter(range(10 ** 6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    p = new(70)
    fuzzy = list(p)
    for k in (20, 45):
        fuzzy[k] = f"changed{k}"
    del fuzzy[33]
    texts = {0: new(30) + p + new(30), 1: new(10) + p + new(5), 2: fuzzy + new(40), 3: new(100), 4: new(40) + p[:30] + new(40), 5: p[:51], 6: p + p}
    docs = spark.createDataFrame([(k, " ".join(v), 1) for k, v in texts.items()], "doc_id long, text string, seed long")
    got = {}
    for x in substrings.passages(docs).collect():
        got.setdefault(x["doc_id"], []).append((x["source_id"], x["start_word"], x["end_word"], x["source_start"], x["source_end"], x["matches"]))
    assert got[1] == [(0, 10, 80, 30, 100, 70)]
    assert got[5] == [(0, 0, 51, 30, 81, 51)]
    assert [x[:3] for x in got[2]] == [(0, 0, 69)] and got[2][0][5] == 67
    assert sorted(x[1:3] for x in got[6]) == [(0, 70), (70, 140)]
    assert set(got) == {1, 2, 5, 6}
    assert substrings.passages(none).count() == 0
    assert all(x["doc_id"] != x["source_id"] for x in substrings.passages(odd).collect())
    assert r


def test_seeds_of_many_texts_at_once():
    r = random.Random(4)
    texts = [None, "", "a b c d e", "a b c d e f", "x " * 400, *(" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (6, 7, 16, 17, 18, 19, 60, 0, 200)), "z " * 17]
    for w in chunks(pa.array(texts, pa.string()), lower=True):
        got = list(zip(*(x.tolist() for x in substrings.winnowed(w.hashes, w.word, 6, 12))))
        want = set()
        for i in range(len(w)):
            runs = windows(w.hashes[w.word[i]:w.word[i + 1]], 6).tolist()
            for s in range(max(len(runs) - 11, min(len(runs), 1))):
                view = runs[s:s + 12]
                want.add((i, s + view.index(min(view)), min(view)))
        assert len(got) == len(set(got)) and set(got) == want


def covered_words(found):
    out = {}
    for x in found:
        out.setdefault(x["doc_id"], set()).update(range(x["start_word"], x["end_word"]))
    return out


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def check_passages(texts, found, least=50):
    """Every run that an earlier document has is covered, and every passage is one."""
    seen, got = {}, covered_words(found)
    for d in sorted(texts):
        for k in range(len(texts[d]) - least + 1):
            first = seen.setdefault(tuple(texts[d][k:k + least]), d)
            assert first == d or set(range(k, k + least)) <= got.get(d, set()), (d, k, first)
    for x in found:
        a, b = texts[x["doc_id"]][x["start_word"]:x["end_word"]], texts[x["source_id"]][x["source_start"]:x["source_end"]]
        assert x["source_id"] < x["doc_id"] and max(len(a), len(b)) >= least and common_words(a, b) >= 0.8 * max(len(a), len(b))


def test_passages_of_mosaics(spark):
    r = random.Random(3)
    sentences = [[f"s{k}x{j}" for j in range(r.randint(8, 45))] for k in range(60)]
    texts = {k: [f"b{k}"] * 5 + s + [f"e{k}x{j}" for j in range(5)] for k, s in enumerate(sentences)}
    for d in range(100, 130):
        texts[d] = sum((sentences[r.randrange(60)] for _ in range(8)), [])
        if d % 2:
            other = texts[r.randrange(100, d)] if d > 101 else texts[100]
            at = r.randrange(len(other) - 55)
            texts[d] = texts[d][:40] + other[at:at + r.randint(50, 120)] + texts[d][40:90]
    chorus = [f"c{j}" for j in range(7)]
    texts[200], texts[201], texts[202] = chorus * 12, ["x"] + chorus * 10 + ["y"], ["word"] * 300
    texts[203] = ["z"] + ["word"] * 130
    # an unbroken passage whose neighbours are alike too, but not enough
    p, q, s = ([f"{c}{j}" for j in range(60)] for c in "pqs")
    texts[204], texts[205] = q + p, [x if j % 2 else "n" for j, x in enumerate(q)] + p[:52] + s
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string").repartition(3)
    found = substrings.passages(docs).collect()
    assert {101, 201, 203, 205} <= {x["doc_id"] for x in found}
    check_passages(texts, found)


def changed(r, words, every=None, share=0.0):
    """Words of a passage with every n-th changed, or a share of them replaced, left out or doubled; both ends are kept."""
    out = []
    for k, w in enumerate(words):
        if k in (0, len(words) - 1) or not (k % every == every - 1 if every else r.random() < share):
            out.append(w)
        else:
            how = 0 if every else r.randrange(3)
            out += [f"new{r.randrange(10 ** 9)}"] if how == 0 else [] if how == 1 else [w, w]
    return out


def test_passages_with_many_changed_words(spark):
    r = random.Random(11)
    new = lambda n: [f"v{r.randrange(10 ** 9)}" for _ in range(n)]
    texts, wanted = {}, []
    for size in (50, 60, 100):
        for how in ({"every": 12}, {"every": 7}, {"every": 5}, {"share": 0.15}):
            for _ in range(20):
                p, d = new(size), len(texts)
                q = changed(r, p, **how)
                texts[d], texts[d + 1] = new(30) + p + new(30), new(40) + q + new(20)
                if max(len(p), len(q)) >= 50 and common_words(p, q) >= 0.8 * max(len(p), len(q)):
                    wanted.append((d + 1, d, len(q)))
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string").repartition(3)
    found = substrings.passages(docs).collect()
    check_passages(texts, found)
    words = covered_words(found)
    hit = [len(words.get(d, set()) & set(range(40, 40 + n))) >= 0.8 * n for d, _, n in wanted]
    assert len(wanted) > 200 and sum(hit) >= 0.97 * len(wanted), (sum(hit), len(wanted))


def test_changed_passages_whose_parts_came_first_elsewhere(spark):
    r = random.Random(12)
    new = lambda n: [f"v{r.randrange(10 ** 9)}" for _ in range(n)]
    parts = [new(r.randint(18, 24)) for _ in range(40)]
    texts = {k: new(5) + p + new(60) for k, p in enumerate(parts)}
    wanted = []
    for k in range(20):
        p = sum(r.sample(parts, 3), [])
        # two of the three parts came together before, too few words for a passage
        texts[100 + 3 * k] = new(60) + p[:42][-30:] + new(60)
        texts[101 + 3 * k] = new(20) + p + new(20)
        q = changed(r, p, every=8)
        texts[102 + 3 * k] = new(9) + q + new(9)
        wanted.append((102 + 3 * k, range(9, 9 + len(q))))
    # a passage that agrees inside a longer stretch which does not
    p, q, s = new(60), new(60), new(60)
    texts[500], texts[501] = q + p + s, [x if j % 2 else "n" for j, x in enumerate(q)] + changed(r, p, every=9) + [x if j % 2 else "m" for j, x in enumerate(s)]
    wanted.append((501, range(62, 118)))
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string").repartition(3)
    found = substrings.passages(docs).collect()
    check_passages(texts, found)
    words = covered_words(found)
    hit = [len(words.get(d, set()) & set(at)) >= 0.9 * len(at) for d, at in wanted]
    assert hit[-1] and sum(hit) >= 19, hit
