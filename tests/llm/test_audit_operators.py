"""Source divergence, filter audit and license scan against plain Python and SQL."""

import os
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from cases import LOWER, ODD, SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import compare, duck
from tidebar.llm import catalog, divergence, filter_audit, licenses, sorted_ids

ids = st.lists(st.integers(0, 60), max_size=40).map(lambda x: np.unique(np.array(x, np.int64)))


@given(ids, ids, st.lists(ids, max_size=5), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_galloping_equals_sets(a, b, many, block):
    held, sorted_ids.BLOCK = sorted_ids.BLOCK, block
    try:
        x, y = sorted_ids.shared(a, b)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert sorted_ids.without(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert sorted_ids.merged(many).tolist() == sorted(set().union(*[x.tolist() for x in many]))
        assert sorted_ids.places(a, b).tolist() == np.searchsorted(b, a).tolist()
    finally:
        sorted_ids.BLOCK = held


def small_corpus():
    """(doc_id, text, lang, source): odd texts, null keys, a group without terms, a language with one source, ties."""
    rows = [(i, t, "en", f"s{k % 3}") for k, (i, t) in enumerate(ODD)]
    rows += [(100 + k, f"alpha beta {'gamma ' * (k % 4)}Été x{k}", "en", "s1" if k % 2 else "s2") for k in range(12)]
    rows += [(200 + k, "uno dos tres", None, None if k % 2 else "s9") for k in range(4)] + [(300, "solo", "xx", "one"), (301, "123 456", "en", "empty"), (302, "rare", "zz", "a"), (303, None, "zz", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "k", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, value double").repartition(3)


def brute_divergence(rows, min_docs, top=50):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: {t: count[lang, s][t] for t in kept} for x, s in groups if x == lang}

        def priced(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (n + 5) // (total + 5 * len(kept)) for t, n in c.items()}

        whole = priced({t: sum(c[t] for c in own.values()) for t in kept})
        p = {s: priced(c) for s, c in own.items()}
        for s in own:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s],
                     "term": [(p[s][t] - whole[t], t) for t in kept if own[s][t] and p[s][t] > whole[t]]}
            for part, items in parts.items():
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("min_docs,width", [(2, 2), (1, 1 << 16), (1000, 4)])
def test_divergence_brute_force(spark, monkeypatch, min_docs, width):
    monkeypatch.setattr(divergence, "RANGE", width)
    rows = small_corpus()
    got = [tuple(r) for r in divergence.divergence(frame(spark, rows), min_docs, top=3).collect()]
    want = brute_divergence(rows, min_docs, 3)
    assert set(got) == want and len(got) == len(want)


def test_prices_stay_exact_for_large_counts():
    for count, total, terms in [(0, 0, 1), (10**15, 10**15 + 7, 3), (123456789012, 8 * 10**15, 10**6)]:
        want = 1 + 10**9 * (count + 5) // (total + 5 * terms)
        assert divergence.prices(np.array([count]), total, terms).tolist() == [want]


def test_divergence_columns_price_alike(spark):
    rows = [(0, 0, 1), (10**15, 10**15 + 7, 3), (123456789012, 8 * 10**15, 10**6)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("*", divergence.price(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert {(r["c"], r["n"], r["v"], r["p"]) for r in got} == {(c, n, v, 1 + 10**9 * (c + 5) // (n + 5 * v)) for c, n, v in rows}


def brute_audit(rows, labels):
    marks = {k: {d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1)}
    parts = defaultdict(list)
    for i, text, _, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _, _ in rows)}
        parts[source or ""].append(({f for f, x in fails.items() if x}, i in marks[0], i in marks[1]))
    out, gone = [], Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left, before = docs, set()
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                gone[part, f] += len(here)
                out.append((part, order, step, len(left), len(here), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs),
                            sum(d[1] for d in here), sum(d[2] for d in here)))
                before.add(f)
    return sorted((*r, gone[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("width,hot", [(4, 5), (1 << 16, 5000), (1, 50)])
def test_filter_audit_brute_force(spark, monkeypatch, width, hot):
    monkeypatch.setattr(filter_audit, "HOT", hot)
    monkeypatch.setattr(filter_audit.postings, "__defaults__", (width,))
    rows = small_corpus() + [(400 + k, " ".join(f"w{j}" for j in range(250)) + (" #" if k % 2 else "") + " ABC" * (k % 3) * 10, "en", "long") for k in range(9)]
    labels = [(r[0], k % 2, k % 3 % 2) for k, r in enumerate(rows)] + [(100, 1, None), (None, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in filter_audit.audit(frame(spark, rows), given).collect()) == brute_audit(rows, labels)


def test_postings_are_sorted_lists(spark):
    rows = filter_audit.flagged(frame(spark, small_corpus()), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for r in filter_audit.postings(rows, 3).collect():
        assert all(list(r[f]) == sorted(set(r[f])) and len(r[f]) <= r["n_rows"] for f in "ABCDE") and not r["good"]


def brute_scan(rows, templates, phrases, least, slack):
    texts = [licenses.words_of(t or "") for _, t in rows]
    seen = Counter(w for x in texts for w in set(x))
    weight = {w: 1 + np.log((len(rows) + 1) / (seen[w] + 1)) for t in templates for w in licenses.words_of(t.text)}
    out = []
    for (i, _), words in zip(rows, texts):
        def starts(phrase, words=words):
            p = licenses.words_of(phrase)
            return [k for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]

        base = [(k, label) for p, label in phrases.items() for k in starts(p)]
        labels, score = {x[1] for x in base}, float(bool(base))
        for t in templates:
            own = licenses.words_of(t.text)
            total = sum(weight[w] for w in own)
            for o in range(-len(own) - slack, len(words) + slack):
                share = sum(weight[w] for k, w in enumerate(own) if w in words[max(0, o + k - slack):max(0, o + k + slack + 1)]) / total
                if share >= least - 1e-9 and all(any(o - slack <= s and s + len(licenses.words_of(p)) <= o + len(own) + slack for s in starts(p)) for p in t.phrases):
                    labels.add(t.label)
                    score = max(score, min(share, 1.0))
        places = [x[0] for x in base]
        out.append((i, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x[1] for x in base})), ",".join(sorted(labels)), round(score, 9)))
    return Counter(out)


def test_license_scan_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, t if len(t or "") < 1000 else t[:300]) for i, t in ODD]
    for k in range(160):
        t = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        w = t.text.split()
        for _ in range(k % 5):  # changed, lost and added words
            at = int(r.integers(len(w)))
            w[at:at + int(r.integers(0, 2))] = ["other"] * int(r.integers(0, 2))
            w = w or ["x"]
        noise = [str(x) for x in r.choice(["the", "of", "License", "license,", "under", "permission", "cc", "by", "mit"], int(r.integers(0, 25)))]
        at = int(r.integers(0, len(noise) + 1))
        rows.append((1000 + k, " ".join(noise[:at] + w + noise[at:])))
    docs = spark.createDataFrame([(*x, "a", 1.0) for x in rows], "doc_id long, text string, labels string, score double").repartition(3)
    for least, slack in ((0.75, 3), (0.5, 0)):
        got = Counter((*x[:-1], round(x[-1], 9)) for x in map(tuple, licenses.scanned(docs, least=least, slack=slack).collect()))
        assert got == brute_scan(rows, licenses.TEMPLATES, licenses.PHRASES, least, slack)
    assert sum(v for k, v in got.items() if "," in k[-2]) > 10
    assert licenses.scanned(docs, templates=(), phrases={}).where("score > 0 OR labels <> ''").count() == 0


def test_empty_tables(spark):
    none = frame(spark, small_corpus()).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert divergence.divergence(none).count() == filter_audit.audit(none, labels).count() == licenses.scanned(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
@pytest.mark.parametrize("key", ["op2_decontamination", "op7_url_filter", "op8_near_dedup", "op11_source_divergence", "op12_filter_audit"])
def test_matches_sql(spark, key):
    result = compare(spark, duck(SF), key, SF, catalog.QUERIES, catalog.ORACLES)
    assert result.startswith("ok"), result


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
def test_pipeline_stages_on_odd_and_empty_documents(spark):
    import corpus_pipeline

    long = "plain words of a document that goes on for a while and says one thing after another " * 8
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", None if t is None else len(t), "x", 1) for k, (i, t) in enumerate(ODD)]
    rows += [(500, long, "en", "s", len(long), "y", 2), (501, long, "en", "s", len(long), "y", 2), (501, long, "en", "s", len(long), "y", 2), (None, long + "and more", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, block int").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        none = stage(spark, docs.limit(0), SF)
        assert out.count() >= 0 and none.count() == 0 and none.columns == out.columns
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    assert dict(corpus_pipeline.STAGES)["pii"](spark, docs, SF).count() == len(rows)
    kept = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs.where("doc_id >= 500"), SF).collect()]
    assert kept == [500]
    packed = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, SF)
    assert packed.where("piece = 0").count() == len(rows)
