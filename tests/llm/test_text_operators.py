"""Chat formatting, quality rules, personal data and URL rules against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebar.llm import chat, pii, quality_rules, url_filter
from tidebar.llm.words import chunks

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CHAT = "conv_id long, turn long, role string, text string, window_no int"
nasty = st.text(alphabet="<|\\>im_startend\n ab\u00e9", max_size=40)


@given(nasty)
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def digests(turns):
    body = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget", [40, 2048])
def test_chat_reads_back(spark, budget):
    long = "very long answer " * 300
    cases = {1: [("system", "be kind"), ("user", "hi <|im_end|>\n"), ("assistant", "<|im_start|>assistant\nok"), ("user", "more"), ("assistant", long), ("user", "bye"), ("assistant", "")],
             2: [("assistant", None), (None, "x"), ("user\nassistant", "<\\|")], 3: [("user", "")], None: [("user", "q"), ("assistant", "a")]}
    rows = [(i, k, r, t, 7) for i, turns in cases.items() for k, (r, t) in enumerate(turns)]
    windows = chat.format_windows(spark.createDataFrame(rows, CHAT).repartition(3), VOCABULARY, budget=budget, history=30)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {k: digests(v) for k, v in cases.items()}
    own = sorted((r for r in windows.where("conv_id = 1").collect()), key=lambda r: r["window_no"])
    assert (len(own) > 1) == (budget == 40)
    for w in own:
        assert w["text"].startswith("<|im_start|>system\nbe kind<|im_end|>\n")  # the system turn stays
        new = [n for n in w["turns"] if n >= w["first_new"]]
        assert w["n_tokens"] <= budget or len(new) == 1


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], CHAT)
    assert chat.read_back(chat.format_windows(empty, VOCABULARY)).count() == 0


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    repeated = {k + j for k in range(len(w) - 2) if triples[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_quality_counts(odd, docs, none):
    for frame in (odd, docs):
        want = Counter((r["doc_id"], *base_counts(r["text"])) for r in frame.select("doc_id", "text").collect())
        got = quality_rules.judged(frame, quality_rules.Chain()).collect()
        assert Counter(tuple(r[k] for k in ["doc_id", *quality_rules.COUNTS]) for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert r["kept"] == (not r["base_failed"])  # a chain without weights finds content only
    assert quality_rules.judged(none, quality_rules.Chain()).count() == 0
    assert quality_rules.kept_documents(odd, quality_rules.Chain()).columns == odd.columns


def test_line_equality_sees_white_space():
    import pyarrow as pa

    text = "a b\na\tb\na b \n a b\na b\na  b\n\n\na\tb"
    counts = next(quality_rules.measured(w) for w in chunks(pa.array([text])))[0]
    assert counts[0, 3] == 2


def brute_best(chain, features):
    best, score = None, -np.inf
    for bits in range(2 ** len(features)):
        states = [(bits >> k) & 1 for k in range(len(features))]
        s = sum(features[k] @ chain.weights for k in range(len(features)) if states[k]) + sum(chain.steps[a, b] for a, b in zip(states, states[1:]))
        if s > score + 1e-12:
            best, score = states, s
    return best, score


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    chain = quality_rules.Chain(r.normal(size=quality_rules.FEATURES), r.normal(size=(2, 2)))
    sizes = [1, 6, 0, 4]
    lines = np.concatenate([[0], np.cumsum(sizes)])
    features = r.normal(size=(lines[-1], quality_rules.FEATURES))
    states = chain.decode(features, lines)
    for a, b in zip(lines[:-1], lines[1:]):
        if b > a:
            assert states[a:b].astype(int).tolist() == brute_best(chain, features[a:b])[0]


def test_chain_learns_junk(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"]: r for r in quality_rules.judged(docs, quality_rules.fit_chain(docs, labels)).collect()}
    judged = [(r["quality"], kept[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in kept and not kept[r["doc_id"]]["base_failed"]]
    assert sum(bool(q) == k["kept"] for q, k in judged) >= 0.9 * len(judged)
    assert quality_rules.fit_chain(docs, labels.limit(0)).decode(np.ones((2, quality_rules.FEATURES)), np.array([0, 2])).tolist() == [False, False]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


PERSONAL = ["a@b.c_d@e.f x_@y.z é 1.2.3.4.5.6.7.8 +12 (345) 678-90 4111 1111 1111 1111 4111-1111-1111-1112", "😀a@b.co é 1.02.000.255 256.1.1.1 0001.2.3.4", "9" * 5000, "a" * 20000,
            "a@" + "b." * 8000 + "c", "+1" + "(" * 5000, "1." * 9000, "x@y.z@w.v.u@a.b", "..a@b-.c", "+1 2 3 4 5 6 7 8 9 +1-2-3-4-5-6-7-8-9-", None, ""]


def test_personal_data(spark, odd, docs, none):
    own = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for frame in (own, docs, odd):
        want = Counter()
        for r in frame.select("doc_id", "text").collect():
            b = base_spans(r["text"])
            want[r["doc_id"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest(), *[sum(x[0] == k for x in b) for k in PATTERNS]] += 1
        assert Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.digests(frame).collect()) == want
    assert pii.digests(none).count() == 0


def test_more_kinds_and_redaction(spark):
    text = "iban DE89370400440532013000, not DE89370400440532013001; ssn 123-45-6789 but 123-45-6789 alone; born 1990-01-02 mail a@b.co"
    d = spark.createDataFrame([(1, text, "z"), (2, None, "z")], "doc_id long, text string, kind string")
    spans = {(s["kind"], s["match"]) for s in pii.spans(d).where("doc_id = 1").first()["spans"]}
    assert ("iban", "DE89370400440532013000") in spans and ("iban", "DE89370400440532013001") not in spans
    assert ("dob", "1990-01-02") in spans and ("email", "a@b.co") in spans
    assert sum(k == "ssn" for k, _ in spans) == 1
    out = {r["doc_id"]: r for r in pii.redacted(d).collect()}
    assert out[1]["text"].startswith("iban [iban], not DE89370400440532013001; ssn [ssn]") and out[1]["text"].endswith("[email]") and out[2]["text"] is None


URLS = ["http://example.com/en/1", "https://WWW.Example.com/en/1", "http://a.example.com/en/", "http://example.com/EN/", "http://x.net/es/", "http://x.net/es", "http://x.net/fr/?q", "http://com/", "http://com",
        "http://notexample.com/en/", "ftp://spam-farm.example.org/en/", "http://a.org/adclick/x", "no scheme", "", None, "http://", "http://h?x/y", "http://h#x/y", "a://b://c/en/", "http://example.com/english",
        "http://cheap-pills.net/es/1", "http://x.org/?a=1&gclid=2", "http://u:p@example.com:80/en/"]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for r in url_filter.SITES:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    whole = "//" + url.split("://", 1)[1] if url and "://" in url else url or ""
    hit = any(re.search(p.regex, whole.lower()) for p in url_filter.PATTERNS)
    return host, path, best and best.text, best.verdict if best else "block" if hit else "allow"


def test_url_rules(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate([*URLS, *URLS[:3]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {i: plain_verdict(u) for i, u, *_ in rows}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_rules_without_tokens(spark):
    pages = spark.createDataFrame([(1, "http://a.org/ab-cd"), (2, "http://a.org/b")], "page_id long, url string")
    rule = url_filter.pattern_rule("*b-c*")
    assert rule.tokens == ()
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], [rule]).collect()} == {1: "block", 2: "allow"}
