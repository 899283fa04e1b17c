"""The methods themselves: recall of signatures, exact fields on small graphs, optima, layouts."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.llm import _text, bpe_tables, langid, minhash, pii, quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(rows, least=0.8):
    """Smallest id that links reach, by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    inverse = {}
    for i, s in sets.items():
        for x in s:
            inverse.setdefault(x, []).append(i)
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    pairs = {p for own in inverse.values() for p in itertools.combinations(sorted(own), 2)}
    links = [p for p in sorted(pairs) if similar(sets[p[0]], sets[p[1]]) >= least]
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        comp[b] = a
    return {i: root(i) for i in sets}, links


def test_signatures_recall_all_similar_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, links = classes(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert len(links) > 50 and np.mean([got[a] == got[b] for a, b in links]) >= 0.99
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99 and all(want[i] == want[c] for i, c in got.items())


def test_crowded_buckets_are_compared_completely(spark, monkeypatch):
    """Chains of near copies under one frame: centres leave buckets open, blocks of four texts close them."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BANDS", 150)
    monkeypatch.setattr(minhash, "ROWS", 1)
    rng = random.Random(4)
    frame = " ".join(f"f{i}" for i in range(60))
    rows, at = [], 0
    for chain in range(6):
        tail = [f"c{chain}x{i}" for i in range(40 + 25 * (chain % 3))]
        for _ in range(7):
            rows.append((at, f"{frame} {' '.join(tail)}"))
            at += 1
            for _ in range(3):
                tail[rng.randrange(len(tail))] = f"n{at}{rng.random()}"
    want, links = classes(rows)
    assert links and len(set(want.values())) < len(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_ids_with_several_texts_and_clashing_columns(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, a), (4, None), (4, ""), (5, "the " * 20_000), (6, "the " * 20_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_id", "_h1", "h1", "h2", "n", "id", "component_id", "w")})
    got = sorted(((r.doc_id, r.text) for r in minhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, a), (4, None), (4, ""), (5, rows[8][1])], key=repr)
    assert minhash.keep_one(docs.limit(0)).columns == docs.columns


def test_weighted_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    items = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    a, b = rng.integers(1, 9, 400).astype(float), rng.integers(1, 9, 400).astype(float)
    b[:250] = a[:250]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = (minhash.dart_signature(items, a, 2_000) == minhash.dart_signature(items, b, 2_000)).mean()
    assert abs(got - want) < 0.05
    s, n = np.array([5, 7], np.uint64), np.array([3, 1])
    assert len(set(minhash._counted(s, n).tolist())) == 4 and set(s.tolist()) <= set(minhash._counted(s, n).tolist())


def test_patterns_of_cards_and_phones():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (234) 567-8901", "+49 30 12345678", " ", "-", "7", ".", "(", "x", "1.2.3.4", "a@b.c", "\n", "0" * 14, "+", "٣"]) for _ in range(12))
        want = []
        for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(pattern, text):
                d = re.findall("[0-9]", m[0])
                luhn = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
                if (13 <= len(d) <= 19 and luhn) if kind == "card" else 9 <= len(d) <= 15:
                    want.append((kind, *m.span()))
        assert [s for s in pii.base_spans(text) if s[0] in ("card", "phone")] == want, text


def field(k):
    rng = np.random.default_rng(3)
    return pii.Model(rng.normal(0, 1, (pii.FEATURES, k)), rng.normal(0, 0.3, (k, k)), np.array([1.0, 0.6]))


def test_messages_against_enumeration():
    k = len(pii.LABELS) + 1
    model = field(k)
    for text, exact in (("a1 b2", True), ("x1 word y2 word x1", True), ("1a 2b 1a", False)):
        g = pii.graph(text)
        own = np.array([model.observe[f].sum(axis=0) for f in g.feats])
        p = np.zeros_like(own)
        for y in itertools.product(range(k), repeat=len(own)):
            s = sum(own[i, v] for i, v in enumerate(y)) + sum(model.chain[y[a], y[b]] for a, b in g.chain) + sum(model.skip[t] * (y[a] == y[b]) for a, b, t in g.skip)
            for i, v in enumerate(y):
                p[i, v] += np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        np.testing.assert_allclose(pii.marginals(g, model), p, atol=1e-3 if exact else 0.15)


def test_skip_edges_carry_labels():
    """A secret that is assigned once is likelier again where nothing announces it, the more the stronger skips are."""
    rng = random.Random(5)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = []
    for i in range(120):
        h = hexes()
        texts.append(f'some words 12 here token = "{h}" and 34 more mail a{i}@b.co or {i * 7} words, password: {h}' if i % 3 else f"plain text of {i} words and {h} is a checksum 99, that {h} again")
    model = pii.train(texts)
    assert (model.skip >= 0).all()
    secret = hexes()
    text = f'api token = "{secret}" was set. Later {secret} came up.'
    at = 1 + pii.LABELS.index("secret")
    later = {skip: pii.marginals(pii.graph(text), pii.Model(model.observe, model.chain, np.full(2, skip) if skip is not None else model.skip))[1, at] for skip in (None, 0.0, 6.0)}
    assert model.skip[0] > 0 and later[None] > later[0.0] and later[6.0] > max(pii.SURE, later[None])
    tied = pii.Model(model.observe, model.chain, np.full(2, 6.0))
    assert [text[a:b] for k, a, b in pii.all_spans(text, tied)[1] if k == "secret"] == [secret, secret]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, chain = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 0, 0, 1, 2, 2])
    p, moved = langid.forward_backward(scores, chain, moves, expect=True)
    want, expected = np.zeros((7, 3)), np.zeros((3, 3))
    for c in range(3):
        own = np.flatnonzero(chain == c)
        total, pm, mm = 0.0, np.zeros((len(own), 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=len(own)):
            e = np.exp(sum(scores[i, v] for i, v in zip(own, y, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            total += e
            for i, v in enumerate(y):
                pm[i, v] += e
            for a, b in itertools.pairwise(y):
                mm[a, b] += e
        want[own] = pm / total
        expected += mm / total
    np.testing.assert_allclose(p, want, atol=1e-9)
    np.testing.assert_allclose(moved, expected, atol=1e-9)


def test_words_are_letters_only(spark):
    rows = [("“hello—world” naïve Ünïcode 12 «été»…",), ("日本語 テスト",), ("áb",)]
    spelled = [r.t for r in spark.createDataFrame(rows, "text string").select(langid._spelled(F.col("text")).alias("t")).collect()]
    counts = []
    for t in spelled:
        data = np.frombuffer(t.encode(), np.uint8)
        counts.append(len(langid.read_words(data, np.array([0, len(data)])).row))
    assert counts == [5, 2, 1]


def test_ratios_and_dual_optimum():
    counts = np.array([[3, 5, 0], [9, 1, 8]])
    r = quality.log_count_ratios(counts)
    n = 1 << quality.BITS
    assert r[3] == pytest.approx(np.log(1 / (n + 8)) - np.log(6 / (n + 6))) and r[9] == pytest.approx(np.log(9 / (n + 8)) - np.log(2 / (n + 6)))
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(40)]
    y = np.where(np.array([1 in f for f in rows]) ^ (rng.random(40) < 0.1), 1.0, -1.0)
    ratios = rng.normal(0, 1, 12)
    w, bias = quality.dual_descent(rows, y, ratios, epochs=2_000)
    x = np.zeros((40, 13))
    for i, f in enumerate(rows):
        x[i, f] = ratios[f] / np.linalg.norm(ratios[f])
    x[:, 12] = 1
    v = np.append(w / ratios, bias)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    best = min(loss(v + d * rng.normal(0, 1, 13)) for d in (1e-3, 1e-2, 1e-1) for _ in range(2_000))
    assert loss(v) <= best * (1 + 1e-3)  # descent ends when no weight moves by a thousandth


def test_layout_at_a_hundred_terabytes():
    parts, buckets = bpe_tables.layout(10**14, 1_000)
    assert parts <= 65_536 and buckets <= 100_000 and bpe_tables.layout(10**9, 200) == (64, 200)
    assert bpe_tables.layout(10**12, 200)[0] < 10_000


def test_catalog_stays_clean(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "some text here"), (2, None)], "doc_id long, text string")
    assert bpe_tables.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("spoorline_")]


def test_long_words_hash_alike_at_any_place():
    h, at = _text.words(np.frombuffer(b"one two one", np.uint8), np.array([0, 11]))
    assert h[0] == h[2] != h[1] and (_text.grams_at(h, np.array([0, 1]), 2) == _text.grams(h, 2)).all()
