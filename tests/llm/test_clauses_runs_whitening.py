"""Operators 11 to 13 against plain Python and NumPy, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spoorline.llm import periodic, queries, toxicity, whitening

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    """Maximal repetitions by comparing words q apart, for every q."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def first_places(words):
    known = {}
    return np.array([known.setdefault(x, i) for i, x in enumerate(words)], np.int64)


def test_runs_against_all_periods():
    rng = random.Random(3)
    for _ in range(600):
        n, k = rng.randint(1, 150), rng.choice([1, 2, 3, 8])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
        got = list(zip(*(x.tolist() for x in periodic.runs(first_places([*w, "end"]), n)), strict=True))
        assert got == plain_runs(w)


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_runs_of_one_word_and_of_blocks(block, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", block)
    assert [x.tolist() for x in periodic.runs(first_places(["a"] * 5000 + ["end"]), 5000)] == [[0], [5000], [1]]
    w = [f"w{i % 700}" for i in range(3000)] + ["x"] + ["b", "c"] * 100
    assert list(zip(*(x.tolist() for x in periodic.runs(first_places([*w, "end"]), len(w))), strict=True)) == plain_runs(w)


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n = len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_the_query_against_plain_python(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in queries.op12_periodic(spark, SF).collect()}
    assert len(docs) > 100 and {r.doc_id: plain_row(r.doc_id, r.text) for r in docs} == {r.doc_id: got[r.doc_id] for r in docs}
    assert sum(g[0] > 0 for g in got.values()) > 10


ODD = [(1, None, 7), (2, "", 7), (3, " \t\r\n", 7), (4, "a b " * 40_000, 7), (4, "a b " * 40_000, 7), (None, "x x x x x x", 7), (6, "é é " * 6, 7), (7, "one", 7)]


def test_odd_rows_of_runs(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, runs int")
    rows = periodic.periodic_runs(docs).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows}
    assert by[1] == by[2] == by[3] == (0, [], "") and by[4] == (80_000, [(0, 80_000, 2)], "a b") and by[None] == (6, [(0, 6, 1)], "x")
    assert by[6] == (6, [(0, 6, 1)], "é é") and by[7] == (1, [], "one")
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_symmetric_qr():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 17, 40):
        m = rng.normal(size=(d + 2, d))
        a = m.T @ m
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * d * values[0]) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13 * d)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * d * values[0])
    assert np.allclose(whitening.symmetric_qr(np.ones((5, 5)))[0], [5, 0, 0, 0, 0]) and not whitening.symmetric_qr(np.zeros((3, 3)))[0].any()


def plain_whitening(vectors):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(axis=1), np.abs((x - s / n) @ q / np.sqrt(e)), e / np.trace(v)


def test_whitening_against_numpy(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, white, explained = plain_whitening([r.embedding for r in data])
    got = {(r.vec_id, r.component): r for r in queries.op13_whitening(spark, SF).collect()}
    assert len(got) == 4 * len(data)
    for i, r in enumerate(data):
        for k in range(4):
            g = got[r.vec_id, k + 1]
            assert (g.n, g.deviation) == (n, deviation[i]) and abs(abs(g.whitened) - white[i, k]) < 1e-9 and abs(g.explained / explained[k] - 1) < 1e-9 and g.identity_error < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(30, 5))]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(30, good[0], 0), (0, good[0], 0), (None, good[1], 0)]
    bad = [(40, None, 0), (41, [], 0), (42, [1.0, None, 1.0, 1.0, 1.0], 0), (43, [float("nan")] * 5, 0), (44, [float("inf")] * 5, 0), (45, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n int")
    model = whitening.fit(df)
    n, deviation, white, _ = plain_whitening(good)
    out = whitening.whitened(df, model).collect()
    assert model.n == n == 30 and len(out) == 4 * len(rows) and {r.vec_id for r in out} == {*range(31), None}
    assert all(r.deviation == deviation[r.vec_id] and abs(abs(r.whitened) - white[r.vec_id, r.component - 1]) < 1e-9 for r in out if r.vec_id is not None and r.vec_id < 30)
    assert whitening.whitened(df, whitening.fit(df.limit(0))).count() == 0
    same = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.component, r.whitened, r.explained, r.deviation) for r in whitening.whitened(same, whitening.fit(same)).where("vec_id = 1").orderBy("component").collect()] == [(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 0)]
    wide = whitening.Whitening(3, [3 * 2**40, 0], np.array([1.0]), 1.0, np.zeros((2, 1)))
    assert wide.deviation(np.array([[2**40, 0], [2**40 - 2**33, 0], [2**40 - 10, 1]])) == [0, None, 909]


def test_moments_merge_like_one_pass():
    x = np.random.default_rng(4).normal(1e6, 1.0, (50, 3))
    whole, parts = whitening.Moments(3), [whitening.Moments(3) for _ in range(4)]
    whole.add(x)
    for p, rows in zip(parts, np.array_split(x, [0, 7, 30]), strict=True):
        p.add(rows)
    for p in parts[1:]:
        parts[0].merge(p)
    want = np.cov(x.T, bias=True) * 50
    assert parts[0].n == 50 and np.allclose(parts[0].scatter, want, rtol=1e-8) and np.allclose(whole.scatter, want, rtol=1e-8) and np.allclose(parts[0].mean, x.mean(axis=0))


def test_the_composed_grammar_is_its_parts_in_turn():
    rng = random.Random(1)
    parts, whole = (toxicity.negation(), toxicity.reported(), toxicity.insulted(), toxicity.threatened()), toxicity.grammar()
    for _ in range(300):
        states, state = [0] * 4, 0
        for s in (rng.randrange(7) for _ in range(15)):
            symbol, weight = s, 0.0
            for k, arcs in enumerate(parts):
                states[k], symbol, w = arcs[states[k], symbol]
                weight += w
            state, out, w = whole[state, s]
            assert out == symbol and abs(w - weight) < 1e-12


def model_with(words):
    h = np.array([toxicity._hash_of(w) for w in words], np.uint64)
    return toxicity.Model(toxicity.Lexicon(h, np.full(len(h), 2.0), np.full(len(h), 9.0)), np.array([-4.0, 2.0, 2.0, 2.0]))


def test_clauses_weigh_by_context(spark):
    texts = ["What an idiot.", "You are an idiot!", "he is not an idiot.", 'They said that idiot left', "I will kill you", "kill the process", "fine words. Nothing here", None, "", 'she: "idiot" ok']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as score", "2 as clauses")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, model_with(["idiot"])).collect()}
    weight = {i: round(sum(c.weight for c in r.clauses), 4) for i, r in rows.items()}
    assert weight == {0: 2.0, 1: 2.5, 2: 0.5, 3: 1.25, 4: 4.0, 5: 0.4, 6: 0.0, 7: 0.0, 8: 0.0, 9: 1.0}
    assert [(c.start, c.end) for c in rows[1].clauses] == [(0, 4)] and rows[0].score < rows[1].score and rows[2].score < rows[0].score
    assert rows[7].n_words == 0 and rows[7].score == rows[8].score == rows[6].score and toxicity.toxicity(docs.limit(0), model_with(["idiot"])).count() == 0


def test_weights_without_their_factors_do_not_change_clauses():
    flat = toxicity.Model(model_with(["idiot"]).lexicon, np.zeros(4), toxicity.compose(toxicity.negation(factor=1.0), toxicity.insulted(factor=1.0)))
    raw = np.frombuffer(b"he is not an idiot", np.uint8)
    assert flat.clauses(toxicity.words(raw, np.array([0, len(raw)])))[2].tolist() == [2.0]


def test_beginnings_and_capitals():
    raw = np.frombuffer("RÉEUXON réeux été!".encode(), np.uint8)
    w = toxicity.words(raw, np.array([0, len(raw)]))
    assert w.forms.shape == (7, 3) and w.forms[3, 0] != 0 and w.forms[3, 1] == 0 and w.forms[1, 0] == w.forms[1, 1] and w.forms[0, 0] == toxicity._hash_of("réeuxon")


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    y = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").toxic
    got = queries.op11_toxicity(spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    test = got[got.held_out & got.doc_id.isin(y.index)]
    truth = y[test.doc_id].to_numpy()
    assert (test.predicted == truth).mean() > 0.94 and test.predicted[truth == 0].mean() < 0.03 and test.predicted[truth == 1].mean() > 0.5


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, "some words", "a") for i in range(9)], "doc_id long, text string, y string")
    for value, low, high in ((1, 0.9, 1.0), (0, 0.0, 0.1), (None, 0.0, 0.1)):
        labels = docs.selectExpr("doc_id", f"cast({'null' if value is None else value} as int) as toxic")
        assert all(low <= r.score <= high for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect())
