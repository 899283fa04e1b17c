"""Skips that training weighs, tokens as wholes, shared passages, and blocks of long texts."""

import re
import time

import numpy as np
import pandas as pd

from spoorline.llm import decontaminate, minhash, pii


def luhn(digits):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0


def test_trained_skips_add_spans_that_vanish_without_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = [t for (t,) in docs.select("text").collect() if t and re.search("[0-9@]", t)]
    model = pii.fit(docs)
    assert (model.skip > 0.3).all()
    alone = pii.Model(model.observe, model.chain, np.zeros(2))
    added, more = 0, []
    for text in texts:
        base, spans = pii.all_spans(text, model)
        assert set(base) <= set(spans)
        own = set(spans) - set(base)
        added += len(own)
        more += [(kind, text[a:b]) for kind, a, b in own - set(pii.all_spans(text, alone)[1])]
    assert added >= 100 and more and all(kind == "card" and luhn(value) for kind, value in more)


def test_tokens_are_compared_as_wholes():
    one, two = "1" * 300 + "a" + "1" * 50, "1" * 300 + "1" + "1" * 50
    assert pii._shape(one) != pii._shape(two)
    assert not [x for x in pii.graph(f"{one} word {two}").skip if x[2] == 1]
    assert pii.graph(f"{one} word {one}").skip == [(0, 1, 0), (0, 1, 1)] or pii.graph(f"{one} word {one}").skip == [(0, 1, 0)]
    began = time.time()
    assert len(pii.graph("9" * 2_000_000 + " x " + "9" * 2_000_000).skip) >= 1 and time.time() - began < 20


def test_a_passage_that_all_items_share(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    shared = words("s", 200)
    docs = spark.createDataFrame([(d, f"{words(f'd{d}x', 60)} {shared} {words(f'e{d}x', 40)}") for d in range(20)], "doc_id long, text string")
    took = {}
    for n in (100, 4000):
        items = spark.createDataFrame(pd.DataFrame({"item_id": [f"i{k:05}" for k in range(n)], "text": [f"{shared} q{k} {words(f'q{k}x', 20)}" for k in range(n)]}))
        began = time.time()
        got = decontaminate.contamination(docs, items).collect()
        took[n] = time.time() - began
        assert all(r.n_hit == 200 and len(r["items"]) == n and r["items"] == sorted(r["items"]) for r in got)
    assert took[4000] < took[100] + 20
    index = decontaminate.Index([(f"i{k}", np.arange(50, dtype=np.uint64)) for k in range(30)])
    assert len(index.sets) == 1 and index.items(np.array([0, 0])) == sorted(f"i{k}" for k in range(30))


def test_both_ways_with_shared_and_nested_passages(spark, monkeypatch):
    parts = [" ".join(f"{k}{i}" for i in range(15)) for k in "abcd"]
    docs = spark.createDataFrame([(1, " ".join(parts)), (2, f"{parts[0]} x {parts[2]}"), (3, "nothing"), (4, f"one two {parts[3]} one two"), (None, parts[1])], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{k}", " ".join(parts[: 1 + k % 4])) for k in range(40)] + [("s", "one two"), ("i0", parts[3])], "item_id string, text string")

    def result():
        return sorted(repr((r.doc_id, r.n_words, sorted(map(tuple, r.spans)), r["items"], r.n_hit, r.contaminated)) for r in decontaminate.contamination(docs, bench).collect())

    whole = result()
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 1)
    assert result() == whole and sum("'s'" in r for r in whole) == 1


def test_blocks_of_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 50, 60)) for _ in range(3)]
    rows = [(i, base[i % 3] + (f" tail{i}" if i % 2 else "")) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BANDS", 150)
    monkeypatch.setattr(minhash, "ROWS", 1)
    want = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 100)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == want and len({r[2] for r in want}) == 3
