"""The ten operators: edge cases, and brute force on small tables."""

import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spoorline.llm import bpe_tables, decontaminate, langid, licenses, lines, minhash, pii, quality, queries, subspace, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, words string"
LONG = " ".join(f"w{i}" for i in range(6000))
TEXTS = [None, "", "   \n\t", "one two", LONG, LONG, LONG + " tail", "Mail a@b.co, ip 1.2.3.4.\n<|endoftext|> ok", "été 12345 under the MIT license, under the mit license\nx"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "s", 0, "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_near_duplicates(odd):
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert got[5] == (4, False) and got[6] == (4, False) and all(got[i] == (i, True) for i in (0, 1, 2, 3, 4, 7, 8))
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_patterns_and_field(odd):
    base = {r.doc_id: [tuple(s) for s in r.base] for r in pii.personal_data(odd, pii.fit(odd)).collect()}
    assert base[7] == [("email", 5, 11), ("ip", 16, 23)] and not base[0] and not base[1]
    text = "x..@a.b.c @@ a@b 300.1.1.1 1.2.3.4.5 4111 1111 1111 1111 +1 (234) 567-8901 9" * 2
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    assert [s for s in pii.base_spans(text) if s[0] in ("email", "ip")] == want


def test_lines(spark):
    rows = [(i, f"shared line\nown {i}\n", f"s{i}") for i in range(12)] + [(99, None, "s0"), (98, "", None)]
    out = {r.doc_id: r for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].text == "shared line\nown 0\n" and out[5].text == "own 5\n" and out[5].n_removed == 1
    assert out[99].text is None and out[99].n_lines == 0 and out[98].text == ""


def test_long_lines_of_few_sites(spark):
    hot, wide, rare, short = (f"{k} " + " ".join(f"{k}{i}" for i in range(60)) for k in ("hot", "wide", "rare", "short"))
    short = " ".join(short.split()[:50])
    rows = [(i, f"{hot}\n{short}\nown {i}", "s0") for i in range(12)]
    rows += [(20 + i, f"{wide}\nown {i}", f"s{i}") for i in range(8)] + [(40 + i, f"{rare}\nown {i}", f"s{i % 7}") for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    out = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, docs, SF).collect()}
    first = {0, 20}
    for i, text, _ in rows:
        want = text if i in first or i >= 40 else "\n".join(x for x in text.split("\n") if x not in (hot, wide))
        assert (out[i].text, out[i].n_chars) == (want, len(want))
    assert sum(r.n_removed for r in lines.remove_boilerplate(docs).collect()) == 0


def test_languages_and_quality_hold_out(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    got = queries.op4_langid(spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    test = got[got.held_out]
    assert (test.lang_pred == d[test.doc_id].to_numpy()).mean() > 0.9 and got.score.between(0, 1).all()
    y = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    got = queries.op7_quality(spark, sf).toPandas()
    test = got[got.held_out & got.doc_id.isin(y.index)]
    assert (test.predicted == y[test.doc_id].to_numpy()).mean() > 0.85


def test_odd_texts_have_defined_results(odd):
    lang = {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.fit(odd)).collect()}
    assert lang[0] == lang[1] == lang[2] == "und"
    labels = odd.select("doc_id", odd.doc_id.cast("int").alias("quality"))
    scores = quality.quality_scores(odd, quality.fit(odd, labels)).collect()
    assert len(scores) == 10 and all(0 <= r.score <= 1 for r in scores)
    hits = {r.doc_id: r for r in licenses.license_hits(odd).collect()}
    assert [(h.start, h.label) for h in hits[8].hits if h.base] == [(2, "mit"), (6, "mit")] and hits[0].n_words == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 16))
    v[20:] = v[:20] + rng.normal(0, 0.05, (20, 16))
    rows = [(i, [float(np.float32(c)) for c in x], i % 2) for i, x in enumerate(v)] + [(90, None, 0), (91, [0.0] * 16, 0), (92, [float("nan")] * 16, 0), (93, [1.0] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in subspace.near_vectors(df).collect()}
    u = np.array([r[1] for r in rows[:40]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= subspace.COSINE) & (np.arange(40)[:, None] % 2 == np.arange(40)[None] % 2) & ~np.eye(40, dtype=bool)
    assert [got[i].n_links for i in range(40)] == link.sum(axis=1).tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (90, 91, 92, 93))


def test_tokens_are_the_librarys(odd):
    t = Tokenizer.from_file(PATH)
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, PATH).collect()}
    coded = {r.doc_id: r for r in bpe_tables.encode_and_decode(odd, PATH, digest=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert counts[i] == (len((text or "").encode()), len(ids), len(ids) > 512)
        decoded = t.decode(ids, skip_special_tokens=False).encode()
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
    assert bpe_tables.encode_and_decode(odd.limit(0), PATH).count() == 0 and token_counts.token_counts(odd.limit(0), PATH).count() == 0


def test_contamination_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    windows = {}
    for item, text in ((r.item_id, r.text) for r in bench.collect()):
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for r in docs.collect():
        w, hit, items = words(r.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))):
                    hit.update(range(i, i + n))
                    items |= found
        assert got[r.doc_id] == (len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))


def test_a_large_benchmark_gives_the_same_rows(spark, monkeypatch):
    a, b = (" ".join(f"{k}{i}" for i in range(20)) for k in "ab")
    rows = [(1, f"{a} x {b}"), (1, f"{a} x {b}"), (None, b), (None, b), (2, None), (2, None), (3, "clean"), (4, "two words"), (5, ""), (6, "go " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [a, b] * 4 + ["two words", "go " * 20, "", None]
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "item_id string, text string")

    def result():
        return sorted(repr((r.doc_id, r.n_words, sorted(map(tuple, r.spans)), r["items"], r.n_hit, r.contaminated)) for r in decontaminate.contamination(docs, bench).collect())

    whole = result()
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 40)
    assert len(whole) == len(rows) and result() == whole
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0 and not decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count()


def test_texts_that_repeat_themselves_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "the " * 100_000), (2, "a b " * 50_000)], "doc_id long, text string").withColumns({"_id": F.lit(1), "_th": F.lit(2), "th": F.lit(3)})
    bench = spark.createDataFrame([("i", "the " * 10_000), ("j", "a b " * 10_000)], "item_id string, text string")
    began = time.time()
    got = {r.doc_id: (r.n_hit, list(r["items"]), [tuple(s) for s in r.spans]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (100_000, ["i"], [(0, 100_000)]), 2: (100_000, ["j"], [(0, 100_000)])} and time.time() - began < 20
    assert decontaminate.remove_contaminated(docs, bench).count() == 0
    kept = decontaminate.remove_contaminated(docs, bench.limit(0))
    assert kept.columns == docs.columns and kept.count() == 2


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))
