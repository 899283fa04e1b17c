"""The pipeline and each stage against plain Python."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spoorline.llm import lines, quality
from tests.llm.test_methods import WORD, classes

SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def good(rows, model):
    out = []
    for r in rows:
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        f = next(quality.features(data, np.array([0, len(data)])))
        if model.score(np.array([model.margin(f)]))[0] >= 0.5:
            out.append(r)
    return out


def without_boilerplate(rows):
    sites, docs, first = {}, {}, {}
    for r in rows:
        for p, x in enumerate((r["text"] or "").split("\n")):
            if x.strip(" "):
                sites.setdefault(x, set()).add(r["source"])
                docs.setdefault(x, set()).add(r["doc_id"])
                first[x] = min(first.get(x, (1 << 60, 0)), (r["doc_id"], p))

    def gone(x, at):
        if not x.strip(" ") or first[x] == at:
            return False
        least = lines.LONG_LIMITS if len(x.split()) > lines.LONG_WORDS else (lines.MIN_SITES, 1 << 60)
        return len(sites[x] - {None}) >= least[0] or len(docs[x]) >= least[1]

    out = []
    for r in rows:
        if r["text"] is None:
            out.append(r)
            continue
        text = "\n".join(x for p, x in enumerate(r["text"].split("\n")) if not gone(x, (r["doc_id"], p)))
        out.append({**r, "text": text, "n_chars": r["n_chars"] if text == r["text"] else len(text)})
    return out


def one_of_each(rows):
    comp, _ = classes([(r["doc_id"], r["text"]) for r in rows])
    return [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]


def clean(rows, bench):
    windows = set()
    for b in bench:
        w = words(b)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    sizes, out = {len(w) for w in windows}, []
    for r in rows:
        w, hit = words(r["text"]), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def coded(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        out.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out)


def as_rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def test_run_and_stages_against_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = as_rows(docs)
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (lambda r: good(r, model), without_boilerplate, one_of_each, lambda r: clean(r, bench), coded), strict=True):
        alone = stage(spark, docs, SF)
        if name == "bpe":
            assert sorted(map(tuple, alone.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == plain(as_rows(docs))
        else:
            assert alone.columns == docs.columns
            assert as_rows(alone) == plain(as_rows(docs)), name
        rows = plain(rows)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == rows and 0 < len(rows) < docs.count()


def test_stages_on_odd_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "no id here at all", None), (3, "ok " * 30_000, "b")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("d", "th", "_id", "h1", "score", "spans", "n")})
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, SF)
            if name != "bpe":
                assert out.columns == odd.columns
            if name != "quality":
                assert out.count() == docs.count(), name
