"""License scans: sentences, partial and reordered texts, long repetitive files, odd rows."""

import time

from pyspark.sql import functions as F

from spoorline.llm import licenses


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"codes": F.lit("x"), "hits": F.lit(1)})
    return {r.doc_id: r for r in licenses.license_hits(docs).collect()}


def plain(text):
    """(start, label, share) by a scan of every place for every template."""
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    out = []
    for t in licenses.TEMPLATES:
        for i in range(len(w) - len(t.key) + 1):
            if w[i : i + len(t.key)] == t.key:
                at = i - t.offset
                out.append((i, t.label, sum(0 <= at + k < len(w) and w[at + k] == x for k, x in enumerate(t.words)) / len(t.words)))
    return sorted(out)


def test_every_template_finds_itself_and_parts_of_it(spark):
    texts = [t.text for t in licenses.TEMPLATES] + [" ".join(t.words[t.offset : t.offset + len(t.key)]) for t in licenses.TEMPLATES]
    texts += ["# The above copyright notice and this\n# permission notice shall be included in all copies or substantial portions of the Software. Permission is hereby granted, free of charge, to any person"]
    texts += ["permission is granted", "under the mit", "the mit license under", "License MIT the under", "", None, "Under The MIT License under the mit license", "Kunder the mit license"]
    got = scan(spark, texts)
    for i, text in enumerate(texts):
        assert sorted((h.start, h.label, h.share) for h in got[i].hits) == plain(text), text
    for i, t in enumerate(licenses.TEMPLATES):
        assert any(h.label == t.label and h.share == 1.0 for h in got[i].hits)
    assert {h.label for h in got[2 * len(licenses.TEMPLATES)].hits} == {"mit"}


def test_long_files_of_hits(spark):
    began = time.time()
    got = scan(spark, ["released under the mit license " * 20_000, "permission " * 100_000])
    assert len(got[0].hits) == 20_000 and not got[1].hits and got[0].n_words == 100_000 and time.time() - began < 60
    assert licenses.license_hits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hundreds_of_templates_change_no_hit(spark):
    more = tuple(licenses.Template(f"x{i}", f"terms of the license number {i} apply to zz{i} users", f"license number {i} apply") for i in range(300))
    docs = spark.createDataFrame([(1, "under the MIT license; license number 7 apply to zz7 users"), (2, "license number 299 apply"), (3, "no terms"), (4, None)], "doc_id long, text string").selectExpr("*", "1 as codes", "2 as hits")
    few = {r.doc_id: sorted((h.start, h.label) for h in r.hits) for r in licenses.license_hits(docs).collect()}
    many = {r.doc_id: sorted((h.start, h.label) for h in r.hits) for r in licenses.license_hits(docs, licenses.TEMPLATES + more).collect()}
    assert few == {1: [(0, "mit")], 2: [], 3: [], 4: []} and many == {1: [(0, "mit"), (4, "x7")], 2: [(0, "x299")], 3: [], 4: []}
