"""Line removal: clashing names, many removed lines, the joined path, repeated rows."""

import time

import pytest
from pyspark.sql import functions as F

from spoorline.llm import lines


def brute(rows, least):
    sites, first = {}, {}
    for d, text, site in rows:
        for p, x in enumerate((text or "").split("\n") if text is not None else []):
            if x.strip(" "):
                sites.setdefault(x, set())
                if site is not None:
                    sites[x].add(site)
                first[x] = min(first.get(x, (10**9, 0)), (d, p))
    out = {}
    for d, text, _ in rows:
        kept = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if len(sites.get(x, ())) < least or first[x] == (d, p))
        out[d] = kept
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_against_python_with_clashing_columns(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_LINES", broadcast)
    monkeypatch.setattr(lines, "HOT_LINES", 2)
    rows = [(i, "\n".join([f"menu {i % 3}", "shared", f"own {i}", "", "shared", f"foot {i % 2}"][: 2 + i % 5]), f"s{i % 13}") for i in range(60)]
    rows += [(97, None, "s0"), (98, "", None), (99, "shared\nshared", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in ("d", "th", "gone", "a", "b", "site", "pos", "line", "n_lines", "_d")})
    out = lines.remove_boilerplate(docs, 5)
    assert set(docs.columns) <= set(out.columns)
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == brute(rows, 5) and all((r.d, r.th, r.gone, r._d) == ("d", "th", "gone", "_d") for r in got)
    assert lines.remove_boilerplate(docs.limit(0)).count() == 0


def test_repeated_rows_are_cleaned_alike_and_long_texts_in_linear_time(spark):
    rows = [(i, "x\ny", f"s{i}") for i in range(12)] + [(3, "x\ny", "s3")]
    got = [(r.doc_id, r.text) for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted(got) == sorted([(0, "x\ny")] + [(i, "") for i in range(1, 12)] + [(3, "")])
    body = "\n".join(f"line {i}" for i in range(100_000))
    began = time.time()
    docs = spark.createDataFrame([(i, body, f"s{i}") for i in range(10)], "doc_id long, text string, source string")
    assert sorted((r.n_removed, len(r.text)) for r in lines.remove_boilerplate(docs).collect()) == [(0, len(body))] + [(100_000, 0)] * 9 and time.time() - began < 60
