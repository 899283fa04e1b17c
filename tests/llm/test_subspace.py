"""The pigeonhole join of vectors: brute force, crowded cells, few comparisons, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.llm import subspace
from spoorline.llm._scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine):
    ids = np.array([r[0] for r in rows])
    u = np.array([r[1] for r in rows])
    u = u / np.linalg.norm(u, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    link = (u @ u.T >= cosine) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    comp = ids.copy()
    while True:
        low = np.where(link, comp[None, :], comp[:, None]).min(axis=1)
        if (low == comp).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids.tolist(), link.sum(axis=1), comp, strict=True)}
        comp = np.minimum(comp, low)


def table(spark, d, n, near, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    for i in range(near):
        v[n - 1 - i] = v[i // 4] * rng.uniform(0.5, 2) + rng.normal(0, 0.08, d)
    rows = [(i, [float(np.float32(c)) for c in x], int(i % 3)) for i, x in enumerate(v)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("d", "cosine"), [(64, 0.98), (10, 0.98), (1, 0.98)])
def test_links_and_components_against_all_pairs(spark, d, cosine):
    rows, df = table(spark, d, 90, 60)
    got = {r.vec_id: (r.n_links, r.component_id) for r in subspace.near_vectors(df, cosine).collect()}
    assert got == brute(rows, cosine)


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    rows, df = table(spark, 16, 10, 0)
    rng = np.random.default_rng(5)
    hot = np.ones(16) + rng.normal(0, 0.1, (150, 16))
    rows += [(100 + i, [float(np.float32(c)) for c in x], 0) for i, x in enumerate(hot)]
    monkeypatch.setattr(subspace, "CHUNK", 16)
    got = {r.vec_id: (r.n_links, r.component_id) for r in subspace.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, subspace.COSINE)


def test_few_pairs_are_compared_in_full(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    scratch = Scratch(spark)
    reps = scratch.write(v.mapInArrow(subspace._packed, "vec_id long, label string, d int, x binary").groupBy("label", "d", "x").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m")))
    n = [r.n for r in reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()]
    full = subspace.linked(reps, subspace.COSINE, scratch).agg(F.sum("full")).first()[0] or 0
    assert full < 0.05 * sum(k * (k - 1) / 2 for k in n)


def test_cosine_one_and_odd_rows(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, 0), (2, [2.0, 4.0, 6.0], 0), (3, [1.0, 2.0, 3.1], 0), (3, [1.0, 2.0, 3.1], 0), (4, a, None), (5, None, 0), (6, [], 0), (7, [1.0, None, 2.0], 0), (8, [float("inf"), 1.0, 1.0], 0), (9, [0.0] * 3, 0), (None, a, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"d": F.lit("x"), "m": F.lit(7), "cell": F.lit(0)})
    got = subspace.near_vectors(df, 1.0).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (1, 1, True) and by[2] == (1, 1, False) and by[None] == (0, None, True)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9))
    assert subspace.near_vectors(df.limit(0)).count() == 0
