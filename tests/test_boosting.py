"""Boosted trees against a plain leaf-wise version, and their storage."""

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spoorline.operators import boosting, learn
from spoorline.sources.stages import Stages


def table(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[rng.random((n, 4)) < 0.15] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=1.5) + np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 2]) + rng.normal(0, 0.3, n) > 0.4).astype(float)
    return x, y


def frame(spark, x, y, **more):
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(y=y, **more)).coalesce(1)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "abcdy"})


def plain_fit(b, y, s, folds=None, left_out=-1):
    """Leaf by leaf, every histogram from its rows: raw scores of all rows."""
    rows = np.arange(len(y))
    mine = ~np.isnan(y) & (folds != left_out if folds is not None else True)
    p = y[mine].mean()
    score, rng = np.full(len(y), np.log(p / (1 - p))), np.random.default_rng(s.seed)
    shrunk = lambda g: np.sign(g) * max(abs(g) - s.l1, 0.0)
    gain_of = lambda g, h: shrunk(g) ** 2 / (h + s.l2)
    for t in range(s.trees):
        columns = np.sort(rng.choice(b.shape[1], max(1, round(s.columns * b.shape[1])), replace=False))
        bag = rows[mine & boosting.in_bag(rows, t, s.rows, s.seed)]
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)

        def best(own, g=g, h=h, columns=columns):
            gains = []
            for f in columns:
                for missing in (False, True):
                    for cut in range(1, s.bins - 1):
                        left = np.where(b[own, f] == 0, missing, b[own, f] <= cut)
                        one, two = own[left], own[~left]
                        if min(len(one), len(two)) < s.least_rows or min(h[one].sum(), h[two].sum()) < s.least_weight:
                            continue
                        gains.append((gain_of(g[one].sum(), h[one].sum()) + gain_of(g[two].sum(), h[two].sum()) - gain_of(g[own].sum(), h[own].sum()), f, missing, cut))
            top = max((x[0] for x in gains), default=0.0)
            return next((top, *x[1:]) for x in gains if x[0] >= top - 1e-9 * max(1.0, top)) if top > 1e-10 else None

        leaves, heap, n = {0: (bag, rows, 0)}, [], 0

        def offer(k, leaves=leaves, heap=heap):
            own, _, depth = leaves[k]
            found = best(own) if depth < s.depth else None
            if found:
                heapq.heappush(heap, (-found[0], k, found))

        offer(0)
        while heap and len(leaves) < s.leaves:
            _, k, (_, f, missing, cut) = heapq.heappop(heap)
            own, every, depth = leaves.pop(k)
            goes = lambda r, f=f, missing=missing, cut=cut: np.where(b[r, f] == 0, missing, b[r, f] <= cut).astype(bool)
            for side in (True, False):
                n += 1
                leaves[n] = (own[goes(own) == side], every[goes(every) == side], depth + 1)
                offer(n)
        for own, every, _ in leaves.values():
            score[every] += -shrunk(g[own].sum()) / (h[own].sum() + s.l2) * s.rate
    return score


@pytest.mark.parametrize("leaves", [31, 5])
def test_trees_equal_a_plain_leafwise_fit(spark, leaves):
    x, y = table(700)
    y[::50] = np.nan
    folds = np.arange(len(y)) % 2
    settings = {"trees": 3, "bins": 12, "least_weight": 2.0, "least_rows": 5, "leaves": leaves, "rate": 0.3}
    df = frame(spark, x, y, fold=folds)
    models = boosting.fit(df, list("abcd"), ["y"], "fold", 2, **settings)
    for k in (0, 1):
        m = models["y", k]
        b = boosting.binned(x, m.cuts)
        np.testing.assert_allclose(m.raw(b), plain_fit(b, y, boosting.Settings(**settings), folds, k), rtol=1e-9, atol=1e-9)
        assert max(sum(f < 0 for f in t.feature) for t in m.trees) <= leaves


def test_scores_over_partitions_and_many_labels(spark):
    x, y = table(900)
    df = frame(spark, x, y).withColumns({"z": 1 - F.col("y"), "w": F.lit(0.0)}).withColumn("fold", (F.col("a").isNull()).cast("int")).repartition(5)
    settings = {"trees": 10, "rate": 0.3, "bins": 16}
    models = boosting.fit(df, list("abcd"), ["y", "z"], **settings)
    out = boosting.scores(df, {"p": [models["y", -1]], "q": [models["z", -1]], "both": [models["y", -1], models["z", -1]]}).toPandas()
    assert out.columns.tolist() == [*df.columns, "p", "q", "both"] and len(out) == 900
    np.testing.assert_allclose(out.p + out.q, 1, atol=1e-6)
    np.testing.assert_allclose(out.both, (out.p + out.q) / 2)
    assert out.p[out.y == 1].mean() > out.p[out.y == 0].mean() + 0.3


def test_one_pass_equals_the_mean_of_stored_models(spark, tmp_path):
    x, y = table(600)
    df = frame(spark, x, y, g=np.arange(600) // 40)
    scored = learn.out_of_fold(df, list("abcd"), "g", "y", folds=3, save=str(tmp_path / "m"), trees=9, rate=0.3).toPandas()
    assert len(scored) == 600 and (scored.groupby("g").fold.nunique() == 1).all() and ((scored.score > 0.5) == (scored.label == 1)).mean() > 0.75
    models = learn.saved_models(df, str(tmp_path / "m"))
    raw = [m.raw(boosting.binned(x, m.cuts)) for m in models]
    plan = learn.mean_scores(df, {"one": str(tmp_path / "m"), "two": str(tmp_path / "m")})
    got = plan.toPandas()
    np.testing.assert_allclose(got.one, np.mean([1 / (1 + np.exp(-r)) for r in raw], axis=0), rtol=1e-12)
    assert (got.one == got.two).all() and plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    own = np.array([r.score for r in boosting.scores(df.join(spark.createDataFrame(scored[["g", "fold"]].drop_duplicates()), "g"), {"score": models}, "fold").orderBy("g", "a", "b", "c", "d", "y").collect()])
    np.testing.assert_allclose(own, scored.sort_values(["g", "a", "b", "c", "d", "y"], na_position="first").score, rtol=1e-9)


def test_no_positives_and_no_values(spark):
    x, y = table(100)
    df = frame(spark, x, np.zeros(100), g=np.arange(100) % 10)
    assert {r.score for r in learn.out_of_fold(df, list("abcd"), "g", "y", folds=2).collect()} == {0.0}
    none = frame(spark, np.full((100, 4), np.nan), y, g=np.arange(100) % 10)
    scores = [r.score for r in learn.out_of_fold(none, list("abcd"), "g", "y", folds=2, trees=2).collect()]
    assert len(scores) == 100 and all(0 < s < 1 for s in scores)


def test_writing_scores_between_trees_changes_nothing(spark, monkeypatch):
    x, y = table(500)
    df = frame(spark, x, y)
    made = []
    for every in (2, 100):
        monkeypatch.setattr(boosting, "WRITE_EVERY", every)
        made.append(boosting.fit(df, list("abcd"), ["y"], trees=5, bins=8, rate=0.3)["y", -1])
    assert made[0].trees == made[1].trees


def test_rows_bind_where_they_say_more_than_the_weight(spark):
    x, y = table(500)
    settings = {"trees": 2, "bins": 10, "least_weight": 0.5, "least_rows": 60, "rate": 0.3}
    m = boosting.fit(frame(spark, x, y), list("abcd"), ["y"], **settings)["y", -1]
    np.testing.assert_allclose(m.raw(boosting.binned(x, m.cuts)), plain_fit(boosting.binned(x, m.cuts), y, boosting.Settings(**settings)), rtol=1e-9, atol=1e-9)


def test_a_pass_deals_rows_of_one_file_evenly_and_no_older_trees(spark, monkeypatch):
    x, y = table(1600)
    df, settings, seen, made = frame(spark, x, y), {"trees": 6, "rate": 0.3, "bins": 16}, [], []

    def recorded(blocks, one):
        held = blocks.map(lambda b: len(b.row)).glom().map(sum).collect()
        seen.append((held, len(pickle.dumps(one)), one.tree, len(one.growing[0].feature)))
        return gathered(blocks, one)

    gathered = boosting._gathered
    monkeypatch.setattr(boosting, "TASK_ROWS", 200)
    with monkeypatch.context() as m:
        m.setattr(boosting, "_gathered", recorded)
        made.append(boosting.fit(df, list("abcd"), ["y"], **settings)["y", -1])
    assert all(len(held) > 4 and sum(held) == 1600 and max(held) < 400 for held, *_ in seen)
    # A pass's size does not grow with the trees before it.
    first = {tree: size for _, size, tree, nodes in seen if nodes == 1}
    assert len(first) == 6 and max(first.values()) - min(first.values()) < 50
    # Blocks that are lost, or were never kept, are made again from their rows.
    monkeypatch.setattr(Stages, "keep", lambda self, rdd, write=False: rdd)
    made.append(boosting.fit(df, list("abcd"), ["y"], **settings)["y", -1])
    assert made[0].trees == made[1].trees


def test_blocks_hold_all_rows_and_few():
    row = np.arange(1050)
    packed = pa.RecordBatch.from_arrays([pa.array(row), pa.array(row % 5, pa.int32()), boosting._binary((row[:, None] % [7, 9, 11]).astype(np.uint8)), boosting._binary(row[:, None] / 2)], names=["row", "fold", "x", "y"])
    made = pa.Table.from_batches(boosting._in_blocks(iter([packed.slice(0, 90), packed.slice(90, 0), packed.slice(90)]), 100)).to_pylist()
    blocks = list(boosting._blocks((tuple(r.values()) for r in made), 3, 1, [(0, -1)]))
    assert max(len(b.row) for b in blocks) == 100 and [v for b in blocks for v in b.row] == row.tolist()
    assert all((b.x == b.row % np.array([[7], [9], [11]])).all() and (b.fold == b.row % 5).all() and (b.y == b.row / 2).all() and b.score.shape == (1, len(b.row)) for b in blocks)
