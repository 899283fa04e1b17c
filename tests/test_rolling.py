"""Rolling statistics in blocks: brute force over frames, long tracks, holes, and exact quantiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spoorline.functions import quantiles, rolling
from spoorline.functions.frames import Tracks, scale
from spoorline.functions.rolling import Roll, at_least, rolled, share

T = Tracks(["track"])


def frame_of(i, n, size, frame):
    low, high = {"trailing": (i - size + 1, i), "centred": (i - size // 2, i + (size - 1) // 2), "before": (i - size, i - 1)}[frame]
    return slice(max(0, low), max(0, min(n - 1, high) + 1))


def plain(roll, x, y, i, fps):
    size = scale(roll.rows, fps)
    own = frame_of(i, len(x), size, roll.frame)
    known = ~np.isnan(x[own]) & (~np.isnan(y[own]) if roll.kind == "corr" else True)
    v, w = x[own][known], y[own][known]
    if len(v) < max(1, roll.least(size, fps)) or (roll.kind in ("std", "var") and len(v) < 2):
        return np.nan
    if roll.kind == "corr":
        a, b = v - v.mean(), w - w.mean()
        return np.nan if min((a * a).sum(), (b * b).sum()) * len(v) <= 1e-12 else (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
    if roll.kind == "rank":
        return np.nan if np.isnan(x[i]) else ((v < x[i]).sum() + ((v == x[i]).sum() + 1) / 2) / len(v)
    return {"mean": np.mean, "sum": np.sum, "std": lambda v: v.std(ddof=1), "var": lambda v: v.var(ddof=1), "min": np.min, "max": np.max, "count": len, "quantile": lambda v: np.quantile(v, roll.q)}[roll.kind](v)


@pytest.mark.parametrize("fps", [25.0, 30.0, 60.0])
def test_statistics_against_every_frame(fps):
    rng = np.random.default_rng(1)
    sizes = [1, 5, 67, 130]
    n = sum(sizes)
    x, y = (np.where(rng.random(n) < 0.2, np.nan, np.round(rng.normal(0, 10, n), 1)) for _ in range(2))
    x[50], x[100:120] = 1e10, 3.3  # a far value spoils no frame that lacks it, and a constant frame does not vary
    rolls = [Roll(f"{k}_{f}_{w}", k, ("x", "y") if k == "corr" else ("x",), w, f, share(4)) for w in (1, 2, 3, 7, 30, 120) for f in ("trailing", "centred", "before") for k in ("mean", "sum", "std", "var", "min", "max", "count", "corr")]
    rolls += [Roll(f"{k}_{w}", k, ("x",), w, "trailing", share(3), q=0.25) for w in (1, 4, 30, 120) for k in ("quantile", "rank")]
    first = np.cumsum([0, *sizes[:-1]])
    rows = rolling.Rows(first, n)
    got = rolling.statistics(rows, rolls, {"x": x, "y": y}, np.repeat(sizes, sizes), np.ones(n, bool), rows.place.astype(float), fps)
    for r in rolls:
        want = np.concatenate([[plain(r, x[a : a + m], y[a : a + m], i, fps) for i in range(m)] for a, m in zip(first, sizes, strict=True)])
        np.testing.assert_allclose(got[r.name], want, rtol=1e-7, atol=1e-7, err_msg=r.name)
    assert np.nanmax(got["std_trailing_7"][114:120]) == 0


def long_track(spark, n=5000, small=40, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(1, i, float(v)) for i, v in enumerate(rng.normal(0, 5, n))] + [(t, i, float(v)) for t in range(2, 6) for i, v in enumerate(rng.normal(0, 5, small))]
    rows = [(t, i, None if (i * 7 + t) % 11 == 0 or 900 < i < 1800 else v) for t, i, v in rows]
    return spark.createDataFrame(rows, "track long, frame long, x double")


ROLLS = [Roll("m", "mean", ("x",), 120, "centred", share(4)), Roll("s", "std", ("x",), 60, "trailing", at_least(2)), Roll("q", "quantile", ("x",), 30, "trailing", q=0.75), Roll("l", "shift", ("x",), -30), Roll("a", "shift", ("x",), 30), Roll("e", "ewm", ("x",), 60), Roll("k", "streak", ("gone",))]


def test_a_long_track_is_many_blocks_with_the_same_results(spark):
    df = long_track(spark).withColumn("gone", F.col("x").isNull().cast("double"))
    behind, ahead = (max(r.reach()[k] for r in ROLLS) for k in (0, 1))
    blocks = rolling.in_blocks(df, T, behind, ahead, block=256)
    held = blocks.groupBy("track", "_block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_own").cast("int")).alias("own")).collect()
    assert max(r.n for r in held) <= 256 + behind + ahead + 2 and sum(r.own for r in held) == df.count() and len([r for r in held if r.track == 1]) == 20
    got = {n: rolled(df, T, ROLLS, block=n).orderBy("track", "frame").toPandas() for n in (256, 1 << 20)}
    assert list(got[256].columns) == list(got[1 << 20].columns) and len(got[256]) == df.count()
    for r in ROLLS:
        np.testing.assert_allclose(got[256][r.name], got[1 << 20][r.name], rtol=1e-9, atol=1e-9, err_msg=r.name)
    own = got[256][got[256].track == 1]
    x = own.x.reset_index(drop=True)
    np.testing.assert_allclose(own.e, x.ewm(span=60, min_periods=1).mean(), rtol=1e-9)
    np.testing.assert_allclose(own.m, x.rolling(120, min_periods=30, center=True).mean(), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(own.l, x.shift(30))
    gone = x.isna()
    np.testing.assert_array_equal(own.k, [0 if not g else i - max((j for j in range(i) if not gone[j]), default=-1) + (1 if (~gone[:i]).any() else 0) for i, g in enumerate(gone)])


def test_layers_reach_as_far_as_their_sum(spark):
    df = long_track(spark, 1500)
    one, two = Roll("m", "mean", ("x",), 60, "trailing"), Roll("mm", "max", ("m",), 60, "centred")
    reach = [one.reach()[k] + two.reach()[k] for k in (0, 1)]
    got = [rolling.add(rolling.add(rolling.in_blocks(df, T, *reach, block=n), [one]), [two]).where("_own").orderBy("track", "frame").toPandas().mm for n in (128, 1 << 20)]
    np.testing.assert_allclose(*got)


def test_holes_order_of_other_kinds_and_null_keys(spark):
    rows = [(t, f, float(f)) for t in (None, 7) for f in (3, 4, 9, 70_000, 200_000)]
    df = spark.createDataFrame(rows, "track long, frame long, x double")
    roll = [Roll("b", "before", ("x",)), Roll("m", "sum", ("x",), 2, "trailing")]
    want = {(3, None, 3.0), (4, 3.0, 7.0), (9, 4.0, 13.0), (70_000, 9.0, 70_009.0), (200_000, 70_000.0, 270_000.0)}
    for order in (df, df.withColumn("frame", F.col("frame").cast("double"))):
        out = rolled(order, T, roll).collect()
        assert len(out) == 10 and {(int(r.frame), r.b, r.m) for r in out if r.track is None} == want == {(int(r.frame), r.b, r.m) for r in out if r.track == 7}
    assert rolled(df.limit(0), T, roll).count() == 0
    twice = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 2, 3.0)], "track long, frame long, x double")
    with pytest.raises(Exception, match="two rows of one frame"):
        rolled(twice, T, roll).collect()


def test_track_quantiles_of_long_tracks(spark):
    rng = np.random.default_rng(5)
    tracks = {1: rng.normal(0, 1, 3000), 2: np.repeat([1.0, 2.0, 3.0], 700), 3: np.concatenate([rng.normal(0, 1e-9, 2000), [1e300, -1e300]]), 4: rng.normal(0, 1, 30), 5: np.full(500, 4.0)}
    rows = [(t, float(v), None) for t, vs in tracks.items() for v in vs] + [(1, None, None), (6, None, None), (None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "track long, x double, y double")
    for buffer in (64, 1 << 16):
        got = {r.track: r for r in quantiles.track_quantiles(df, ["track"], ["x", "y"], (0.01, 0.5, 0.99), buffer).collect()}
        for t, vs in tracks.items():
            np.testing.assert_allclose(got[t]["_l_x"], np.quantile(vs, [0.01, 0.5, 0.99]), rtol=1e-12)
            assert got[t]["_l_y"] is None
        assert got[6]["_l_x"] is None and got[None]["_l_x"] == [2.0] * 3 and got[None]["_l_y"] == [1.0] * 3 and len(got) == 7


def test_pandas_agrees_on_means_of_scaled_windows(spark):
    rows = [(t, i, float((i * 37 + t) % 50), fps) for t, fps in ((1, 25.0), (2, 60.0), (3, None)) for i in range(120)]
    df = spark.createDataFrame(rows, "track long, frame long, x double, fps double")
    got = rolled(df, T, [Roll("m", "mean", ("x",), 15, "trailing", share(4))], F.coalesce("fps", F.lit(30.0))).orderBy("track", "frame").toPandas()
    for t, fps in ((1, 25), (2, 60), (3, 30)):
        own, n = got[got.track == t], scale(15, fps)
        np.testing.assert_allclose(own.m, pd.Series(own.x.to_numpy()).rolling(n, min_periods=max(1, n // 4)).mean())
