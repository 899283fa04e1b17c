"""Hand-sized cases of the track operators, and the catalogue against DuckDB."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spoorline.functions import series
from spoorline.functions.frames import Tracks, ind, scale, scale_signed
from spoorline.functions.rolling import Roll, rolled
from spoorline.operators import boosting, evaluate, intervals, reshape
from spoorline.plans import catalogue
from spoorline.plans.pair import pair_features
from spoorline.plans.single import single_features
from spoorline.sources import tables

SF = "/root/testdata/sf0.001"
T = Tracks(["track"])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
#: Without SQL, or with plans of many columns; of the feature groups three are compared here.
HEAVY = {"all_single_features", "all_pair_features", "gbt_classifier_oof"}
HEAVY |= {n for n in catalogue.queries() if n.startswith(("single_", "pair_"))} - {"single_micro", "pair_ends", "pair_contact"}


def track(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(1, i, *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "track long, frame long, " + ", ".join(f"{c} double" for c in columns))


def values(df, column):
    return [r[column] for r in df.orderBy("frame").collect()]


def test_scale_rounds_halves_to_even():
    assert [scale(n, 25) for n in (15, 45, 3, 9)] == [12, 38, 2, 8]
    assert [scale_signed(n, 30) for n in (-10, 0, 10)] == [-10, 0, 10]


def test_gap_fill(spark):
    df = track(spark, x=[0, *[None] * 12, 13])
    assert values(series.gap_fill(df, T, ["x"], 3), "x") == [0, 1, 2, 3, 3, 3, 3, None, None, None, 13, 13, 13, 13]
    df = track(spark, x=[*[None] * 5, 1, 2, *[None] * 5])
    assert values(series.gap_fill(df, T, ["x"], 3), "x") == [None, None, 1, 1, 1, 1, 2, 2, 2, 2, None, None]


def test_streak_rank_ewm_corr(spark):
    missing = [1, 1, 0, 1, 1, 1, 0]
    df = track(spark, x=missing)
    assert values(rolled(df, T, [Roll("s", "streak", ("x",))]), "s") == [1, 2, 0, 2, 3, 4, 0]
    df = track(spark, x=[3, 1, 2, 2, 2, None, 5])
    got = values(rolled(df, T, [Roll("r", "rank", ("x",), 4, "trailing")]), "r")
    assert [None if v is None else round(v, 4) for v in got] == [1, 0.5, 0.6667, 0.625, 0.75, None, 1]
    df = track(spark, x=[1, None, 3, 4])
    assert [round(v, 6) for v in values(rolled(df, T, [Roll("e", "ewm", ("x",), 3)]), "e")] == [1, 1, 2.6, 3.461538]
    df = track(spark, x=[1, 2, 3, None, 5, 6], y=[2, 1, 4, 5, None, 9])
    got = values(rolled(df, T, [Roll("r", "corr", ("x", "y"), 4, "trailing")]), "r")
    assert [None if v is None else round(v, 6) for v in got] == [None, -1, 0.654654, 0.654654, 1, 1]


def test_states_and_changes(spark):
    df = track(spark, x=[None, 0.5, 0.6, 2, 5, 9]).withColumn("s", series.speed_state(F.col("x")))
    assert values(df, "s") == [None, 0, 1, 1, 2, 3]
    assert values(df.withColumn("c", series.change_flag(F.col("s"), T)), "c") == [1, 1, 1, 0, 1, 1]
    assert df.select(ind(F.lit(None).cast("double") >= 30).alias("i")).first().i == 0.0


def test_overlaps_batches_and_runs(spark):
    rows = [(1, "a", s, e) for s, e in ((0, 10), (5, 20), (10, 12), (11, 13), (12, 30))]
    df = spark.createDataFrame(rows, "track long, action string, start_frame long, stop_frame long")
    assert sorted((r.start_frame, r.stop_frame) for r in intervals.without_overlaps(df, ["track"]).collect()) == [(0, 10), (10, 12), (12, 30)]
    listed = spark.createDataFrame([(1, "mouse1", "self", a) for a in "abcd"], "video_id long, agent_id string, target_id string, action string")
    extent = spark.createDataFrame([(1, 0, 4)], "video_id long, lo long, hi long")
    none = spark.createDataFrame([], "video_id long")
    got = sorted((r.start_frame, r.stop_frame) for r in intervals.default_batches(listed, extent, none, compat=True).collect())
    assert got == [(0, 2), (2, 4), (4, 5), (6, 5)]
    assert intervals.default_batches(listed, extent, none).count() == 3
    states = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, "b", "b"])], "track long, frame long, s string")
    assert sorted(intervals.runs(states, ["track"], "s").collect()) == [(1, "a", 0, 2), (1, "b", 3, 5)]
    assert sorted(intervals.runs(states, ["track"], "s", compat=True).collect()) == [(1, "a", 0, 2)]


def test_labels_of_unlisted_actions_are_positive_only(spark):
    frames = spark.createDataFrame([(1, i) for i in range(5)], "track long, frame long")
    marks = spark.createDataFrame([(1, "zz", 1, 2), (1, "a", 4, 9)], "track long, action string, start_frame long, stop_frame long")
    listed = spark.createDataFrame([(1, "a")], "track long, action string")
    got = sorted((r.action, r.frame, r.label) for r in reshape.paint_labels(frames, marks, listed, ["track"]).collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 4, 1), ("zz", 1, 1), ("zz", 2, 1)]


def test_pivot_rejects_duplicates_and_densifies(spark):
    schema = "video_id long, mouse_id long, video_frame long, bodypart string, x double, y double"
    rows = [(1, 1, 0, "nose", 1.0, 2.0), (1, 1, 1, "tail_base", 3.0, 4.0), (1, 2, 0, "nose", 5.0, 6.0)]
    wide = reshape.pivot_parts(spark.createDataFrame(rows, schema), ["nose", "tail_base"])
    assert wide.count() == 4
    assert {(r.mouse_id, r.has_nose, r.has_tail_base) for r in wide.collect()} == {(1, True, True), (2, True, False)}
    with pytest.raises(Exception, match="two points"):
        reshape.pivot_parts(spark.createDataFrame([rows[0], rows[0]], schema), ["nose"]).collect()


def test_f1_and_sweep(spark):
    df = spark.createDataFrame([("k", 1, 0.9), ("k", 0, 0.4), ("k", 1, 0.4), ("k", 0, 0.1), ("n", 0, 0.2)], "k string, y int, s double")
    best = {r.k: (round(r.threshold, 2), round(r.f1, 4)) for r in evaluate.best_threshold(evaluate.sweep(df, ["k"], "y", "s"), ["k"]).collect()}
    assert best == {"k": (0.11, 0.8), "n": (0.0, 0.0)}


def test_interval_sink_numbers_rows(spark, tmp_path):
    df = spark.createDataFrame([(v, "mouse1", "self", "rear", 5 * v, 5 * v + 1) for v in range(20)], tables.INTERVALS)
    tables.write_intervals(df, str(tmp_path / "out"))
    got = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out")).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(20)) and [r.video_id for r in got] == list(range(20))
    tables.write_intervals(df.limit(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "none")).count() == 1


def test_files_give_their_keys(spark, tmp_path):
    pdf = pd.DataFrame({"video_frame": [0], "mouse_id": [1], "bodypart": ["nose"], "x": [math.nan], "y": [2.0]}).astype({"video_frame": "int32", "mouse_id": "int32"})
    (tmp_path / "lab A").mkdir()
    pdf.to_parquet(tmp_path / "lab A" / "17.parquet")
    row = tables.read_tracking(spark, str(tmp_path)).first()
    assert (row.lab_id, row.video_id, row.x, row.y) == ("lab A", 17, None, 2.0)


def test_features_against_pandas(spark):
    rng = np.random.default_rng(3)
    n, p = 90, {c: rng.normal(0, 4, 90).cumsum() for c in ("nose_x", "nose_y", "tail_base_x", "tail_base_y", "body_center_x", "body_center_y")}
    rows = [(1, i, *[float(p[c][i]) for c in p]) for i in range(n)]
    df = spark.createDataFrame(rows, "track long, frame long, " + ", ".join(f"{c} double" for c in p))
    df = df.select("*", *[F.lit(True).alias(f"has_{c}") for c in ("nose", "tail_base", "body_center")], F.lit(30.0).alias("fps"), F.lit(50.0).alias("arena_width_cm"), F.lit(40.0).alias("arena_height_cm"), F.lit("square").alias("arena_shape"))
    got = single_features(df, ["nose", "tail_base", "body_center"], 1, ["track"], groups=("motion", "micro")).orderBy("frame").toPandas()
    cx, cy, nx, ny = (pd.Series(p[c]) for c in ("body_center_x", "body_center_y", "nose_x", "nose_y"))
    speed = np.hypot(cx.diff(), cy.diff()) * 30
    head = np.hypot(nx.diff().diff(), ny.diff().diff()) * 900
    want = {
        "sp_m15": speed.rolling(15, min_periods=3).mean(), "sp_q75_30": speed.rolling(30, min_periods=7).quantile(0.75), "cx_s15": cx.rolling(15, min_periods=1, center=True).std(),
        "x_e30": cx.ewm(span=30, min_periods=1).mean(), "head_accel_m5": head.rolling(5, min_periods=2, center=True).mean(), "disp15": np.hypot(cx.diff().rolling(15, min_periods=1).sum(), cy.diff().rolling(15, min_periods=1).sum()),
        "sp_pct30": speed.rolling(30, min_periods=5).rank(pct=True),
    }
    for name, series_ in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), series_.to_numpy(float), rtol=1e-4, atol=1e-4, err_msg=name)
    assert got["sp_m120"].isna().all()  # the track is shorter


def test_swapping_a_pair_mirrors_its_features(spark):
    f = pair_features(catalogue.pairs(spark, SF).where("video < 2"), catalogue.PARTS, ["video", "agent", "target"])
    f = f.select("video", "agent", "target", "frame", "A_chasing_p15", "A_front_to_B_min", "B_front_to_A_min", "A_face_B", "B_face_A").toPandas()
    m = f.merge(f, left_on=["video", "agent", "target", "frame"], right_on=["video", "target", "agent", "frame"])
    assert len(m) == len(f) and (len({*f.columns}) == len(f.columns))
    np.testing.assert_allclose(m["A_front_to_B_min_x"].astype(float), m["B_front_to_A_min_y"].astype(float))
    np.testing.assert_allclose(m["A_face_B_x"].astype(float), m["B_face_A_y"].astype(float))


def canon(df):
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return "-"
        return str(bool(v)) if isinstance(v, (bool, np.bool_)) else f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - HEAVY))
def test_catalogue_against_duckdb(spark, duck, name):
    assert canon(catalogue.queries()[name](spark, SF).toPandas()) == canon(duck.execute(catalogue.oracle_sql()[name]).df())


def test_trees_are_fitted_at_full_size(spark, monkeypatch):
    made = []

    def small(df, features, labels, fold=None, folds=0, **settings):
        made.append((boosting.Settings(**settings), folds, len(features)))
        return fit(df, features, labels, fold, folds, **{**settings, "trees": 1, "depth": 1})

    fit = boosting.fit
    monkeypatch.setattr(boosting, "fit", small)
    out = catalogue.queries()["gbt_classifier_oof"](spark, SF)
    assert [(s.trees, s.leaves, s.depth, s.rate, s.least_weight, s.l1, s.l2, s.rows, s.columns, k) for s, k, _ in made] == [(250, 31, 6, 0.08, 10.0, 0.1, 0.1, 0.8, 0.8, 5)] and made[0][2] > 20
    rows = out.toPandas()
    assert len(rows) == len(rows[["track", "frame"]].drop_duplicates()) == spark.read.parquet(f"{SF}/events.parquet").count() and rows.score.between(0, 1).all()
    assert (rows.groupby("track").fold.nunique() == 1).all()


def test_flagship_has_no_overlaps(spark):
    rows = sorted(catalogue.flagship(spark, SF).select("track", "start_frame", "stop_frame").collect())
    assert rows and all(r[1] < r[2] for r in rows)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(rows, rows[1:], strict=False))
