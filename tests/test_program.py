"""Recordings to models to intervals, over a small written fixture."""

import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spoorline.operators import evaluate, learn, meta, reshape
from spoorline.plans import program
from spoorline.sources import tables

PARTS = {"A": ["body"], "B": ["body_center", "nose", "tail_base"], "C": ["nose", "tail_base"]}
SETTINGS = {"folds": 2, "trees": 3, "depth": 2, "rate": 0.5, "groups": {"single": ("micro",), "pair": ("chase",)}}


@pytest.fixture(scope="module")
def fixture(tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    rng, rows = np.random.default_rng(8), []
    for video, kind in ((1, "A"), (2, "B"), (3, "B"), (4, "B"), (5, "B"), (6, "C"), (7, "B")):
        lab = "MABe22_x" if video == 7 else "lab one"
        row = dict.fromkeys([c.split()[0] for c in re.split(r",\s*", tables.METADATA)])
        row |= {"lab_id": lab, "video_id": video, "behaviors_labeled": json.dumps(["mouse1,self,rear", "'mouse2,self,rear'", "mouse1,mouse2,chase"]), "body_parts_tracked": json.dumps(PARTS[kind])}
        row |= {"frames_per_second": 30.0 if video != 3 else None, "pix_per_cm_approx": 2.0, "arena_width_cm": 50.0, "arena_height_cm": 40.0, "arena_shape": "square", "mouse1_strain": "s", "mouse2_strain": "s"}
        rows.append(row)
        for folder in ("tracking", "annotation"):
            (root / folder / lab).mkdir(parents=True, exist_ok=True)
        track = []
        for mouse in (1, 2):
            step = np.where((np.arange(60) >= 20) & (np.arange(60) < 40), 6.0, 0.5)
            at = np.cumsum(rng.normal(0, 1, (60, 2)) * step[:, None], axis=0)
            for i, part in enumerate(PARTS[kind]):
                track += [(f, mouse, part, at[f, 0] + i, at[f, 1] - i) for f in range(60) if not (f in (7, 8) and i == 0)]
        pd.DataFrame(track, columns=["video_frame", "mouse_id", "bodypart", "x", "y"]).astype({"video_frame": "int32", "mouse_id": "int32"}).to_parquet(root / "tracking" / lab / f"{video}.parquet")
        marks = [(1, 1, "rear", 20, 39), (2, 2, "rear", 20, 39), (1, 2, "chase", 25, 39)]
        pd.DataFrame(marks, columns=["agent_id", "target_id", "action", "start_frame", "stop_frame"]).astype({c: "int32" for c in ("agent_id", "target_id", "start_frame", "stop_frame")}).to_parquet(root / "annotation" / lab / f"{video}.parquet")
    pd.DataFrame(rows).to_csv(root / "meta.csv", index=False)
    return str(root)


def test_train_then_predict(spark, fixture, tmp_path):
    rec = program.Recordings.read(spark, f"{fixture}/meta.csv", f"{fixture}/tracking", f"{fixture}/annotation")
    assert sorted(r.video_id for r in rec.meta.collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted((r.section, json.loads(r.body_parts_tracked)) for r in reshape.sections(rec.meta).collect()) == [(1, PARTS["B"]), (2, PARTS["C"])]
    root = str(tmp_path / "run")
    got = {(r.section, r.kind, r.action): r for r in program.train(rec, root, **SETTINGS).collect()}
    assert set(got) == {("1", "single", "rear"), ("1", "pair", "chase")} and all(0 <= r.threshold <= 1 for r in got.values())
    assert got["1", "single", "rear"].f1 > 0.6
    oof = spark.read.parquet(f"{root}/oof/1/single/rear")
    assert oof.count() == 4 * 2 * 60 and oof.groupBy("video_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    registry = tables.model_registry(spark, f"{root}/models")
    assert sorted((r.section, r.kind, r.action) for r in registry.collect()) == [("1", "pair", "chase"), ("1", "single", "rear")]
    assert len(learn.saved_models(rec.meta, f"{root}/models/1/pair/chase")) == 2
    assert spark.read.parquet(f"{root}/mean_f1").first().f1 == pytest.approx(np.mean([r.f1 for r in got.values()]))
    found = program.predict(program.Recordings(rec.meta, rec.points), rec.meta, root, groups=SETTINGS["groups"], save=f"{root}/submission").collect()
    written = spark.read.option("header", True).csv(f"{root}/submission").collect()
    assert sorted((int(r.video_id), r.agent_id, r.target_id, int(r.start_frame)) for r in written) == sorted((r.video_id, r.agent_id, r.target_id, r.start_frame) for r in found)
    assert {r.video_id for r in found} >= {2, 3, 4, 5} and all(r.start_frame < r.stop_frame for r in found)
    for key in {(r.video_id, r.agent_id, r.target_id) for r in found}:
        own = sorted((r.start_frame, r.stop_frame) for r in found if (r.video_id, r.agent_id, r.target_id) == key)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
    default = sorted((r.start_frame, r.stop_frame) for r in found if r.video_id == 6 and r.target_id == "self" and r.agent_id == "mouse1")
    assert default == [(0, 60)]  # no model for its section: its listed action over its frames
    rear = [r for r in found if r.video_id in (2, 3, 4, 5) and r.action == "rear"]
    assert rear and np.mean([20 <= (r.start_frame + r.stop_frame) / 2 <= 42 for r in rear]) > 0.6


def test_gaps_are_filled_by_seconds(spark):
    rows = [(1, 1, f, "nose", float(f), 0.0) for f in range(40) if not 5 <= f < 30]
    points = spark.createDataFrame(rows, "video_id long, mouse_id long, video_frame long, bodypart string, x double, y double")
    grid = points.unionByName(spark.createDataFrame([(1, 2, f, "nose", 0.0, 0.0) for f in range(40)], points.schema))
    own = spark.createDataFrame([(1, 1.0, 20.0)], "video_id long, pix_per_cm_approx double, frames_per_second double")
    got = {r.video_frame: r.nose_x for r in reshape.samples(grid, own, ["nose"]).where("mouse_id = 1").collect()}
    # 5 frames on the line, 5 of the last of them, 5 back from the end; the rest of the gap stays.
    assert [got[f] for f in (4, 5, 9, 14, 15, 24, 25, 29)] == pytest.approx([4, 5, 9, 9, None, None, 30, 30])


def test_arenas_means_and_missing_categories(spark):
    schema = "video_id long, arena_width_cm double, arena_height_cm double, arena_shape string"
    a, b = spark.createDataFrame([(1, 1.0, 1.0, "x"), (2, None, None, None)], schema), spark.createDataFrame([(2, 5.0, 5.0, "y"), (3, 6.0, 6.0, "z")], schema)
    assert sorted(map(tuple, reshape.arenas(a, b).collect()), key=repr) == [(1, 1.0, 1.0, "x"), (2, None, None, None), (3, 6.0, 6.0, "z")]
    assert evaluate.mean_f1(spark.createDataFrame([("a", 0.5), ("b", 1.0)], "action string, f1 double")).first().f1 == 0.75
    df = spark.createDataFrame([("k",), (None,), ("new",)], "c string")
    rows = [tuple(r) for r in df.select(*[v.alias(n) for n, v in meta.one_hot({"c": ["k"]}).items()]).collect()]
    assert rows == [(1, 0, 0), (0, 1, 0), (0, 1, 0)]
    assert tuple(df.where("c is null").select(*[v.alias(n) for n, v in meta.one_hot({"c": ["k"]}, compat=False).items()]).first()) == (0, 0, 1)


def test_group_folds_keep_groups_whole_and_spread_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(rng.random() < 0.1 + 0.02 * g)) for g in range(25) for _ in range(20 + g)]
    df = spark.createDataFrame(rows, "g long, y int")
    folds = {r.g: r.fold for r in evaluate.group_folds(df, "g", "y").collect()}
    assert set(folds) == set(range(25)) and set(folds.values()) == set(range(5))
    ones = [sum(y for g, y in rows if folds[g] == k) for k in range(5)]
    assert max(ones) <= 1.5 * min(ones)
