"""Overlap removal, decoding and label painting against plain Python, over blocks; reading chosen recordings only."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spoorline.operators import intervals, reshape
from spoorline.sources import tables


def greedy(rows):
    out = []
    for key in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == key and r[2] < r[3]), key=lambda r: (r[2], r[3], r[1])):
            if last is None or r[2] >= last:
                out.append(r)
                last = r[3]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [5, 16, 64, 1 << 16])
def test_overlap_removal_over_blocks(spark, block):
    rng = random.Random(block)
    rows = [(t or None, rng.choice("abc"), a, a + rng.choice([-1, 0, 1, 2, 5, 60])) for t in range(5) for a in (rng.randrange(300) for _ in range(rng.choice([3, 50, 200])))]
    rows += [(7, "a", i, i + 2) for i in range(100)] + [(8, "a", 0, 500)] + [(8, "b", i, i + 1) for i in range(90)] + [(7, "a", 0, 2)]
    df = spark.createDataFrame(rows, "track long, action string, start_frame long, stop_frame long")
    assert sorted(map(tuple, intervals.without_overlaps(df, ["track"], block).collect()), key=repr) == greedy(rows)


def test_a_million_overlapping_intervals_of_one_track(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("track"), F.lit("a").alias("action"), F.col("id").alias("start_frame"), (F.col("id") + 3).alias("stop_frame"), (F.col("id") % 2).alias("more"))
    got = intervals.without_overlaps(rows, ["track"])
    assert got.columns == rows.columns and tuple(got.agg(F.count(F.lit(1)), F.sum("start_frame"), F.sum("more")).first()) == (333_334, sum(range(0, 1_000_000, 3)), sum(i % 2 for i in range(0, 1_000_000, 3)))


def one_sequence(rows, compat):
    rows, changes, before = sorted(rows), [], ()
    for r in rows:
        if before == () or r[2] is None or before is None or r[2] != before:
            changes.append(r)
        before = r[2]
    last = {t: max(r[1] for r in rows if r[0] == t) for t in {r[0] for r in rows}}
    out = []
    for i, r in enumerate(changes):
        nxt = changes[i + 1] if i + 1 < len(changes) else None
        if r[2] is not None and not (compat and nxt is None):
            out.append((r[0], r[2], r[1], nxt[1] if nxt and nxt[0] == r[0] else last[r[0]] + 1))
    return sorted(out)


@pytest.mark.parametrize("compat", [False, True])
def test_all_tracks_as_one_sequence(spark, compat):
    rng = random.Random(3)
    rows = [(t, i, rng.choice(["a", "a", "a", "b", None])) for t in range(9) for i in range(rng.randrange(1, 40))]
    rows += [(t, i, "a") for t in (20, 21) for i in range(5)]  # the second one's run is swallowed
    df = spark.createDataFrame(rows, "track long, frame long, s string").repartition(7)
    want = one_sequence(rows, compat)
    assert sorted(map(tuple, intervals.runs_in_one_sequence(df, ["track"], "s", compat=compat).collect())) == want and not any(r[0] == 21 for r in want)
    assert intervals.runs_in_one_sequence(df.limit(0), ["track"], "s").count() == 0


@pytest.mark.parametrize("block", [5, 16, 1 << 14])
def test_labels_over_blocks(spark, block):
    rng = random.Random(block)
    frames = [(t, i) for t in (None, 1, 2) for i in range(60)] + [(3, 1_000_000), (3, 5)]
    marks = [(rng.choice([None, 1, 2, 9]), rng.choice("abz"), a, a + rng.randrange(-1, 30)) for a in (rng.randrange(70) for _ in range(25))] + [(3, "a", 0, 2_000_000)]
    listed = [(None, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "b")]
    want = set()
    for t, i in frames:
        for a in "abz":
            inside = any((r[0], r[1]) == (t, a) and r[2] <= i <= r[3] for r in marks)
            if inside or (t, a) in listed:
                want.add((t, i, a, int(inside)))
    got = [tuple(r) for r in reshape.paint_labels(spark.createDataFrame(frames, "track long, frame int"), spark.createDataFrame(marks, "track long, action string, start_frame int, stop_frame int"), spark.createDataFrame(listed, "track long, action string"), ["track"], block=block).collect()]
    assert len(got) == len(want) and set(got) == want


def test_only_chosen_recordings_are_read(spark, tmp_path):
    pdf = pd.DataFrame({"video_frame": [0, 1], "mouse_id": [1, 1], "bodypart": ["nose"] * 2, "x": [1.0, 2.0], "y": [2.0, 3.0]}).astype({"video_frame": "int32", "mouse_id": "int32"})
    for lab in ("lab A", "lab B"):
        (tmp_path / lab).mkdir()
        for video in range(20):
            pdf.to_parquet(tmp_path / lab / f"{video}.parquet")
    chosen = spark.createDataFrame([("lab A", 3), ("lab A", 17), ("lab B", 3), ("lab B", 99), ("none", 1), (None, 2)], "lab_id string, video_id long")
    got = tables.read_tracking(spark, str(tmp_path), chosen)
    assert len(got.inputFiles()) == 3 and sorted({(r.lab_id, r.video_id) for r in got.collect()}) == [("lab A", 3), ("lab A", 17), ("lab B", 3)]
    assert len(tables.read_tracking(spark, str(tmp_path)).inputFiles()) == 40
    assert tables.read_tracking(spark, str(tmp_path), chosen.where("video_id = 99")).count() == 0
