"""Row-level scores and states to clean intervals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import Tracks, changed
from ..functions.rolling import meet
from ..sources.stages import Stages

DEFAULT_THRESHOLD = 0.27


def best_action(scores: dict[str, Column], thresholds: dict[str, float] | None = None) -> Column:
    """The action of the largest score, the first of equals, if that score reaches the action's threshold; else NULL."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F
    for name, score in scores.items():
        limit = (thresholds or {}).get(name, DEFAULT_THRESHOLD)
        out = out.when(score == top, F.when(top >= limit, F.lit(name)))
    return out


def runs(df: DataFrame, keys: list[str], state: str, frame: str = "frame", compat: bool = False) -> DataFrame:
    """(keys, action, start_frame, stop_frame) of each run of equal, known states; stop excluded.

    A run stops where the next one starts; the last of a track stops after the track's last frame, or is lost
    with ``compat``. Missing states end runs and give none.
    """
    t = Tracks(keys, frame)
    marked = df.select(*keys, frame, state, changed(F.col(state), t.lag(F.col(state))).alias("_c"), F.max(frame).over(t.whole).alias("_last"))
    firsts = marked.where(F.col("_c")).withColumn("_next", F.lead(frame).over(t.rows))
    stop = F.col("_next") if compat else F.coalesce(F.col("_next"), F.col("_last") + 1)
    out = firsts.where(F.col(state).isNotNull()).select(*keys, F.col(state).alias("action"), F.col(frame).alias("start_frame"), stop.alias("stop_frame"))
    return out.where("stop_frame is not null")


def runs_in_one_sequence(df: DataFrame, keys: list[str], state: str, frame: str = "frame", compat: bool = False) -> DataFrame:
    """As ``runs``, with all tracks as one sequence in the order of (keys, frame), as the surveyed validation decodes them.

    A state that goes on into the next track makes no new run, so that track's part of it is lost; a run whose next change
    is in another track stops after the last frame of its first key's recording. With ``compat`` the last change is lost.
    The rows are dealt to ranges; each range's last state and first change are handed to its neighbours, one row a range.
    """
    stages = Stages(df.sparkSession)
    order = [*keys, frame]
    dealt = df.select(*order, F.col(state).alias("_s")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stages.write(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    own, parts = Window.partitionBy("_p").orderBy("_k"), Window.orderBy("_p")  # the latter over one row a range
    tail = dealt.groupBy("_p").agg(F.max_by(F.struct("_s"), "_k").alias("_end"))
    tail = tail.select("_p", F.lag("_end").over(parts).alias("_before"))
    marked = dealt.withColumn("_one", F.row_number().over(own) == 1).withColumn("_lag", F.lag("_s").over(own)).join(F.broadcast(tail), "_p")
    firsts = marked.where(changed(F.col("_s"), F.when(F.col("_one"), F.col("_before._s")).otherwise(F.col("_lag")))).select(*order, "_s", "_p", "_k")
    at = F.struct(*order)
    heads = firsts.groupBy("_p").agg(F.min_by(at, "_k").alias("_head")).select(F.col("_p"), F.lead("_head").over(parts).alias("_after"))
    nxt = F.coalesce(F.lead(at).over(own), F.col("_after"))
    last = dealt.groupBy(keys[0]).agg(F.max(frame).alias("_last"))
    out = firsts.join(F.broadcast(heads), "_p").withColumn("_next", nxt).join(last, keys[0])
    same = reduce(lambda a, b: a & b, [F.col(f"_next.{k}").eqNullSafe(F.col(k)) for k in keys])
    stop = F.when(same, F.col(f"_next.{frame}")).otherwise(F.col("_last") + 1)
    out = out.where(F.col("_s").isNotNull() & (F.col("_next").isNotNull() if compat else F.lit(True)))
    return out.select(*keys, F.col("_s").alias("action"), F.col(frame).alias("start_frame"), stop.alias("stop_frame"))


def valid(intervals: DataFrame) -> DataFrame:
    return intervals.where("start_frame < stop_frame")


def without_overlaps(intervals: DataFrame, keys: list[str], block: int = 1 << 16) -> DataFrame:
    """Greedy by (start, stop, action) within a track: an interval stays if it starts at or after the last kept stop.

    Intervals that do not stop after they start are left out. Of those with one start only the first can stay, so a block of
    ``block`` frames of a track holds no more rows than frames. A block is a function from the last kept stop before it to
    that behind it; the functions are chained by one group a track, of the few starts that stops before a block reach.
    """
    columns = intervals.columns
    rest = [c for c in columns if c not in (*keys, "start_frame")]
    first = ["stop_frame", "action", *[c for c in rest if c not in ("stop_frame", "action")]]
    df = valid(intervals).groupBy(*keys, "start_frame").agg(F.min(F.struct(*first)).alias("_r")).select(*keys, "start_frame", "_r.*")
    df = df.withColumn("_block", F.floor(F.col("start_frame") / F.lit(block)).cast("long"))
    ends = df.groupBy(*keys, "_block").agg(F.max("stop_frame").cast("long").alias("_stop"))
    track = Window.partitionBy(*keys)
    ends = ends.withColumn("_many", F.count(F.lit(1)).over(track) > 1)
    ends = ends.withColumn("_reach", F.max("_stop").over(track.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).where("_many").select(*keys, "_block", "_reach")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", `_block` long"
    functions = meet(df.select(*keys, "_block", F.col("start_frame").cast("long").alias("a"), F.col("stop_frame").cast("long").alias("b")), ends, [*keys, "_block"])
    functions = functions.groupBy(*keys, "_block").applyInPandas(lambda g: _exits(g, keys), f"{kinds}, a array<long>, b array<long>")
    states = functions.groupBy(*keys).applyInPandas(lambda g: _chained(g, keys), f"{kinds}, `_from` long")
    df = meet(df, states, [*keys, "_block"], "left").repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "start_frame")
    df = df.select(*[F.col(c) for c in columns], "_block", "_from")
    return df.mapInArrow(lambda it: _kept(it, [*keys, "_block"]), df.schema).select(*columns)


def _exits(g: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Starts of a block, and the last kept stop behind the block if the one before it lets that start be the first kept."""
    g = g.sort_values("a")
    a, b = g["a"].to_numpy(np.int64), g["b"].to_numpy(np.int64)
    after, out = np.searchsorted(a, b).tolist(), b.tolist()
    for i in range(len(a) - 1, -1, -1):
        if after[i] < len(a):
            out[i] = out[after[i]]
    reach = g["_reach"].iloc[0]
    n = 1 if pd.isna(reach) else min(len(a), int(np.searchsorted(a, int(reach))) + 1)
    row = g.iloc[:1][[*keys, "_block"]].copy()
    row["a"], row["b"] = [a[:n].tolist()], [out[:n]]
    return row


def _chained(g: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    g = g.sort_values("_block")
    out, stop, before = g[[*keys, "_block"]].copy(), None, []
    for a, b in zip(g["a"], g["b"], strict=True):
        before.append(stop)
        at = 0 if stop is None else int(np.searchsorted(a, stop))
        stop = int(b[at]) if at < len(a) else stop
    out["_from"] = pd.array(before, "Int64")
    return out


def _kept(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted blocks that the greedy choice keeps."""
    key, last = None, 0
    for batch in batches:
        starts, stops, before = (batch.column(c).to_pylist() for c in ("start_frame", "stop_frame", "_from"))
        on = []
        for i, own in enumerate(zip(*(batch.column(c).to_pylist() for c in group), strict=True)):
            if own != key:
                key, last = own, before[i]
            keep = last is None or starts[i] >= last
            on.append(keep)
            if keep:
                last = stops[i]
        yield batch.filter(pa.array(on, pa.bool_()))


def unpredicted(videos: DataFrame, found: DataFrame) -> DataFrame:
    """``videos`` whose video_id has no row in ``found``."""
    return videos.join(found.select("video_id").distinct(), "video_id", "left_anti")


def default_batches(listed: DataFrame, extent: DataFrame, found: DataFrame, compat: bool = False) -> DataFrame:
    """Intervals for recordings without any: their frames dealt to the actions that each (agent, target) lists.

    ``listed``: video_id, agent_id, target_id, action; ``extent``: video_id, lo, hi (frames, both included);
    ``found``: video_id of recordings with intervals. With ``compat`` empty batches stay.
    """
    own = unpredicted(listed.distinct(), found).join(extent, "video_id")
    w = Window.partitionBy("video_id", "agent_id", "target_id")
    own = own.withColumn("i", F.row_number().over(w.orderBy("action")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    own = own.withColumn("size", F.ceil((F.col("hi") + 1 - F.col("lo")) / F.col("n")).cast("long"))
    start = F.col("lo") + F.col("i") * F.col("size")
    out = own.select("video_id", "agent_id", "target_id", "action", start.cast("long").alias("start_frame"), F.least(start + F.col("size"), F.col("hi") + 1).cast("long").alias("stop_frame"))
    return out if compat else valid(out)


def cleaned(intervals: DataFrame, listed: DataFrame, extent: DataFrame, compat: bool = False) -> DataFrame:
    """Valid intervals without overlaps, and default ones for recordings that have none."""
    kept = without_overlaps(valid(intervals), ["video_id", "agent_id", "target_id"])
    return kept.unionByName(default_batches(listed, extent, kept, compat).select(*kept.columns))
