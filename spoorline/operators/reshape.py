"""From long points and annotations to wide tracks, ordered pairs and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from ..functions.frames import Tracks
from ..functions.rolling import meet
from ..sources.tables import UNLABELLED

#: Parts that are dropped from recordings of more than five parts.
NOISY_PARTS = (
    "headpiece_bottombackleft", "headpiece_bottombackright", "headpiece_bottomfrontleft", "headpiece_bottomfrontright",
    "headpiece_topbackleft", "headpiece_topbackright", "headpiece_topfrontleft", "headpiece_topfrontright",
    "spine_1", "spine_2", "tail_middle_1", "tail_middle_2", "tail_midpoint",
)


def drop_noisy_parts(points: DataFrame, noisy: tuple[str, ...] = NOISY_PARTS, more_than: int = 5) -> DataFrame:
    """Without the noisy parts, in recordings of more than ``more_than`` parts; one aggregation counts them."""
    rich = points.groupBy("video_id").agg(F.count_distinct("bodypart").alias("n")).where(F.col("n") > more_than).select("video_id", F.lit(True).alias("_rich"))
    return points.join(rich, "video_id", "left").where(F.col("_rich").isNull() | ~F.col("bodypart").isin(*noisy)).drop("_rich")


def declared_parts(text: Column) -> Column:
    """The list of a JSON text; the noisy ones go if it has more than five."""
    parts = F.from_json(text, "array<string>")
    return F.when(F.size(parts) > 5, F.filter(parts, lambda p: ~p.isin(*NOISY_PARTS))).otherwise(parts)


def pivot_parts(points: DataFrame, parts: list[str]) -> DataFrame:
    """One row per (video_id, mouse_id, video_frame) with ``<part>_x``, ``<part>_y`` and ``has_<part>``.

    Every mouse of a recording gets every frame of it. ``has_<part>``: the mouse has rows of the part anywhere
    in the recording. Two points of one key are an error.
    """
    keys = ["video_id", "mouse_id", "video_frame"]
    points = points.where(F.col("bodypart").isin(*parts))
    cells = []
    for p in parts:
        own = F.col("bodypart") == p
        cells += [F.max(F.when(own, F.col("x"))).alias(f"{p}_x"), F.max(F.when(own, F.col("y"))).alias(f"{p}_y"), F.sum(own.cast("int")).alias(f"_n_{p}")]
    wide = points.groupBy(*keys).agg(*cells)
    once = F.greatest(*[F.col(f"_n_{p}") for p in parts], F.lit(0)) <= 1
    wide = wide.where(F.when(once, F.lit(True)).otherwise(F.raise_error(F.lit("two points of one video, mouse, frame and part")).cast("boolean")))
    mice = wide.groupBy("video_id", "mouse_id").agg(*[(F.max(f"_n_{p}") > 0).alias(f"has_{p}") for p in parts])
    grid = points.select("video_id", "video_frame").distinct().join(mice, "video_id")
    return grid.join(wide.drop(*[f"_n_{p}" for p in parts]), keys, "left")


def rescale(points: DataFrame, per_unit: str = "pix_per_cm_approx") -> DataFrame:
    """x and y in centimetres; an unknown scale leaves nothing known."""
    return points.withColumns({c: F.try_divide(c, F.col(per_unit)) for c in ("x", "y")})


def behaviours(meta: DataFrame) -> DataFrame:
    """(video_id, agent, target, action): the distinct entries of each recording's JSON list, quotes removed."""
    listed = F.array_sort(F.array_distinct(F.transform(F.from_json("behaviors_labeled", "array<string>"), lambda b: F.replace(b, F.lit("'"), F.lit("")))))
    one = F.split("b", ",")
    return meta.where("behaviors_labeled is not null").select("video_id", F.explode(listed).alias("b")).select("video_id", one[0].alias("agent"), one[1].alias("target"), one[2].alias("action"))


def mouse_number(agent: Column) -> Column:
    """The last character as a number."""
    return F.try_cast(F.substring(agent, -1, 1), "int") if hasattr(F, "try_cast") else F.substring(agent, -1, 1).try_cast("int")


def names_of(agent: Column, target: Column) -> tuple[Column, Column]:
    """mouse<n> and mouse<n> or self."""
    return F.concat(F.lit("mouse"), agent), F.when(agent == target, F.lit("self")).otherwise(F.concat(F.lit("mouse"), target))


def ordered_pairs(tracks: DataFrame, columns: list[str], video: str = "video_id", mouse: str = "mouse_id", frame: str = "video_frame") -> DataFrame:
    """Each two different mice of a recording, frame by frame: ``A_<column>`` and ``B_<column>``. One equi-join."""
    a = tracks.select(video, frame, F.col(mouse).alias("agent"), *[F.col(c).alias(f"A_{c}") for c in columns])
    b = tracks.select(video, frame, F.col(mouse).alias("target"), *[F.col(c).alias(f"B_{c}") for c in columns])
    return a.join(b, [video, frame]).where("agent <> target")


def paint_labels(frames: DataFrame, intervals: DataFrame, listed: DataFrame, keys: list[str], frame: str = "frame", block: int = 1 << 14) -> DataFrame:
    """(keys, frame, action, label): 1 within an interval of the action (stop included), 0 elsewhere if the track lists it.

    An annotated action that is not listed gives its 1s only. A start adds one and the frame after a stop takes one away:
    a running sum over blocks of ``block`` frames of a track and action, with the sum of the blocks before carried in,
    tells how many intervals hold a frame, whatever their lengths.
    """
    group = [*keys, "action"]
    marks = intervals.where("start_frame <= stop_frame")
    kind = frames.schema[frame].dataType
    events = marks.select(*group, F.explode(F.array(F.struct(F.col("start_frame").cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col("stop_frame") + 1).cast("long").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    events = events.select(*group, F.col("e.at").alias("_at"), F.col("e.d").alias("_d")).groupBy(*group, "_at").agg(F.sum("_d").alias("_d"))
    known = listed.select(*group).distinct().withColumn("_listed", F.lit(True)).unionByName(marks.select(*group).distinct().withColumn("_listed", F.lit(False)))
    known = known.groupBy(*group).agg(F.max("_listed").alias("_listed"))
    rows = meet(frames.select(*keys, F.col(frame).cast("long").alias("_at")), known.groupBy(*keys).agg(F.collect_list(F.struct("action", "_listed")).alias("_own")), keys)
    rows = rows.select(*keys, "_at", F.inline("_own")).withColumn("_d", F.lit(None).cast("long"))
    both = rows.unionByName(events.withColumn("_listed", F.lit(None).cast("boolean"))).withColumn("_block", F.floor(F.col("_at") / F.lit(block)))
    per = events.groupBy(*group, F.floor(F.col("_at") / F.lit(block)).alias("_block")).agg(F.sum("_d").alias("_sum"))
    ahead = F.lead("_block").over(Window.partitionBy(*group).orderBy("_block"))
    total = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    # A sum other than 0 is carried to each block up to the next that has events: as many rows as blocks are held.
    carried = per.select(*group, "_block", ahead.alias("_to"), total.alias("_open")).where("_open <> 0 and _to is not null")
    carried = carried.select(*group, F.explode(F.sequence(F.col("_block") + 1, F.col("_to"))).alias("_block"), "_open")
    in_block = Window.partitionBy(*group, "_block").orderBy("_at", F.col("_d").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = meet(both, carried, [*group, "_block"], "left")
    label = (F.coalesce(F.sum("_d").over(in_block), F.lit(0)) + F.coalesce("_open", F.lit(0)) > 0).cast("int")
    out = both.withColumn("label", label).where(F.col("_d").isNull() & (F.col("_listed") | (F.col("label") == 1)))
    return out.select(*keys, F.col("_at").cast(kind).alias(frame), "action", "label")


def with_fps(tracks: DataFrame, meta: DataFrame, lookup: DataFrame | None = None, default: float = 30.0) -> DataFrame:
    """``tracks`` with fps: the recording's own rate, else the lookup's, else the default."""
    rate = meta.select("video_id", F.col("frames_per_second").alias("_own"))
    out = tracks.join(rate, "video_id", "left")
    if lookup is not None:
        out = out.join(lookup.select("video_id", F.col("fps").alias("_other")), "video_id", "left")
    return out.withColumn("fps", F.coalesce("_own", *(["_other"] if lookup is not None else []), F.lit(default))).drop("_own", "_other")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def union_all(*tables: DataFrame) -> DataFrame:
    """By name; a column that a table lacks is NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in an order: a preview."""
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, values): the sorted distinct values of each key."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(column)).alias("values"))


def frame_extent(points: DataFrame, frame: str = "video_frame") -> DataFrame:
    """(video_id, lo, hi): first and last frame of each recording."""
    return points.groupBy("video_id").agg(F.min(frame).cast("long").alias("lo"), F.max(frame).cast("long").alias("hi"))


def arenas(*metas: DataFrame) -> DataFrame:
    """(video_id, arena_width_cm, arena_height_cm, arena_shape) over all tables; the first table that knows a recording wins."""
    columns = ["video_id", "arena_width_cm", "arena_height_cm", "arena_shape"]
    every = union_all(*[m.select(*columns, F.lit(i).alias("_rank")) for i, m in enumerate(metas)])
    return first_of(every, ["video_id"], ["_rank", *columns[1:]]).drop("_rank")


def sections(meta: DataFrame) -> DataFrame:
    """(section, body_parts_tracked): places of the distinct lists of parts in their order; the first, 0, is left out."""
    known = meta.where("body_parts_tracked is not null").select("body_parts_tracked").distinct()
    placed = known.withColumn("section", F.row_number().over(Window.orderBy("body_parts_tracked")) - 1)  # a handful of part lists
    return placed.where("section >= 1").select("section", "body_parts_tracked")


def samples(points: DataFrame, meta: DataFrame, parts: list[str], gap_seconds: float = 0.25) -> DataFrame:
    """Scaled wide tracks of the recordings in ``meta``, with gaps up to ``gap_seconds`` filled (one frame at least)."""
    used = drop_noisy_parts(points.join(meta.select("video_id", "pix_per_cm_approx"), "video_id"))
    wide = with_fps(pivot_parts(rescale(used), parts), meta)
    tracks, columns = Tracks(["video_id", "mouse_id"], "video_frame"), [f"{p}_{a}" for p in parts for a in "xy"]
    return series.gap_fill(wide, tracks, columns, F.greatest(F.bround(F.col("fps") * gap_seconds), F.lit(1.0)))


def solution(annotations: DataFrame, meta: DataFrame, skip_prefix: str = UNLABELLED) -> DataFrame:
    """Annotated intervals with names, of labelled recordings."""
    agent, target = names_of(F.col("agent_id"), F.col("target_id"))
    own = meta.where(~F.col("lab_id").startswith(skip_prefix) & F.col("behaviors_labeled").isNotNull()).select("video_id", "lab_id", "behaviors_labeled")
    return annotations.drop("lab_id").join(own, "video_id").select("video_id", "lab_id", agent.alias("agent_id"), target.alias("target_id"), "action", "start_frame", "stop_frame", "behaviors_labeled")
