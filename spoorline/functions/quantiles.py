"""Exact quantiles of whole tracks in bounded memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import Stages

#: Values of a track that may meet in one buffer; bins of a counting pass.
BUFFER, BINS = 1 << 16, 1024


def track_quantiles(df: DataFrame, keys: list[str], columns: list[str], qs: tuple[float, ...], buffer: int | None = None) -> DataFrame:
    """(keys, ``_l_<column>``): the linear quantiles ``qs`` of each track's known values, an array each; NULL without any.

    Tracks of up to ``buffer`` rows sort their values in one aggregation. Longer ones count theirs in bins, take the bin
    that holds the rank as the next range, and so on until a range holds few values or one alone: only counts are shuffled.
    """
    buffer = buffer or BUFFER
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    array = F.array(*[F.lit(q) for q in qs])
    found = [F.percentile(c, array).alias(f"_l_{c}") for c in columns]
    long = sizes.where(F.col("_n") > buffer).select(*keys)
    if long.isEmpty():
        return df.groupBy(*keys).agg(*found)
    stages = Stages(df.sparkSession)
    long = stages.write(long)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    short = df.alias("d").join(long.alias("o"), same("d", "o"), "left_anti").groupBy(*keys).agg(*found)
    values = df.alias("d").join(F.broadcast(long).alias("o") if long.count() <= buffer else long.alias("o"), same("d", "o"), "left_semi")
    values = values.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("_e"))
    values = stages.write(values.select(*keys, F.col("_e.c").alias("_c"), F.col("_e.v").alias("_v")).where("_v is not null"))
    ranked = _ranks(values, keys, qs, buffer, stages)
    at = {(i, j): F.max(F.when((F.col("_c") == i) & (F.col("_q") == j), F.col("_x"))) for i in range(len(columns)) for j in range(len(qs))}
    whole = ranked.groupBy(*keys).agg(*[F.array(*[at[i, j] for j in range(len(qs))]).alias(f"_l_{c}") for i, c in enumerate(columns)])
    return short.unionByName(whole.withColumns({f"_l_{c}": F.when(F.col(f"_l_{c}")[0].isNotNull(), F.col(f"_l_{c}")) for c in columns}))


def _ranks(values: DataFrame, keys: list[str], qs: tuple[float, ...], buffer: int, stages: Stages) -> DataFrame:
    """(keys, _c, _q, _x): the quantiles of (keys, _c, _v)."""
    group = [*keys, "_c"]
    ends = values.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_q") + 1)
    wanted = ends.withColumn("_q", F.explode(F.array(*[F.lit(i) for i in range(len(qs))]))).withColumn("_place", place)
    ranges = wanted.select(*group, "_lo", "_hi", "_n", F.lit(0).cast("long").alias("_below"), F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_rank")).distinct()
    wanted, ranges = stages.write(wanted), stages.write(ranges)
    row = [*group, "_rank"]
    while not ranges.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > buffer)).isEmpty():
        # The widths of two halves, as a range may span more than the largest number.
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        own = _met(values, ranges, group).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bins = own.groupBy(*row, "_below", F.when(F.col("_lo") < F.col("_hi"), F.least(F.floor(part * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).alias("_bin"))
        bins = bins.agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_n").over(Window.partitionBy(*row).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("_below", F.col("_below") + F.coalesce(before, F.lit(0)))
        narrow = stages.write(bins.where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_n"))).select(*group, "_lo", "_hi", "_n", "_below", "_rank"))
        stages.drop(ranges)
        ranges = narrow
    own = _met(values, ranges.where("_lo < _hi"), group).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    picked = own.groupBy(*row).agg(F.get(F.array_sort(F.collect_list("_v")), (F.col("_rank") - F.max("_below")).cast("int")).alias("_x"))
    known = ranges.where("_lo = _hi").select(*row, F.col("_lo").alias("_x")).unionByName(picked)
    low, high = (_met(known, wanted.select(*group, "_q", "_place", f(F.col("_place")).alias("_at")), group).where("_rank = _at") for f in (F.floor, F.ceil))
    both = low.select(*group, "_q", "_place", "_x").unionByName(high.select(*group, "_q", "_place", "_x"))
    share = F.col("_place") - F.floor("_place")
    return both.groupBy(*group, "_q", "_place").agg(F.min("_x").alias("_a"), F.max("_x").alias("_b")).select(*group, "_q", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("_x"))


def _met(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``many`` with the columns of ``few``, a handful of rows a track; NULL keys meet too."""
    few = few.withColumnsRenamed({k: f"_k{k}" for k in on})
    return many.join(F.broadcast(few) if few.count() <= BUFFER else few, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in on])).drop(*[f"_k{k}" for k in on])


def within(x: Column, limits: str) -> Column:
    """``x`` bounded by the two ``limits``."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.col(limits)[0]), F.col(limits)[1]))
