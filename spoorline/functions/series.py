"""Series operators that a plain window aggregate does not express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import Tracks, changed
from .quantiles import track_quantiles, within
from .rolling import meet


def gap_fill(df: DataFrame, tracks: Tracks, columns: list[str], limit: int | Column) -> DataFrame:
    """``df`` with gaps filled: at most ``limit`` (of the track) rows of a gap on the line between its ends, then ``limit`` rows of the
    value before, then ``limit`` rows of the value after; the rest of a long gap stays missing."""
    past, ahead = tracks.rows.rowsBetween(Window.unboundedPreceding, 0), tracks.rows.rowsBetween(0, Window.unboundedFollowing)
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    df = df.withColumn("_n", F.row_number().over(tracks.rows))
    ends = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(c).alias("v")))
        ends[f"_p_{c}"], ends[f"_q_{c}"] = F.last(at, ignorenulls=True).over(past), F.first(at, ignorenulls=True).over(ahead)
    df = df.withColumns(ends)
    filled = {}
    for c in columns:
        p, q, n = F.col(f"_p_{c}"), F.col(f"_q_{c}"), F.col("_n")
        k = n - p["n"]
        line = p["v"] + (q["v"] - p["v"]) * F.least(k, limit) / (q["n"] - p["n"])
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(p.isNotNull() & q.isNotNull() & (k <= limit * 2), line)
            .when(p.isNotNull() & q.isNull() & (k <= limit), p["v"])
            .when(q.isNotNull() & (q["n"] - n <= limit), q["v"])
        )
    return df.withColumns(filled).drop("_n", *ends)


def speed_state(speed: Column) -> Column:
    """0 to 3 by right-closed limits 0.5, 2 and 5."""
    return F.when(speed <= 0.5, 0.0).when(speed <= 2.0, 1.0).when(speed <= 5.0, 2.0).when(speed.isNotNull(), 3.0)


def change_flag(x: Column, tracks: Tracks) -> Column:
    return changed(x, tracks.lag(x)).cast("double")


def winsorised(df: DataFrame, tracks: Tracks, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``df`` with ``_w_<column>`` bounded by the track's own exact quantiles."""
    df = meet(df, track_quantiles(df, tracks.keys, columns, (low, high)), tracks.keys)
    return df.withColumns({f"_w_{c}": within(F.col(c), f"_l_{c}") for c in columns}).drop(*[f"_l_{c}" for c in columns])
