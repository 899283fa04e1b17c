"""F1, threshold sweeps and grouped folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing is positive."""
    return F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))


def f1_by(df: DataFrame, keys: list[str], label: str, predicted: str) -> DataFrame:
    """(keys, f1) of rows with a known label."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p))])
    return counts.select(*keys, f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def mean_f1(scores: DataFrame) -> DataFrame:
    """(f1): the mean over rows of ``f1_by``."""
    return scores.agg(F.avg("f1").alias("f1"))


def sweep(df: DataFrame, keys: list[str], label: str, score: str, steps: int = 100) -> DataFrame:
    """(keys, threshold, f1): F1 of score >= threshold for thresholds 0, 1/steps, ..., 1.

    Rows become counts per (key, step) before the shuffle; the thresholds are met by cumulative sums over at
    most ``steps + 1`` rows a key.
    """
    step = F.least(F.greatest(F.floor(F.col(score) * steps + F.lit(1e-9)), F.lit(-1)), F.lit(steps)).cast("int")
    binned = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("y"))
    per = binned.groupBy(*keys).agg(F.collect_list(F.struct("s", "n", "y")).alias("b"), F.sum("y").alias("all_y"))
    wide = per.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    over = lambda c: F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.when(x["s"] >= F.col("s"), x[c]).otherwise(F.lit(0).cast("long")))
    wide = wide.withColumn("tp", over("y")).withColumn("pos", over("n"))
    return wide.select(*keys, (F.col("s") / F.lit(float(steps))).alias("threshold"), f1(F.col("tp"), F.col("pos") - F.col("tp"), F.col("all_y") - F.col("tp")).alias("f1"))


def best_threshold(swept: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, f1): the best, the smallest of equals."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")
    return swept.groupBy(*keys).agg(best).select(*keys, F.abs("b.t").alias("threshold"), F.col("b.f1").alias("f1"))


def enough_groups(df: DataFrame, keys: list[str], group: str, least: int = 5) -> DataFrame:
    """Keys whose rows come from ``least`` different groups at least."""
    return df.groupBy(*keys).agg(F.count_distinct(group).alias("n_groups")).where(F.col("n_groups") >= least)


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, fold): groups stay whole; each goes to the fold that then spreads the classes most evenly.

    Spark counts the classes of each group; the assignment runs over these counts, one row per group and class
    (recordings, not rows: thousands), the most uneven groups first, equals by name. The spread of a fold's shares is
    compared in whole numbers, so ties go to the fold of fewer rows, then the first.
    """
    counts: dict = {}
    for r in df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r[0], {})[r[1]] = r["n"]
    classes = sorted({c for own in counts.values() for c in own})
    total = {c: max(1, sum(own.get(c, 0) for own in counts.values())) for c in classes}
    spread = lambda v: len(v) * sum(x * x for x in v) - sum(v) ** 2
    weight = {c: math.prod(total[o] ** 2 for o in classes if o != c) for c in classes}
    load = [dict.fromkeys(classes, 0) for _ in range(folds)]
    out = []
    for g in sorted(counts, key=lambda g: (-spread([counts[g].get(c, 0) for c in classes]), str(g))):
        cost = []
        for k in range(folds):
            held = {c: [load[j][c] + (counts[g].get(c, 0) if j == k else 0) for j in range(folds)] for c in classes}
            cost.append((sum(weight[c] * spread(held[c]) for c in classes), sum(load[k].values()), k))
        k = min(cost)[2]
        for c, n in counts[g].items():
            load[k][c] += n
        out.append((g, k))
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"{group} {kind}, fold int")
