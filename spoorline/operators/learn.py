"""One boosted classifier per action, with scores from folds that have not seen the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stages
from . import boosting
from .boosting import Ensemble
from .evaluate import best_threshold, group_folds, sweep


def out_of_fold(df: DataFrame, features: list[str], group: str, label: str = "label", folds: int = 5, save: str | None = None, stages: Stages | None = None, **settings) -> DataFrame:
    """``df`` (rows of known label) with fold and score. Groups stay in one fold; without positives every score is 0.

    All folds share the passes of the fit. Features without any value are left out. With ``save`` the folds' models are
    written to ``save``/fold=<k>. The rows are written to ``stages`` (of the session's life, if not given) on the way.
    """
    stages = stages or Stages(df.sparkSession)
    rows = stages.write(df.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")))
    assigned = rows.join(F.broadcast(group_folds(rows, group, "label", folds)), group)
    known = assigned.agg(F.max("label").alias("_hi"), F.min("label").alias("_lo"), *[F.count(f"`{c}`").alias(c) for c in features]).first()
    if known is None or known["_hi"] != 1 or known["_lo"] != 0:
        return assigned.withColumn("score", F.lit(0.0))
    models = boosting.fit(assigned, [c for c in features if known[c]], ["label"], "fold", folds, **settings)
    if save:
        for (_, k), model in models.items():
            model.save(df.sparkSession, f"{save}/fold={k}")
    return boosting.scores(assigned, {"score": [models["label", k] for k in range(folds)]}, "fold")


def saved_models(df: DataFrame, folder: str) -> list[Ensemble]:
    """The models of all folds that ``folder`` holds."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/fold=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [Ensemble.load(spark, path) for path in sorted(s.getPath().toString() for s in found)]


def mean_scores(df: DataFrame, folders: dict[str, str]) -> DataFrame:
    """``df`` with a column for each name: the mean probability of the models saved in its folder, all in one pass."""
    return boosting.scores(df, {name: saved_models(df, folder) for name, folder in folders.items()})


def tuned_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    return best_threshold(sweep(scored, keys, "label", "score"), keys)
