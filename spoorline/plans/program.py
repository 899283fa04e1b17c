"""From recordings to stored models, and from stored models to clean intervals.

Recordings fall into sections by their list of body parts; a section has fixed parts, so fixed feature columns. Each
action of a section has one classifier, over the tracks (target self) or ordered pairs of the recordings that list it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, intervals, learn, meta, reshape
from ..sources import tables
from ..sources.stages import Stages
from . import pair, single

KEYS = ["video_id", "agent_id", "target_id"]
KINDS = ("single", "pair")


@dataclass
class Recordings:
    """Tables as ``sources.tables`` reads them; annotations only where labels are known."""

    meta: DataFrame
    points: DataFrame
    annotations: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, metadata: str, tracking: str, annotation: str | None = None) -> Recordings:
        """Only the files of recordings that the metadata choose are read."""
        known = tables.read_metadata(spark, metadata).where("behaviors_labeled is not null")
        points = tables.read_tracking(spark, tracking, known).drop("lab_id")
        return cls(known, points, tables.read_annotations(spark, annotation, known).drop("lab_id") if annotation else None)


def listed(own: DataFrame, kind: str) -> DataFrame:
    """(video_id, agent_id, target_id, action) that recordings list: of one mouse alone, or of two."""
    b = reshape.behaviours(own).where("target = 'self'" if kind == "single" else "target <> 'self'")
    return b.select("video_id", F.col("agent").alias("agent_id"), F.col("target").alias("target_id"), "action")


def with_metadata(features: DataFrame, own: DataFrame, vocab: dict[str, list[str]], codes: bool = False) -> DataFrame:
    """``features`` with the metadata features of each row's recording; categories one-hot, or by ``codes``."""
    made = {f"meta_{n}": c.cast("double") for n, c in {**meta.numeric_features(), **(meta.label_codes(vocab) if codes else meta.one_hot(vocab))}.items()}
    return features.join(own.select("video_id", *[c.alias(n) for n, c in made.items()]), "video_id")


def of_listed(rows: DataFrame, own: DataFrame, kind: str) -> DataFrame:
    """Rows of tracks or pairs that their recordings list; a listed mouse without a track has no rows."""
    return rows.join(listed(own, kind).select(*KEYS).distinct(), KEYS, "left_semi")


def features(rec: Recordings, own: DataFrame, parts: list[str], section: int, kind: str, arena: DataFrame, vocab: dict[str, list[str]], groups: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, video_frame, features) of the tracks or pairs whose recordings list an action of them."""
    wide = reshape.samples(rec.points, own, parts)
    if kind == "single":
        made = single.single_features(wide.join(arena, "video_id", "left"), parts, section, ["video_id", "mouse_id"], "video_frame", groups or single.GROUPS)
        agent, target = reshape.names_of(F.col("mouse_id"), F.col("mouse_id"))
        named = made.withColumns({"agent_id": agent, "target_id": target}).drop("mouse_id")
    else:
        columns = [f"{p}_{a}" for p in parts for a in "xy"] + [f"has_{p}" for p in parts]
        fps = wide.select("video_id", "fps").distinct()
        made = pair.pair_features(reshape.ordered_pairs(wide, columns).join(fps, "video_id"), parts, ["video_id", "agent", "target"], "video_frame", groups or pair.GROUPS)
        agent, target = reshape.names_of(F.col("agent"), F.col("target"))
        named = made.withColumns({"agent_id": agent, "target_id": target}).drop("agent", "target")
    named = of_listed(named, own, kind)
    named = named.toDF(*[c.replace("+", "_to_") for c in named.columns])
    return with_metadata(named, own, vocab)


def labels(rec: Recordings, own: DataFrame, frames: DataFrame, kind: str) -> DataFrame:
    """(keys, video_frame, action, label) of annotated recordings."""
    agent, target = reshape.names_of(F.col("agent_id"), F.col("target_id"))
    marks = rec.annotations.select("video_id", agent.alias("agent_id"), target.alias("target_id"), "action", "start_frame", "stop_frame")
    annotated = rec.annotations.select("video_id").distinct()
    return reshape.paint_labels(frames.join(annotated, "video_id", "left_semi"), marks, listed(own, kind), KEYS, "video_frame")


def _sections(meta_table: DataFrame, known: DataFrame) -> Iterator[tuple[int, DataFrame, list[str]]]:
    """Section, its recordings and its parts: one row of a few per section reaches the driver."""
    declared = reshape.declared_parts(F.col("body_parts_tracked")).alias("parts")
    for row in reshape.sections(known).select("*", declared).orderBy("section").collect():
        yield row.section, meta_table.where(F.col("body_parts_tracked") == row.body_parts_tracked), list(row.parts)


def train(rec: Recordings, root: str, test: DataFrame | None = None, folds: int = 5, groups: dict | None = None, **settings) -> DataFrame:
    """Fits, tunes and stores; (section, kind, action, threshold, f1) of each action that has a threshold.

    Under ``root``: models/<section>/<kind>/<action>/fold=<k>, oof/..., thresholds, scores and mean_f1, the mean over
    actions. Actions in fewer than ``folds`` recordings are left out; an action without positives gets scores of 0 and
    neither model nor threshold.
    """
    arena = reshape.arenas(rec.meta, *([test] if test is not None else []))
    vocab, done, spark = meta.vocabulary(rec.meta), [], rec.meta.sparkSession
    for section, own, parts in _sections(rec.meta, rec.meta):
        for kind in KINDS:
            stages = Stages(spark)
            x = stages.write(features(rec, own, parts, section, kind, arena, vocab, (groups or {}).get(kind)))
            names = [c for c in x.columns if c not in (*KEYS, "video_frame")]
            y = stages.write(labels(rec, own, x.select(*KEYS, "video_frame"), kind))
            for row in evaluate.enough_groups(y, ["action"], "video_id", folds).orderBy("action").collect():
                place = f"{section}/{kind}/{quote(row.action, safe='')}"
                data = x.join(y.where(F.col("action") == row.action).drop("action"), [*KEYS, "video_frame"])
                scored = learn.out_of_fold(data, names, "video_id", folds=folds, save=f"{root}/models/{place}", stages=stages, **settings)
                scored.select(*KEYS, "video_frame", "fold", "label", "score").write.mode("overwrite").parquet(f"{root}/oof/{place}")
                scored = spark.read.parquet(f"{root}/oof/{place}").select("label", "score", *[F.lit(v).alias(n) for n, v in (("section", str(section)), ("kind", kind), ("action", row.action))])
                if not scored.where("label = 1").isEmpty():
                    done.append(learn.tuned_threshold(scored, ["section", "kind", "action"]))
            stages.close()
    out = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "section string, kind string, action string, threshold double, f1 double")
    out.write.mode("overwrite").parquet(f"{root}/scores")
    out = spark.read.parquet(f"{root}/scores")
    evaluate.mean_f1(out).write.mode("overwrite").parquet(f"{root}/mean_f1")
    tables.write_thresholds(out, f"{root}/thresholds")
    return out


def predict(rec: Recordings, known: DataFrame, root: str, train_arena: DataFrame | None = None, groups: dict | None = None, save: str | None = None, compat: bool = False) -> DataFrame:
    """(keys, action, start_frame, stop_frame) of ``rec``, by the models under ``root``; with ``save`` also written as CSV.

    ``known``: metadata of the training recordings, which fixes sections and vocabularies. An action is scored where its
    section and kind have a model of it (with ``compat``: where its section has exactly one model of it, of either kind)
    and the track or pair lists it; the scores of all saved folds' models are averaged, all actions in one pass.
    """
    spark = known.sparkSession
    arena = reshape.arenas(*([train_arena] if train_arena is not None else []), rec.meta)
    vocab, registry, found, every = meta.vocabulary(known), tables.model_registry(spark, f"{root}/models"), [], []
    limits = {(r.kind, r.section, r.action): r.threshold for r in tables.read_thresholds(spark, f"{root}/thresholds").collect()}
    by = ("section", "action") if compat else ("section", "kind", "action")
    for section, own, parts in _sections(rec.meta, known):
        for kind in KINDS:
            mine = listed(own, kind)
            every.append(mine)
            asked = mine.select(F.lit(str(section)).alias("section"), F.lit(kind).alias("kind"), "action").distinct()
            wanted = tables.single_models(asked, registry, by).join(registry, ["section", "kind", "action"])
            models = {r.action: r.path for r in wanted.collect()}
            if not models:
                continue
            x = features(rec, own, parts, section, kind, arena, vocab, (groups or {}).get(kind))
            own_actions = mine.groupBy(*KEYS).agg(F.collect_set("action").alias("_own"))  # a few actions a track
            x = learn.mean_scores(x, {f"_a{i}": path for i, (_, path) in enumerate(sorted(models.items()))}).join(own_actions, KEYS)
            scored = {a: F.when(F.array_contains("_own", a), F.col(f"_a{i}")) for i, a in enumerate(sorted(models))}
            tuned = {a: limits[kind, str(section), a] for a in models if (kind, str(section), a) in limits}
            states = x.select(*KEYS, "video_frame", intervals.best_action(scored, tuned).alias("state"))
            found.append(intervals.runs(states, KEYS, "state", "video_frame", compat))
    none = spark.createDataFrame([], "video_id long, agent_id string, target_id string, action string, start_frame long, stop_frame long")
    out = reduce(DataFrame.unionByName, [f.select(*none.columns) for f in found], none)
    out = intervals.cleaned(out, reduce(DataFrame.unionByName, every), reshape.frame_extent(rec.points), compat)
    if save:
        tables.write_intervals(out, save)
    return out
