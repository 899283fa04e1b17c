"""Queries of the program's pieces over recordings that the test tables give, and their SQL.

Four users make a recording of four mice; its metadata come from the customer of its number. A mouse shows one body part a
frame, by the kind of event. What the program reads from files is written to them first, so sources and sinks take part.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, intervals, learn, meta, reshape
from ..operators.boosting import Ensemble, Tree
from ..sources import tables
from ..sources.stages import Stages
from . import program

PARTS = {"click": "nose", "view": "tail_base", "purchase": "body_center", "signup": "spine_1", "error": "ear_left"}
LISTS = {0: ["body_center"], 1: ["nose", "tail_base", "body_center"], 2: ["nose", "tail_base"], 3: ["body_center", "ear_left", "ear_right", "nose", "spine_1", "tail_base"]}
_LISTED = {0: ["mouse1,self,rear", "mouse2,self,'rear'", "mouse1,mouse2,chase"], 1: ["mouse2,self,groom", "mouse1,mouse3,'chase'", "mouse1,mouse3,attack", "mouse2,self,groom"], 2: ["mouse4,mouse1,follow", "mouse1,self,rear"]}
#: Column -> an expression that Spark and DuckDB read alike, over c_custkey as v and c_nationkey as k.
META = {
    "lab_id": f"case when v % 7 = 0 then '{tables.UNLABELLED}_a' else concat('lab, ', cast(k % 3 as string)) end",
    "video_id": "cast(v as bigint)",
    "behaviors_labeled": None,
    "body_parts_tracked": None,
    "frames_per_second": "case when v % 4 <> 3 then case v % 3 when 0 then 25e0 when 1 then 30e0 else 60e0 end end",
    "pix_per_cm_approx": "case when v % 11 <> 5 then 2e0 + v % 6 end",
    "video_width": "case when v % 13 <> 4 then 640e0 + v % 50 end",
    "video_height": "480e0 + v % 9",
    "arena_width_cm": "case when v % 6 <> 2 then 40e0 + v % 10 end",
    "arena_height_cm": "30e0 + v % 8",
    "arena_shape": "case v % 5 when 0 then 'circle' when 1 then 'square' when 2 then 'rectangle' end",
    "arena_type": "case when v % 2 = 0 then 'familiar' else 'resident' end",
    "tracking_method": "case when v % 3 = 0 then 'A \"b\"' else 'B' end",
    **{f"mouse{i}_strain": f"case when v % {i + 1} = 0 then 'CD' end" for i in range(1, 5)},
}
SHOWN = ("circle", "rectangle", "square")


def _json(values: list[str]) -> str:
    return "[" + ", ".join(f'"{v}"' for v in values) + "]"


def _case(by: str, values: dict[int, list[str]], quote: Callable[[str], str]) -> str:
    return f"case {by} " + " ".join(f"when {k} then {quote(_json(v))}" for k, v in values.items()) + " end"


def _columns(quote: Callable[[str], str]) -> dict[str, str]:
    own = {"behaviors_labeled": f"case when v % 5 <> 4 then {_case('v % 3', _LISTED, quote)} end", "body_parts_tracked": _case("v % 4", LISTS, quote)}
    return {n: e or own[n] for n, e in META.items()}


_SPARK, _DUCK = _columns(lambda t: "'" + t.replace("'", "\\'") + "'"), _columns(lambda t: "'" + t.replace("'", "''") + "'")
RECORDINGS = "every as (select " + ", ".join(f"{e.replace('as string', 'as varchar')} as {n}" for n, e in _DUCK.items()) + f""" from (select c_custkey as v, c_nationkey as k from customer)),
    meta as (select *, {' + '.join(f'cast(mouse{i}_strain is not null as int)' for i in range(1, 5))} as n_mice from every where not starts_with(lab_id, '{tables.UNLABELLED}'))"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of all recordings, as the metadata file holds them."""
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("v"), F.col("c_nationkey").alias("k"))
    return own.select(*[F.expr(e).alias(n) for n, e in _SPARK.items()])


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of labelled labs, written as CSV and read again."""
    path = f"{Stages(spark).root}/metadata"
    recordings(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_metadata(spark, path)


#: Two stored models over x and y: a cut's tree sends values up to it left, missing ones as the tree says.
MODELS = [
    Ensemble(["x", "y"], [[2.0, 10.0, 40.0], [1.0, 5.0]], start, [Tree([0, 1, -1, -1, -1], [cut, 1, 0, 0, 0], [cut % 2 == 0, True, False, False, False], [1, 3, 0, 0, 0], [2, 4, 0, 0, 0], [0.0, 0.0, 0.25 * cut, -0.5, step]) for cut in (1, 2, 3)])
    for start, step in ((-0.5, 0.125), (0.25, -0.375))
]


def _model_sql(model: Ensemble) -> str:
    """The raw score of a model as nested cases over its features."""

    def node(tree: Tree, n: int) -> str:
        if tree.feature[n] < 0:
            return repr(tree.value[n])
        name, cuts = model.features[tree.feature[n]], model.cuts[tree.feature[n]]
        goes = f"{name} <= {cuts[tree.bin[n] - 1]!r}" if tree.bin[n] <= len(cuts) else "true"
        return f"case when case when {name} is null then {str(tree.missing[n]).lower()} else {goes} end then {node(tree, tree.left[n])} else {node(tree, tree.right[n])} end"

    return " + ".join([repr(model.start), *(node(t, 0) for t in model.trees)])


def _recordings_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of one (lab_id, video_id) in a sorted batch."""
    lab, video = batch.column("lab_id"), batch.column("video_id")
    new = pc.or_kleene(*[pc.fill_null(pc.not_equal(c[1:], c[:-1]), True) for c in (lab, video)])
    ends = [*(pc.indices_nonzero(new).to_numpy() + 1).tolist(), batch.num_rows]
    for at, end in zip([0, *ends], ends, strict=False):
        yield (lab[at].as_py(), video[at].as_py()), batch.slice(at, end - at)


def _file_writer(root: str, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over rows sorted by (lab_id, video_id) that writes ``root/<lab>/<video>.parquet`` of each; how many.

    A file gets its name when it is whole, so a task that is run again leaves no part of one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, key, out, staged = 0, None, None, None

        def finish() -> None:
            out.close()
            os.replace(staged, f"{root}/{key[0]}/{key[1]}.parquet")

        for batch in batches:
            for now, rows in _recordings_of(batch) if batch.num_rows else ():
                if now != key:
                    if out:
                        finish()
                    if None in now:
                        raise ValueError(f"a recording without a lab or a number has no file: {now}")
                    n, key, staged = n + 1, now, f"{root}/{now[0]}/_{uuid.uuid4().hex}"
                    os.makedirs(os.path.dirname(staged), exist_ok=True)
                    out = pq.ParquetWriter(staged, rows.select(columns).schema)
                out.write_batch(rows.select(columns))
        if out:
            finish()
        yield pa.RecordBatch.from_pydict({"files": [n]})

    return write


def per_recording(rows: DataFrame, schema: str) -> str:
    """Writes rows (lab_id, video_id, columns of ``schema``) as one file a recording, ``<lab>/<video>.parquet``; the folder.

    On a file system of the machine, tasks write the files themselves: Hadoop starts processes to set the permissions of
    each file there, which takes longer than writing it. Elsewhere Spark writes them, and they are renamed.
    """
    spark = rows.sparkSession
    hadoop, root = spark._jvm.org.apache.hadoop.fs, Stages(spark).root
    files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    made = files.makeQualified(hadoop.Path(f"{root}/files"))
    files.mkdirs(made)
    columns = [F.col(n).cast(kind).alias(n) for n, kind in (c.split() for c in schema.split(", "))]
    rows = rows.select("lab_id", "video_id", *columns)
    if made.toUri().getScheme() == "file":
        # A given number of tasks: by their bytes, many small files would share a few.
        dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id").sortWithinPartitions("lab_id", "video_id")
        dealt.mapInArrow(_file_writer(made.toUri().getPath(), rows.columns[2:]), "files long").agg(F.sum("files")).collect()
        return f"{root}/files"
    rows.repartition("video_id").write.partitionBy("lab_id", "video_id").parquet(f"{root}/dealt")
    for status in files.globStatus(hadoop.Path(f"{root}/dealt/lab_id=*/video_id=*/part-*")):
        lab, video = (p.split("=", 1)[1] for p in status.getPath().toString().split("/")[-3:-1])
        folder = hadoop.Path(made, unquote(lab))
        files.mkdirs(folder)
        files.rename(status.getPath(), hadoop.Path(folder, f"{video}.parquet"))
    return f"{root}/files"


def all_queries(tracks: Callable[[SparkSession, str], DataFrame], tracks_sql: str) -> dict[str, tuple[Callable, str]]:
    """name -> (query, SQL)."""
    base = f"with recursive {tracks_sql}, {RECORDINGS}"
    out: dict[str, tuple[Callable, str]] = {}

    def query(sql: str) -> Callable:
        def register(f: Callable) -> Callable:
            out[f.__name__] = (f, f"{base}{sql}")
            return f

        return register

    part_of = "case event_type " + " ".join(f"when '{e}' then '{p}'" for e, p in PARTS.items()) + " end"

    def points(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tracks(spark, sf_dir)
        return t.select((F.floor(F.col("track") / 4) + 1).alias("video_id"), (F.col("track") % 4 + 1).cast("int").alias("mouse_id"), F.col("frame").alias("video_frame"), F.expr(part_of).alias("bodypart"), "x", "y")

    point_sql = f", points as (select track // 4 + 1 as video_id, cast(track % 4 + 1 as int) as mouse_id, frame as video_frame, {part_of} as bodypart, x, y from t)"

    def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points(spark, sf_dir).where("bodypart = 'body_center' and x is not null")
        return p.select("video_id", F.col("mouse_id").alias("agent_id"), (F.floor(F.col("y")) % 4 + 1).cast("int").alias("target_id"), F.when(F.floor("y") % 3 == 0, "chase").otherwise("rear").alias("action"), F.col("video_frame").alias("start_frame"), (F.col("video_frame") + F.floor(F.col("x")) % 9).alias("stop_frame"))

    mark_sql = f"""{point_sql}, marks as (select video_id, mouse_id as agent_id, cast(floor(y) % 4 + 1 as int) as target_id, case when floor(y) % 3 = 0 then 'chase' else 'rear' end as action,
        video_frame as start_frame, video_frame + cast(floor(x) as bigint) % 9 as stop_frame from points where bodypart = 'body_center' and x is not null)"""
    listed_sql = """, b as (select distinct video_id, unnest(from_json(behaviors_labeled, '["varchar"]')) as b from meta where behaviors_labeled is not null),
        behaviours as (select distinct video_id, string_split(replace(b, '''', ''), ',')[1] as agent_id, string_split(replace(b, '''', ''), ',')[2] as target_id, string_split(replace(b, '''', ''), ',')[3] as action from b)"""

    @query(" select * from meta")
    def recording_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
        return known(spark, sf_dir)

    @query(" select video_id, array_to_string(case when len(p) > 5 then list_filter(p, lambda x: x <> 'spine_1') else p end, ',') as parts from (select video_id, from_json(body_parts_tracked, '[\"varchar\"]') as p from meta)")
    def recording_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return known(spark, sf_dir).select("video_id", F.array_join(reshape.declared_parts(F.col("body_parts_tracked")), ",").alias("parts"))

    @query(" select * from (select body_parts_tracked, row_number() over (order by body_parts_tracked) - 1 as section from (select distinct body_parts_tracked from meta)) where section >= 1")
    def recording_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reshape.sections(known(spark, sf_dir)).select("body_parts_tracked", F.col("section").cast("long").alias("section"))

    @query(f"{listed_sql} select video_id, agent_id, target_id, action, case when target_id = 'self' then 'single' else 'pair' end as kind from behaviours")
    def recording_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = known(spark, sf_dir)
        return reshape.union_all(*[program.listed(m, kind).withColumn("kind", F.lit(kind)) for kind in program.KINDS])

    @query(f"""{mark_sql} select video_id, lab_id, 'mouse' || agent_id as agent_id, case when agent_id = target_id then 'self' else 'mouse' || target_id end as target_id, action, start_frame, stop_frame, behaviors_labeled
        from marks join meta using (video_id) where behaviors_labeled is not null""")
    def solution_table(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reshape.solution(annotations(spark, sf_dir), known(spark, sf_dir))

    @query(f"{mark_sql} select distinct 'mouse' || agent_id as agent, cast(agent_id as int) as number from marks")
    def mouse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
        agent, _ = reshape.names_of(F.col("agent_id"), F.col("target_id"))
        return annotations(spark, sf_dir).select(agent.alias("agent")).distinct().select("agent", reshape.mouse_number(F.col("agent")).alias("number"))

    @query("""select * exclude (n) from (select *, row_number() over (partition by video_id order by r, arena_width_cm nulls first, arena_height_cm nulls first, arena_shape nulls first) as n from (
        select 0 as r, video_id, arena_width_cm, arena_height_cm, arena_shape from meta where video_id % 2 = 0
        union all select 1, video_id, arena_width_cm + 1, arena_height_cm, 'other' from meta where video_id % 3 = 0)) where n = 1""".replace("select * exclude (n)", " select video_id, arena_width_cm, arena_height_cm, arena_shape"))
    def recording_arenas(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = known(spark, sf_dir)
        test = m.where("video_id % 3 = 0").withColumns({"arena_width_cm": F.col("arena_width_cm") + 1, "arena_shape": F.lit("other")})
        return reshape.arenas(m.where("video_id % 2 = 0"), test)

    @query(f"{point_sql} select video_id, min(video_frame) as lo, max(video_frame) as hi from points group by video_id")
    def recording_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reshape.frame_extent(points(spark, sf_dir))

    @query(f"""{point_sql}{listed_sql}, own as (select distinct video_id, 'mouse' || mouse_id as agent_id, 'self' as target_id, video_frame from points)
        select video_id, agent_id, target_id, video_frame from own semi join behaviours using (video_id, agent_id, target_id)""")
    def listed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
        agent, target = reshape.names_of(F.col("mouse_id"), F.col("mouse_id"))
        rows = points(spark, sf_dir).select("video_id", agent.alias("agent_id"), target.alias("target_id"), "video_frame").distinct()
        return program.of_listed(rows, known(spark, sf_dir), "single").select("video_id", "agent_id", "target_id", "video_frame")

    texts = {"frames_per_second": "case when v % 3 = 0 then 'n/a' else cast(v % 60 as string) end", "video_width": "case when v % 4 = 0 then '' else cast(v as string) end", "video_height": "concat('1', cast(v % 10 as string), '.5')"}
    numbers = {n: f"try_cast({e.replace('as string', 'as varchar')} as double)" for n, e in texts.items()}

    @query(f""", n as (select v, {', '.join(f'{e} as {n}' for n, e in numbers.items())} from (select c_custkey as v from customer))
        select v, frames_per_second, round(ln(1 + frames_per_second), 6) as fps_log1p, video_width, round(video_width / (video_height + 1e-6), 6) as video_aspect from n""")
    def coerced_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("v"))
        m = m.select("v", *[F.expr(e).alias(n) for n, e in texts.items()], *[F.lit("1").alias(c) for c in meta.NUMERIC if c not in texts])
        made = meta.numeric_features()
        return m.select("v", *[F.round(made[n], 6).alias(n) for n in ("frames_per_second", "fps_log1p", "video_width", "video_aspect")])

    own_parts = ["body_center", "nose", "tail_base"]
    cells = ", ".join(f"max(case when bodypart = '{p}' then {a} end) as {p}_{a}" for p in own_parts for a in "xy")
    has = ", ".join(f"bool_or(bodypart = '{p}') as has_{p}" for p in own_parts)
    axes = [f"{p}_{a}" for p in own_parts for a in "xy"]
    by = "(partition by video_id, mouse_id order by video_frame"
    ends = ", ".join(
        f"last_value({c} ignore nulls) over {by}) as {c}_p, last_value(case when {c} is not null then n end ignore nulls) over {by}) as {c}_pn, "
        f"first_value({c} ignore nulls) over {by} rows between current row and unbounded following) as {c}_q, first_value(case when {c} is not null then n end ignore nulls) over {by} rows between current row and unbounded following) as {c}_qn"
        for c in axes
    )
    filled = ", ".join(
        f"round(case when {c} is not null then {c} when {c}_p is not null and {c}_q is not null and n - {c}_pn <= 2 * lim then {c}_p + ({c}_q - {c}_p) * least(n - {c}_pn, lim) / ({c}_qn - {c}_pn) "
        f"when {c}_p is not null and {c}_q is null and n - {c}_pn <= lim then {c}_p when {c}_q is not null and {c}_qn - n <= lim then {c}_q end, 9) as {c}"
        for c in axes
    )

    @query(f"""{point_sql}, rich as (select video_id from points join meta using (video_id) group by video_id having count(distinct bodypart) > 5),
        used as (select p.video_id, mouse_id, video_frame, bodypart, x / pix_per_cm_approx as x, y / pix_per_cm_approx as y from points p join meta m using (video_id) where bodypart in ('body_center', 'nose', 'tail_base')),
        wide as (select video_id, mouse_id, video_frame, {cells} from used group by all), mice as (select video_id, mouse_id, {has} from used group by all),
        grid as (select * from (select distinct video_id, video_frame from used) join mice using (video_id)),
        g as (select grid.video_id, grid.mouse_id, grid.video_frame, {', '.join(f'has_{p}' for p in own_parts)}, {', '.join(axes)}, coalesce(frames_per_second, 30) as fps, greatest(round_even(0.25 * coalesce(frames_per_second, 30), 0), 1) as lim,
            row_number() over (partition by grid.video_id, grid.mouse_id order by grid.video_frame) as n
            from grid left join wide on wide.video_id = grid.video_id and wide.mouse_id = grid.mouse_id and wide.video_frame = grid.video_frame join meta on meta.video_id = grid.video_id),
        e as (select *, {ends} from g) select video_id, mouse_id, video_frame, {', '.join(f'has_{p}' for p in own_parts)}, fps, {filled} from e""")
    def recording_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = reshape.samples(points(spark, sf_dir), known(spark, sf_dir), own_parts)
        return s.select("video_id", "mouse_id", "video_frame", *[f"has_{p}" for p in own_parts], "fps", *[F.round(c, 9).alias(c) for c in axes])

    shapes = ", ".join(f"cast(coalesce(arena_shape = '{v}', false) as double) as \"meta_arena_shape={v}\"" for v in SHOWN)

    @query(f"""{point_sql} select p.video_id, mouse_id, video_frame, round(ln(1 + frames_per_second), 5) as meta_fps_log1p, round(arena_width_cm * arena_height_cm, 5) as meta_arena_area_cm2, cast(n_mice as double) as meta_n_mice, {shapes},
        cast(arena_shape is null as double) as "meta_arena_shape=__UNK__", 0e0 as "meta_arena_shape=__NA__" from points p join meta using (video_id)""")
    def features_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = known(spark, sf_dir)
        f = program.with_metadata(points(spark, sf_dir).select("video_id", "mouse_id", "video_frame"), m, meta.vocabulary(m, ("arena_shape",)))
        shown = [f"meta_arena_shape={v}" for v in (*SHOWN, meta.UNKNOWN, meta.MISSING)]
        return f.select("video_id", "mouse_id", "video_frame", F.round("meta_fps_log1p", 5).alias("meta_fps_log1p"), F.round("meta_arena_area_cm2", 5).alias("meta_arena_area_cm2"), "meta_n_mice", *shown)

    @query(f"""{mark_sql}, c as (select action, video_id, agent_id <> target_id as y, stop_frame - start_frame >= 4 as p from marks),
        f as (select action, case when 2 * sum(cast(y and p as int)) + sum(cast(y <> p as int)) = 0 then 0 else 2.0 * sum(cast(y and p as int)) / (2 * sum(cast(y and p as int)) + sum(cast(y <> p as int))) end as f1 from c group by action)
        select round(avg(f1), 9) as f1 from f""")
    def mean_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = annotations(spark, sf_dir)
        a = a.select("action", (F.col("agent_id") != F.col("target_id")).cast("int").alias("y"), (F.col("stop_frame") - F.col("start_frame") >= 4).cast("int").alias("p"))
        return evaluate.mean_f1(evaluate.f1_by(a, ["action"], "y", "p")).select(F.round("f1", 9).alias("f1"))

    @query("""select kind, section, action, threshold from (select case when v % 2 = 0 then 'single' else 'pair' end as kind, cast(v % 3 as varchar) as section, 'a ' || v as action, v / 1000.0 as threshold
        from (select c_custkey as v from customer))""".replace("select kind", " select kind").replace("v / 1000.0", "cast(v as double) / 1000"))
    def stored_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{Stages(spark).root}/thresholds"
        v = F.col("c_custkey")
        own = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(v % 2 == 0, "single").otherwise("pair").alias("kind"), (v % 3).cast("string").alias("section"), F.concat(F.lit("a "), v).alias("action"), (v.cast("double") / 1000).alias("threshold"))
        tables.write_thresholds(own, path)
        return tables.read_thresholds(spark, path)

    @query(f"""{mark_sql}{listed_sql}, i as (select video_id, 'mouse' || agent_id as agent_id, case when agent_id = target_id then 'self' else 'mouse' || target_id end as target_id, action, start_frame, stop_frame from marks where start_frame < stop_frame and video_id % 3 <> 0),
        o as (select *, row_number() over (partition by video_id, agent_id, target_id order by start_frame, stop_frame, action) as k from i),
        w as (select *, true as keep, stop_frame as upto from o where k = 1
            union all select o.*, o.start_frame >= w.upto, case when o.start_frame >= w.upto then o.stop_frame else w.upto end from o join w on o.video_id = w.video_id and o.agent_id = w.agent_id and o.target_id = w.target_id and o.k = w.k + 1),
        kept as (select video_id, agent_id, target_id, action, start_frame, stop_frame from w where keep),
        extent as (select video_id, min(video_frame) as lo, max(video_frame) as hi from points group by video_id),
        l as (select *, row_number() over (partition by video_id, agent_id, target_id order by action) - 1 as n, count(*) over (partition by video_id, agent_id, target_id) as m from behaviours join extent using (video_id) where video_id not in (select video_id from kept)),
        d as (select *, cast(ceil((hi + 1 - lo) / m::double) as bigint) as size from l),
        filled as (select video_id, agent_id, target_id, action, lo + n * size as start_frame, least(lo + (n + 1) * size, hi + 1) as stop_frame from d),
        every_one as (select * from kept union all select * from filled where start_frame < stop_frame)
        select row_number() over (order by video_id, agent_id, target_id, start_frame, stop_frame, action) - 1 as row_id, * from every_one""")
    def submission_file(spark: SparkSession, sf_dir: str) -> DataFrame:
        agent, target = reshape.names_of(F.col("agent_id"), F.col("target_id"))
        found = annotations(spark, sf_dir).where("video_id % 3 <> 0").select("video_id", agent.alias("agent_id"), target.alias("target_id"), "action", "start_frame", "stop_frame")
        m = known(spark, sf_dir)
        listed = reshape.union_all(*[program.listed(m, kind) for kind in program.KINDS])
        path = f"{Stages(spark).root}/submission"
        tables.write_intervals(intervals.cleaned(found, listed, reshape.frame_extent(points(spark, sf_dir))), path)
        return spark.read.schema(f"row_id long, {tables.INTERVALS}").option("header", True).csv(path).withColumns({c: F.col(c).cast("long") for c in ("start_frame", "stop_frame")})

    @query(f"""{point_sql} select lab_id, video_id, video_frame, mouse_id, bodypart, x, y from points join meta using (video_id) where behaviors_labeled is not null""")
    def tracking_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = known(spark, sf_dir)
        root = per_recording(points(spark, sf_dir).join(recordings(spark, sf_dir).select("video_id", "lab_id"), "video_id"), tables.TRACKING)
        return tables.read_tracking(spark, root, m.where("behaviors_labeled is not null")).withColumn("video_frame", F.col("video_frame").cast("long"))

    @query(f"""{mark_sql} select lab_id, video_id, agent_id, target_id, action, start_frame, stop_frame from marks join every using (video_id)""")
    def annotation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = per_recording(annotations(spark, sf_dir).join(recordings(spark, sf_dir).select("video_id", "lab_id"), "video_id"), tables.ANNOTATION)
        return tables.read_annotations(spark, root).withColumns({c: F.col(c).cast("long") for c in ("start_frame", "stop_frame")})

    @query(f""", s as (select track, frame, {', '.join(f'{sql} as p{k}' for k, sql in enumerate(map(_model_sql, MODELS)))} from t)
        select track, frame, round(({' + '.join(f'1 / (1 + exp(-p{k}))' for k in range(len(MODELS)))}) / {len(MODELS)}, 9) as score from s""")
    def stored_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{Stages(spark).root}/action"
        for k, model in enumerate(MODELS):
            model.save(spark, f"{folder}/fold={k}")
        return learn.mean_scores(tracks(spark, sf_dir).select("track", "frame", "x", "y"), {"score": folder}).select("track", "frame", F.round("score", 9).alias("score"))

    @query(" select doc_id, 0e0 as label, 0e0 as score from documents join labels using (doc_id)")
    def action_without_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
        return learn.out_of_fold(d.withColumn("label", F.lit(0)), ["n_chars"], "source").select("doc_id", "label", "score")

    by_track = "order by track, frame"

    @query(f""", s as (select track, frame, case when x > 20 then 'high' when x > 5 then 'mid' end as action from t),
        c as (select *, max(frame) over (partition by track) as last, row_number() over ({by_track}) = 1 or action is null or lag(action) over ({by_track}) is null or action <> lag(action) over ({by_track}) as c from s),
        n as (select *, lead(frame) over ({by_track}) as nf, lead(track) over ({by_track}) as nt from c where c)
        select track, action, frame as start_frame, case when nt = track then nf else last + 1 end as stop_frame from n where action is not null and nf is not null""")
    def rle_one_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = tracks(spark, sf_dir).select("track", "frame", F.when(F.col("x") > 20, "high").when(F.col("x") > 5, "mid").alias("action"))
        return intervals.runs_in_one_sequence(s, ["track"], "action", compat=True)

    return out
