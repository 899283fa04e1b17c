"""The registered queries of the track operators over the test tables, and their SQL.

``events`` gives the tracks: a user is an animal, the place in the order of (ts, event_id) its frame, value and
props.k its coordinates, missing on errors; users 2n and 2n + 1 are a pair. Body parts stand at fixed offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series
from ..functions.frames import Tracks, cosine, ind, norm
from ..functions.rolling import Roll, at_least, rolled, share
from ..operators import evaluate, intervals, learn, meta, reshape
from ..sources import tables
from . import feature_queries, recording_queries
from .pair import pair_features
from .single import single_features

T = Tracks(["track"])
PARTS = ["body_center", "nose", "tail_base", "ear_left", "ear_right"]
_OFFSET = {"body_center": ("x", "y"), "nose": ("x + 1 + g", "y + 2"), "tail_base": ("x - 2", "y - 1 - g"), "ear_left": ("x + 0.5", "y + 1.5"), "ear_right": ("x + 1.5", "y + 1")}
#: The same offsets, one by one.
_STEPS = {"nose": ([1, "g"], [2]), "tail_base": ([-2], [-1, "minus_g"]), "ear_left": ([0.5], [1.5]), "ear_right": ([1.5], [1])}
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def r6(x: Column) -> Column:
    return F.round(x, 6)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    known = F.col("event_type") != "error"
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("track"),
        (F.row_number().over(w) - 1).cast("long").alias("frame"),
        F.when(known, F.col("value")).alias("x"),
        F.when(known, F.get_json_object("props", "$.k").cast("double")).alias("y"),
        "event_type",
        (F.col("user_id") % 3).alias("g"),
    )


TRACKS = """t as (
    select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
           case when event_type <> 'error' then value end as x,
           case when event_type <> 'error' then cast(regexp_extract(props, '([0-9]+)', 1) as double) end as y,
           event_type, user_id % 3 as g
    from events)"""
BY = "partition by track order by frame"
DIFF = f"""d as (select *, x - lag(x) over ({BY}) as dx, y - lag(y) over ({BY}) as dy from t),
    v as (select *, sqrt(dx * dx + dy * dy) as s from d)"""


def _tr(n: int) -> str:
    return f"over ({BY} rows between {n - 1} preceding and current row)"


def _ce(n: int) -> str:
    return f"over ({BY} rows between {n // 2} preceding and {(n - 1) // 2} following)"


def _roll(agg: str, x: str, over: str, least: int) -> str:
    return f"case when count({x}) {over} >= {least} then {agg}({x}) {over} end"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide tracks with all parts and the rate of the group."""
    t = tracks(spark, sf_dir)
    out = t.select("track", "frame", "g", *[F.expr(e).alias(f"{p}_{a}") for p, xy in _OFFSET.items() for a, e in zip("xy", xy, strict=True)], *[F.lit(True).alias(f"has_{p}") for p in PARTS])
    return out.withColumns({"fps": F.lit(30.0), "arena_width_cm": F.lit(60.0), "arena_height_cm": F.lit(90.0), "arena_shape": F.when(F.col("g") == 1, "Circular").otherwise("square")})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = points(spark, sf_dir).withColumns({"video": F.floor(F.col("track") / 2), "minus_g": -F.col("g")})
    columns = [f"{p}_{a}" for p in PARTS for a in "xy"] + [f"has_{p}" for p in PARTS] + ["g", "minus_g"]
    return reshape.ordered_pairs(t, columns, "video", "track", "frame").withColumn("fps", F.lit(30.0))


# --- scans, projections, joins


@_query("""select doc_id, upper(lang) as lang_upper, round(n_chars / 12.5, 6) as scaled, contains(text, 'the') as has_word
    from documents where not starts_with(source, 'src1') and lang is not null""")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.without_prefix(_table(spark, sf_dir, "documents"), "source", "src1").where("lang is not null")
    return d.select("doc_id", F.upper("lang").alias("lang_upper"), r6(F.col("n_chars") / 12.5).alias("scaled"), F.col("text").contains("the").alias("has_word"))


@_query(f"with {TRACKS} select track, frame, cast(x is not null as int) + cast(y is not null as int) as n_known from t")
def derived_null_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("track", "frame", tables.count_known(["x", "y"]).alias("n_known"))


_META = {
    "frames_per_second": "o_custkey % 60",
    "pix_per_cm_approx": "o_totalprice / 10000",
    "video_width": "o_orderkey % 1000",
    "video_height": "o_custkey % 700",
    "arena_width_cm": "o_custkey % 50 - 2",
    "arena_height_cm": "o_orderkey % 40",
    "n_mice": "o_custkey % 5",
}
_META_OUT = {
    "fps_log1p": "ln(1 + f)", "sec_per_frame": "1 / (f + 1e-6)", "cm_per_pix_approx": "1 / (p + 1e-6)", "log_pix_per_cm": "ln(1 + p)",
    "video_aspect": "vw / (vh + 1e-6)", "video_diag_px": "sqrt(vw * vw + vh * vh)", "arena_aspect": "w / (h + 1e-6)", "arena_area_log1p": "ln(1 + w * h)",
    "arena_perimeter_cm": "2 * (w + h)", "arena_diag_cm": "sqrt(w * w + h * h)", "n_mice_sq": "n * n", "mice_density": "n / (w * h + 1e-6)", "arena_area_per_mouse": "w * h / (n + 1e-6)",
}


@_query(f"""with m as (select o_orderkey, greatest(0, o_custkey % 60)::double as f, greatest(0, o_totalprice / 10000)::double as p, (o_orderkey % 1000)::double as vw,
    (o_custkey % 700)::double as vh, greatest(0, o_custkey % 50 - 2)::double as w, (o_orderkey % 40)::double as h, (o_custkey % 5)::double as n from orders)
    select o_orderkey, {', '.join(f'round({e}, 4) as {n}' for n, e in _META_OUT.items())} from m""")
def meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _META.items()])
    made = meta.numeric_features()
    return m.select("o_orderkey", *[F.round(made[n], 4).alias(n) for n in _META_OUT])


@_query("""select o_orderkey, cast(coalesce(p = '1-URGENT', false) as int) as urgent, cast(coalesce(p = '2-HIGH', false) as int) as high,
    cast(coalesce(p not in ('1-URGENT', '2-HIGH'), true) as int) as other, 0 as none,
    case p when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end as code
    from (select o_orderkey, case when o_orderkey % 7 <> 3 then o_orderpriority end as p from orders)""")
def onehot_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 3, F.col("o_orderpriority")))
    vocab = meta.vocabulary(o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), ("o_orderpriority",))
    made = meta.one_hot(vocab)
    names = {"1-URGENT": "urgent", "2-HIGH": "high", meta.UNKNOWN: "other", meta.MISSING: "none"}
    return o.select("o_orderkey", *[made[f"o_orderpriority={v}"].cast("int").alias(n) for v, n in names.items()], meta.label_codes(vocab)["o_orderpriority_idx"].alias("code"))


@_query(f"""with {TRACKS}, p as (select track // 10 as video_id, track as mouse_id, frame as video_frame, event_type, x, y from t where event_type in ('click', 'view')),
    g as (select distinct video_id, video_frame from p), m as (select video_id, mouse_id, bool_or(event_type = 'click') as has_click, bool_or(event_type = 'view') as has_view from p group by all)
    select g.video_id, m.mouse_id, g.video_frame, has_click, has_view, max(case when event_type = 'click' then x end) as click_x, max(case when event_type = 'click' then y end) as click_y,
    max(case when event_type = 'view' then x end) as view_x, max(case when event_type = 'view' then y end) as view_y
    from g join m using (video_id) left join p on p.mouse_id = m.mouse_id and p.video_frame = g.video_frame group by all""")
def pivot_long_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select(F.floor(F.col("track") / 10).alias("video_id"), F.col("track").alias("mouse_id"), F.col("frame").alias("video_frame"), F.col("event_type").alias("bodypart"), "x", "y")
    return reshape.pivot_parts(t, ["click", "view"])


@_query(f"""with {TRACKS}, n as (select track, count(distinct event_type) as n from t group by track)
    select track as video_id, frame, event_type as bodypart from t join n using (track) where n <= 4 or event_type not in ('click', 'signup')""")
def noisy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select(F.col("track").alias("video_id"), "frame", F.col("event_type").alias("bodypart"))
    return reshape.drop_noisy_parts(t, ("click", "signup"), 4)


@_query("""select l_orderkey, l_partkey, l_suppkey, coalesce(case when p_size < 25 then p_size end, case when s_suppkey % 3 = 0 then s_nationkey end, 30)::double as rate
    from lineitem left join part on l_partkey = p_partkey left join supplier on l_partkey = s_suppkey""")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("video_id"), "l_suppkey")
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), F.when(F.col("p_size") < 25, F.col("p_size")).alias("frames_per_second"))
    s = _table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("video_id"), F.col("s_nationkey").alias("fps"))
    return reshape.with_fps(li, p, s).select("l_orderkey", F.col("video_id").alias("l_partkey"), "l_suppkey", F.col("fps").cast("double").alias("rate"))


@_query(f"""with {TRACKS}, p as (select distinct track, unnest(generate_series(frame, frame + 5)) as frame from t where event_type = 'purchase')
    select t.track, t.frame, 'buy' as action, cast(p.frame is not null as int) as label from t left join p on p.track = t.track and p.frame = t.frame
    where t.track % 2 = 0 or p.frame is not null""")
def interval_label_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    marks = t.where("event_type = 'purchase'").select("track", F.lit("buy").alias("action"), F.col("frame").alias("start_frame"), (F.col("frame") + 5).alias("stop_frame"))
    listed = t.where("track % 2 = 0").select("track", F.lit("buy").alias("action"))
    return reshape.paint_labels(t, marks, listed, ["track"])


@_query(f"""with {TRACKS} select a.track // 2 as video, a.frame, a.track as agent, b.track as target, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 6) as d2
    from t a join t b on a.track // 2 = b.track // 2 and a.frame = b.frame and a.track <> b.track""")
def ordered_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("video", F.floor(F.col("track") / 2))
    p = reshape.ordered_pairs(t, ["x", "y"], "video", "track", "frame")
    return p.select("video", "frame", "agent", "target", r6(F.pow(F.col("A_x") - F.col("B_x"), 2) + F.pow(F.col("A_y") - F.col("B_y"), 2)).alias("d2"))


@_query("select c_custkey, c_name from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 10 = 0)")
def anti_join_unpredicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), "c_name")
    found = _table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("video_id"))
    return intervals.unpredicted(own, found).withColumnRenamed("video_id", "c_custkey")


@_query("select c_custkey from customer where c_custkey in (select o_custkey from orders group by o_custkey having count(*) = 1)")
def semi_join_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = _table(spark, sf_dir, "customer").select(F.lit("1").alias("section"), F.col("c_custkey").alias("action"))
    registry = _table(spark, sf_dir, "orders").select(F.lit("1").alias("section"), F.col("o_custkey").alias("action"), F.col("o_orderkey").alias("path"))
    return tables.single_models(actions, registry).select(F.col("action").alias("c_custkey"))


@_query("""select event_type as action, count(distinct user_id) as n_groups from events where value > 50 group by event_type having count(distinct user_id) >= 5""")
def enough_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("value > 50").withColumnRenamed("event_type", "action")
    return evaluate.enough_groups(e, ["action"], "user_id")


# --- windows


@_query(f"with {TRACKS} select track, frame, round(x - lag(x) over ({BY}), 6) as dx, lag(x, 3) over ({BY}) as x_lag3, lead(x, 2) over ({BY}) as x_lead2 from t")
def lag_lead_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return tracks(spark, sf_dir).select("track", "frame", r6(T.diff(x)).alias("dx"), T.shift(x, -3).alias("x_lag3"), T.shift(x, 2).alias("x_lead2"))


@_query(f"""with {TRACKS} select track, frame, round({_roll('avg', 'x', _tr(15), 3)}, 6) as trailing_15, round({_roll('avg', 'x', _ce(4), 2)}, 6) as centred_4,
    round({_roll('avg', 'x', _ce(15), 3)}, 6) as centred_15, round({_roll('avg', 'x', _tr(5), 5)}, 6) as full_5 from t""")
def roll_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"trailing_15": (15, "trailing", 3), "centred_4": (4, "centred", 2), "centred_15": (15, "centred", 3), "full_5": (5, "trailing", 5)}
    t = rolled(tracks(spark, sf_dir).select("track", "frame", "x"), T, [Roll(k, "mean", ("x",), w, f, at_least(n)) for k, (w, f, n) in frames.items()])
    return t.select("track", "frame", *[r6(F.col(k)).alias(k) for k in frames])


@_query(f"""with {TRACKS} select track, frame, round(cast({_roll('stddev_samp', 'x', _ce(6), 1)} as float)::double, 3) as sd,
    round(cast({_roll('var_samp', 'x', _tr(10), 2)} as float)::double, 2) as var, round({_roll('sum', 'x', _tr(10), 2)}, 4) as total,
    {_roll('min', 'x', _ce(7), 1)} as low, {_roll('max', 'x', _ce(7), 1)} as high from t""")
def roll_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolls = {"sd": ("std", 6, "centred", 1), "var": ("var", 10, "trailing", 2), "total": ("sum", 10, "trailing", 2), "low": ("min", 7, "centred", 1), "high": ("max", 7, "centred", 1)}
    t = rolled(tracks(spark, sf_dir).select("track", "frame", "x"), T, [Roll(n, k, ("x",), w, f, at_least(least)) for n, (k, w, f, least) in rolls.items()])
    short = lambda c, n: F.round(F.col(c).cast("float").cast("double"), n).alias(c)
    return t.select("track", "frame", short("sd", 3), short("var", 2), F.round("total", 4).alias("total"), "low", "high")


@_query(f"""with {TRACKS} select track, frame, round(case when count(x) {_tr(20)} >= 5 then quantile_cont(x, 0.25) {_tr(20)} end, 5) as q25,
    round(case when count(x) {_tr(20)} >= 5 then quantile_cont(x, 0.75) {_tr(20)} end, 5) as q75 from t""")
def roll_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rolled(tracks(spark, sf_dir).select("track", "frame", "x"), T, [Roll(n, "quantile", ("x",), 20, "trailing", at_least(5), q=q) for n, q in (("q25", 0.25), ("q75", 0.75))])
    return t.select("track", "frame", *[F.round(n, 5).alias(n) for n in ("q25", "q75")])


@_query(f"""with {TRACKS}, l as (select track, frame, y, list(y) filter (where y is not null) {_tr(30)} as l from t)
    select track, frame, round(case when y is not null and len(l) >= 5 then (len(list_filter(l, lambda e: e < y)) + (len(list_filter(l, lambda e: e = y)) + 1) / 2.0) / len(l) end, 6) as pct from l""")
def roll_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rolled(tracks(spark, sf_dir).select("track", "frame", "y"), T, [Roll("pct", "rank", ("y",), 30, "trailing", at_least(5))])
    return t.select("track", "frame", r6(F.col("pct")).alias("pct"))


@_query(f"""with {TRACKS}, c as (select track, frame, case when y is not null then x end as a, case when x is not null then y end as b from t)
    select track, frame, round(case when count(a) {_tr(20)} >= 5 then case when isfinite(corr(a, b) {_tr(20)}) then corr(a, b) {_tr(20)} end end, 5) as r from c""")
def roll_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rolled(tracks(spark, sf_dir).select("track", "frame", "x", "y"), T, [Roll("r", "corr", ("x", "y"), 20, "trailing", at_least(5))])
    return t.select("track", "frame", F.round("r", 5).alias("r"))


@_query(f"""with {TRACKS} select track, frame, round(sum(x * pow(29.0 / 31, -frame)) over ({BY}) / sum(case when x is not null then pow(29.0 / 31, -frame) end) over ({BY}), 5) as ewm from t""")
def ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rolled(tracks(spark, sf_dir).select("track", "frame", "x"), T, [Roll("ewm", "ewm", ("x",), 30)])
    return t.select("track", "frame", F.round("ewm", 5).alias("ewm"))


@_query(f"""with {TRACKS}, i as (select track, frame, x, sum(case when x is null then 0 else 1 end) over ({BY}) as i from t)
    select track, frame, case when x is null then row_number() over (partition by track, i order by frame) else 0 end::double as streak from i""")
def missing_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("track", "frame", F.col("x").isNull().cast("double").alias("gone"))
    return rolled(t, T, [Roll("streak", "streak", ("gone",))]).select("track", "frame", "streak")


_FILL = f"""p as (select track, frame, x, last_value(x ignore nulls) over ({BY}) as pv, last_value(case when x is not null then frame end ignore nulls) over ({BY}) as pr,
        first_value(x ignore nulls) over ({BY} rows between current row and unbounded following) as nv,
        first_value(case when x is not null then frame end ignore nulls) over ({BY} rows between current row and unbounded following) as nr from h),
    f as (select track, frame, case when x is not null then x when pv is not null and nv is not null and frame - pr <= 2 * 2 then pv + (nv - pv) * least(frame - pr, 2) / (nr - pr)
        when pv is not null and nv is null and frame - pr <= 2 then pv when nv is not null and nr - frame <= 2 then nv end as filled from p)"""


@_query(f"with {TRACKS}, h as (select track, frame, case when x < 20 then x end as x from t), {_FILL} select track, frame, round(filled, 6) as filled from f")
def gap_fill_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("track", "frame", F.when(F.col("x") < 20, F.col("x")).alias("x"))
    return series.gap_fill(t, T, ["x"], 2).select("track", "frame", r6(F.col("x")).alias("filled"))


@_query(f"""with {TRACKS}, k as (select track, frame, abs(x - y) as k from t)
    select track, frame, round(case when count(k) over w = 6 then avg(k) over w end, 6) as gap from k window w as ({BY} rows between 6 preceding and 1 preceding)""")
def lagged_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rolled(tracks(spark, sf_dir).select("track", "frame", F.abs(F.col("x") - F.col("y")).alias("k")), T, [Roll("gap", "mean", ("k",), 6, "before", share(1))])
    return t.select("track", "frame", r6(F.col("gap")).alias("gap"))


@_query(f"""with {TRACKS}, c as (select track, frame, case when x / 10 <= 0.5 then 0 when x / 10 <= 2 then 1 when x / 10 <= 5 then 2 when x is not null then 3 end as state from t),
    m as (select *, cast(state is null or lag(state) over ({BY}) is null or state <> lag(state) over ({BY}) as double) as moved from c)
    select track, frame, state::double as state, moved, round(avg(cast(coalesce(state = 1, false) as double)) {_tr(15)}, 6) as share_1, sum(moved) {_tr(15)} as trans from m""")
def state_bins_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("state", series.speed_state(F.col("x") / 10))
    t = t.withColumn("moved", series.change_flag(F.col("state"), T))
    w = T.trailing(15)
    return t.select("track", "frame", "state", "moved", r6(F.avg(ind(F.col("state") == 1.0)).over(w)).alias("share_1"), F.sum("moved").over(w).alias("trans"))


@_query(f"""with {TRACKS}, q as (select track, quantile_cont(x, 0.01) as lo, quantile_cont(x, 0.99) as hi from t group by track),
    c as (select track, frame, case when x is not null then least(greatest(x, lo), hi) end as c from t join q using (track))
    select track, frame, round(max(c) {_ce(15)} - min(c) {_ce(15)}, 5) as rng from c""")
def winsor_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = series.winsorised(tracks(spark, sf_dir).select("track", "frame", "x"), T, ["x"])
    t = rolled(t, T, [Roll("hi", "max", ("_w_x",), 15), Roll("lo", "min", ("_w_x",), 15)])
    return t.select("track", "frame", F.round(F.col("hi") - F.col("lo"), 5).alias("rng"))


@_query(f"with {TRACKS} select track, frame, case g " + " ".join(f"when {g} then round({_roll('avg', 'x', _ce(n), max(1, n // 4))}, 6)" for g, n in ((0, 12), (1, 15), (2, 30))) + " end as m from t")
def fps_scaled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("track", "frame", "x", F.when(F.col("g") == 0, 25.0).when(F.col("g") == 2, 60.0).otherwise(30.0).alias("fps"))
    return rolled(t, T, [Roll("m", "mean", ("x",), 15, least=share(4))], F.col("fps")).select("track", "frame", r6(F.col("m")).alias("m"))


@_query(f"""with {TRACKS}, {DIFF}, a as (select *, dx - lag(dx) over ({BY}) as ax, dy - lag(dy) over ({BY}) as ay, abs(atan2(dy, dx) - lag(atan2(dy, dx)) over ({BY})) as turn from v),
    c as (select *, abs(dx * ay - dy * ax) / (pow(s, 3) + 1e-6) as k from a)
    select track, frame, round(cast({_roll('avg', 'k', _tr(15), 3)} as float)::double, 3) as curv_mean_15, round(cast({_roll('sum', 'turn', _tr(15), 3)} as float)::double, 3) as turn_rate_15 from c""")
def curvature_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some(lambda names: single_features(points(spark, sf_dir), PARTS, 1, ["track"], groups=("motion",), names=names), ["track", "frame"], ["curv_mean_15", "turn_rate_15"], 3)


def _some(make: Callable, keys: list[str], names: list[str], digits: int = 4) -> DataFrame:
    """Only these of the features that ``make`` gives, rounded."""
    return make(names).select(*keys, *[F.round(F.col(f"`{n}`").cast("double"), digits).alias(n) for n in names])


def _as_float(x: str, name: str, digits: int = 4) -> str:
    return f"round(cast(({x}) as float)::double, {digits}) as {name}"


@_query(f"""with {TRACKS}, {DIFF}, u as (select *, dx * 30 as vx, dy * 30 as vy, 3.0 + g as ox, 3.0 + g as oy from v), w as (select *, sqrt(ox * ox + oy * oy) + 1e-6 as o from u),
    f as (select *, (vx * ox + vy * oy) / o as fwd, (ox * vy - oy * vx) / o as lat, atan2(vy, vx) - atan2(oy, ox) as off from w)
    select track, frame, {_as_float('fwd', 'v_forward')}, {_as_float('lat', 'v_lateral')}, {_as_float('atan2(sin(off), cos(off))', 'slip_angle')},
    {_as_float(_roll('avg', 'cast(coalesce(fwd > 1, false) as double)', _ce(15), 3), 'forward_ratio_15')} from f""")
def axis_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some(lambda names: single_features(points(spark, sf_dir), PARTS, 1, ["track"], groups=("head",), names=names), ["track", "frame"], ["v_forward", "v_lateral", "slip_angle", "forward_ratio_15"])


@_query(f"""with {TRACKS}, e as (select *, min(x) over (partition by track) as x0, max(x) over (partition by track) as x1, min(y) over (partition by track) as y0, max(y) over (partition by track) as y1 from t),
    c as (select *, sqrt(pow(x - (x0 + x1) / 2, 2) + pow(y - (y0 + y1) / 2, 2)) as away from e),
    w as (select *, case when x is null then null when g = 1 then greatest(30 - away, 0) else least(x - x0, x1 - x, y - y0, y1 - y) end as wall from c)
    select track, frame, {_as_float('away', 'dist_to_arena_center')}, {_as_float('wall', 'dist_to_nearest_wall')},
    cast(coalesce(wall < case when g = 1 then 4.5 else 9 end, false) as double) as is_near_wall, cast(coalesce(away < case when g = 1 then 9 else 18 end, false) as double) as is_in_center from w""")
def arena_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some(lambda names: single_features(points(spark, sf_dir), PARTS, 1, ["track"], groups=("arena",), names=names), ["track", "frame"], ["dist_to_arena_center", "dist_to_nearest_wall", "is_near_wall", "is_in_center"])


_PAIR = f"""{TRACKS}, q as (select a.track // 2 as video, a.track as agent, b.track as target, a.frame, a.x as ax, a.y as ay, b.x as bx, b.y as by_, a.g as ag, b.g as bg
    from t a join t b on a.track // 2 = b.track // 2 and a.frame = b.frame and a.track <> b.track)"""
_PBY = "partition by video, agent, target order by frame"


@_query(f"""with {_PAIR}, r as (select *, ax - bx as rx, ay - by_ as ry, sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)) as d from q),
    w as (select *, ax - lag(ax) over ({_PBY}) as avx, ay - lag(ay) over ({_PBY}) as avy, bx - lag(bx) over ({_PBY}) as bvx, by_ - lag(by_) over ({_PBY}) as bvy, d - lag(d) over ({_PBY}) as dd from r),
    l as (select *, (avx * rx + avy * ry) / (d + 1e-6) as al, -(bvx * rx + bvy * ry) / (d + 1e-6) as bl from w),
    c as (select *, cast(coalesce(al > 0 and dd < 0, false) as double) as ch, cast(coalesce(al < 0 and bl < 0, false) as double) as es from l)
    select video, agent, target, frame, {_as_float('al', 'A_vel_along')}, {_as_float('bl', 'B_vel_along')}, ch as "A_chasing", es as "A_escaping",
    {_as_float(f'avg(ch) over ({_PBY} rows between 7 preceding and 7 following)', '"A_chasing_p15"')} from c""")
def chase_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["video", "agent", "target"]
    return _some(lambda names: pair_features(pairs(spark, sf_dir), PARTS, keys, groups=("chase",), names=names), [*keys, "frame"], ["A_vel_along", "B_vel_along", "A_chasing", "A_escaping", "A_chasing_p15"])


@_query(f"""with {_PAIR}, n as (select *, ax + 1 + ag as nx, ay + 2 as ny from q),
    m as (select *, least(sqrt(pow(nx - bx, 2) + pow(ny - by_, 2)), sqrt(pow(nx - bx - 1 - bg, 2) + pow(ny - by_ - 2, 2)), sqrt(pow(nx - bx + 2, 2) + pow(ny - by_ + 1 + bg, 2)),
        sqrt(pow(nx - bx - 0.5, 2) + pow(ny - by_ - 1.5, 2)), sqrt(pow(nx - bx - 1.5, 2) + pow(ny - by_ - 1, 2))) as d from n),
    c as (select *, cast(coalesce(d < 5, false) as double) as touch from m)
    select video, agent, target, frame, {_as_float('d', '"A_front_to_B_min"')}, touch as "A_front_contact_5", sum(touch) over ({_PBY} rows between 15 preceding and 14 following) as "A_contact_duration_30" from c""")
def contact_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["video", "agent", "target"]
    return _some(lambda names: pair_features(pairs(spark, sf_dir), PARTS, keys, groups=("contact",), names=names, steps=_STEPS), [*keys, "frame"], ["A_front_to_B_min", "A_front_contact_5", "A_contact_duration_30"])


@_query("""select a.vec_id as vec_id, b.vec_id as other_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    o = e.select(F.col("vec_id").alias("other_id"), (F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v"))
    return e.join(o, "vec_id").select("vec_id", "other_id", r6(cosine("u", "v")).alias("cosine"))


# --- decoding, cleaning, evaluation


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).withColumn("action", F.when(F.col("x") > 20, "high").when(F.col("x") > 5, "mid"))


_STATES = f"{TRACKS}, s as (select track, frame, case when x > 20 then 'high' when x > 5 then 'mid' end as action from t)"
_RUNS = f"""m as (select *, max(frame) over (partition by track) as last, action is null or lag(action) over ({BY}) is null or action <> lag(action) over ({BY}) as c from s),
    n as (select *, lead(frame) over ({BY}) as nxt from m where c)"""


@_query(f"with {_STATES}, {_RUNS} select track, action, frame as start_frame, coalesce(nxt, last + 1) as stop_frame from n where action is not null")
def rle_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.runs(_states(spark, sf_dir), ["track"], "action")


@_query(f"with {_STATES}, {_RUNS} select track, action, frame as start_frame, nxt as stop_frame from n where action is not null and nxt is not null")
def rle_intervals_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.runs(_states(spark, sf_dir), ["track"], "action", compat=True)


@_query(f"""with {TRACKS}, p as (select track, frame, x / 50 as p1, y / 100 as p2 from t)
    select track, frame, case when p1 is null and p2 is null then null when p1 >= p2 then case when p1 >= 0.27 then 'one' end else case when p2 >= 0.6 then 'two' end end as action from p""")
def best_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = {"one": F.col("x") / 50, "two": F.col("y") / 100}
    return tracks(spark, sf_dir).select("track", "frame", intervals.best_action(scores, {"two": 0.6}).alias("action"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).where("x is not null and event_type <> 'view'")
    return t.select("track", F.col("event_type").alias("action"), F.col("frame").alias("start_frame"), (F.col("frame") + 1 + F.col("y") % 7).cast("long").alias("stop_frame"))


@_query(f"""with recursive {TRACKS}, c as (select track, event_type as action, frame as start_frame, frame + 1 + cast(y as bigint) % 7 as stop_frame from t where x is not null and event_type <> 'view'),
    o as (select *, row_number() over (partition by track order by start_frame, stop_frame, action) as i from c),
    k as (select *, true as keep, stop_frame as upto from o where i = 1
        union all select o.*, o.start_frame >= k.upto, case when o.start_frame >= k.upto then o.stop_frame else k.upto end from o join k on o.track = k.track and o.i = k.i + 1)
    select track, action, start_frame, stop_frame from k where keep""")
def greedy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.without_overlaps(_candidates(spark, sf_dir), ["track"])


@_query("""with own as (select c_custkey as video_id, c_custkey % 4 as lo, c_custkey % 4 + c_custkey % 50 as hi from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 10 = 0)),
    l as (select video_id, 'mouse1' as agent_id, 'self' as target_id, unnest(['approach', 'groom', 'rear', 'sniff']) as action, lo, hi from own),
    b as (select *, row_number() over (partition by video_id order by action) - 1 as i, cast(ceil((hi + 1 - lo) / 4) as bigint) as size from l)
    select video_id, agent_id, target_id, action, lo + i * size as start_frame, least(lo + (i + 1) * size, hi + 1) as stop_frame from b""")
def default_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    extent = c.select(F.col("c_custkey").alias("video_id"), (F.col("c_custkey") % 4).alias("lo"), (F.col("c_custkey") % 4 + F.col("c_custkey") % 50).alias("hi"))
    listed = c.select(F.col("c_custkey").alias("video_id"), F.lit("mouse1").alias("agent_id"), F.lit("self").alias("target_id"), F.explode(F.array(*map(F.lit, ("approach", "groom", "rear", "sniff")))).alias("action"))
    return intervals.default_batches(listed, extent, _table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("video_id")), compat=True)


@_query("""select o_orderkey as video_id, agent, target, action from (select o_orderkey, unnest(['mouse1,self,rear', 'mouse1,mouse2,a' || (o_orderkey % 3)]) as b from orders),
    lateral (select string_split(b, ',')[1] as agent, string_split(b, ',')[2] as target, string_split(b, ',')[3] as action)""")
def listed_behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.format_string('["mouse1,self,rear","mouse1,mouse2,\'a%d\'","mouse1,self,rear"]', (F.col("o_orderkey") % 3).cast("int"))
    return reshape.behaviours(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), own.alias("behaviors_labeled")))


@_query("""with p as (select source, quality as y, cast(n_chars >= 1000 as int) as p from documents join labels using (doc_id)),
    c as (select source, sum(cast(y = 1 and p = 1 as int)) as tp, sum(cast(y <> 1 and p = 1 as int)) as fp, sum(cast(y = 1 and p <> 1 as int)) as fn from p group by source)
    select source, round(case when 2 * tp + fp + fn = 0 then 0 else 2.0 * tp / (2 * tp + fp + fn) end, 6) as f1 from c""")
def f1_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).withColumn("p", (F.col("n_chars") >= 1000).cast("int"))
    return evaluate.f1_by(d, ["source"], "quality", "p").select("source", r6(F.col("f1")).alias("f1"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id")


_SWEEP = """p as (select lang, quality as y, least(100, n_chars // 40) as s from documents join labels using (doc_id)),
    g as (select lang, s.s as t from (select distinct lang from p), (select unnest(generate_series(0, 100)) as s) s),
    c as (select g.lang, g.t, sum(cast(p.s >= g.t and y = 1 as int)) as tp, sum(cast(p.s >= g.t and y <> 1 as int)) as fp, sum(cast(p.s < g.t and y = 1 as int)) as fn from g join p using (lang) group by g.lang, g.t),
    f as (select lang, t / 100.0 as threshold, case when 2 * tp + fp + fn = 0 then 0 else 2.0 * tp / (2 * tp + fp + fn) end as f1 from c)"""


@_query(f"with {_SWEEP} select lang, threshold::double as threshold, round(f1, 6) as f1 from f")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).withColumn("score", F.least(F.floor(F.col("n_chars") / 40), F.lit(100)) / 100.0)
    return evaluate.sweep(d, ["lang"], "quality", "score").select("lang", "threshold", r6(F.col("f1")).alias("f1"))


@_query(f"with {_SWEEP}, b as (select lang, max(f1) as f1 from f group by lang) select lang, round(b.f1, 6) as f1, min(threshold)::double as threshold from f join b using (lang) where f.f1 = b.f1 group by lang, b.f1")
def tuned_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).withColumn("score", F.least(F.floor(F.col("n_chars") / 40), F.lit(100)) / 100.0)
    return evaluate.best_threshold(evaluate.sweep(d, ["lang"], "quality", "score"), ["lang"]).select("lang", "threshold", r6(F.col("f1")).alias("f1"))


@_query("""with recursive n as (select source, sum(cast(quality = 0 as int))::hugeint as a, sum(cast(quality = 1 as int))::hugeint as b from documents join labels using (doc_id) group by source),
    total as (select greatest(1, sum(a))::hugeint as ta, greatest(1, sum(b))::hugeint as tb from n),
    g as (select source, a, b, row_number() over (order by 2 * (a * a + b * b) - (a + b) * (a + b) desc, source) as i from n),
    f as (select 0::bigint as i, null::varchar as source, null::int as fold, [0, 0, 0, 0, 0]::hugeint[] as la, [0, 0, 0, 0, 0]::hugeint[] as lb
        union all select c.i, c.source, (c.k - 1)::int, list_transform(range(1, 6), lambda j: c.la[j] + case when j = c.k then c.a else 0 end), list_transform(range(1, 6), lambda j: c.lb[j] + case when j = c.k then c.b else 0 end)
        from (select *, row_number() over (order by cost, la[k] + lb[k], k) as r from (
            select g.i, g.source, g.a, g.b, f.la, f.lb, k,
                tb * tb * (5 * list_sum(list_transform(range(1, 6), lambda j: (f.la[j] + case when j = k then g.a else 0 end) * (f.la[j] + case when j = k then g.a else 0 end))) - (list_sum(f.la) + g.a) * (list_sum(f.la) + g.a))
                + ta * ta * (5 * list_sum(list_transform(range(1, 6), lambda j: (f.lb[j] + case when j = k then g.b else 0 end) * (f.lb[j] + case when j = k then g.b else 0 end))) - (list_sum(f.lb) + g.b) * (list_sum(f.lb) + g.b)) as cost
            from f join g on g.i = f.i + 1, total, (select unnest(range(1, 6)) as k))) c where r = 1)
    select source, fold from f where source is not null""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.group_folds(_scored(spark, sf_dir), "source", "quality")


@_query("select r_regionkey as key, r_name as name, null::varchar as extra from region union all select n_nationkey, n_name, n_name from nation")
def union_null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_name").alias("extra"))
    return reshape.union_all(r, n)


@_query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) where k = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.first_of(_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@_query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.head(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 5)


@_query("select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as kinds from orders group by o_custkey")
def sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.distinct_values(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", F.array_join("values", ",").alias("kinds"))


@_query()
def all_single_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_features(points(spark, sf_dir), PARTS, 1, ["track"])


@_query()
def all_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_features(pairs(spark, sf_dir), PARTS, ["video", "agent", "target"])


@_query()
def gbt_classifier_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of painted labels from track features, by models of the program's size that have not seen the track."""
    p = points(spark, sf_dir)
    x = single_features(p, PARTS, 1, ["track"], groups=("micro",))
    marks = tracks(spark, sf_dir).where("event_type = 'purchase'").select("track", F.lit("buy").alias("action"), F.col("frame").alias("start_frame"), (F.col("frame") + 5).alias("stop_frame"))
    y = reshape.paint_labels(p, marks, p.select("track", F.lit("buy").alias("action")), ["track"])
    names = [c for c in x.columns if c not in ("track", "frame")]
    return learn.out_of_fold(x.join(y, ["track", "frame"]), names, "track").select("track", "frame", "fold", "label", "score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks, gap fill, smoothed speed, states, runs, then intervals without overlaps."""
    t = series.gap_fill(tracks(spark, sf_dir).select("track", "frame", "x", "y"), T, ["x", "y"], 8)
    t = t.withColumn("speed", norm(T.diff(F.col("x")), T.diff(F.col("y"))))
    t = t.withColumn("calm", T.roll(F.avg, F.col("speed"), T.centred(5), 2))
    t = t.withColumn("action", F.when(F.col("calm") > 40, "run").when(F.col("calm") > 25, "walk"))
    found = intervals.runs(t, ["track"], "action")
    return intervals.without_overlaps(intervals.valid(found), ["track"])



def _filled(c: str, limit: int) -> str:
    """``c`` with its gaps filled over the columns before and after it."""
    return f"""case when {c} is not null then {c} when {c}_pv is not null and {c}_nv is not null and frame - {c}_pr <= 2 * {limit} then {c}_pv + ({c}_nv - {c}_pv) * least(frame - {c}_pr, {limit}) / ({c}_nr - {c}_pr)
        when {c}_pv is not null and {c}_nv is null and frame - {c}_pr <= {limit} then {c}_pv when {c}_nv is not null and {c}_nr - frame <= {limit} then {c}_nv end as {c}"""


def _ends(c: str) -> str:
    ahead, at = f"over ({BY} rows between current row and unbounded following)", f"case when {c} is not null then frame end"
    return f"""last_value({c} ignore nulls) over ({BY}) as {c}_pv, last_value({at} ignore nulls) over ({BY}) as {c}_pr, first_value({c} ignore nulls) {ahead} as {c}_nv, first_value({at} ignore nulls) {ahead} as {c}_nr"""


_query(f"""with recursive {TRACKS}, e as (select track, frame, x, y, {_ends('x')}, {_ends('y')} from t), g as (select track, frame, {_filled('x', 8)}, {_filled('y', 8)} from e),
    d as (select *, sqrt(power(x - lag(x) over ({BY}), 2) + power(y - lag(y) over ({BY}), 2)) as speed from g),
    c as (select track, frame, {_roll('avg', 'speed', _ce(5), 2)} as calm from d), s as (select track, frame, case when calm > 40 then 'run' when calm > 25 then 'walk' end as action from c), {_RUNS},
    i as (select track, action, frame as start_frame, coalesce(nxt, last + 1) as stop_frame from n where action is not null),
    o as (select *, row_number() over (partition by track order by start_frame, stop_frame, action) as k from i where start_frame < stop_frame),
    w as (select *, true as keep, stop_frame as upto from o where k = 1
        union all select o.*, o.start_frame >= w.upto, case when o.start_frame >= w.upto then o.stop_frame else w.upto end from o join w on o.track = w.track and o.k = w.k + 1)
    select track, action, start_frame, stop_frame from w where keep""")(flagship)


for _name, (_made, _text) in (feature_queries.all_groups(tracks, TRACKS) | recording_queries.all_queries(tracks, TRACKS)).items():
    _queries[_name], _sql[_name] = _made, _text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
