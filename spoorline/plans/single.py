"""Features of single tracks.

The schema follows from the declared parts and the section alone; what a track cannot have is NULL.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.frames import REFERENCE_FPS, Tracks, changed, clip, ind, norm, ratio, wrap_once
from ..functions.rolling import Roll, at_least, in_blocks, scaled_rows, share
from .layers import LAST, Layers, Point, centre_options, first_available, nose_options, part

M, S, SUM, MAX, MIN = "mean", "std", "sum", "max", "min"
FOUR = [15, 30, 60, 120]


def _given(has: Column, x: Column) -> Column:
    return F.when(has, x)


def missing_layer(b: Layers, parts: list[str], side: str, out: str) -> tuple[Column, Column, Column]:
    """Ratio of missing parts, and whether the stand-ins for nose and centre are seen."""
    all_parts = [part(p, side) for p in parts]
    ok = sum((p.ok.cast("double") for p in all_parts), F.lit(0.0))
    total = sum((p.has.cast("double") for p in all_parts), F.lit(0.0))
    nose, centre = first_available(nose_options(parts, side)), first_available(centre_options(parts, side))
    if not out:
        b.let(0, "kp_ok_cnt", ok)
    miss = b.let(0, f"{out}kp_missing_ratio", 1.0 - ok / (F.greatest(total, F.lit(1.0)) + 1e-6))
    seen = [b.let(-1, f"{out}{n}_proxy_ok", ind(p.ok) if p is not None else F.lit(0.0)) for n, p in (("nose", nose), ("center", centre))]
    return miss, *seen


def _shape(b: Layers, parts: list[str], section: int, nose: Point | None, centre: Point | None) -> None:
    """Distances, elongation, ears, body angle, nose to tail, triangle, width, elevation, stability."""
    p, nine = {n: part(n) for n in parts}, section == 9
    for one, two in itertools.combinations(parts, 2):
        b.let(0, f"{one}+{two}", _given(p[one].has & p[two].has, (p[one] - p[two]).square))
    if "nose+tail_base" in b.names and "ear_left+ear_right" in b.names:
        b.let(1, "elong", ratio(F.col("`nose+tail_base`"), F.col("`ear_left+ear_right`")))
    ears = {"ear_left", "ear_right"} <= set(p)
    if ears and "tail_base" in p:
        past = {n: Point(b.lag(p[n].x, 10), b.lag(p[n].y, 10), p[n].has) for n in ("ear_left", "ear_right", "tail_base")}
        all_have = p["ear_left"].has & p["ear_right"].has & p["tail_base"].has
        for name, a, c in (("sp_lf", "ear_left", "ear_left"), ("sp_rt", "ear_right", "ear_right"), ("sp_lf2", "ear_left", "tail_base"), ("sp_rt2", "ear_right", "tail_base")):
            b.let(LAST, name, _given(all_have, (p[a] - past[c]).square))
    if ears:
        gap = b.let(0, "_ear_gap", (p["ear_left"] - p["ear_right"]).size)
        for off in (-30, -20, -10, 10, 20, 30):
            b.let(LAST, f"ear_o{off}", b.shift(gap, off))
        b.let(LAST, "ear_con", ratio(b.roll(S, gap, 30, "centred"), b.roll(M, gap, 30, "centred")))
        mid = b.point(0, "ear_mid", p["ear_left"].middle(p["ear_right"]))
        b.let(LAST, "ear_mid_std", norm(*[b.roll(S, x, 30, least=scaled_rows(5)) for x in (mid.x, mid.y)]))
        if centre is not None and nose is not None:
            far = b.let(1, "ear_center_dist", (mid - centre).size)
            b.let(1, "ear_nose_dist", (mid - nose).size)
            u, v = mid - nose, centre - nose
            b.let(1, "ear_nose_center_angle", ratio(u.dot(v), u.size * v.size))
            b.rolls(2, far, {"ear_center_m{w}": M, "ear_center_s{w}": S}, [30, 60] if nine else FOUR, 4)
    if nose is not None and "tail_base" in p:
        tail = p["tail_base"]
        length = b.let(0, "_nt", (nose - tail).size)
        for lag in (10, 20, 40):
            before = b.lag(length, lag)
            b.let(LAST, f"nt_lg{lag}", before)
            b.let(LAST, f"nt_df{lag}", length - before)
        b.let(LAST, "nose_tail_length_std", b.roll(S, length, 30, least=scaled_rows(5)))
        if centre is not None:
            u, v = nose - centre, tail - centre
            b.let(1, "body_ang", ratio(u.dot(v), u.size * v.size))
            area = b.let(1, "tri_area", F.abs((centre - nose).cross(tail - nose)) / 2)
            front, back = u.size, v.size
            b.let(1, "tri_front_back_ratio", ratio(front, back))
            around = front + back + (nose - tail).size
            b.let(1, "tri_compactness", ratio(F.abs((centre - nose).cross(tail - nose)) / 2, around * around))
            b.rolls(2, area, {"tri_area_m{w}": M, "tri_area_s{w}": S}, [15, 30] if nine else FOUR, 4)
            if section > 3 and section != 8:
                b.rolls(1, _given(tail.has, nose.y - centre.y), {"head_elev_mean_{w}": M, "head_elev_std_{w}": S}, [10, 20, 30], None)
                b.rolls(1, _given(tail.has & centre.has, nose.y - tail.y), {"body_vert_{w}": M}, [10, 20, 30], None)
    if section != 3 and {"lateral_left", "lateral_right"} <= set(p):
        width = b.let(0, "_width", (p["lateral_left"] - p["lateral_right"]).size)
        b.rolls(1, width, {"body_width_mean_{w}": M, "body_width_std_{w}": S}, FOUR, None)
        grown = b.let(1, "_width_d", b.diff(width))
        b.rolls(2, grown, {"body_width_change_{w}": M}, FOUR, None)


def _motion(b: Layers, section: int, centre: Point, step: Point) -> None:
    """Centre statistics, curvature, multi-scale speed, states, long range. ``step`` is in layer 1."""
    nine = section == 9
    windows = [5, 15, 30, 60] if nine else FOUR
    for axis, x, d, w_ in (("x", centre.x, step.x, F.col("_w__c_x")), ("y", centre.y, step.y, F.col("_w__c_y"))):
        b.rolls(1, x, {f"c{axis}_m{{w}}": M, f"c{axis}_s{{w}}": S}, windows, None, least=at_least(1))
        for w in windows:
            b.let(LAST, f"{axis}_rng{w}", b.roll(MAX, w_, w, "centred") - b.roll(MIN, w_, w, "centred"))
            b.let(LAST, f"_sum_{axis}{w}", b.roll(SUM, d, w))
            b.let(LAST, f"_var_{axis}{w}", b.roll("var", d, w))
    for w in windows:
        b.let(LAST + 1, f"disp{w}", norm(F.col(f"_sum_x{w}"), F.col(f"_sum_y{w}")))
        b.let(LAST + 1, f"act{w}", F.sqrt(F.col(f"_var_x{w}") + F.col(f"_var_y{w}")))
    bend = b.step(2, "c_acc", step)
    curve = b.let(3, "_curve", ratio(F.abs(step.cross(bend)), F.pow(step.size, F.lit(3.0))))
    b.rolls(4, curve, {"curv_mean_{w}": M}, [25, 50, 75] if nine else FOUR, 5, trailing=True)
    turn = b.let(2, "_turn", F.abs(b.diff(F.atan2(step.y, step.x))))
    b.rolls(3, turn, {"turn_rate_{w}": SUM}, [30] if nine else FOUR, 5, trailing=True)
    speed = b.let(2, "_speed", step.size * b.fps)
    scales = [20, 40, 60, 80] if nine else FOUR
    for w in scales:
        b.rolls(3, speed, {"sp_m{w}": M, "sp_s{w}": S}, [w], 4, trailing=True, long=True)
        low, high = (b.roll("quantile", speed, w, least=share(4), q=q, long=True) for q in (0.25, 0.75))
        b.let(LAST, f"sp_q25_{w}", low)
        b.let(LAST, f"sp_q75_{w}", high)
        b.let(LAST, f"sp_iqr{w}", high - low)
    b.let(LAST + 1, "sp_ratio", ratio(F.col(f"sp_m{scales[0]}"), F.col(f"sp_m{scales[-1]}")))
    calm = b.let(3, "_calm", b.roll(M, speed, 15, least=share(3)))
    calm_before = b.let(3, "_calm_before", b.roll(M, speed, 15, "before", least=share(3)))
    state = b.let(4, "_state", series.speed_state(calm))
    moved = b.let(5, "_moved", changed(state, series.speed_state(calm_before)).cast("double"))
    for w in scales:
        for k in range(4):
            b.rolls(5, _given(centre.has, ind(state == float(k))), {f"s{k}_{{w}}": M}, [w], 5, trailing=True, long=True)
        b.rolls(6, _given(centre.has, moved), {"trans_{w}": SUM}, [w], 5, trailing=True, long=True)
    for axis, x in (("x", centre.x), ("y", centre.y)):
        b.rolls(1, x, {f"{axis}_ml{{w}}": M}, [30, 60, 120], None, trailing=True, least=share(6, 5), long=True)
    b.rolls(3, speed, {"sp_pct{w}": "rank"}, [30, 60, 120], None, trailing=True, least=share(6, 5), long=True)


def _head_and_axis(b: Layers, section: int, nose: Point, centre: Point, step: Point, tail: Point | None) -> None:
    """The head against the body, and motion along the body's axis."""
    fps, nine = b.fps, section == 9
    rel = nose - centre
    turned = b.step(1, "rel_v", rel, fps)
    speed = b.let(2, "head_rel_speed", turned.size)
    b.let(2, "head_body_speed_ratio", ratio(turned.size, step.size * fps))
    b.rolls(3, speed, {"head_rel_sp_m{w}": M, "head_rel_sp_s{w}": S}, [15, 30, 60] if nine else FOUR, 4)
    angle = b.let(0, "_head_angle", F.atan2(rel.y, rel.x))
    spin = b.let(2, "head_turn_speed", F.abs(wrap_once(F.col("_head_spin"))) * fps)
    b.let(1, "_head_spin", b.diff(angle))
    b.rolls(3, spin, {"head_turn_m{w}": M, "head_turn_s{w}": S, "head_turn_sum{w}": SUM}, [15, 30] if nine else FOUR, 4)
    if tail is None:
        return
    axis = nose - tail
    v = Point(step.x * fps, step.y * fps, step.has & axis.has)
    ahead = b.let(2, "v_forward", ratio(v.dot(axis), axis.size))
    aside = b.let(2, "v_lateral", ratio(axis.cross(v), axis.size))
    far = b.let(3, "v_forward_abs", F.abs(ahead))
    wide = b.let(3, "v_lateral_abs", F.abs(aside))
    skew = b.let(3, "lat_over_fwd", ratio(F.abs(aside), F.abs(ahead)))
    three, two = [15, 30, 60] if nine else FOUR, [30, 60] if nine else FOUR
    b.rolls(4, ahead, {"v_fwd_m{w}": M, "v_fwd_s{w}": S}, three, 4)
    b.rolls(4, far, {"v_fwd_abs_m{w}": M}, three, 4)
    b.rolls(4, aside, {"v_lat_m{w}": M, "v_lat_s{w}": S}, three, 4)
    b.rolls(4, wide, {"v_lat_abs_m{w}": M}, three, 4)
    b.rolls(4, skew, {"lat_fwd_ratio_m{w}": M}, three, 4)
    has = axis.has & centre.has
    for name, x in (("forward_ratio_{w}", ahead > 1.0), ("backward_ratio_{w}", ahead < -1.0), ("lateral_dom_ratio_{w}", wide > far)):
        b.rolls(4, _given(has, ind(x)), {name: M}, two, 5)
    off = F.atan2(v.y, v.x) - F.atan2(axis.y, axis.x)
    slip = b.let(2, "slip_angle", F.atan2(F.sin(off), F.cos(off)))
    slip_abs = b.let(3, "slip_angle_abs", F.abs(slip))
    b.rolls(4, slip, {"slip_m{w}": M, "slip_s{w}": S}, three, 4)
    b.rolls(4, slip_abs, {"slip_abs_m{w}": M}, three, 4)
    b.rolls(4, _given(has, ind(slip_abs < math.pi / 6)), {"slip_align_ratio_{w}": M}, two, 5)


def _tremor(b: Layers, name: str, p: Point, full: bool) -> tuple[Point, Column]:
    """Short-window speed, acceleration and changes of direction of one point; its velocity and speed."""
    v = b.step(1, f"{name}_v", p, b.fps)
    speed = b.let(2, f"_{name}_speed", v.size)
    b.rolls(3, speed, {f"{name}_hf_m{{w}}": M, f"{name}_hf_s{{w}}": S} | ({f"{name}_hf_max{{w}}": MAX} if full else {}), [3, 5, 7], 2)
    a = b.step(2, f"{name}_a", v, b.fps)
    accel = b.let(3, f"{name}_accel", a.size)
    b.rolls(4, accel, {f"{name}_accel_m{{w}}": M} | ({f"{name}_accel_s{{w}}": S} if full else {}), [5, 10], 2)
    b.let(2, f"_{name}_swing", b.diff(F.atan2(v.y, v.x + F.lit(1e-8))))
    jitter = b.let(3, f"{name}_jitter", F.abs(wrap_once(F.col(f"_{name}_swing"))))
    b.rolls(4, jitter, {f"{name}_jitter_m{{w}}": M} | ({f"{name}_jitter_sum{{w}}": SUM} if full else {}), [5, 10, 15] if full else [5, 10], 2)
    return v, speed


def _micro(b: Layers, nose: Point | None, centre: Point | None, step: Point | None, tail: Point | None) -> None:
    head = _tremor(b, "head", nose, True) if nose is not None else None
    rear = _tremor(b, "tail", tail, False) if tail is not None else None
    if rear and centre is not None:
        own = Point(rear[0].x - step.x * b.fps, rear[0].y - step.y * b.fps, rear[0].has)
        speed = b.let(2, "tail_rel_speed", own.size)
        b.rolls(3, speed, {"tail_rel_m{w}": M}, [10, 20], 3)
    if head and rear:
        (hv, hs), (tv, ts) = head, rear
        share = b.let(3, "head_tail_speed_ratio", ratio(hs, ts))
        b.rolls(4, share, {"head_tail_ratio_m{w}": M}, [10, 20], 3)
        same = b.let(3, "head_tail_dir_consistency", F.try_divide(hv.dot(tv), (hs + 1e-6) * (ts + 1e-6)))
        b.rolls(4, same, {"head_tail_dir_m{w}": M}, [10, 20, 30], 3)
        apart = b.let(4, "head_tail_independence", (1.0 - F.abs(same)) * (hs + ts))
        b.rolls(5, apart, {"head_tail_indep_m{w}": M}, [15, 30], 3)


def _arena(b: Layers, section: int, nose: Point | None, centre: Point) -> None:
    """The place within the arena. Its walls are the track's own extremes, its size is declared."""
    w, h = F.col("arena_width_cm"), F.col("arena_height_cm")
    shape = F.lower(F.coalesce(F.col("arena_shape"), F.lit("")))
    round_ = shape.contains("circle") | shape.contains("circular") | shape.contains("round")
    known = F.coalesce((w > 0) & (h > 0), F.lit(False)) & centre.has
    small = F.least(w, h)
    x0, x1, y0, y1 = (F.col(n) for n in EXTREMES)
    mid = Point((x0 + x1) / 2, (y0 + y1) / 2, centre.has)
    away = (centre - mid).size
    sides = {"left": centre.x - x0, "right": x1 - centre.x, "bottom": centre.y - y0, "top": y1 - centre.y}
    for name, d in sides.items():
        b.let(3, f"dist_to_{name}_wall", _given(known & ~round_, d))
    wall = F.when(round_, clip(small / 2 - away, 0)).otherwise(F.least(*sides.values()))
    corner = F.least(*[norm(centre.x - x, centre.y - y) for x in (x0, x1) for y in (y0, y1)])
    b.let(3, "dist_to_arena_center", _given(known, away))
    b.let(3, "dist_to_center_norm", _given(known, ratio(away, F.when(round_, small / 2).otherwise(norm(w / 2, h / 2)))))
    b.let(3, "dist_to_nearest_wall", _given(known, wall))
    b.let(3, "dist_to_wall_norm", _given(known, ratio(wall, small / 2)))
    b.let(3, "dist_to_nearest_corner", _given(known & ~round_, corner))
    near = F.when(round_, small / 2 * 0.15).otherwise(small * 0.15)
    b.let(3, "is_near_wall", _given(known, ind(wall < near)))
    b.let(3, "is_in_center", _given(known, ind(away < F.when(round_, small / 2 * 0.3).otherwise(small * 0.3))))
    b.let(3, "is_in_corner", _given(known, F.when(round_, F.lit(0.0)).otherwise(ind(corner < small * 0.2))))
    if nose is None:
        return
    head, inward = nose - centre, mid - centre
    ux, uy = ratio(head.x, head.size), ratio(head.y, head.size)
    least = F.least(*sides.values())
    toward = F.when(sides["left"] == least, -ux).when(sides["right"] == least, ux).when(sides["bottom"] == least, -uy).when(sides["top"] == least, uy)
    outward = -(ux * ratio(inward.x, inward.size) + uy * ratio(inward.y, inward.size))
    facing = b.let(3, "facing_nearest_wall", _given(known & nose.has, F.when(round_, outward).otherwise(toward)))
    b.rolls(4, facing, {"facing_wall_m{w}": M}, [15, 30] if section == 9 else FOUR, 4)


def _streaks_and_means(b: Layers, section: int, miss: Column, nose_ok: Column, centre_ok: Column) -> None:
    for x, name in ((miss, "kp_missing_m{w}"), (nose_ok, "nose_ok_m{w}"), (centre_ok, "center_ok_m{w}")):
        b.rolls(1, x, {name: M}, [20, 40, 60, 80] if section == 9 else FOUR, 5)


GROUPS = ("missing", "shape", "motion", "head", "micro", "arena")


#: Extremes of a track's centre.
EXTREMES = {"_x0": F.min, "_x1": F.max, "_y0": F.min, "_y1": F.max}


def single_features(df: DataFrame, parts: list[str], section: int, keys: list[str], frame: str = "frame", groups: tuple[str, ...] = GROUPS, names: list[str] | None = None) -> DataFrame:
    """(keys, frame, features) of wide tracks: ``<part>_x``, ``<part>_y``, ``has_<part>``, fps, and the arena's
    width, height and shape. All frame rates share one plan; all windows share one shuffle, of blocks of rows.

    ``groups``, and ``names`` of features, limit what is computed. Features are floats in a fixed order.
    """
    rows, of = _features(df, parts, (section,), keys, frame, groups, names)
    return rows.select(*keys, frame, *[F.col(f"`{own}`").cast("float").alias(n) for n, own in of[section].items()])


def sectioned_features(df: DataFrame, parts: list[str], sections: tuple[int, ...], keys: list[str], frame: str = "frame", groups: tuple[str, ...] = GROUPS, shown: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(section, keys, frame, features): each row once a section. What the sections share is computed once, ``shown`` (how a
    feature is given) included."""
    rows, of = _features(df, parts, sections, keys, frame, groups, None)
    every = list(dict.fromkeys(n for own in of.values() for n in own))
    made = {c: shown(F.col(f"`{c}`").cast("float")) for own in of.values() for c in own.values()}
    rows = rows.select(*keys, frame, *[x.alias(c) for c, x in made.items()])
    nothing = shown(F.lit(None).cast("float"))
    value = lambda own, n: (F.col(f"`{own[n]}`") if n in own else nothing).alias(n)
    per = [F.struct(F.lit(s).alias("section"), *[value(own, n) for n in every]) for s, own in of.items()]
    return rows.select(*keys, frame, F.inline(F.array(*per))).select("section", *keys, frame, *[F.col(f"`{n}`") for n in every])


def _features(df: DataFrame, parts: list[str], sections: tuple[int, ...], keys: list[str], frame: str, groups: tuple[str, ...], only: list[str] | None) -> tuple[DataFrame, dict[int, dict[str, str]]]:
    """Rows with the features' columns, and for each section the column of each feature."""
    b, of = Layers(), {}
    for section in sections:
        b.section(section)
        miss, nose_ok, centre_ok = missing_layer(b, parts, "", "")
        if "missing" in groups:
            _streaks_and_means(b, section, miss, nose_ok, centre_ok)
        nose, centre = first_available(nose_options(parts)), first_available(centre_options(parts))
        nose = b.point(-1, "n", nose) if nose is not None else None
        centre = b.point(-1, "c", centre) if centre is not None else None
        tail = part("tail_base") if "tail_base" in parts else None
        moving = centre is not None and any(g in groups for g in ("motion", "head", "micro"))
        step = b.step(1, "c_v", centre) if moving else None
        if "shape" in groups:
            _shape(b, parts, section, nose, centre)
        if centre is not None and "motion" in groups:
            _motion(b, section, centre, step)
        if centre is not None and nose is not None and "head" in groups:
            _head_and_axis(b, section, nose, centre, step, tail)
        if "micro" in groups:
            _micro(b, nose, centre, step, tail)
        if centre is not None and "arena" in groups:
            _arena(b, section, nose, centre)
        of[section] = {n: own for n, own in b.names.items() if "missing" in groups or not (n.startswith(("kp_", "nose_ok_", "center_ok_")) or n.endswith("_proxy_ok"))}
    whole, carry = {}, []
    if "missing" in groups:
        carry = [Roll(f"{n}_missing_streak", "streak", (f"_{n}_gone",)) for n in ("nose", "center")]
    if centre is not None and "motion" in groups:
        carry += [Roll(f"{axis}_e{s}", "ewm", (f"_c_{axis}",), s) for s in (30, 60, 120) for axis in "xy"]
    if only is not None:
        carry = [r for r in carry if r.name in only]
    if centre is not None and "arena" in groups:
        whole = {n: f(f"_c_{n[1]}") for n, f in EXTREMES.items()}
    for own in of.values():
        own |= {r.name: r.name for r in carry}
        if only is not None:
            own.update({n: own.pop(n) for n in only})
            for n in [n for n in own if n not in only]:
                del own[n]
    names = list(dict.fromkeys(c for own in of.values() for c in own.values()))
    read = {*names, *(c for r in carry for c in r.columns), *(f"_c_{n[1]}" for n in whole), *(f"_c_{a}" for a in "xy" if centre is not None and "motion" in groups)}
    gone = any(c.endswith("_gone") for r in carry for c in r.columns)
    b.only(read | ({"nose_proxy_ok", "center_proxy_ok"} if gone else set()))
    t = Tracks(keys, frame)
    fps = F.coalesce(F.col("fps").cast("double"), F.lit(REFERENCE_FPS))
    rows = b.before_blocks(df, [*keys, frame, "fps"])
    if gone:
        rows = rows.withColumns({"_nose_gone": ind(nose_ok < 0.5), "_center_gone": ind(centre_ok < 0.5)})
    bounded = {f"_c_{a}" for a in "xy"} if any(b.reads(f"_w__c_{a}") for a in "xy") else set()
    b.wanted[LAST] += carry
    rows = b.apply(in_blocks(rows, t, *b.reach(), fps, whole, carry, limits=dict.fromkeys(sorted(bounded), (0.01, 0.99))), t, [*keys, frame, *names])
    return rows.where("_own"), of
