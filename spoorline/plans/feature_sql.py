"""DuckDB SQL of the track features, written apart from the plans that it is compared with.

A statement is a chain of selects, each of which adds columns; windows read columns of the selects before.
"""

from __future__ import annotations

import itertools

from ..functions.frames import scale, scale_signed

FOUR, THREE = (15, 30, 60, 120), (15, 30, 60)


class Chain:
    """Columns by step; names that begin with _ are private."""

    def __init__(self, source: str, keys: list[str], parts: list[str], fps: float) -> None:
        self.source, self.keys, self.parts, self.fps = source, keys, parts, fps
        self.by = f"partition by {', '.join(keys)} order by frame"
        self.steps: dict[int, list[str]] = {}
        self.names: list[str] = []

    def add(self, step: int, name: str, expression: str) -> str:
        self.steps.setdefault(step, []).append(f'{expression} as "{name}"')
        if not name.startswith("_"):
            self.names.append(name)
        return f'"{name}"'

    def n(self, frames: float) -> int:
        return scale(frames, self.fps)

    def lag(self, x: str, rows: int = 1) -> str:
        return f"lag({x}, {rows}) over ({self.by})" if rows >= 0 else f"lead({x}, {-rows}) over ({self.by})"

    def diff(self, x: str) -> str:
        return f"({x} - {self.lag(x)})"

    def back(self, rows: int) -> str:
        return f"over ({self.by} rows between {rows - 1} preceding and current row)"

    def around(self, rows: int) -> str:
        return f"over ({self.by} rows between {rows // 2} preceding and {(rows - 1) // 2} following)"

    def whole(self) -> str:
        return f"over (partition by {', '.join(self.keys)})"

    def roll(self, agg: str, x: str, over: str, least: int) -> str:
        return f"case when count({x}) {over} >= {least} then {agg}({x}) {over} end"

    def rolls(self, step: int, x: str, names: dict[str, str], windows: tuple, share: int | None, back: bool = False, least: int | None = None) -> None:
        """``share``: least known values are a window's rows over it; without it all rows."""
        for w in windows:
            rows = self.n(w)
            k = least if least is not None else rows if share is None else max(1, rows // share)
            for name, agg in names.items():
                self.add(step, name.format(w=w), self.roll(agg, x, self.back(rows) if back else self.around(rows), k))

    def select(self, extra: str = "") -> str:
        sql = self.source
        for step in sorted(self.steps):
            sql = f"(select *, {', '.join(self.steps[step])} from {sql})"
        out = ", ".join(f'cast(cast("{n}" as float) as double) as "{n}"' for n in self.names)
        return f"select {', '.join(self.keys)}, frame, {extra}{out} from {sql}"


class P:
    """x, y and presence as SQL."""

    def __init__(self, x: str, y: str, has: str) -> None:
        self.x, self.y, self.has = x, y, has

    def __sub__(self, o: P) -> P:
        return P(f"({self.x} - {o.x})", f"({self.y} - {o.y})", f"({self.has} and {o.has})")

    def mid(self, o: P) -> P:
        return P(f"(({self.x} + {o.x}) / 2)", f"(({self.y} + {o.y}) / 2)", f"({self.has} and {o.has})")

    def times(self, k: float) -> P:
        return P(f"({self.x} * {k})", f"({self.y} * {k})", self.has)

    @property
    def sq(self) -> str:
        return f"({self.x} * {self.x} + {self.y} * {self.y})"

    @property
    def len(self) -> str:
        return f"sqrt({self.sq})"

    @property
    def seen(self) -> str:
        return f"({self.has} and {self.x} is not null and {self.y} is not null)"

    def dot(self, o: P) -> str:
        return f"({self.x} * {o.x} + {self.y} * {o.y})"

    def cross(self, o: P) -> str:
        return f"({self.x} * {o.y} - {self.y} * {o.x})"


def part(name: str, side: str = "") -> P:
    return P(f"{side}{name}_x", f"{side}{name}_y", f"{side}has_{name}")


def over(a: str, b: str) -> str:
    return f"({a} / ({b} + 1e-6))"


def flag(condition: str) -> str:
    return f"cast(coalesce({condition}, false) as double)"


def given(has: str, x: str) -> str:
    return f"case when {has} then {x} end"


def wrapped(a: str) -> str:
    return f"case when {a} > pi() then {a} - 2 * pi() when {a} < -pi() then {a} + 2 * pi() else {a} end"


def stand_in(options: list[P]) -> P:
    pick = lambda f: "case " + " ".join(f"when {p.has} then {f(p)}" for p in options) + " end"
    return P(pick(lambda p: p.x), pick(lambda p: p.y), "(" + " or ".join(p.has for p in options) + ")")


def nose_of(parts: list[str], side: str = "") -> P:
    p = {n: part(n, side) for n in parts}
    return stand_in([p[n] for n in ("nose", "head") if n in p] + ([p["ear_left"].mid(p["ear_right"])] if {"ear_left", "ear_right"} <= set(p) else []))


def centre_of(parts: list[str], side: str = "") -> P:
    p = {n: part(n, side) for n in parts}
    two = [p[a].mid(p[b]) for a, b in (("nose", "tail_base"), ("head", "tail_base"), ("ear_left", "ear_right")) if a in p and b in p]
    return stand_in([p[n] for n in ("body_center", "neck") if n in p] + two)


def _kept(b: Chain, step: int, name: str, p: P) -> P:
    return P(b.add(step, f"_{name}_x", p.x), b.add(step, f"_{name}_y", p.y), p.has)


def _moved(b: Chain, step: int, name: str, p: P, times: float = 1.0) -> P:
    return _kept(b, step, name, P(f"({b.diff(p.x)} * {times})", f"({b.diff(p.y)} * {times})", p.has))


def _missing(b: Chain, side: str) -> tuple[str, str, str]:
    every = [part(p, side) for p in b.parts]
    ok = " + ".join(f"cast({p.seen} as double)" for p in every)
    total = " + ".join(f"cast({p.has} as double)" for p in every)
    if not side:
        b.add(0, "kp_ok_cnt", ok)
    ratio = b.add(0, f"{side}kp_missing_ratio", f"1 - ({ok}) / (greatest({total}, 1.0) + 1e-6)")
    nose = b.add(0, f"{side}nose_proxy_ok", flag(nose_of(b.parts, side).seen))
    centre = b.add(0, f"{side}center_proxy_ok", flag(centre_of(b.parts, side).seen))
    return ratio, nose, centre


def _streak(b: Chain, name: str, ok: str) -> None:
    b.add(1, f"_i_{name}", f"sum(case when {ok} < 0.5 then 0 else 1 end) over ({b.by})")
    b.add(2, name, f"case when {ok} < 0.5 then row_number() over (partition by {', '.join(b.keys)}, \"_i_{name}\" order by frame) else 0 end")


def single(source: str, keys: list[str], parts: list[str], fps: float, section: int, group: str) -> Chain:
    """The columns of one feature group of single tracks."""
    b = Chain(source, keys, parts, fps)
    nine = section == 9
    p = {n: part(n) for n in parts}
    if group == "missing":
        ratio, nose_ok, centre_ok = _missing(b, "")
        for x, name in ((ratio, "kp_missing_m{w}"), (nose_ok, "nose_ok_m{w}"), (centre_ok, "center_ok_m{w}")):
            b.rolls(1, x, {name: "avg"}, (20, 40, 60, 80) if nine else FOUR, 5)
        _streak(b, "nose_missing_streak", nose_ok)
        _streak(b, "center_missing_streak", centre_ok)
        return b
    nose, centre = _kept(b, 0, "n", nose_of(parts)), _kept(b, 0, "c", centre_of(parts))
    tail, v = p["tail_base"], _moved(b, 1, "v", centre)
    {"shape": _shape, "motion": _motion, "head": _head, "micro": _micro, "arena": _arena}[group](b, section, p, nose, centre, tail, v)
    return b


def _shape(b: Chain, section: int, p: dict[str, P], nose: P, centre: P, tail: P, v: P) -> None:
    nine = section == 9
    for one, two in itertools.combinations(b.parts, 2):
        b.add(0, f"{one}+{two}", given((p[one] - p[two]).has, (p[one] - p[two]).sq))
    b.add(1, "elong", over('"nose+tail_base"', '"ear_left+ear_right"'))
    left, right = p["ear_left"], p["ear_right"]
    far = b.n(10)
    for name, a, o in (("sp_lf", left, left), ("sp_rt", right, right), ("sp_lf2", left, tail), ("sp_rt2", right, tail)):
        b.add(1, name, given(f"{left.has} and {right.has} and {tail.has}", f"power({a.x} - {b.lag(o.x, far)}, 2) + power({a.y} - {b.lag(o.y, far)}, 2)"))
    gap = b.add(0, "_gap", (left - right).len)
    for off in (-30, -20, -10, 10, 20, 30):
        b.add(1, f"ear_o{off}", b.lag(gap, -scale_signed(off, b.fps)))
    f = b.around(b.n(30))
    b.add(1, "ear_con", over(f"stddev_samp({gap}) {f}", f"avg({gap}) {f}"))
    mid = _kept(b, 0, "mid", left.mid(right))
    sd = lambda x: b.roll("stddev_samp", x, b.back(b.n(30)), b.n(5))
    b.add(1, "_sx", sd(mid.x))
    b.add(1, "_sy", sd(mid.y))
    b.add(2, "ear_mid_std", 'sqrt("_sx" * "_sx" + "_sy" * "_sy")')
    off = b.add(1, "ear_center_dist", (mid - centre).len)
    b.add(1, "ear_nose_dist", (mid - nose).len)
    b.add(1, "ear_nose_center_angle", over((mid - nose).dot(centre - nose), f"{(mid - nose).len} * {(centre - nose).len}"))
    b.rolls(2, off, {"ear_center_m{w}": "avg", "ear_center_s{w}": "stddev_samp"}, (30, 60) if nine else FOUR, 4)
    length = b.add(1, "_nt", (nose - tail).len)
    for w in (10, 20, 40):
        b.add(2, f"nt_lg{w}", b.lag(length, b.n(w)))
        b.add(2, f"nt_df{w}", f"{length} - {b.lag(length, b.n(w))}")
    b.add(2, "nose_tail_length_std", b.roll("stddev_samp", length, b.back(b.n(30)), b.n(5)))
    u, w_ = nose - centre, tail - centre
    b.add(1, "body_ang", over(u.dot(w_), f"{u.len} * {w_.len}"))
    twice = f"abs(({centre.x} - {nose.x}) * ({tail.y} - {nose.y}) - ({centre.y} - {nose.y}) * ({tail.x} - {nose.x}))"
    area = b.add(1, "tri_area", f"{twice} / 2")
    b.add(1, "tri_front_back_ratio", over(u.len, w_.len))
    rim = f"({u.len} + {w_.len} + {(nose - tail).len})"
    b.add(1, "tri_compactness", over(f"({twice} / 2)", f"{rim} * {rim}"))
    b.rolls(2, area, {"tri_area_m{w}": "avg", "tri_area_s{w}": "stddev_samp"}, (15, 30) if nine else FOUR, 4)
    if section > 3 and section != 8:
        up = b.add(1, "_up", given(tail.has, f"{nose.y} - {centre.y}"))
        b.rolls(2, up, {"head_elev_mean_{w}": "avg", "head_elev_std_{w}": "stddev_samp"}, (10, 20, 30), None)
        b.rolls(2, b.add(1, "_rise", given(f"{tail.has} and {centre.has}", f"{nose.y} - {tail.y}")), {"body_vert_{w}": "avg"}, (10, 20, 30), None)
    if section != 3 and {"lateral_left", "lateral_right"} <= set(b.parts):
        wide = b.add(0, "_wide", (p["lateral_left"] - p["lateral_right"]).len)
        b.rolls(1, wide, {"body_width_mean_{w}": "avg", "body_width_std_{w}": "stddev_samp"}, FOUR, None)
        b.rolls(2, b.add(1, "_grown", b.diff(wide)), {"body_width_change_{w}": "avg"}, FOUR, None)


def _motion(b: Chain, section: int, p: dict[str, P], nose: P, centre: P, tail: P, v: P) -> None:
    nine = section == 9
    rows = b.add(0, "_rows", f"count(*) {b.whole()}")
    for axis, x, d in (("x", centre.x, v.x), ("y", centre.y, v.y)):
        windows = (5, 15, 30, 60) if nine else FOUR
        b.rolls(1, x, {f"c{axis}_m{{w}}": "avg", f"c{axis}_s{{w}}": "stddev_samp"}, windows, None, least=1)
        lo, hi = (b.add(1, f"_{axis}{q}", f"quantile_cont({x}, {q}) {b.whole()}") for q in (0.01, 0.99))
        bounded = b.add(2, f"_w{axis}", f"case when {x} is not null then least(greatest({x}, {lo}), {hi}) end")
        for w in windows:
            f, g = b.around(b.n(w)), b.back(b.n(w))
            b.add(3, f"{axis}_rng{w}", f"max({bounded}) {f} - min({bounded}) {f}")
            b.add(2, f"_sum{axis}{w}", f"sum({d}) {g}")
            b.add(2, f"_var{axis}{w}", f"var_samp({d}) {g}")
        for span in (30, 60, 120):
            a = 1 - 2 / (b.n(span) + 1)
            decay = f"power({a!r}::double, -frame)"
            b.add(1, f"{axis}_e{span}", f"sum({x} * {decay}) over ({b.by}) / sum(case when {x} is not null then {decay} end) over ({b.by})")
    for w in (5, 15, 30, 60) if nine else FOUR:
        b.add(3, f"disp{w}", f'sqrt("_sumx{w}" * "_sumx{w}" + "_sumy{w}" * "_sumy{w}")')
        b.add(3, f"act{w}", f'sqrt("_varx{w}" + "_vary{w}")')
    a = _moved(b, 2, "a", v)
    bend = b.add(3, "_bend", over(f"abs({v.cross(a)})", f"power({v.len}, 3)"))
    b.rolls(4, bend, {"curv_mean_{w}": "avg"}, (25, 50, 75) if nine else FOUR, 5, back=True)
    turn = b.add(2, "_turn", f"abs({b.diff(f'atan2({v.y}, {v.x})')})")
    b.rolls(3, turn, {"turn_rate_{w}": "sum"}, (30,) if nine else FOUR, 5, back=True)
    speed = b.add(2, "_speed", f"({v.len} * {b.fps})")
    scales = (20, 40, 60, 80) if nine else FOUR
    for w in scales:
        n = b.n(w)
        g, least = b.back(n), max(1, n // 4)
        gate = f"{rows} >= {n} and count({speed}) {g} >= {least}"
        b.add(3, f"sp_m{w}", f"case when {gate} then avg({speed}) {g} end")
        b.add(3, f"sp_s{w}", f"case when {gate} then stddev_samp({speed}) {g} end")
        b.add(3, f"sp_q25_{w}", f"case when {gate} then quantile_cont({speed}, 0.25) {g} end")
        b.add(3, f"sp_q75_{w}", f"case when {gate} then quantile_cont({speed}, 0.75) {g} end")
        b.add(4, f"sp_iqr{w}", f'"sp_q75_{w}" - "sp_q25_{w}"')
    b.add(4, "sp_ratio", over(f'"sp_m{scales[0]}"', f'"sp_m{scales[-1]}"'))
    n = b.n(15)
    calm = b.add(3, "_calm", b.roll("avg", speed, b.back(n), max(1, n // 3)))
    state = b.add(4, "_state", f"case when {calm} <= 0.5 then 0 when {calm} <= 2 then 1 when {calm} <= 5 then 2 when {calm} is not null then 3 end")
    moved = b.add(5, "_moved", f"cast({state} is null or {b.lag(state)} is null or {state} <> {b.lag(state)} as double)")
    for w in scales:
        n = b.n(w)
        g, least, long = b.back(n), max(1, n // 5), f"{rows} >= {n} and {centre.has}"
        for k in range(4):
            own = b.add(5, f"_s{k}_{w}", flag(f"{state} = {k}"))
            b.add(6, f"s{k}_{w}", f"case when {long} then {b.roll('avg', own, g, least)} end")
        b.add(6, f"trans_{w}", f"case when {long} then {b.roll('sum', moved, g, least)} end")
    for w in (30, 60, 120):
        n = b.n(w)
        g, least, long = b.back(n), max(5, n // 6), f"{rows} >= {n}"
        for axis, x in (("x", centre.x), ("y", centre.y)):
            b.add(1, f"{axis}_ml{w}", f"case when {long} then {b.roll('avg', x, g, least)} end")
        every = b.add(3, f"_l{w}", f"list({speed}) filter (where {speed} is not null) {g}")
        rank = f"(len(list_filter({every}, lambda e: e < {speed})) + (len(list_filter({every}, lambda e: e = {speed})) + 1) / 2.0) / len({every})"
        b.add(4, f"sp_pct{w}", f"case when {long} and {speed} is not null and len({every}) >= {least} then {rank} end")


def _head(b: Chain, section: int, p: dict[str, P], nose: P, centre: P, tail: P, v: P) -> None:
    nine, fps = section == 9, b.fps
    rel = _kept(b, 1, "rel", nose - centre)
    turned = _moved(b, 2, "relv", rel, fps)
    speed = b.add(3, "head_rel_speed", turned.len)
    b.add(3, "head_body_speed_ratio", over(turned.len, f"{v.len} * {fps}"))
    b.rolls(4, speed, {"head_rel_sp_m{w}": "avg", "head_rel_sp_s{w}": "stddev_samp"}, THREE if nine else FOUR, 4)
    spin = b.add(2, "_spin", b.diff(f"atan2({rel.y}, {rel.x})"))
    turn = b.add(3, "head_turn_speed", f"abs({wrapped(spin)}) * {fps}")
    b.rolls(4, turn, {"head_turn_m{w}": "avg", "head_turn_s{w}": "stddev_samp", "head_turn_sum{w}": "sum"}, (15, 30) if nine else FOUR, 4)
    axis = _kept(b, 1, "axis", nose - tail)
    vel = v.times(fps)
    ahead = b.add(3, "v_forward", over(vel.dot(axis), axis.len))
    aside = b.add(3, "v_lateral", over(axis.cross(vel), axis.len))
    far, wide = b.add(4, "v_forward_abs", f"abs({ahead})"), b.add(4, "v_lateral_abs", f"abs({aside})")
    skew = b.add(5, "lat_over_fwd", over(wide, far))
    three, two = (THREE, (30, 60)) if nine else (FOUR, FOUR)
    off = b.add(2, "_off", f"atan2({vel.y}, {vel.x}) - atan2({axis.y}, {axis.x})")
    slip = b.add(3, "slip_angle", f"atan2(sin({off}), cos({off}))")
    slip_abs = b.add(4, "slip_angle_abs", f"abs({slip})")
    for x, names in ((ahead, {"v_fwd_m{w}": "avg", "v_fwd_s{w}": "stddev_samp"}), (far, {"v_fwd_abs_m{w}": "avg"}), (aside, {"v_lat_m{w}": "avg", "v_lat_s{w}": "stddev_samp"}), (wide, {"v_lat_abs_m{w}": "avg"}), (skew, {"lat_fwd_ratio_m{w}": "avg"}), (slip, {"slip_m{w}": "avg", "slip_s{w}": "stddev_samp"}), (slip_abs, {"slip_abs_m{w}": "avg"})):
        b.rolls(6, x, names, three, 4)
    has = f"{axis.has} and {centre.has}"
    for name, condition in (("forward_ratio", f"{ahead} > 1.0"), ("backward_ratio", f"{ahead} < -1.0"), ("lateral_dom_ratio", f"{wide} > {far}"), ("slip_align_ratio", f"{slip_abs} < pi() / 6")):
        b.rolls(6, b.add(5, f"_{name}", given(has, flag(condition))), {name + "_{w}": "avg"}, two, 5)


def _tremor(b: Chain, name: str, p: P, full: bool) -> tuple[P, str]:
    v = _moved(b, 1, f"{name}_v", p, b.fps)
    speed = b.add(2, f"_{name}_speed", v.len)
    b.rolls(3, speed, {f"{name}_hf_m{{w}}": "avg", f"{name}_hf_s{{w}}": "stddev_samp"} | ({f"{name}_hf_max{{w}}": "max"} if full else {}), (3, 5, 7), 2)
    a = _moved(b, 2, f"{name}_a", v, b.fps)
    accel = b.add(3, f"{name}_accel", a.len)
    b.rolls(4, accel, {f"{name}_accel_m{{w}}": "avg"} | ({f"{name}_accel_s{{w}}": "stddev_samp"} if full else {}), (5, 10), 2)
    swing = b.add(2, f"_{name}_swing", b.diff(f"atan2({v.y}, {v.x} + 1e-8)"))
    jitter = b.add(3, f"{name}_jitter", f"abs({wrapped(swing)})")
    b.rolls(4, jitter, {f"{name}_jitter_m{{w}}": "avg"} | ({f"{name}_jitter_sum{{w}}": "sum"} if full else {}), (5, 10, 15) if full else (5, 10), 2)
    return v, speed


def _micro(b: Chain, section: int, p: dict[str, P], nose: P, centre: P, tail: P, v: P) -> None:
    (hv, hs), (tv, ts) = _tremor(b, "head", nose, True), _tremor(b, "tail", tail, False)
    own = tv - v.times(b.fps)
    b.rolls(4, b.add(3, "tail_rel_speed", own.len), {"tail_rel_m{w}": "avg"}, (10, 20), 3)
    b.rolls(4, b.add(3, "head_tail_speed_ratio", over(hs, ts)), {"head_tail_ratio_m{w}": "avg"}, (10, 20), 3)
    same = b.add(3, "head_tail_dir_consistency", f"{hv.dot(tv)} / (({hs} + 1e-6) * ({ts} + 1e-6))")
    b.rolls(4, same, {"head_tail_dir_m{w}": "avg"}, (10, 20, 30), 3)
    apart = b.add(4, "head_tail_independence", f"(1 - abs({same})) * ({hs} + {ts})")
    b.rolls(5, apart, {"head_tail_indep_m{w}": "avg"}, (15, 30), 3)


def _arena(b: Chain, section: int, p: dict[str, P], nose: P, centre: P, tail: P, v: P) -> None:
    w, h = "arena_width_cm", "arena_height_cm"
    rnd = "(lower(coalesce(arena_shape, '')) like '%circle%' or lower(coalesce(arena_shape, '')) like '%circular%' or lower(coalesce(arena_shape, '')) like '%round%')"
    known, small = f"(coalesce({w} > 0 and {h} > 0, false) and {centre.has})", f"least({w}, {h})"
    x0, x1, y0, y1 = (b.add(1, n, f"{f}({c}) {b.whole()}") for n, f, c in (("_x0", "min", centre.x), ("_x1", "max", centre.x), ("_y0", "min", centre.y), ("_y1", "max", centre.y)))
    mx, my = b.add(2, "_mx", f"({x0} + {x1}) / 2"), b.add(2, "_my", f"({y0} + {y1}) / 2")
    away = b.add(3, "_away", f"sqrt(power({centre.x} - {mx}, 2) + power({centre.y} - {my}, 2))")
    sides = {n: b.add(3, f"_{n}", e) for n, e in (("left", f"{centre.x} - {x0}"), ("right", f"{x1} - {centre.x}"), ("bottom", f"{centre.y} - {y0}"), ("top", f"{y1} - {centre.y}"))}
    least = f"least({', '.join(sides.values())})"
    for n, s in sides.items():
        b.add(4, f"dist_to_{n}_wall", given(f"{known} and not {rnd}", s))
    corners = ", ".join(f"sqrt(power({centre.x} - {x}, 2) + power({centre.y} - {y}, 2))" for x in (x0, x1) for y in (y0, y1))
    wall = b.add(4, "_wall", f"case when {centre.x} is null or {centre.y} is null then null when {rnd} then greatest({small} / 2 - {away}, 0) else {least} end")
    corner = b.add(4, "_corner", f"least({corners})")
    b.add(5, "dist_to_arena_center", given(known, away))
    b.add(5, "dist_to_center_norm", given(known, over(away, f"case when {rnd} then {small} / 2 else sqrt({w} * {w} + {h} * {h}) / 2 end")))
    b.add(5, "dist_to_nearest_wall", given(known, wall))
    b.add(5, "dist_to_wall_norm", given(known, over(wall, f"{small} / 2")))
    b.add(5, "dist_to_nearest_corner", given(f"{known} and not {rnd}", corner))
    b.add(5, "is_near_wall", given(known, flag(f"{wall} < 0.15 * case when {rnd} then {small} / 2 else {small} end")))
    b.add(5, "is_in_center", given(known, flag(f"{away} < 0.3 * case when {rnd} then {small} / 2 else {small} end")))
    b.add(5, "is_in_corner", given(known, f"case when {rnd} then 0.0 else {flag(f'{corner} < 0.2 * {small}')} end"))
    head = nose - centre
    ux, uy = b.add(2, "_ux", over(head.x, head.len)), b.add(2, "_uy", over(head.y, head.len))
    ix, iy = f"({mx} - {centre.x})", f"({my} - {centre.y})"
    long = f"sqrt({ix} * {ix} + {iy} * {iy})"
    out = f"-({ux} * {over(ix, long)} + {uy} * {over(iy, long)})"
    toward = f"case when {sides['left']} = {least} then -{ux} when {sides['right']} = {least} then {ux} when {sides['bottom']} = {least} then -{uy} when {sides['top']} = {least} then {uy} end"
    facing = b.add(4, "facing_nearest_wall", given(f"{known} and {nose.has}", f"case when {rnd} then {out} else {toward} end"))
    b.rolls(5, facing, {"facing_wall_m{w}": "avg"}, (15, 30) if section == 9 else FOUR, 4)


def pair(source: str, keys: list[str], parts: list[str], fps: float, group: str) -> Chain:
    """The columns of one feature group of ordered pairs."""
    b = Chain(source, keys, parts, fps)
    {"missing": _pair_missing, "posture": _posture, "ends": _ends, "chase": _chase, "bodies": _bodies, "contact": _contact}[group](b)
    return b


def _pair_missing(b: Chain) -> None:
    (ra, na, ca), (rb, nb, cb) = _missing(b, "A_"), _missing(b, "B_")
    mean = b.add(1, "AB_kp_missing_ratio_mean", f"({ra} + {rb}) / 2")
    b.add(1, "AB_kp_missing_ratio_diff", f"{ra} - {rb}")
    b.add(1, "AB_both_center_ok", f"{ca} * {cb}")
    b.rolls(2, mean, {"AB_miss_m{w}": "avg"}, FOUR, 5)
    _streak(b, "A_nose_missing_streak", na)
    _streak(b, "B_nose_missing_streak", nb)


def _posture(b: Chain) -> None:
    for one, two in itertools.product(b.parts, repeat=2):
        gap = part(one, "A_") - part(two, "B_")
        b.add(0, f"{one}+{two}", given(gap.has, gap.sq))
    b.add(1, "elong", over('"nose+tail_base"', '"ear_left+ear_right"'))
    ca, cb = part("body_center", "A_"), part("body_center", "B_")
    oa, ob = part("nose", "A_") - part("tail_base", "A_"), part("nose", "B_") - part("tail_base", "B_")
    has = f"({ca.has} and {cb.has} and {oa.has} and {ob.has})"
    ab, ba = cb - ca, ca - cb
    b.add(0, "A_face_B", given(has, over(oa.dot(ab), f"{oa.len} * {ab.len}")))
    b.add(0, "B_face_A", given(has, over(ob.dot(ba), f"{ob.len} * {ba.len}")))
    front, side, align = over(ba.dot(ob), ob.len), over(ob.cross(ba), ob.len), over(oa.dot(ob), f"{oa.len} * {ob.len}")
    b.add(0, "A_front_of_B", given(has, front))
    b.add(0, "A_side_of_B", given(has, side))
    b.add(0, "B_front_of_A", given(has, over(ab.dot(oa), oa.len)))
    b.add(0, "B_side_of_A", given(has, over(oa.cross(ab), oa.len)))
    b.add(0, "body_ori_alignment", given(has, align))
    score = b.add(0, "body_overlap_score", given(has, f"abs({align}) / ({ba.len} + 1)"))
    both = b.add(0, "body_overlap_binary", given(has, flag(f"{ba.len} < 8 and abs({align}) > 0.7")))
    above = b.add(0, "vertical_overlap", given(has, flag(f"abs({front}) < 3 and abs({side}) < 3 and {ba.len} < 8")))
    b.rolls(1, score, {"overlap_score_m{w}": "avg"}, THREE, 5)
    b.rolls(1, both, {"overlap_binary_p{w}": "avg"}, THREE, 5)
    b.rolls(1, above, {"vertical_overlap_p{w}": "avg"}, (15, 30), 5)


def _ends(b: Chain) -> None:
    gap = part("nose", "A_") - part("nose", "B_")
    square, far = b.add(0, "_nn2", gap.sq), b.add(0, "_nn", gap.len)
    close = b.add(1, "_close", given(gap.has, flag(f"{far} < 10")))
    for w in (10, 20, 40):
        n = b.n(w)
        b.add(1, f"appr_{w}", f"{square} - {b.lag(square, n)}")
        b.add(1, f"nn_lg{w}", b.lag(far, n))
        b.add(1, f"nn_ch{w}", f"{far} - {b.lag(far, n)}")
        b.add(2, f"cl_ps{w}", f"avg({close}) {b.back(n)}")
    tails = _kept(b, 0, "tails", part("tail_base", "B_") - part("tail_base", "A_"))
    dist = b.add(0, "tail_rel_dist", (part("tail_base", "B_") - part("tail_base", "A_")).len)
    v = _moved(b, 1, "tv", tails, b.fps)
    speed, near = b.add(2, "tail_rel_speed", v.len), b.add(1, "tail_approach_rate", f"-{b.diff(dist)} * {b.fps}")
    for x, name in ((dist, "tail_rel_dist_m{w}"), (speed, "tail_rel_speed_m{w}"), (near, "tail_approach_rate_m{w}")):
        b.rolls(3, x, {name: "avg"}, THREE, 5)
    has = f"({part('nose', 'A_').has} and {part('nose', 'B_').has} and {tails.has})"
    b.add(0, "tailA_noseB_dist", given(has, (part("tail_base", "A_") - part("nose", "B_")).len))
    b.add(0, "tailB_noseA_dist", given(has, (part("tail_base", "B_") - part("nose", "A_")).len))
    n = b.n(10)
    for ear in ("left", "right"):
        a, o = part(f"ear_{ear}", "A_"), part(f"ear_{ear}", "B_")
        has = f"({a.has} and {o.has})"
        for name, p, q in ((f"sp_A_{ear}", a, a), (f"sp_AB_{ear}", a, o), (f"sp_B_{ear}", o, o)):
            b.add(1, name, given(has, f"power({p.x} - {b.lag(q.x, n)}, 2) + power({p.y} - {b.lag(q.y, n)}, 2)"))


def _chase(b: Chain) -> None:
    ca, cb = _kept(b, 0, "ca", centre_of(b.parts, "A_")), _kept(b, 0, "cb", centre_of(b.parts, "B_"))
    rel = _kept(b, 1, "rel", ca - cb)
    far = b.add(1, "_far", (ca - cb).len)
    has = f"({ca.has} and {cb.has})"
    va, vb = _moved(b, 1, "va", ca), _moved(b, 1, "vb", cb)
    nearer = b.add(2, "_nearer", b.diff(far))
    back = rel.times(-1)
    al, bl = b.add(2, "A_vel_along", over(va.dot(rel), far)), b.add(2, "B_vel_along", over(vb.dot(back), far))
    ap, bp = b.add(2, "A_vel_perp", over(rel.cross(va), far)), b.add(2, "B_vel_perp", over(back.cross(vb), far))
    for s, v, own, other, across, chasing, closing in (("A", va, al, bl, ap, f"{al} > 0 and {nearer} < 0", f"-{nearer}"), ("B", vb, bl, al, bp, f"{bl} > 0 and {nearer} > 0", nearer)):
        escaping = f"{own} < 0 and {other} < 0" if s == "A" else f"{own} < 0 and {other} > 0"
        columns = (
            ("chasing_p", b.add(3, f"{s}_chasing", given(has, flag(chasing)))),
            ("chase_int_m", b.add(3, f"{s}_chase_intensity", over(f"{own} * ({closing})", v.len))),
            ("escaping_p", b.add(3, f"{s}_escaping", given(has, flag(escaping)))),
            ("sidestep_p", b.add(3, f"{s}_sidestepping", given(has, flag(f"abs({across}) > abs({own})")))),
        )
        for name, x in columns:
            b.rolls(4, x, {f"{s}_{name}{{w}}": "avg"}, THREE, 5)
        b.rolls(4, b.add(3, f"_{s}_toward", given(has, flag(f"{own} > 0"))), {f"{s}_chase_consist_{{w}}": "avg"}, (30, 60), 5)


def _bodies(b: Chain) -> None:
    fps = b.fps
    ca, cb = part("body_center", "A_"), part("body_center", "B_")
    has = f"({ca.has} and {cb.has})"
    rel = _kept(b, 0, "r", ca - cb)
    far, square = b.add(0, "_d", (ca - cb).len), b.add(0, "_d2", (ca - cb).sq)
    for name, c in (("v_cls", f"{far} < 5"), ("cls", f"{far} >= 5 and {far} < 15"), ("med", f"{far} >= 15 and {far} < 30"), ("far", f"{far} >= 30")):
        b.add(1, name, given(has, flag(c)))
    b.add(1, "interaction_potential", f"1 / ({far} + 1e-6)")
    closing = b.add(1, "_closing", f"-{b.diff(far)}")
    rate = b.add(2, "approach_rate", f"{closing} * {fps}")
    b.add(3, "sudden_escape", given(has, flag(f"{rate} < -20")))
    v = _moved(b, 1, "rv", rel, fps)
    a = _moved(b, 2, "ra", v, fps)
    acc, pace = b.add(3, "rel_accel", a.len), b.add(2, "_pace", v.len)
    spin = b.add(2, "_spin", b.diff(f"atan2({v.y}, {v.x})"))
    turn = b.add(3, "rel_turn_rate", f"abs({wrapped(spin)}) * {fps}")
    bend = b.add(4, "rel_curvature", over(turn, pace))
    for x, names in ((turn, {"rel_turn_rate_m{w}": "avg"}), (bend, {"rel_curvature_m{w}": "avg"}), (acc, {"rel_accel_m{w}": "avg"}), (pace, {"rel_speed_m{w}": "avg", "rel_speed_s{w}": "stddev_samp"})):
        b.rolls(5, x, names, THREE, 5)
    va, vb = _moved(b, 1, "va", ca), _moved(b, 1, "vb", cb)
    sa, sb, co = b.add(2, "_sa", va.len), b.add(2, "_sb", vb.len), b.add(2, "_co", va.dot(vb))
    b.rolls(3, co, {"co_m{w}": "avg", "co_s{w}": "stddev_samp"}, (5, *THREE), None, least=1)
    b.rolls(1, square, {"d_m{w}": "avg", "d_s{w}": "stddev_samp", "d_mn{w}": "min", "d_mx{w}": "max", "_dv{w}": "var_samp"}, (5, *THREE), None, least=1)
    for w in (5, *THREE):
        b.add(2, f"int{w}", f'1 / ("_dv{w}" + 1)')
    b.add(2, "int_con", over('"d_s30"', '"d_m30"'))
    same = b.add(3, "_same", over(co, f"{sa} * {sb}"))
    for off in (-30, -20, -10, 0, 10, 20, 30):
        b.add(4, f"va_{off}", b.lag(same, -scale_signed(off, fps)) if off else same)
    back = rel.times(-1)
    la, lb = b.add(2, "_la", over(va.dot(rel), f"{va.len} * {far}")), b.add(2, "_lb", over(vb.dot(back), f"{vb.len} * {far}"))
    for s, x in (("A", la), ("B", lb)):
        b.rolls(3, x, {f"{s}_ld{{w}}": "avg"}, (30, 60), 6, back=True)
    b.rolls(4, b.add(3, "_push", f"{closing} * {lb}"), {"chase_{w}": "avg"}, (30,), 6, back=True)
    x = b.add(3, "_pa", f"case when {sa} is not null and {sb} is not null then {sa} end")
    y = b.add(3, "_pb", f"case when {sa} is not null and {sb} is not null then {sb} end")
    for w in (60, 120):
        n = b.n(w)
        g = b.back(n)
        b.add(4, f"sp_cor{w}", f"case when count({x}) {g} >= {max(1, n // 6)} and isfinite(corr({x}, {y}) {g}) then corr({x}, {y}) {g} end")
    n = b.n(30)
    gap = b.add(3, "_gap", f"abs({sa} - {sb})")
    past = f"over ({b.by} rows between {n} preceding and 1 preceding)"
    b.add(4, "speed_dtw_distance", f"case when count(*) {b.whole()} > {n} and count({gap}) {past} = {n} then avg({gap}) {past} end")
    b.add(2, "leadership_asymmetry", f"{over(va.dot(rel), far)} - {over(vb.dot(back), far)}")
    way = b.add(2, "_way", f"atan2({va.y}, {va.x}) - atan2({vb.y}, {vb.x})")
    alike = b.add(3, "direction_similarity", f"cos({wrapped(way)})")
    even = b.add(3, "speed_similarity", f"1 - {over(f'abs({sa} - {sb})', f'{sa} + {sb}')}")
    b.rolls(4, alike, {"direction_sim_m{w}": "avg"}, (60, 120), 6)
    b.rolls(4, even, {"speed_sim_m{w}": "avg"}, (60, 120), 6)
    b.rolls(4, b.add(3, "speed_diff", f"{sa} - {sb}"), {"speed_diff_m{w}": "avg", "speed_diff_s{w}": "stddev_samp"}, THREE, 5)
    b.rolls(4, b.add(3, "speed_ratio", over(sa, sb)), {"speed_ratio_m{w}": "avg"}, THREE, 5)
    oa, ob = part("nose", "A_") - part("tail_base", "A_"), part("nose", "B_") - part("tail_base", "B_")
    ab, ba = cb - ca, ca - cb
    whole = f"({has} and {oa.has} and {ob.has})"
    skew = b.add(1, "facing_asymmetry", f"{given(whole, over(oa.dot(ab), f'{oa.len} * {ab.len}'))} - {given(whole, over(ob.dot(ba), f'{ob.len} * {ba.len}'))}")
    b.rolls(2, skew, {"facing_asym_m{w}": "avg"}, (15, 30), 5)
    for w in (30, 60):
        n = b.n(w)
        pa, pb = (b.add(3, f"_path{s}{w}", b.roll("sum", x, b.around(n), max(1, n // 5))) for s, x in (("a", sa), ("b", sb)))
        b.add(4, f"path_diff_{w}", f"{pa} - {pb}")
        b.add(4, f"path_ratio_{w}", over(pa, pb))
    aa, bb = _moved(b, 2, "aa", va, fps), _moved(b, 2, "bb", vb, fps)
    b.rolls(4, b.add(3, "accel_diff", f"{aa.len} - {bb.len}"), {"accel_diff_m{w}": "avg"}, (15, 30), 5)


def _contact(b: Chain) -> None:
    short = {"nose": "nose", "head": "head", "body_center": "center", "tail_base": "tail"}
    for s, o in (("A", "B"), ("B", "A")):
        front = nose_of(b.parts, f"{s}_")
        gaps = {p: f"({given(f'{front.has} and {part(p, o + "_").has}', (front - part(p, o + '_')).len)})" for p in b.parts}
        near = b.add(0, f"{s}_front_to_{o}_min", f"least({', '.join(gaps.values())})")
        for p, name in short.items():
            if p in gaps:
                b.add(0, f"{s}_front_to_{o}_{name}", gaps[p])
        for limit in (3, 5, 8):
            touch = b.add(1, f"{s}_front_contact_{limit}", given(front.has, flag(f"{near} < {limit}")))
            b.rolls(2, touch, {f"{s}_front_contact_{limit}_p{{w}}": "avg"}, THREE, 5)
        b.rolls(2, f'"{s}_front_contact_5"', {f"{s}_contact_duration_{{w}}": "sum"}, (30, 60), None, least=1)
