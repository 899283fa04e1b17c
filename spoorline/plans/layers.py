"""A registry of feature columns in layers: windows cannot nest in one projection, so each layer is one select."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Tracks, norm
from ..functions.rolling import PLACE, Roll, add, at_least, before, carried_columns, share

#: The layer of what is found last.
LAST = 1000


class Point:
    """Coordinates, and whether the track has the part (or what stands in for it) at all. ``steps``: the point it is fixed to,
    and the steps from there along x and y; then what lies between another point and it is subtracted step by step."""

    def __init__(self, x: Column, y: Column, has: Column, steps: tuple[Point, list[Column], list[Column]] | None = None) -> None:
        self.x, self.y, self.has, self.steps = x, y, has, steps

    def __sub__(self, other: Point) -> Point:
        if other.steps is not None:
            base, dx, dy = other.steps
            less = lambda a, own: reduce(lambda v, d: v - d, own, a)
            return Point(less(self.x - base.x, dx), less(self.y - base.y, dy), self.has & other.has)
        return Point(self.x - other.x, self.y - other.y, self.has & other.has)

    def middle(self, other: Point) -> Point:
        return Point((self.x + other.x) / 2, (self.y + other.y) / 2, self.has & other.has)

    @property
    def size(self) -> Column:
        return norm(self.x, self.y)

    @property
    def square(self) -> Column:
        return self.x * self.x + self.y * self.y

    def dot(self, other: Point) -> Column:
        return self.x * other.x + self.y * other.y

    def cross(self, other: Point) -> Column:
        return self.x * other.y - self.y * other.x

    @property
    def ok(self) -> Column:
        return self.has & self.x.isNotNull() & self.y.isNotNull()


class Layers:
    """Columns by layer. What a layer's columns take from other rows is found from columns of lower layers, in one pass over
    the blocks before the layer's expressions, or by Spark's windows where it is the row before and no pass went before;
    rolled outputs that nothing reads wait for one last pass, and columns of the rows alone that nothing reads are made
    behind it. Names that begin with _ are private.

    Several sections share the columns that they define alike; of one name with another definition each has its own."""

    def __init__(self) -> None:
        self.fps = F.col("_fps")
        self.at: dict[int, dict[str, Column]] = defaultdict(dict)
        self.wanted: dict[int, list[Roll]] = defaultdict(list)
        self.inputs: dict[int, dict[str, Column]] = defaultdict(dict)
        self.sections: dict[int, dict[str, str]] = {}
        self._known: dict[int, dict[str, str]] = defaultdict(dict)
        self._open: list[tuple[str, tuple[Column, ...], dict]] = []
        self._made: dict[str, tuple] = {}
        self._rolled: dict[str, int] = {}
        self._kinds: dict[tuple, str] = {}
        self._n, self._last = 0, None
        self.section(0)

    def section(self, section: int) -> None:
        """What is let from now on belongs to this section; ``names``: public name -> column."""
        self.names = self.sections.setdefault(section, {})

    def _named(self, name: str, definition: tuple) -> str:
        """The column of this name and definition: the name itself, unless another section means something else by it."""
        own, n = name, 1
        while self._made.setdefault(own, definition) != definition:
            own, n = f"{name}@{n}", n + 1
        if not name.startswith("_"):
            self.names[name] = own
        return own

    def let(self, layer: int, name: str, column: Column) -> Column:
        for made, columns, how in self._open:
            self._want(layer, made, columns, how)
        self._open.clear()
        own = self._named(name, (layer, str(column)))
        self.at[layer][own] = column
        return F.col(f"`{own}`")

    def _want(self, layer: int, name: str, columns: tuple[Column, ...], how: dict) -> None:
        before = self._rolled.get(name)
        if before is not None and before <= layer:
            return
        if before is not None:
            self.wanted[before] = [r for r in self.wanted[before] if r.name != name]
        own = []
        for c in columns:
            text = self._text(c)
            if text not in self._known[layer]:
                self._n += 1
                self._known[layer][text] = f"_i{self._n}"
                self.inputs[layer][f"_i{self._n}"] = c
            own.append(self._known[layer][text])
        self._rolled[name] = layer
        self.wanted[layer].append(Roll(name, columns=tuple(own), **how))

    def _text(self, c: Column) -> str:
        if self._last is None or self._last[0] is not c:
            self._last = (c, str(c))
        return self._last[1]

    def roll(self, kind: str, x: Column | tuple[Column, Column], rows: float = 1, frame: str = "trailing", least: Callable = at_least(1), **more) -> Column:
        """A statistic of other rows, for the column that is let next."""
        columns, how = x if isinstance(x, tuple) else (x,), {"kind": kind, "rows": rows, "frame": frame, "least": least, **more}
        key = (*map(self._text, columns), *sorted(how.items()))
        if key not in self._kinds:
            self._n += 1
            self._kinds[key] = f"_k{self._n}"
        self._open.append((self._kinds[key], columns, how))
        return F.col(self._kinds[key])

    def lag(self, x: Column, rows: int | None = None) -> Column:
        """The value one row before, or ``rows`` at the reference rate."""
        return self.roll("before", x) if rows is None else self.roll("shift", x, -rows)

    def shift(self, x: Column, ahead: int) -> Column:
        return self.roll("shift", x, ahead) if ahead else x

    def diff(self, x: Column) -> Column:
        return x - self.lag(x)

    def point(self, layer: int, name: str, p: Point) -> Point:
        return Point(self.let(layer, f"_{name}_x", p.x), self.let(layer, f"_{name}_y", p.y), p.has)

    def step(self, layer: int, name: str, p: Point, times: Column | None = None) -> Point:
        """Difference to the row before."""
        gap = Point(self.diff(p.x), self.diff(p.y), p.has)
        return self.point(layer, name, gap if times is None else Point(gap.x * times, gap.y * times, p.has))

    def rolls(self, layer: int, x: Column, names: dict[str, str], windows: list[int], divide: int | None, trailing: bool = False, least: Callable | None = None, early: bool = False, **more) -> None:
        """For each name pattern (``{w}``) -> statistic, and window; ``divide``: least values are the window's rows over it, or
        all of them. ``early``: for columns of this layer and later ones to read; else they are found last."""
        how = {"frame": "trailing" if trailing else "centred", "least": least or share(divide or 1), **more}
        at = layer if early else LAST
        for w in windows:
            for name, kind in names.items():
                own = {"kind": kind, "rows": w, **how}
                self._want(at, self._named(name.format(w=w), (self._text(x), *sorted(own.items()))), (x,), own)

    def reach(self) -> tuple[float, float]:
        """Rows behind and ahead that all layers together read."""
        return tuple(sum(max((r.reach()[side] for r in rolls), default=0) for rolls in self.wanted.values()) for side in (0, 1))

    def only(self, names: set[str]) -> None:
        """Leaves what the columns ``names`` read, and no other."""
        need = _Read(names)
        for layer in sorted({*self.at, *self.wanted}, reverse=True):
            self.at[layer] = {n: c for n, c in self.at[layer].items() if n in need}
            need.add(*map(str, self.at[layer].values()))
            self.wanted[layer] = [r for r in self.wanted[layer] if r.name in need]
            used = {c for r in self.wanted[layer] for c in r.columns}
            self.inputs[layer] = {n: c for n, c in self.inputs[layer].items() if n in used}
            self._known[layer] = {t: n for t, n in self._known[layer].items() if n in used}
            need.add(*self._known[layer])

    def reads(self, name: str) -> bool:
        read = _Read(())
        for layer in {*self.at, *self.wanted}:
            read.add(*self._texts(layer))
        return name in read

    def _texts(self, layer: int) -> list[str]:
        return [*self._known[layer], *map(str, self.at[layer].values())]

    def before_blocks(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``df`` with the columns of layers before 0, which read no other rows; of its own those that are read or kept."""
        read = _Read(keep)
        for layer in {*self.at, *self.wanted}:
            read.add(*self._texts(layer))
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in read])
        for layer in sorted(k for k in self.at if k < 0):
            df = df.withColumns(self.at.pop(layer))
        return df

    def apply(self, blocks: DataFrame, tracks: Tracks, keep: list[str]) -> DataFrame:
        """``blocks`` of ``tracks`` with all columns; what neither a later layer nor ``keep`` names does not go through its passes."""
        order = sorted({k for k in (*self.at, *self.wanted) if self.at.get(k) or self.wanted.get(k)})
        read = _Read(())
        for layer in order:
            read.add(*self._texts(layer))
        last = {n: c for n, c in self.at.get(0, {}).items() if n not in read}
        self.at[0] = {n: c for n, c in self.at.get(0, {}).items() if n not in last}
        carried = {c for rolls in self.wanted.values() for r in rolls for c in (*r.columns, *carried_columns(r))}
        passed = False
        for i, layer in enumerate(order):
            near = [] if passed else [r for r in self.wanted[layer] if r.kind == "before"]
            if near:
                blocks = before(blocks, tracks, near, self.inputs[layer])
            far = [r for r in self.wanted[layer] if r not in near]
            if far:
                passed = True
                later = _Read({*keep, *PLACE, *carried})
                later.add(*[t for k in order[i:] for t in self._texts(k)], *map(str, last.values()))
                blocks = blocks.select(*[F.col(f"`{c}`") for c in blocks.columns if c in later])
                used = {c for r in far for c in r.columns}
                blocks = add(blocks, far, {n: c for n, c in self.inputs[layer].items() if n in used})
            if self.at[layer]:
                blocks = blocks.withColumns(self.at[layer])
        return blocks.withColumns(last) if last else blocks


class _Read:
    """Names that are given or stand in the texts of expressions."""

    def __init__(self, names) -> None:
        self.words, self.text = set(names), ""

    def add(self, *texts: str) -> None:
        for t in texts:
            self.words.update(re.findall(r"\w+", t))
        self.text = "\n".join([self.text, *texts])

    def __contains__(self, name: str) -> bool:
        return name in self.words or (re.fullmatch(r"\w+", name) is None and name in self.text)


def part(name: str, side: str = "") -> Point:
    return Point(F.col(f"{side}{name}_x"), F.col(f"{side}{name}_y"), F.coalesce(F.col(f"{side}has_{name}"), F.lit(False)))


def first_available(options: list[Point]) -> Point | None:
    """The first option that the track has."""
    if not options:
        return None
    has = [p.has for p in options]
    pick = lambda cols: reduce(lambda w, c: w.when(c[0], c[1]), zip(has, cols, strict=True), F)
    return Point(pick([p.x for p in options]), pick([p.y for p in options]), reduce(lambda a, b: a | b, has))


def nose_options(parts: list[str], side: str = "") -> list[Point]:
    p = {n: part(n, side) for n in parts}
    out = [p[n] for n in ("nose", "head") if n in p]
    return out + ([p["ear_left"].middle(p["ear_right"])] if {"ear_left", "ear_right"} <= set(p) else [])


def centre_options(parts: list[str], side: str = "") -> list[Point]:
    p = {n: part(n, side) for n in parts}
    out = [p[n] for n in ("body_center", "neck") if n in p]
    for a, b in (("nose", "tail_base"), ("head", "tail_base"), ("ear_left", "ear_right")):
        if a in p and b in p:
            out.append(p[a].middle(p[b]))
    return out
