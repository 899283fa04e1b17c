"""Rolling statistics of tracks in blocks of rows.

A track is cut into blocks. Each goes with the rows of its neighbours that its frames reach (the halo), so one shuffle deals
even a single long track to many tasks. Passes over the sorted partitions then add the statistics of all frames of a layer;
what lies between them stays with Spark's expressions. For frames of w rows a block's rows lie in stretches of w: a frame
is the end of one stretch and the beginning of the next, so its moments are those of a suffix and of a prefix, merged. No
value outside a frame enters, and the time per row does not depend on w.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import REFERENCE_FPS, Tracks, scale, scale_signed
from .quantiles import track_quantiles, within

#: Least rows of a block; rows of whole blocks that a pass takes at a time; frames of a bucket where tracks have holes; rows of
#: a task of whole tracks, at most and (where that leaves cores idle) at least.
BLOCK, CHUNK, BUCKET, TASK_ROWS, LEAST_ROWS = 4096, 1 << 11, 1 << 16, 1 << 16, 1 << 12
PLACE = ("_pos", "_len", "_block", "_first", "_own", "_fps")


def at_least(n: int) -> Callable[[int, float], int]:
    """Least number of values of a frame, whatever its size."""
    return _Least(floor=n)


def share(divide: int, floor: int = 1) -> Callable[[int, float], int]:
    """A frame's rows over ``divide``, ``floor`` at least."""
    return _Least(divide, floor)


def scaled_rows(n: int) -> Callable[[int, float], int]:
    """``n`` rows at the reference rate."""
    return _Least(rows=n)


@dataclass(frozen=True)
class _Least:
    divide: int | None = None
    floor: int = 1
    rows: int | None = None

    def __call__(self, size: int, fps: float) -> int:
        if self.rows is not None:
            return scale(self.rows, fps)
        return max(self.floor, size // self.divide) if self.divide else self.floor


@dataclass(frozen=True)
class Roll:
    """One column to add.

    kind: mean, sum, std, var, min, max, count, corr (two columns), rank (share of the frame, ties averaged), quantile
    (``q``, linear); shift (``rows`` ahead, behind if negative), before (the row before); ewm (span ``rows``), streak (place
    in a run of missing rows). ``rows`` are those at the reference rate. frame: trailing, centred (an even size leans
    to the rows before) or before (ends before the row). ``long``: NULL where the track has fewer rows than the frame.
    """

    name: str
    kind: str
    columns: tuple[str, ...]
    rows: float = 1
    frame: str = "centred"
    least: Callable[[int, float], int] = _Least()
    q: float = 0.5
    long: bool = False

    def reach(self) -> tuple[float, float]:
        """Rows behind and ahead, at the reference rate."""
        if self.kind in ("ewm", "streak"):
            return 0, 0
        if self.kind == "before":
            return 1, 0
        if self.kind == "shift":
            return (1 - self.rows, 0) if self.rows < 0 else (0, 1 + self.rows)
        return (self.rows / 2 + 1, self.rows / 2 + 1) if self.frame == "centred" else (self.rows + 1, 0)


class Rows:
    """Whole groups of rows of one frame rate, in order: where each begins, and each row's place in its group."""

    def __init__(self, first: np.ndarray, n: int) -> None:
        self.n, self.first = n, first
        self.size = np.diff(np.append(first, n))
        self.place = np.arange(n) - np.repeat(first, self.size)
        self.room = np.repeat(self.size, self.size)
        self.longest = int(self.size.max()) if n else 0
        self.made: dict = {}

    def shift(self, x: np.ndarray, ahead: int) -> np.ndarray:
        at = self.place + ahead
        on = np.flatnonzero((at >= 0) & (at < self.room))
        out = np.full(self.n, np.nan)
        out[on] = x[on + ahead]
        return out

    def stretches(self, w: int, ahead: int) -> tuple:
        """Rows of each group in stretches of ``w``, with room for ``ahead`` more behind them: stretch size, cells, the cell
        of each row, the cell its frame ends at, whether the frame begins in the stretch before, and in which cell."""
        w = max(1, min(w, self.longest + ahead))
        if (w, ahead) not in self.made:
            cells = -(-(self.size + ahead) // w) * w
            own = np.repeat(np.cumsum(cells) - cells, self.size) + self.place
            end, place = own + ahead, self.place + ahead
            two = (place >= w) & ((place + 1) % w != 0)
            self.made[w, ahead] = (w, int(cells.sum()), own, end, two, np.where(two, end - w + 1, 0))
        return self.made[w, ahead]

    def laid(self, x: np.ndarray, w: int, ahead: int) -> np.ndarray:
        w, cells, own, *_ = self.stretches(w, ahead)
        out = np.full(cells, np.nan)
        out[own] = x
        return out.reshape(-1, w)

    def both(self, one: np.ndarray, w: int, ahead: int, step: np.ufunc = np.add, nothing: float = 0.0) -> np.ndarray:
        """``step`` over each frame: of a prefix, and where it begins earlier of a suffix too."""
        _, _, _, end, two, start = self.stretches(w, ahead)
        prefix = step.accumulate(one, axis=1).ravel()[end]
        suffix = step.accumulate(one[:, ::-1], axis=1)[:, ::-1].ravel()[start]
        return step(prefix, np.where(two, suffix, nothing))

    def moments(self, cells: list[np.ndarray], w: int, ahead: int) -> tuple[np.ndarray, list[np.ndarray], dict[tuple[int, int], np.ndarray]]:
        """Of columns laid out alike, where all have values: number, means, and sums of products of deviations from them.

        Both parts are summed from a value of their own, so a constant frame deviates by nothing."""
        _, _, _, end, two, start = self.stretches(w, ahead)
        known = ~np.isnan(cells[0])
        for c in cells[1:]:
            known &= ~np.isnan(c)
        pairs = [(i, j) for i in range(len(cells)) for j in range(i, len(cells))]

        def part(flip: bool, at: np.ndarray) -> tuple:
            turn = (lambda m: m[:, ::-1]) if flip else (lambda m: m)
            k = turn(known)
            origin = np.argmax(k, axis=1)[:, None]
            bases = [np.nan_to_num(np.take_along_axis(turn(c), origin, 1)) for c in cells]
            gaps = [np.where(k, turn(c) - b, 0.0) for c, b in zip(cells, bases, strict=True)]
            pick = lambda m: turn(np.cumsum(m, axis=1)).ravel()[at]
            n, sums = pick(k), [pick(g) for g in gaps]
            some = np.maximum(n, 1)
            means = [np.broadcast_to(b, known.shape).ravel()[at] + s / some for b, s in zip(bases, sums, strict=True)]
            return n, means, {(i, j): pick(gaps[i] * gaps[j]) - sums[i] * sums[j] / some for i, j in pairs}

        n1, m1, p1 = part(False, end)
        n2, m2, p2 = part(True, start)
        n2 = np.where(two, n2, 0)
        n = n1 + n2
        some = np.maximum(n, 1)
        apart = [np.where((n1 > 0) & (n2 > 0), b - a, 0.0) for a, b in zip(m1, m2, strict=True)]
        means = [np.where(n1 > 0, a, b) + np.where(n1 > 0, d, 0.0) * (n2 / some) for a, b, d in zip(m1, m2, apart, strict=True)]
        return n, means, {(i, j): p1[i, j] + np.where(n2 > 0, p2[i, j], 0.0) + apart[i] * apart[j] * (n1 * n2 / some) for i, j in pairs}

    def ordered(self, x: np.ndarray, size: int, qs: tuple[float, ...], rank: bool) -> list[np.ndarray]:
        """Number of values of each trailing frame, its quantiles and the row's rank in it, from values kept in order: one goes
        in and one out a row."""
        out = [np.full(self.n, np.nan) for _ in range(len(qs) + rank)]
        number = np.zeros(self.n, np.int64)
        values = x.tolist()
        for a, b in zip(self.first.tolist(), (self.first + self.size).tolist(), strict=True):
            kept: list[float] = []
            for i in range(a, b):
                v = values[i]
                if v == v:
                    insort(kept, v)
                if i - size >= a and values[i - size] == values[i - size]:
                    del kept[bisect_left(kept, values[i - size])]
                n = number[i] = len(kept)
                if not n:
                    continue
                for o, q in zip(out, qs, strict=False):
                    k = int((n - 1) * q)
                    low = kept[k]
                    part = (n - 1) * q - k
                    o[i] = low + (kept[k + 1] - low) * part if part else low
                if rank and v == v:
                    out[-1][i] = (bisect_left(kept, v) + bisect_right(kept, v) + 1) / 2 / n
        return [number, *out]


def _ewm(mean: float, weight: float, values: list[float], keep: float) -> tuple[list[float], float, float]:
    """Means after each value, and the last mean and weight; a missing value only lets weights decay."""
    out = []
    for v in values:
        weight *= keep
        if v == v:
            weight += 1
            mean = v if mean != mean else mean + (v - mean) / weight
        out.append(mean)
    return out, mean, weight


def _carried(rows: Rows, roll: Roll, data: dict[str, np.ndarray], own: np.ndarray, pos: np.ndarray, fps: float) -> np.ndarray:
    """Statistics of all rows so far, from what the blocks before hand on."""
    out, x = np.full(rows.n, np.nan), data[roll.columns[0]]
    if roll.kind == "streak":
        last = np.where(own & (x == 0), pos, -1.0)
        at = np.flatnonzero(own)
        begin = np.concatenate([[True], np.diff(at) > 1]) | (rows.place[at] == 0) if len(at) else np.empty(0, bool)
        last[at[begin]] = np.maximum(last[at[begin]], np.nan_to_num(data[f"_{roll.name}_last"][at[begin]], nan=-1.0))
        for a, b in zip(rows.first.tolist(), (rows.first + rows.size).tolist(), strict=True):
            last[a:b] = np.maximum.accumulate(last[a:b])
        return np.where(x == 0, 0.0, np.where(last < 0, pos + 1, pos - last + 1))
    keep = 1 - 2 / (scale(roll.rows, fps) + 1)
    for a, b in zip(rows.first.tolist(), (rows.first + rows.size).tolist(), strict=True):
        mine = a + np.flatnonzero(own[a:b])
        if len(mine):
            mean, weight = data[f"_{roll.name}_mean"][mine[0]], data[f"_{roll.name}_weight"][mine[0]]
            out[mine] = _ewm(mean, 0.0 if weight != weight else weight, x[mine].tolist(), keep)[0]
    return out


def statistics(rows: Rows, rolls: list[Roll], data: dict[str, np.ndarray], length: np.ndarray, own: np.ndarray, pos: np.ndarray, fps: float) -> dict[str, np.ndarray]:
    """name -> values (NaN for NULL) of each roll over rows of one frame rate."""
    out: dict[str, np.ndarray] = {}
    laid: dict = {}
    shared: dict = {}

    def once(key: tuple, make: Callable) -> np.ndarray:
        if key not in shared:
            shared[key] = make()
        return shared[key]

    at = None
    for r in sorted(rolls, key=lambda r: (r.columns, r.rows, r.frame)):
        if at != (r.columns, r.rows):
            at = (r.columns, r.rows)
            laid.clear()
            shared.clear()
        if r.kind in ("ewm", "streak"):
            out[r.name] = _carried(rows, r, data, own, pos, fps)
            continue
        if r.kind in ("shift", "before"):
            out[r.name] = rows.shift(data[r.columns[0]], -1 if r.kind == "before" else scale_signed(r.rows, fps))
            continue
        size = scale(r.rows, fps)
        least = r.least(size, fps)
        if r.kind in ("quantile", "rank"):
            same = [o for o in rolls if (o.columns, o.rows) == (r.columns, r.rows)]
            qs = tuple(sorted({o.q for o in same if o.kind == "quantile"}))
            rank = any(o.kind == "rank" for o in same)
            n, *made = once((r.columns, size, "ordered"), lambda size=size, qs=qs, rank=rank, r=r: rows.ordered(data[r.columns[0]], size, qs, rank))
            x = np.where(n >= max(1, least), made[-1] if r.kind == "rank" else made[qs.index(r.q)], np.nan)
        else:
            ahead = (size - 1) // 2 if r.frame == "centred" else 0
            key = (r.columns, rows.stretches(size, ahead)[0], ahead)
            if key not in laid:
                laid[key] = [rows.laid(data[c], size, ahead) for c in r.columns]
            cells = laid[key]
            n = once((*key, "n"), lambda size=size, ahead=ahead, cells=cells: rows.both(np.all([~np.isnan(c) for c in cells], axis=0).astype(np.int32), size, ahead))
            if r.kind == "count":
                x = n.astype(float)
            elif r.kind in ("sum", "mean"):
                x = once((*key, "sum"), lambda size=size, ahead=ahead, cells=cells: rows.both(np.nan_to_num(cells[0], nan=0.0), size, ahead))
                x = x / np.maximum(n, 1) if r.kind == "mean" else x
            elif r.kind in ("min", "max"):
                step, far = (np.minimum, np.inf) if r.kind == "min" else (np.maximum, -np.inf)
                x = rows.both(np.where(np.isnan(cells[0]), far, cells[0]), size, ahead, step, far)
            else:
                _, _, products = once((*key, "moments"), lambda size=size, ahead=ahead, cells=cells: rows.moments(cells, size, ahead))
                if r.kind == "corr":
                    vx, vy = n * products[0, 0], n * products[1, 1]
                    x = np.where((vx > 1e-12) & (vy > 1e-12), n * products[0, 1] / np.sqrt(np.maximum(vx, 1e-300)) / np.sqrt(np.maximum(vy, 1e-300)), np.nan)
                    x = np.clip(x, -1, 1)
                else:
                    x = np.where(n > 1, np.maximum(products[0, 0], 0) / np.maximum(n - 1, 1), np.nan)
                    x = np.sqrt(x) if r.kind == "std" else x
            x = np.where(n >= max(1, least), x, np.nan)
        if r.frame == "before":
            x = rows.shift(x, -1)
        out[r.name] = np.where(length >= size, x, np.nan) if r.long else x
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of whole groups, each of ``CHUNK`` rows and one group at most."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        at = 0
        for first in np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False)).tolist():
            if rows + first - at >= CHUNK:
                whole = [b for b in (*held, batch.slice(at, first - at)) if b.num_rows]
                yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
                held, rows, at = [], 0, first
        if at < batch.num_rows:
            held.append(batch.slice(at))
            rows += batch.num_rows - at
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _added(batches: Iterator[pa.RecordBatch], rolls: list[Roll], inputs: list[str], drop: set[str]) -> Iterator[pa.RecordBatch]:
    for batch in _whole_groups(batches):
        first, own, pos, fps, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_first", "_own", "_pos", "_fps", "_len"))
        at = np.flatnonzero(first)
        if (np.diff(pos)[~first[1:]] != 1).any():
            raise ValueError("a track has two rows of one frame")
        data = {c: _numbers(batch.column(c)) for c in inputs}
        made = {r.name: np.full(batch.num_rows, np.nan) for r in rolls}
        rate = fps[at]
        for f in np.unique(rate):
            mine = np.repeat(rate == f, np.diff(np.append(at, batch.num_rows)))
            on = slice(None) if mine.all() else np.flatnonzero(mine)
            n = batch.num_rows if mine.all() else len(on)
            rows = Rows(np.flatnonzero(first[on]), n)
            with np.errstate(all="ignore"):
                found = statistics(rows, rolls, {c: v[on] for c, v in data.items()}, length[on], own[on], pos[on].astype(float), float(f))
            for name, v in found.items():
                made[name][on] = v
        names = [c for c in batch.schema.names if c not in drop]
        columns = [batch.column(c) for c in names] + [pa.array(made[n], from_pandas=True) for n in made]
        names += made
        del data, made, found
        yield pa.RecordBatch.from_arrays(columns, names=names)


def add(blocks: DataFrame, rolls: list[Roll], inputs: dict[str, Column] | None = None) -> DataFrame:
    """``blocks`` (of ``in_blocks``) with the columns of ``rolls``; ``inputs`` are computed for them and dropped. No shuffle."""
    if not rolls:
        return blocks
    inputs = inputs or {}
    carried = [c for r in rolls for c in carried_columns(r)]
    drop = {*inputs, *carried}
    wide = blocks.withColumns({n: c.cast("double") for n, c in inputs.items()}) if inputs else blocks
    used = list(dict.fromkeys([*[c for r in rolls for c in r.columns], *carried]))
    schema = T.StructType([f for f in wide.schema.fields if f.name not in drop] + [T.StructField(r.name, T.DoubleType()) for r in rolls])
    return wide.mapInArrow(lambda it: _added(it, rolls, used, drop), schema)


def before(blocks: DataFrame, tracks: Tracks, rolls: list[Roll], inputs: dict[str, Column]) -> DataFrame:
    """As ``add``, of rolls of the kind before, by Spark's windows over the blocks as they lie: no pass, and no shuffle or sort as
    long as none went before."""
    rows = Window.partitionBy(*tracks.keys, "_block").orderBy(tracks.order)
    gap = F.col("_pos") - F.lag("_pos").over(rows)
    twice = F.raise_error(F.lit("a track has two rows of one frame")).cast("double")
    lags = {r.name: F.lag(F.nanvl(inputs[r.columns[0]].cast("double"), F.lit(None).cast("double"))).over(rows) for r in rolls}
    first = rolls[0].name
    return blocks.withColumns(lags | {first: F.when(gap.isNull() | (gap == 1), lags[first]).otherwise(twice)})


#: What the blocks before hand on.
_CARRY = {"ewm": ("mean", "weight"), "streak": ("last",)}


def carried_columns(roll: Roll) -> list[str]:
    """Columns of the state that a block begins with."""
    return [f"_{roll.name}_{c}" for c in _CARRY.get(roll.kind, ())]


def meet(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``other`` (a row per key); NULL keys meet too."""
    other = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def _extents(df: DataFrame, tracks: Tracks) -> Row:
    """Rows of the longest track, all rows, and whether a track's places are no differences of its frames."""
    order = tracks.order
    numbers = isinstance(df.schema[order].dataType, T.IntegralType)
    extent = df.groupBy(*tracks.keys).agg(F.count(F.lit(1)).alias("_len"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    holes = F.max(F.col("_len") != F.col("_hi") - F.col("_lo") + 1) if numbers else F.lit(True)
    return extent.agg(F.coalesce(F.max("_len"), F.lit(0)).alias("longest"), F.coalesce(F.sum("_len"), F.lit(0)).alias("rows"), holes.alias("holes")).first()


def placed(df: DataFrame, tracks: Tracks, holes: bool | None, whole: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with _pos (place in the track, from 0), _len (rows of the track) and aggregates over the whole track.

    Where each track's frames are whole numbers without holes, a place is a difference. Else rows are counted in buckets
    of frames and numbered within them; only an order that is no whole number is numbered by a window over the track.
    """
    keys, order = tracks.keys, tracks.order
    numbers = isinstance(df.schema[order].dataType, T.IntegralType)
    extent = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"), F.min(order).alias("_lo"), F.max(order).alias("_hi"), *[c.alias(n) for n, c in (whole or {}).items()])
    if not numbers:
        return meet(df, extent.drop("_lo", "_hi"), keys).withColumn("_pos", (F.row_number().over(tracks.rows) - 1).cast("long"))
    if not holes:
        return meet(df, extent.drop("_hi"), keys).withColumn("_pos", (F.col(order) - F.col("_lo")).cast("long")).drop("_lo")
    bucket = [*keys, "_bucket"]
    df = df.withColumn("_bucket", F.floor(F.col(order) / BUCKET))
    counts = df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*bucket, F.coalesce(before, F.lit(0)).alias("_at"))
    own = F.row_number().over(Window.partitionBy(*bucket).orderBy(order)) - 1
    return meet(meet(df, starts, bucket), extent.drop("_lo", "_hi"), keys).withColumn("_pos", (F.col("_at") + own).cast("long")).drop("_bucket", "_at")


def _whole_tracks(df: DataFrame, tracks: Tracks, seen: Row, whole: dict[str, Column]) -> DataFrame:
    """As ``placed``, of tracks that a task holds whole: one shuffle, aggregates over windows. Tasks follow the number of rows."""
    every = tracks.rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, 1 + seen.rows // LEAST_ROWS), -(-seen.rows // TASK_ROWS))
    place = F.row_number().over(tracks.rows) - 1 if seen.holes in (True, None) else F.col(tracks.order) - F.min(tracks.order).over(every)
    columns = {"_pos": place.cast("long"), "_len": F.count(F.lit(1)).over(every), **{n: c.over(every) for n, c in whole.items()}}
    return df.repartition(parts, *tracks.keys).withColumns(columns)


def in_blocks(df: DataFrame, tracks: Tracks, behind: float, ahead: float, fps: Column | None = None, whole: dict[str, Column] | None = None, carry: list[Roll] | None = None, block: int | None = None, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``df`` in blocks that hold ``behind`` and ``ahead`` rows (at the reference rate) of their neighbours, sorted.

    A block has ``block`` rows or more, so a halo is of its two neighbours only; ``_own`` marks the rows that are no
    halo. ``carry``: rolls over all rows so far (ewm, streak), whose state each block begins with is found from one row
    a block, for tracks of several blocks. Where no track is longer than a block, tracks are dealt as they are.
    ``limits``: ``_w_<column>`` is the column bounded by these quantiles of its track.
    """
    keys, limits = tracks.keys, limits or {}
    bounded = {f"_w_{c}": within(F.col(c), f"_l_{c}") for c in limits}
    spare = [f"_l_{c}" for c in limits]
    df = df.withColumn("_fps", (F.lit(REFERENCE_FPS) if fps is None else fps).cast("double"))
    seen = _extents(df, tracks)
    if seen.longest <= (block or BLOCK):
        quantiles = {f"_l_{c}": F.percentile(c, F.array(*map(F.lit, qs))) for c, qs in limits.items()}
        df = _whole_tracks(df, tracks, seen, (whole or {}) | quantiles)
        df = df.withColumns(bounded).drop(*spare) if limits else df
        empty = {c: F.lit(None).cast("double") for r in carry or [] for c in carried_columns(r)}
        out = df.withColumns({"_block": F.lit(0).cast("long"), "_own": F.lit(True), "_first": F.col("_pos") == 0, **empty})
        return out.sortWithinPartitions(*keys, tracks.order)
    for qs in dict.fromkeys(limits.values()):
        df = meet(df, track_quantiles(df, keys, [c for c in limits if limits[c] == qs], qs), keys)
    df = placed(df.withColumns(bounded).drop(*spare) if limits else df, tracks, seen.holes, whole)
    rate = F.greatest(F.col("_fps") / F.lit(REFERENCE_FPS), F.lit(1.0))
    back, front = ((F.ceil(F.lit(float(n)) * rate) + F.lit(int(n > 0))).cast("long") for n in (behind, ahead))
    size = F.greatest(F.lit(block or BLOCK), back, front).cast("long")
    df = df.withColumns({"_size": size, "_home": F.floor(F.col("_pos") / size).cast("long")})
    states = _states(df, keys, carry) if carry else None
    at, home = F.col("_pos") % F.col("_size"), F.col("_home")
    near = F.array(
        F.when((at < front) & (home > 0), home - 1), home, F.when((at >= F.col("_size") - back) & ((home + 1) * F.col("_size") < F.col("_len")), home + 1)
    )
    out = df.withColumn("_block", F.explode(F.array_compact(near)))
    if states is not None:
        out = meet(out, states, [*keys, "_block"], "left")
    out = out.withColumns({"_own": F.col("_block") == home, "_first": F.col("_pos") == F.greatest(F.lit(0), F.col("_block") * F.col("_size") - back)}).drop("_size", "_home")
    return out.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", tracks.order)


def _states(df: DataFrame, keys: list[str], carry: list[Roll]) -> DataFrame:
    """(keys, _block, state columns): what each block but the first begins with. One row a block reaches a track's group."""
    columns = list(dict.fromkeys(c for r in carry for c in r.columns))
    fields = [c for r in carry for c in carried_columns(r)]
    kinds = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], "`_block` long", "`_fps` double", "`_n` long", *[f"`{c}` double" for c in fields]])

    def ends(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_pos")
        fps, out = float(g["_fps"].iloc[0]), g.iloc[:1][[*keys, "_block", "_fps"]].copy()
        out["_n"] = len(g)
        for r in carry:
            x = g[r.columns[0]].to_numpy(float, na_value=np.nan)
            if r.kind == "ewm":
                _, mean, weight = _ewm(float("nan"), 0.0, x.tolist(), 1 - 2 / (scale(r.rows, fps) + 1))
                out[f"_{r.name}_mean"], out[f"_{r.name}_weight"] = mean, weight
            else:
                seen = g["_pos"].to_numpy()[x == 0]
                out[f"_{r.name}_last"] = float(seen[-1]) if len(seen) else float("nan")
        return out

    def hand_on(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_block").reset_index(drop=True)
        out, fps = g.copy(), float(g["_fps"].iloc[0])
        out["_block"] += 1
        for r in carry:
            if r.kind == "streak":
                out[f"_{r.name}_last"] = g[f"_{r.name}_last"].ffill()
                continue
            mean, weight, keep, means, weights = float("nan"), 0.0, 1 - 2 / (scale(r.rows, fps) + 1), [], []
            for n, m, w in zip(g["_n"], g[f"_{r.name}_mean"], g[f"_{r.name}_weight"], strict=True):
                far = weight * keep**n
                mean = m if mean != mean else mean if m != m or w + far == 0 else (m * w + mean * far) / (w + far)
                weight = w + far
                means.append(mean)
                weights.append(weight)
            out[f"_{r.name}_mean"], out[f"_{r.name}_weight"] = means, weights
        return out

    long = df.where(F.col("_len") > F.col("_size")).select(*keys, F.col("_home").alias("_block"), "_fps", "_pos", *[F.col(c).cast("double").alias(c) for c in columns])
    blocks = long.groupBy(*keys, "_block").applyInPandas(ends, kinds)
    return blocks.groupBy(*keys).applyInPandas(hand_on, kinds).select(*keys, "_block", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in fields])


def rolled(df: DataFrame, tracks: Tracks, rolls: list[Roll], fps: Column | None = None, block: int | None = None) -> DataFrame:
    """``df`` (a row per track and frame) with the columns of ``rolls`` over its own columns; one shuffle."""
    behind, ahead = (max(r.reach()[side] for r in rolls) for side in (0, 1))
    carry = [r for r in rolls if r.kind in _CARRY]
    out = add(in_blocks(df, tracks, behind, ahead, fps, carry=carry, block=block), rolls)
    return out.where("_own").drop(*PLACE)
