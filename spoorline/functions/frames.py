"""Row frames of tracks: window sizes that follow the frame rate, and rolling, lag and indicator columns.

A track is one entity (or ordered pair) of one recording; its time is the row position. Missing is NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-6
#: Frame rate that window sizes are stated for, and that of recordings without one.
REFERENCE_FPS = 30.0


def scale(n: float, fps: float, reference: float = REFERENCE_FPS) -> int:
    """Rows of a window that is ``n`` rows at the reference rate: halves to even, one at least."""
    return max(1, round(n * fps / reference))


def scale_signed(n: float, fps: float, reference: float = REFERENCE_FPS) -> int:
    """As ``scale``, keeping the sign; 0 stays 0."""
    return 0 if n == 0 else scale(abs(n), fps, reference) * (1 if n > 0 else -1)


def ind(predicate: Column) -> Column:
    """1.0 where the predicate holds, else 0.0, also where it is unknown."""
    return F.coalesce(predicate, F.lit(False)).cast("double")


def ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.try_divide(a, b + F.lit(eps))


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def cosine(a: str, b: str) -> Column:
    """Of two array columns of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bounded; a NULL stays NULL."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def wrap_once(angle: Column) -> Column:
    """One turn off an angle beyond half a turn."""
    pi = F.pi()
    return F.when(angle > pi, angle - 2 * pi).when(angle < -pi, angle + 2 * pi).otherwise(angle)


def changed(value: Column, before: Column) -> Column:
    """Whether a value differs from the one before; missing differs from everything, missing included."""
    return value.isNull() | before.isNull() | (value != before)


class Tracks:
    """Window frames over tracks: all share one partitioning and one sort."""

    def __init__(self, keys: list[str], order: str = "frame") -> None:
        self.keys, self.order = keys, order

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def trailing(self, size: int) -> WindowSpec:
        return self.rows.rowsBetween(-(size - 1), 0)

    def centred(self, size: int) -> WindowSpec:
        """An even size leans to the rows before."""
        return self.rows.rowsBetween(-(size // 2), (size - 1) // 2)

    def before(self, size: int) -> WindowSpec:
        """``size`` rows that end before the current one."""
        return self.rows.rowsBetween(-size, -1)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.rows)

    def shift(self, x: Column, ahead: int) -> Column:
        """The value ``ahead`` rows later (earlier if negative)."""
        return x if ahead == 0 else F.lead(x, ahead).over(self.rows) if ahead > 0 else F.lag(x, -ahead).over(self.rows)

    def diff(self, x: Column) -> Column:
        return x - self.lag(x)

    def length(self) -> Column:
        return F.count(F.lit(1)).over(self.whole)

    @staticmethod
    def roll(agg: Callable[[Column], Column], x: Column, frame: WindowSpec, least: int = 1) -> Column:
        """NULL where the frame has fewer than ``least`` values."""
        return F.when(F.count(x).over(frame) >= least, agg(x).over(frame))
