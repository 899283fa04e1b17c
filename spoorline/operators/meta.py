"""Features of a recording's metadata, per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import EPS, clip

NUMERIC = ("frames_per_second", "pix_per_cm_approx", "video_width", "video_height", "arena_width_cm", "arena_height_cm", "n_mice")
CATEGORIES = ("lab_id", "arena_shape", "arena_type", "tracking_method")
UNKNOWN, MISSING = "__UNK__", "__NA__"


def numeric_features(names: dict[str, str] | None = None) -> dict[str, Column]:
    """name -> column. ``names`` maps the expected columns to those of another table."""
    v = {c: F.col((names or {}).get(c, c)).try_cast("double") for c in NUMERIC}
    pos = {c: clip(x, 0) for c, x in v.items()}
    fps, ppc, w, h, n = pos["frames_per_second"], pos["pix_per_cm_approx"], pos["arena_width_cm"], pos["arena_height_cm"], pos["n_mice"]
    vw, vh = v["video_width"], v["video_height"]
    area = w * h
    return {
        **v,
        "fps_log1p": F.log1p(fps),
        "sec_per_frame": F.try_divide(F.lit(1.0), fps + EPS),
        "cm_per_pix_approx": F.try_divide(F.lit(1.0), ppc + EPS),
        "log_pix_per_cm": F.log1p(ppc),
        "video_aspect": F.try_divide(vw, vh + EPS),
        "video_area_px": vw * vh,
        "video_area_log1p": F.log1p(clip(vw * vh, 0)),
        "video_diag_px": F.sqrt(clip(vw * vw + vh * vh, 0)),
        "arena_aspect": F.try_divide(w, h + EPS),
        "arena_area_cm2": area,
        "arena_area_log1p": F.log1p(clip(area, 0)),
        "arena_perimeter_cm": 2 * (w + h),
        "arena_diag_cm": F.sqrt(w * w + h * h),
        "n_mice_log1p": F.log1p(n),
        "n_mice_sq": n * n,
        "mice_density": F.try_divide(n, area + EPS),
        "arena_area_per_mouse": F.try_divide(area, n + EPS),
    }


def vocabulary(train: DataFrame, columns: tuple[str, ...] = CATEGORIES, limit: int = 10_000) -> dict[str, list[str]]:
    """Sorted known values of each column. More than ``limit`` values are no category, which is an error."""
    out = {}
    for c in columns:
        values = [r[0] for r in train.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(limit + 1).collect()]
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} values")
        out[c] = sorted(values)
    return out


def _known(c: str, values: list[str], compat: bool) -> Column:
    text = F.col(c).cast("string")
    return F.when(text.isNull(), F.lit(UNKNOWN if compat else MISSING)).when(text.isin(*values) if values else F.lit(False), text).otherwise(F.lit(UNKNOWN))


def one_hot(vocab: dict[str, list[str]], compat: bool = True) -> dict[str, Column]:
    """``column=value`` over the vocabulary, the unknown and the missing value.

    With ``compat``, as surveyed, a missing value counts as unknown, so the column of the missing value is always 0.
    """
    return {f"{c}={v}": (_known(c, values, compat) == v).cast("byte") for c, values in vocab.items() for v in [*values, UNKNOWN, MISSING]}


def label_codes(vocab: dict[str, list[str]]) -> dict[str, Column]:
    """``column_idx``: place in the vocabulary; its size where unknown or missing."""
    out = {}
    for c, values in vocab.items():
        at = F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), F.col(c).cast("string"))
        out[f"{c}_idx"] = F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(len(values)).cast("int")
    return out
