"""Hashed samples of a bounded size, alike at every size of the input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sampled(key: str, share: Column | float) -> Column:
    """Whether a row's hash of ``key`` falls into the first ``share`` of all hashes; a null key never does."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return F.col(key).isNotNull() & (place < share)
