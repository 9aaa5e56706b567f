"""Column-level building blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(c) -> list:
    if c is None:
        return []
    return list(c) if isinstance(c, (list, tuple)) else [c]


def r6(c: Column | str) -> Column:
    """Round to six places: the precision at which results are published."""
    return F.round(as_col(c).cast("double"), 6)


def hash_key(ident: Column | str, seed: int | str) -> Column:
    """Seeded, engine-independent order: md5 of ``id|seed``."""
    return F.md5(F.concat(as_col(ident).cast("string"), F.lit(f"|{seed}")))


def hash_uniform(key: Column) -> Column:
    """First 13 hex digits of an md5 key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def hash_shard(key: Column, digits: int = 2) -> Column:
    """Shard that is monotone in the md5 key, so sharded ranks stay exact."""
    return F.substring(key, 1, digits)


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """``num / den`` with a stated value where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))
