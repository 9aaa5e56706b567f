"""Array arithmetic that stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col


def doubles(v: Column | str) -> Column:
    return as_col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: Column | str, eps: float = 1e-12) -> Column:
    """v / max(norm, eps)."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(F.arrays_zip(doubles(v).alias("x"), F.array_repeat(n, F.size(as_col(v))).alias("n")), lambda s: s["x"] / s["n"])


def pad_to_multiple(v: Column | str, m: int) -> Column:
    """Zero-pad on the right to the next multiple of ``m``."""
    v = as_col(v)
    return F.concat(doubles(v), F.array_repeat(F.lit(0.0), (F.lit(m) - F.size(v) % m) % m))


def standardize(v: Column | str, mean: Column, std: Column) -> Column:
    return F.zip_with(
        F.zip_with(doubles(v), mean, lambda x, m: x - m), std, lambda x, s: x / s
    )


def clip_scale(v: Column | str, center: Column, alpha: Column) -> Column:
    return F.zip_with(F.zip_with(doubles(v), center, lambda x, c: x - c), alpha, lambda x, a: x * a)
