"""Constraint checks: every rule returns its violations as (check, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_text
from .clean import keys_text


def _six(x: Column) -> Column:
    """``x`` to six places as text; what rounds to zero from below keeps its sign."""
    r = F.round(x, 6)
    return number_text(F.when((r == 0) & x.cast("string").startswith("-"), F.lit(-0.0)).otherwise(r))


def _rows(df: DataFrame, check: str, key, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.alias("key"), detail.cast("string").alias("detail"))


def unique_key(df: DataFrame, keys, name: str = "duplicate_key") -> DataFrame:
    dup = df.groupBy(*(keys if isinstance(keys, list) else [keys])).count().filter("count > 1")
    return _rows(dup, name, keys_text(keys), F.col("count"))


def missing_match(left: DataFrame, right: DataFrame, key: str, name: str = "missing_match") -> DataFrame:
    lost = left.join(right.select(key).distinct(), key, "left_anti").groupBy(key).count()
    return _rows(lost, name, keys_text(key), F.col("count"))


def required_columns(df: DataFrame, columns: list[str], name: str = "missing_column") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame([(name, c, "") for c in missing], "check string, key string, detail string")


def row_count_equal(left: DataFrame, right: DataFrame, name: str = "row_count") -> DataFrame:
    n = left.agg(F.count("*").alias("a")).withColumn("b", right.agg(F.count("*")).scalar())
    return _rows(n.filter("a <> b"), name, F.lit(""), F.concat_ws("<>", F.col("a").cast("string"), F.col("b").cast("string")))


def symmetric_matrix(pairs: DataFrame, tol: float = 1e-9, name: str = "asymmetric") -> DataFrame:
    """(i, j, sim): square means every (i, j) has its (j, i) with an equal value."""
    mirror = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sim").alias("other"))
    both = pairs.join(mirror, ["i", "j"], "left")
    bad = both.filter(F.col("other").isNull() | (F.abs(F.col("sim") - F.col("other")) > tol))
    return _rows(bad, name, keys_text(["i", "j"]), F.col("other"))


def parts_sum(df: DataFrame, keys, parts: list[str], total: float = 100.0, tol: float = 1e-6, name: str = "parts_sum") -> DataFrame:
    s = reduce(lambda a, b: a + b, [F.col(c) for c in parts])
    return _rows(df.withColumn("_s", s).filter(F.abs(F.col("_s") - total) > tol), name, keys_text(keys), F.round("_s", 6))


def out_of_range(df: DataFrame, keys, col: str, lo: float, hi: float, name: str = "out_of_range") -> DataFrame:
    x = F.col(col).cast("double")
    bad = df.filter(x.isNull() | F.isnan(x) | (x < lo) | (x > hi))
    return _rows(bad, name, keys_text(keys), _six(x))


def not_positive(df: DataFrame, keys, col: str, name: str = "not_positive") -> DataFrame:
    x = F.col(col).cast("double")
    return _rows(df.filter(x.isNull() | F.isnan(x) | (x <= 0)), name, keys_text(keys), _six(x))


def violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(found: DataFrame) -> None:
    first = found.limit(5).collect()
    if first:
        raise ValueError("constraint violations: " + "; ".join(f"{r['check']} {r['key']} {r['detail']}" for r in first))
