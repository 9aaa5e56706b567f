"""Numbers as text and closed forms at large counts."""

import math

from pyspark.sql import functions as F

from strandwork.functions.text import compact_number, compact_number_bands, fixed_digits, number_text
from strandwork.operators import checks, statistics


def test_fixed_digits_round_the_binary_value(spark):
    values = [k * 0.125 for k in range(2000)] + [k / 1000 for k in range(0, 9000, 5)] + [float(2**53) + 2.0, 4503599627370497.5]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[fixed_digits(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2)])
    for r in df.collect():
        assert [r.d0, r.d1, r.d2] == [f"{r.x:.{d}f}" for d in (0, 1, 2)]


def test_compact_number_takes_halves_to_even(spark):
    df = spark.createDataFrame([(2.5,), (2250.0,), (12500.0,), (1150.0,), (1.125e6,), (2.25e6,)], "x double")
    got = [tuple(r) for r in df.select(compact_number("x"), compact_number_bands("x")).collect()]
    assert got == [("2", "2"), ("2.2K", "2.2k"), ("12.5K", "12k"), ("1.1K", "1.1k"), ("1.12M", "1.1M"), ("2.25M", "2.2M")]


def test_number_text_as_python_writes_it(spark):
    values = [0.0, -0.0, 1e-5, 1.2e-5, 1e-4, 0.00012, 1e-3, 1.5, 1e7, 12345678.25, 1e15, 1e16, 1.5e22, -2.0, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(number_text("x")).collect()] == [repr(v) for v in values]


def test_checks_keep_the_sign_of_zero(spark):
    df = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -1e-9), (4, -0.00001), (5, -12345678.0), (6, 3.0)], "k long, x double")
    got = {r["key"]: r["detail"] for r in checks.not_positive(df, "k", "x").collect()}
    assert got == {"1": "-0.0", "2": "0.0", "3": "-0.0", "4": "-1e-05", "5": "-12345678.0"}


def test_rarefaction_holds_its_digits_at_large_counts(spark):
    sizes = {29: 400_000, 30: 500_000, 31: 300_000, 5_000: 3}
    total = sum(m * c for m, c in sizes.items())
    rows = spark.createDataFrame(list(sizes.items()), "members long, n int").select("members", F.explode(F.sequence(F.lit(1), "n")).alias("cluster"))
    samples = [1, 5, 1000, 1_000_000, total - 3, total]
    got = {r["sample_size"]: r["expected_clusters"] for r in statistics.rarefaction_expected(rows, samples).collect()}
    for z in samples:
        log_miss = lambda m: sum(math.log1p(-z / (total - i)) for i in range(m)) if total - m >= z else -math.inf
        want = math.fsum(c * -math.expm1(log_miss(m)) for m, c in sizes.items())
        assert abs(got[z] - want) < 1e-4, z
