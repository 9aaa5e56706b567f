"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col


#: Terms that are summed one by one; longer sums are integrated with as many steps for any length.
SUMMED_TERMS, STEPS = 64, 1024


def chi2_sf_even(x: Column, half_df: Column) -> Column:
    """Upper tail of chi-square with 2*half_df degrees of freedom, in bounded work.

    Up to SUMMED_TERMS it is exp(-x/2) * sum_{i<k} (x/2)^i / i!, every term taken in
    log space. Beyond, the same tail is the integral of a gamma density from x/2,
    which Simpson's rule takes to about ten digits in STEPS steps.
    """
    h, k = x / 2, half_df.cast("double")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(half_df, F.lit(SUMMED_TERMS)).cast("int") - 1, F.lit(1))),
        F.struct((-h).alias("log_term"), F.exp(-h).alias("acc")),
        lambda s, i: F.struct(
            (s["log_term"] + F.log(h) - F.log(i.cast("double"))).alias("log_term"),
            (s["acc"] + F.exp(s["log_term"] + F.log(h) - F.log(i.cast("double")))).alias("acc"),
        ),
        lambda s: s["acc"],
    )
    tail = F.when(h < (k - 1) - 12 * F.sqrt(k), 1.0).otherwise(_gamma_tail(h, k - 1))
    summed = F.when(half_df <= SUMMED_TERMS, terms).otherwise(tail)
    return F.when(half_df <= 1, F.exp(-h)).when(h <= 0, F.lit(1.0)).otherwise(F.least(summed, F.lit(1.0)))


def _gamma_tail(h: Column, n: Column) -> Column:
    """Integral of t^n exp(-t) / n! from h, for n of some dozens and more.

    The density is written around its peak at n with Stirling's series, so that no
    large numbers cancel. The range is as wide as the density falls: some standard
    deviations, or the decay length where h lies far above the peak.
    """
    scale = F.least(F.sqrt(n + 1), F.when(h > n, 1 / (1 - n / h)).otherwise(F.sqrt(n + 1)))
    width = F.when(h < n, (n - h) + 14 * F.sqrt(n + 1)).otherwise(40 * scale)
    step = width / STEPS
    base = -0.5 * F.log(2 * F.lit(3.141592653589793) * n) - 1 / (12 * n) + 1 / (360 * n * n * n)

    def density(i: Column) -> Column:
        u = (h + step * i - n) / n
        return F.exp(base - n * (u - F.log1p(u)))

    weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda a, i: a + weight(i) * density(i.cast("double")))
    return total * step / 3


# Lanczos coefficients (g = 7, n = 9) for log-gamma.
LANCZOS = [
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
]


def log_gamma(x: Column) -> Column:
    """Natural log of gamma for x >= 0.5 (Lanczos series)."""
    z = as_col(x).cast("double") - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(series)


def log_choose(n: Column, k: Column) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def _stirling(x: Column) -> Column:
    """What is left of log gamma(x + 1) after Stirling's main terms, for x >= 16."""
    y = 1.0 / (x * x)
    return (1.0 / 12 - y * (1.0 / 360 - y * (1.0 / 1260 - y / 1680))) / x


def log_miss(total: Column, members: Column, sample: Column) -> Column:
    """log of C(total - members, sample) / C(total, sample): no member is drawn.

    The main terms of the four factorials are joined before they are taken, so no term
    is larger than the number of members; single factorials would lose what the size
    of their logs takes. They are used only where few rows are in neither part, and
    there the ratio is nought or the numbers are small.
    """
    n, m, z = total.cast("double"), members.cast("double"), sample.cast("double")
    rest = n - m - z
    main = (n - m + 0.5) * F.log1p(-m / n) - (rest + 0.5) * F.log1p(-m / (n - z)) + m * F.log1p(-z / n)
    return F.when(rest >= 16, main + _stirling(n - m) + _stirling(n - z) - _stirling(n) - _stirling(rest)).otherwise(
        log_choose(total - members, sample) - log_choose(total, sample)
    )


def significance_stars(p: Column | str) -> Column:
    p = as_col(p)
    return (
        F.when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")
    )
