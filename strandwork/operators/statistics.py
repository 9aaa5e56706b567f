"""Combined p-values, permutation and empirical tests, enrichment."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_list, ratio
from ..functions.stats import chi2_sf_even, log_miss
from ..session import cut_lineage
from .ordering import compute_partitions, ordered_scan


def fisher_columns(p: str) -> list[Column]:
    """Partial sums of the combined statistic; nulls leave."""
    return [
        F.sum(F.when(F.col(p).isNotNull(), F.log(F.greatest(F.col(p), F.lit(1e-300))))).alias(f"_s_{p}"),
        F.count(p).alias(f"_k_{p}"),
    ]


def fisher_value(p: str) -> Column:
    k = F.col(f"_k_{p}")
    return F.when(k > 0, chi2_sf_even(-2.0 * F.col(f"_s_{p}"), k)).otherwise(F.lit(float("nan")))


def fisher_combine(df: DataFrame, p: str, group=()) -> DataFrame:
    """-2 sum ln p against chi-square with 2k degrees; an empty group gives NaN."""
    out = df.groupBy(*as_list(group)).agg(*fisher_columns(p))
    return out.select(*as_list(group), F.col(f"_k_{p}").alias("n_tests"), fisher_value(p).alias("p_combined"))


# Fixed values of the keyed shuffle: rounds, the prime of its bits, the bit that decides.
SHUFFLE_ROUNDS, SHUFFLE_PRIME, SHUFFLE_BIT = 24, 2**31 - 1, 15
#: Ranks and shuffles that one call of a kernel holds.
PIECE_RANKS, SHUFFLES_AT_ONCE = 2048, 250


def shuffle_keys(names: list[str], n: int) -> np.ndarray:
    """(round, 3, shuffle): mirror, factor and addend of every round, from md5 of ``name|round``."""
    out = np.empty((SHUFFLE_ROUNDS, 3, len(names)), np.int64)
    for i in range(SHUFFLE_ROUNDS):
        digests = [hashlib.md5(f"{name}|{i}".encode()).hexdigest() for name in names]
        one, two, three = (np.array([int(d[j : j + 8], 16) for d in digests], np.int64) for j in (0, 8, 16))
        out[i] = one % n, 1 + two % (SHUFFLE_PRIME - 1), three % SHUFFLE_PRIME
    return out


def shuffled_ranks(ranks: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """(shuffle, rank): where each of the ranks 0 .. n - 1 goes in each shuffle.

    A swap-or-not shuffle: in a round a rank and its mirror image change places or
    not, by a bit of the larger of the two. Every shuffle is a bijection for any n, and
    the place of a rank is known without looking at the others, so no task needs
    them together.
    """
    x = np.broadcast_to(ranks, (keys.shape[2], len(ranks))).copy()
    for mirror, factor, addend in keys[:, :, :, None]:
        image = (mirror - x) % n
        y = (factor * np.maximum(x, image) + addend) % SHUFFLE_PRIME
        x = np.where(y * y % SHUFFLE_PRIME >> SHUFFLE_BIT & 1 == 1, image, x)
    return x


def _rank_pieces(hist: DataFrame, keys: list[str], order: list[str], count: str) -> DataFrame:
    """Runs of equal rows as pieces of at most PIECE_RANKS ranks: columns ``_from``, ``_upto``, ``_piece``."""
    scanned = ordered_scan(hist, order, {"_end": F.col(count)}, keys).withColumn("_start", F.col("_end") - F.col(count))
    first, last = F.floor(F.col("_start") / PIECE_RANKS), F.floor((F.col("_end") - 1) / PIECE_RANKS)
    cut = scanned.filter(F.col(count) > 0).withColumn("_piece", F.explode(F.sequence(first, last)))
    return cut.withColumns({"_from": F.greatest("_start", F.col("_piece") * PIECE_RANKS), "_upto": F.least("_end", (F.col("_piece") + 1) * PIECE_RANKS)}).drop("_start", "_end")


def permutation_test(values: DataFrame, category: str, value: str, comparisons: list[tuple[str, str]], n_perm: int, seed: int = 42) -> DataFrame:
    """Two-sided label-shuffle test of a difference in means.

    p = (count + 1) / (N + 1) with ``>=`` on absolute differences. The pooled values
    of a comparison are ranked; a shuffle sends every rank to a place of its own, and
    the first n_a places are the shuffled group. Places are computed rank by rank
    from keys of (seed, comparison, shuffle), so pieces of ranks are summed apart, whatever their
    number, and one seed gives one answer. Null values leave; a comparison without
    rows on one side has no result.
    """
    spark = values.sparkSession
    hist = cut_lineage(values.filter(F.col(value).isNotNull()).groupBy(category, value).agg(F.count("*").alias("n")))
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(comparisons)], "cmp int, category_a string, category_b string")
    sides = pairs.select("cmp", F.explode(F.array(F.struct(F.col("category_a").alias(category), F.lit(1).alias("in_a")), F.struct(F.col("category_b").alias(category), F.lit(0).alias("in_a")))).alias("s")).select("cmp", "s.*")
    member = cut_lineage(hist.join(sides, category).groupBy("cmp", F.col(value).cast("double").alias("v")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("in_a")).alias("n_in_a")
    ))
    totals = member.groupBy("cmp").agg(
        F.sum("n_in_a").alias("n_a"), (F.sum("n") - F.sum("n_in_a")).alias("n_b"),
        F.sum(F.col("v") * F.col("n_in_a")).alias("sum_a"), F.sum(F.col("v") * F.col("n")).alias("sum_all"),
    )
    totals = cut_lineage(totals.filter("n_a > 0 and n_b > 0"))
    pieces = _rank_pieces(member.join(totals.select("cmp", "n_a", (F.col("n_a") + F.col("n_b")).alias("_n")), "cmp"), ["cmp"], ["v"], "n")
    spread = pieces.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // SHUFFLES_AT_ONCE))))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        cmp_, blk, n, n_a = (int(pdf[c].iloc[0]) for c in ("cmp", "_blk", "_n", "n_a"))
        perms = np.arange(blk * SHUFFLES_AT_ONCE, min((blk + 1) * SHUFFLES_AT_ONCE, n_perm))
        pdf = pdf.sort_values("_from")
        ranks = np.concatenate([np.arange(a, b) for a, b in zip(pdf["_from"], pdf["_upto"])])
        v = np.repeat(pdf["v"].to_numpy(), (pdf["_upto"] - pdf["_from"]).to_numpy())
        places = shuffled_ranks(ranks, n, shuffle_keys([f"{seed}|{cmp_}|{p}" for p in perms], n))
        return pd.DataFrame({"cmp": cmp_, "perm": perms, "part": (places < n_a) @ v})

    parts = compute_partitions(spread, "cmp", "_blk", "_piece").groupBy("cmp", "_blk", "_piece").applyInPandas(sums, "cmp int, perm long, part double")
    perm = parts.groupBy("cmp", "perm").agg(F.sum("part").alias("s")).join(totals, "cmp")
    diff = F.abs(F.col("s") / F.col("n_a") - (F.col("sum_all") - F.col("s")) / F.col("n_b"))
    mean_a, mean_b = F.col("sum_a") / F.col("n_a"), (F.col("sum_all") - F.col("sum_a")) / F.col("n_b")
    hits = perm.groupBy("cmp").agg(F.count_if(diff >= F.abs(mean_a - mean_b) - 1e-12).alias("hits"))
    out = pairs.join(totals, "cmp").join(hits, "cmp")
    return out.select(
        "category_a", "category_b", "n_a", "n_b", mean_a.alias("mean_a"), mean_b.alias("mean_b"),
        (mean_a - mean_b).alias("observed_mean_diff"), ((F.col("hits") + 1) / F.lit(n_perm + 1.0)).alias("p_value"),
    )


def empirical_z_p(observed: DataFrame, nulls: DataFrame, keys, higher: bool = True) -> DataFrame:
    """Null mean, sample std (floor 1e-9), z and one-sided (count + 1) / (n + 1).

    ``observed`` is (keys, observed); ``nulls`` is (keys, value).
    """
    keys = as_list(keys)
    both = nulls.join(observed, keys)
    beyond = F.col("value") >= F.col("observed") if higher else F.col("value") <= F.col("observed")
    g = both.groupBy(*keys, "observed").agg(
        F.avg("value").alias("null_mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("null_std"),
        F.count_if(beyond).alias("_c"),
        F.count("*").alias("n_null"),
    )
    return g.select(
        *keys, "observed", "n_null", "null_mean",
        ((F.col("observed") - F.col("null_mean")) / F.greatest("null_std", F.lit(1e-9))).alias("z"),
        ((F.col("_c") + 1) / (F.col("n_null") + 1)).alias("p"),
    )


# Coefficients of the Chebyshev fit of erfc.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def chi2_sf_one(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom (erfc of sqrt(x/2),
    rational approximation of relative error under 1.2e-7)."""
    z = F.sqrt(x / 2)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


def enrichment(counts: DataFrame, group: str, eco: str, obs: str) -> DataFrame:
    """Observed against expected counts of every group x ecosystem cell.

    expected = group_total * eco_total / N; log2 is null at obs = 0. The p-value
    is a one-degree chi-square of the 2 x 2 table, a choice of this library.
    The cell table is one row per category pair; totals are windows over it.
    """
    n = F.sum(obs).over(Window.partitionBy())
    t = counts.withColumns(
        {
            "group_total": F.sum(obs).over(Window.partitionBy(group)),
            "ecosystem_total": F.sum(obs).over(Window.partitionBy(eco)),
            "global_total": n,
        }
    )
    o, g, e, tot = (F.col(c).cast("double") for c in (obs, "group_total", "ecosystem_total", "global_total"))
    t = t.withColumns({"expected": g * e / tot, "share_in_group": ratio(o, g)})
    fold = ratio(o, F.col("expected"))
    d = o * (tot - g - e + o) - (g - o) * (e - o)
    chi2 = ratio(tot * d * d, g * e * (tot - g) * (tot - e))
    return t.withColumns(
        {"fold_enrichment": fold, "log2_enrichment": F.when(F.col(obs) > 0, F.log2(fold)), "chi2": chi2, "p_value": F.least(chi2_sf_one(chi2), F.lit(1.0))}
    )


def enrichment_flags(df: DataFrame, q: str = "q_value", log2: str = "log2_enrichment") -> DataFrame:
    """Significant at q < 0.01 and |log2| >= 0.5; a null log2 is plotted at min - 0.5."""
    low = df.agg(F.min(log2)).scalar()
    return df.withColumns(
        {
            "significant": (F.col(q) < 0.01) & (F.abs(F.coalesce(F.col(log2), F.lit(float("inf")))) >= 0.5),
            "plot_log2": F.coalesce(F.col(log2), low - 0.5),
        }
    )


def sample_grid(total: int) -> list[int]:
    """Sample sizes in near even log steps (1, 2, 3, 5, 8 by powers of ten) up to ``total``, which is the last."""
    steps = [k * 10**e for e in range(len(str(total))) for k in (1, 2, 3, 5, 8)]
    return [s for s in steps if s < total] + [total] * (total > 0)


def _explode_sizes(samples: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(s)).cast("long") for s in samples]).cast("array<bigint>"))


def rarefaction_expected(sizes: DataFrame, samples: list[int]) -> DataFrame:
    """(sample_size, expected distinct clusters) in closed form.

    sum over clusters of 1 - C(N - n_i, n) / C(N, n). Clusters of equal size are
    counted once, so the work grows with the number of distinct sizes.
    ``sizes`` is (cluster, members).
    """
    by_size = sizes.groupBy(F.col("members").alias("_m")).agg(F.count("*").alias("_c"))
    total = by_size.agg(F.sum(F.col("_m") * F.col("_c")).alias("t")).scalar()
    grid = by_size.withColumn("_N", total).withColumn("sample_size", _explode_sizes(samples))
    grid = grid.filter(F.col("sample_size") <= F.col("_N"))
    N, m, n = F.col("_N"), F.col("_m"), F.col("sample_size")
    found = F.when(N - m < n, F.lit(1.0)).otherwise(-F.expm1(log_miss(N, m, n)))
    clusters = sizes.agg(F.count("*")).scalar()
    out = grid.groupBy("sample_size").agg(F.sum(F.col("_c") * found).alias("expected_clusters"))
    return out.withColumn("total_clusters", clusters).withColumn("fraction", F.col("expected_clusters") / F.col("total_clusters"))


def rarefaction_repeats(sizes: DataFrame, samples: list[int], repeats: int, seed: int = 42) -> DataFrame:
    """(sample_size, mean, lo, hi): distinct clusters of repeated random samples.

    ``sizes`` is (cluster, members). A cluster owns as many ranks as it has members; a
    repeat is a keyed shuffle of all ranks, a sample of size n its first n places, and a
    cluster is found when its first place is within n. Rows are never repeated: pieces of
    ranks give their least place in each repeat, and these are counted.
    """
    rows = cut_lineage(sizes.select(F.col("cluster").cast("string").alias("cluster"), "members"))
    n = rows.agg(F.sum("members")).scalar()
    pieces = _rank_pieces(rows.withColumn("_n", n), [], ["cluster"], "members")
    spread = pieces.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit((repeats - 1) // SHUFFLES_AT_ONCE))))

    def firsts(pdf: pd.DataFrame) -> pd.DataFrame:
        blk, n = int(pdf["_blk"].iloc[0]), int(pdf["_n"].iloc[0])
        reps = np.arange(blk * SHUFFLES_AT_ONCE, min((blk + 1) * SHUFFLES_AT_ONCE, repeats)) + 1
        pdf = pdf.sort_values("_from")
        ranks = np.concatenate([np.arange(a, b) for a, b in zip(pdf["_from"], pdf["_upto"])])
        places = shuffled_ranks(ranks, n, shuffle_keys([f"{seed}|{r}" for r in reps], n))
        starts = np.cumsum(pdf["_upto"] - pdf["_from"]) - (pdf["_upto"] - pdf["_from"])
        least = np.minimum.reduceat(places, starts.to_numpy(), axis=1)
        return pd.DataFrame({"cluster": np.tile(pdf["cluster"].to_numpy(), len(reps)), "_rep": np.repeat(reps, len(pdf)), "_first": least.ravel() + 1})

    kernel = compute_partitions(spread, "_blk", "_piece").groupBy("_blk", "_piece").applyInPandas(firsts, "cluster string, _rep long, _first long")
    seen = kernel.groupBy("_rep", "cluster").agg(F.min("_first").alias("_first"))
    grid = seen.withColumn("sample_size", _explode_sizes(samples))
    found = grid.groupBy("_rep", "sample_size").agg(F.count_if(F.col("_first") <= F.col("sample_size")).alias("_d"))
    return found.groupBy("sample_size").agg(  # one row per repeat
        F.avg("_d").alias("mean_clusters"), F.percentile("_d", 0.025).alias("lo"), F.percentile("_d", 0.975).alias("hi")
    )
