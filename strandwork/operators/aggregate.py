"""Aggregations: pooling, distributions, summaries, pivots, feature usage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col, as_list, ratio
from .ordering import compute_partitions, interpolated_quantiles, rank_rows, top_k, value_cells

# The quantiles of a distribution summary.
SUMMARY_QUANTILES = {"median": 0.5, "q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9}
DEAD_THRESHOLDS = [100, 500, 1000, 2000, 5000]


# ---- pooling ----------------------------------------------------------------


def sparse_mean_pool(tokens: DataFrame, lengths: DataFrame, seq: str = "seq_id") -> DataFrame:
    """(seq, feature, mean): token sums over the sequence LENGTH.

    ``tokens`` is (seq, token, feature, value); ``lengths`` is (seq, length).
    When any length is not positive the observed token counts are used for all.
    """
    sums = tokens.groupBy(seq, "feature").agg(F.sum("value").alias("_s"))
    bad = lengths.agg(F.coalesce(F.max((F.col("length") <= 0).cast("int")), F.lit(0))).scalar()
    seen = tokens.groupBy(seq).agg(F.count_distinct("token").alias("_seen"))
    denom = lengths.join(seen, seq, "left").withColumn(
        "_d", F.when(bad == 1, F.coalesce("_seen", F.lit(0))).otherwise(F.col("length"))
    )
    return sums.join(denom.select(seq, "_d"), seq).select(seq, "feature", (F.col("_s") / F.greatest("_d", F.lit(1))).alias("mean"))


def long_cells(df: DataFrame, keys, vec: str = "vec") -> DataFrame:
    """Vectors to (keys, dim, x)."""
    return df.select(*as_list(keys), F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))


def vector_mean(vec: str | Column) -> Column:
    """Element-wise mean of a group's vectors; one buffer a group, no row per element."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_col(vec).cast("array<double>"))))


def dense_mean_pool(tokens: DataFrame, seq: str, vec: str, mask: str | None = None, dims: int | None = None) -> DataFrame:
    """(seq, vec): element-wise mean of the (masked) token vectors of a sequence.

    Vectors are summed whole, first inside tasks. Sequences without a kept token get
    the zero vector when ``dims`` is given.
    """
    kept = tokens.filter(F.col(mask)) if mask else tokens
    pooled = kept.filter(F.col(vec).isNotNull()).groupBy(seq).agg(vector_mean(vec).alias("vec"))
    if dims is None:
        return pooled
    everyone = tokens.select(seq).distinct()
    return everyone.join(pooled, seq, "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)))


def cls_and_mean(cls: Column, mean: Column) -> Column:
    return F.concat(cls.cast("array<double>"), mean)


def normalized_mean(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, mean): mean of the L2-normalised vectors."""
    x = F.col(vec).cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)), F.lit(1e-9))
    unit = df.filter(F.col(vec).isNotNull()).withColumn("_n", norm).select(F.transform(x, lambda v: v / F.col("_n")).alias("_u"))
    return unit.agg(vector_mean("_u").alias("m")).select(F.posexplode("m").alias("dim", "mean"))


def weighted_top_label(tokens: DataFrame, manifest: DataFrame, seq: str, label: str, conf: str, pos: str) -> DataFrame:
    """Per sequence the label with the greatest confidence sum (first met wins
    a tie), its share and the token counts; (-1, 0, 0) where nothing mapped.

    ``manifest`` must hold every sequence once.
    """
    per = tokens.groupBy(seq, label).agg(F.sum(conf).alias("_w"), F.count("*").alias("_n"), F.min(pos).alias("_first"))
    real = F.col(label) >= 0
    g = per.groupBy(seq).agg(
        F.max_by(label, F.when(real, F.struct(F.round("_w", 9), -F.col("_first")))).alias("top"),
        F.max(F.when(real, F.col("_w"))).alias("weight"),
        F.sum(F.when(real, F.col("_w"))).alias("_all"),
        F.sum("_n").alias("_total"),
        F.sum(F.when(real, F.col("_n"))).alias("_mapped"),
        F.count_if(real).alias("_unique"),
    )
    zero = F.lit(0)
    return manifest.select(seq).join(g, seq, "left").select(
        seq,
        F.coalesce("top", F.lit(-1)).alias("top_label"),
        F.coalesce("weight", F.lit(0.0)).alias("top_weight"),
        F.coalesce(F.when(F.col("_all") > 0, F.col("weight") / F.col("_all")), F.lit(0.0)).alias("top_fraction"),
        F.coalesce("_total", zero).alias("total_tokens"),
        F.coalesce("_mapped", zero).alias("mapped_tokens"),
        F.coalesce("_unique", zero).alias("unique_labels"),
    )


# ---- distributions and pair summaries ----------------------------------------


def recounted_summary(df: DataFrame, value: str, group, bounds: tuple[float, float]) -> DataFrame:
    """``distribution_summary`` of a table whose rows are computed twice and not shuffled:
    once into counts and moments of value cells along ``bounds``, once for the values
    next to the wanted ranks. Exact for any values; few should lie beyond the bounds."""
    group = as_list(group)
    cells = value_cells(df, value, group, bounds)
    mean = cells.groupBy(*group).agg(
        F.sum("_c").alias("n"), (F.sum(F.col("_c") * F.col("_mean")) / F.sum("_c")).alias("mean"), F.min("_min").alias("min"), F.max("_max").alias("max")
    )
    apart = F.col("_mean") - F.col("mean")
    var = cells.join(mean.select(*group, "mean"), group).groupBy(*group).agg((F.sum(F.col("_c") * (F.col("_var") + apart * apart)) / F.sum("_c")).alias("_var"))
    base = mean.join(var, group).select(*group, "n", "mean", F.sqrt("_var").alias("std"), "min", "max")
    return base.join(interpolated_quantiles(df, value, SUMMARY_QUANTILES, group, bounds, cells), group)


def distribution_summary(df: DataFrame, value: str, group=()) -> DataFrame:
    """n, mean, median, population std, extremes and linear quantiles, exact."""
    group = as_list(group)
    base = df.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quant = interpolated_quantiles(df, value, SUMMARY_QUANTILES, group)
    if group:
        return base.join(quant, group)
    q = quant.select(F.struct(*SUMMARY_QUANTILES).alias("q")).scalar()
    return base.withColumn("_q", q).select(*base.columns, *[F.col(f"_q.{c}").alias(c) for c in SUMMARY_QUANTILES])


def cluster_pair_summary(pairs: DataFrame, catalog: DataFrame, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Scores by unordered cluster pair with flags and structure counts.

    ``pairs`` is (cluster1, cluster2, score); ``catalog`` is (id, cluster, group);
    most scores lie within ``bounds``. Pairs are computed twice and never shuffled.
    """
    keyed = pairs.select(F.least("cluster1", "cluster2").alias("cluster1"), F.greatest("cluster1", "cluster2").alias("cluster2"), "score")
    return with_cluster_info(recounted_summary(keyed, "score", ["cluster1", "cluster2"], bounds), catalog)


def with_cluster_info(stats: DataFrame, catalog: DataFrame) -> DataFrame:
    """``stats`` by (cluster1, cluster2) with groups, structure counts and flags of ``catalog`` (id, cluster, group)."""
    info = catalog.groupBy("cluster").agg(F.max("group").alias("group"), F.count("*").alias("n_structures"))
    for side in ("1", "2"):
        stats = stats.join(info.select(*[F.col(c).alias(c + side) for c in info.columns]), f"cluster{side}")
    return stats.withColumns(
        {"same_cluster": F.col("cluster1") == F.col("cluster2"), "same_group": F.col("group1") == F.col("group2")}
    )


def mean_matrix_pivot(pair_means: DataFrame, labels: list | None = None, row: str = "cluster1", col: str = "cluster2", value: str = "mean") -> DataFrame:
    """Symmetric label x label matrix, null where a pair is absent. Columns are the given
    labels, or all that there are."""
    mirrored = pair_means.select(row, col, value).unionByName(
        pair_means.filter(F.col(row) != F.col(col)).select(F.col(col).alias(row), F.col(row).alias(col), value)
    )
    return mirrored.groupBy(F.col(row).alias("cluster")).pivot(col, labels).agg(F.first(value))


def relation_category(same_cluster: Column, same_group: Column) -> Column:
    return F.when(same_cluster, "within_cluster").when(same_group, "between_clusters_same_group").otherwise("between_groups")


def relation_category_summary(pair_rows: DataFrame) -> DataFrame:
    """Distribution of pair means per relation category."""
    cat = pair_rows.withColumn("category", relation_category(F.col("same_cluster"), F.col("same_group")))
    return distribution_summary(cat, "mean", ["category"])


def evidence_summary(detail: DataFrame, group: str, means: list[str], deltas: list[str], pvalues: list[str]) -> DataFrame:
    """Means, counts of delta > 0 and p < 0.05, combined p, per group."""
    from .statistics import fisher_columns

    aggs = [F.count("*").alias("n")]
    aggs += [F.avg(c).alias(f"mean_{c}") for c in means]
    aggs += [F.count_if(F.col(c) > 0).alias(f"n_positive_{c}") for c in deltas]
    aggs += [F.count_if(F.col(p) < 0.05).alias(f"n_significant_{p}") for p in pvalues]
    for p in pvalues:
        aggs += fisher_columns(p)
    out = detail.groupBy(group).agg(*aggs)
    from .statistics import fisher_value

    return out.withColumns({f"fisher_{p}": fisher_value(p) for p in pvalues}).drop(*[f"_{k}_{p}" for p in pvalues for k in ("s", "k")])


# ---- ecosystem tables ----------------------------------------------------------


def geo_grid_pivot(df: DataFrame, lat: str, lon: str, category: str, categories: list[str], bin_deg: float) -> DataFrame:
    """Half-even grid cells clamped to the globe: total, count per category and
    mean true coordinates. A cell whose rows all have other categories is left out."""
    cell = {
        "plot_lat": F.greatest(F.least(F.bround(F.col(lat) / bin_deg) * bin_deg, F.lit(90.0)), F.lit(-90.0)),
        "plot_lon": F.greatest(F.least(F.bround(F.col(lon) / bin_deg) * bin_deg, F.lit(180.0)), F.lit(-180.0)),
    }
    kept = df.withColumns(cell).filter(F.col(category).isin(categories))
    return kept.groupBy("plot_lat", "plot_lon").agg(
        F.count("*").alias("total"),
        F.avg(lat).alias("latitude"),
        F.avg(lon).alias("longitude"),
        *[F.count_if(F.col(category) == c).alias(c) for c in categories],
    )


def sharing_matrix(rows: DataFrame, degrees: list[int], columns: list[str] | None = None, col: str = "sub", value: str = "n_clusters") -> DataFrame:
    """Degree x column sums with row totals; other degrees are skipped. Columns are the given
    ones, or all that there are."""
    wide = rows.filter(F.col("degree").isin(degrees)).groupBy("degree").pivot(col, columns).agg(F.sum(value)).fillna(0)
    return wide.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in wide.columns if c != "degree"]))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("members"))


def cluster_size_stats(df: DataFrame, cluster: str) -> DataFrame:
    return cluster_sizes(df, cluster).agg(
        F.count("*").alias("n_clusters"), F.sum("members").alias("n_members"), F.max("members").alias("max_size"), F.min("members").alias("min_size")
    )


def largest_clusters(df: DataFrame, cluster: str, k: int = 10) -> DataFrame:
    return cluster_sizes(df, cluster).orderBy(F.desc("members"), cluster).limit(k)


# ---- scaling and vector statistics ----------------------------------------------


def standardize_fit(df: DataFrame, keys=(), vec: str = "vec", floor: float = 1e-6) -> DataFrame:
    """(keys, mean, std): arrays by dimension; population std, under ``floor`` 1."""
    measured = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(vec).cast("array<double>")))
    got = df.filter(F.col(vec).isNotNull()).groupBy(*as_list(keys)).agg(measured.alias("m"))
    n = F.col("m.count").cast("double")
    std = F.transform(vector_to_array("m.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return got.select(*as_list(keys), vector_to_array("m.mean").alias("mean"), F.transform(std, lambda v: F.when(v < floor, 1.0).otherwise(v)).alias("std"))


def standardize_apply(df: DataFrame, fitted: DataFrame, keys=(), vec: str = "vec") -> DataFrame:
    """``vec`` as z-scores of the fitted means and stds, one row of arrays per key."""
    keys = as_list(keys)
    if keys:
        rows = df.join(fitted, keys)
    else:
        rows = df.withColumn("_f", fitted.select(F.struct("mean", "std").alias("f")).scalar()).select("*", "_f.mean", "_f.std").drop("_f")
    moved = F.zip_with(F.col(vec).cast("array<double>"), "mean", lambda x, m: x - m)
    return rows.withColumn(vec, F.zip_with(moved, "std", lambda x, d: x / d)).drop("mean", "std")


def robust_stats(cells: DataFrame, clip: float = 5.0, approximate: bool = False) -> DataFrame:
    """Per dimension mean, std, median, IQR, extremes, clip bounds, >10 sigma flag.

    ``approximate`` trades exact quantiles for one pass of sketches.
    """
    base = cells.groupBy("dim").agg(
        F.avg("x").alias("mean"),
        F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    if approximate:
        quant = cells.groupBy("dim").agg(
            *[F.percentile_approx("x", q, 10000).alias(n) for n, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))]
        )
    else:
        quant = interpolated_quantiles(cells, "x", {"median": 0.5, "q25": 0.25, "q75": 0.75}, ["dim"])
    both = base.join(quant, "dim")
    return both.select(
        "dim", "mean", "std", "min", "max", "median",
        F.greatest(F.col("q75") - F.col("q25"), F.lit(1e-6)).alias("iqr"),
        (F.col("mean") - clip * F.col("std")).alias("clip_min"),
        (F.col("mean") + clip * F.col("std")).alias("clip_max"),
        ((F.col("min") < F.col("mean") - 10 * F.col("std")) | (F.col("max") > F.col("mean") + 10 * F.col("std"))).alias("extreme"),
    )


def feature_counts(activations: DataFrame, n_features: int, total_steps: int) -> DataFrame:
    """(feature, activations, last_step, steps_since) for every feature id.

    ``activations`` is (step, feature) with steps 1 .. total_steps; a feature
    that never fired has waited for all steps.
    """
    g = activations.groupBy("feature").agg(F.count("*").alias("activations"), F.max("step").alias("last_step"))
    every = activations.sparkSession.range(n_features).select(F.col("id").cast("int").alias("feature"))
    return every.join(g, "feature", "left").select(
        "feature",
        F.coalesce("activations", F.lit(0)).alias("activations"),
        (F.lit(total_steps) - F.coalesce("last_step", F.lit(0))).alias("steps_since"),
    )


def feature_usage(counts: DataFrame, threshold: int, total_steps: int, rare_rate: float = 0.01, thresholds=DEAD_THRESHOLDS) -> DataFrame:
    """One row of activity counts, ratios, quartiles, Gini and entropy."""
    s, a = F.col("steps_since"), F.col("activations")
    tot = counts.agg(F.sum("activations").cast("double")).scalar()
    rate_sum = F.col("_tot") / (total_steps + 1e-8)
    p = (a / (total_steps + 1e-8)) / (rate_sum + 1e-10)
    ranked = rank_rows(counts.withColumn("_tot", tot), ["activations", "feature"], (), "_rk")
    one = ranked.agg(
        F.count("*").alias("n_total"),
        F.count_if(a > 0).alias("n_active"),
        F.count_if(s > threshold).alias("n_dead"),
        F.count_if((s > threshold // 2) & (s <= threshold)).alias("n_at_risk"),
        F.count_if(s > 2 * threshold).alias("n_critically_dead"),
        F.avg((a == 0).cast("double")).alias("never_ratio"),
        F.avg((a / (total_steps + 1e-8) < rare_rate).cast("double")).alias("rare_ratio"),
        F.sum("activations").alias("total_activations"),
        F.max("steps_since").alias("max_steps_since"),
        (-F.sum(p * F.log(p + 1e-10))).alias("entropy"),
        F.sum(F.col("_rk") * a).alias("_ra"),
        F.avg(F.when(a > 0, a)).alias("active_mean"),
        F.stddev_pop(F.when(a > 0, a)).alias("active_std"),
        *[F.count_if(s > t).alias(f"dead_at_{t}") for t in thresholds],
    )
    quart = interpolated_quantiles(counts.filter("activations > 0"), "activations", {"active_q25": 0.25, "active_median": 0.5, "active_q75": 0.75})
    q = quart.select(F.struct("active_q25", "active_median", "active_q75").alias("q")).scalar()
    n = F.col("n_total")
    gini = F.when(F.col("total_activations") > 0, 2 * F.col("_ra") / (n * F.col("total_activations")) - (n + 1) / n).otherwise(0.0)
    out = one.withColumns(
        {
            "gini": gini,
            "active_ratio": F.col("n_active") / n,
            "dead_ratio": F.col("n_dead") / n,
            "at_risk_ratio": F.col("n_at_risk") / n,
            "_q": q,
        }
    )
    return out.select(*[c for c in out.columns if c not in ("_ra", "_q")], "_q.active_q25", "_q.active_median", "_q.active_q75")


def reconstruction_by_dim(cells: DataFrame) -> DataFrame:
    """(dim, mse, var, ev) from (row, dim, x, xhat): sample variance, EV = 1 - mse/var."""
    g = cells.groupBy("dim").agg(F.avg(F.pow(F.col("x") - F.col("xhat"), 2)).alias("mse"), F.var_samp("x").alias("var"))
    return g.withColumn("ev", 1 - F.col("mse") / (F.col("var") + 1e-8))


def reconstruction_totals(by_dim: DataFrame) -> DataFrame:
    """Total and lower-median EV over dimensions and the weak-dimension counts."""
    ranked = rank_rows(by_dim, ["ev", "dim"], (), "_r").withColumn("_n", by_dim.agg(F.count("*")).scalar())
    return ranked.agg(
        F.avg("mse").alias("total_mse"),
        (1 - F.avg("mse") / (F.avg("var") + 1e-8)).alias("total_ev"),
        F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) / 2) + 1, F.col("ev"))).alias("median_ev"),
        F.count_if(F.col("ev") < 0.5).alias("dims_below_50pct"),
        F.count_if(F.col("ev") < 0).alias("dims_below_0"),
    )


def extreme_dims(by_dim: DataFrame, k: int = 20) -> DataFrame:
    """The k worst and the k best dimensions by explained variance."""
    worst = top_k(by_dim, ["ev", "dim"], k).withColumn("side", F.lit("worst"))
    best = top_k(by_dim, [F.desc("ev"), "dim"], k).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def batch_l0(sparse: DataFrame, row: str) -> DataFrame:
    """Mean number of active features per row."""
    return sparse.groupBy(row).agg(F.count("*").alias("_n")).agg(F.avg("_n").alias("l0"))


# ---- panels --------------------------------------------------------------------


def metric_panel_union(tables: dict[str, tuple[DataFrame, dict[str, str]]], metrics: list[str], models: list[str]) -> DataFrame:
    """Differently named metric tables to one long (split, model, metric, value)."""
    parts = []
    for split, (df, names) in tables.items():
        cols = [F.col(old).alias(new) for old, new in names.items()]
        part = df.select(*cols).unpivot("model", metrics, "metric", "value")
        parts.append(part.withColumn("split", F.lit(split)))
    return reduce(DataFrame.unionByName, parts).filter(F.col("model").isin(models))


def fold_mean_std(df: DataFrame, metrics: list[str], group=(), sample: bool = False) -> DataFrame:
    """Mean and std per metric: population over folds, sample over seeds (0 for
    one run); an empty input gives 0, 0."""
    std = F.stddev_samp if sample else F.stddev_pop
    aggs = []
    for m in metrics:
        aggs += [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean"), F.coalesce(std(m), F.lit(0.0)).alias(f"{m}_std")]
    return df.groupBy(*as_list(group)).agg(*aggs)


def fp_per_million(fp: Column, negatives: Column) -> Column:
    return ratio(fp * 1_000_000.0, negatives)


def pair_cosine(cells: DataFrame, item: str, feature: str, value: str, block_items: int = 256, block_features: int = 50_000) -> DataFrame:
    """(i, j, sim): cosine of every pair of item profiles given as long cells.

    The result is the whole similarity matrix. Items and features are hashed
    into blocks; a block of the matrix is the product of two item blocks summed
    over the feature blocks, so a feature that all items share costs no more
    than any other and an item of many features is spread over the blocks.
    Pairs without a common feature are left out.
    """
    norms = cells.groupBy(item).agg(F.greatest(F.sqrt(F.sum(F.col(value) * F.col(value))), F.lit(1e-12)).alias("_n"))
    unit = cells.join(norms, item).select(F.col(item).alias("it"), F.col(feature).alias("ft"), (F.col(value) / F.col("_n")).alias("u"))
    n_blocks = norms.agg(F.ceil(F.count("*") / block_items).cast("int")).scalar()
    n_feat = unit.agg(F.ceil(F.approx_count_distinct("ft") / block_features).cast("int")).scalar()
    unit = unit.withColumns({"_nb": n_blocks, "_nf": n_feat})
    unit = unit.withColumns({"_b": F.pmod(F.xxhash64("it"), "_nb").cast("int"), "_f": F.pmod(F.xxhash64("ft"), "_nf").cast("int")})
    met = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda o: F.struct(F.least(F.col("_b"), o).alias("lo"), F.greatest(F.col("_b"), o).alias("hi")))
    spread = unit.withColumn("_p", F.explode(met)).select("it", "ft", "u", "_b", "_f", "_p.lo", "_p.hi")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        a, b = pdf[pdf["_b"] == lo], pdf[pdf["_b"] == hi]
        ia, ka = np.unique(a["it"].to_numpy(), return_inverse=True)
        ib, kb = np.unique(b["it"].to_numpy(), return_inverse=True)
        feats, code = np.unique(pdf["ft"].to_numpy(), return_inverse=True)
        in_a, in_b = (pdf["_b"] == lo).to_numpy(), (pdf["_b"] == hi).to_numpy()
        fa, fb, ua, ub = code[in_a], code[in_b], a["u"].to_numpy(), b["u"].to_numpy()
        sim, hit = np.zeros((len(ia), len(ib))), np.zeros((len(ia), len(ib)))
        for start in range(0, len(feats), 2048):
            pa, pb = (fa >= start) & (fa < start + 2048), (fb >= start) & (fb < start + 2048)
            A, B = np.zeros((len(ia), 2048)), np.zeros((len(ib), 2048))
            A[ka[pa], fa[pa] - start] = ua[pa]
            B[kb[pb], fb[pb] - start] = ub[pb]
            sim += A @ B.T
            hit += (A != 0).astype(float) @ (B != 0).astype(float).T
        r, c = np.nonzero(hit)
        out = pd.DataFrame({"i": ia[r], "j": ib[c], "part": sim[r, c]})
        if lo != hi:
            out = pd.concat([out, out.rename(columns={"i": "j", "j": "i"})[["i", "j", "part"]]])
        return out

    kind = dict(cells.dtypes)[item]
    parts = compute_partitions(spread, "lo", "hi", "_f").groupBy("lo", "hi", "_f").applyInPandas(product, f"i {kind}, j {kind}, part double")
    return parts.groupBy("i", "j").agg(F.sum("part").alias("sim"))
