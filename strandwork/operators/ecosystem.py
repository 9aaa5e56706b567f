"""Ecosystem membership, composition, repertoire and assignment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio


def sharing_degree(members: DataFrame, cluster: str, main: str, sub: str) -> DataFrame:
    """Sequences and clusters per (main, sub, degree) with sub-ecosystem totals;
    degree = number of main ecosystems a cluster is found in."""
    per = members.groupBy(cluster, main, sub).agg(F.count("*").alias("_n"))
    degree = per.groupBy(cluster).agg(F.count_distinct(main).alias("degree"))
    g = per.join(degree, cluster).groupBy(main, sub, "degree").agg(F.sum("_n").alias("n_sequences"), F.count("*").alias("n_clusters"))
    return g.withColumn("sub_total", F.sum("n_sequences").over(Window.partitionBy(sub)))  # a few degrees per sub


def composition_percent(wide: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Wide counts to long with the percent inside each column (0 at total 0)."""
    long = wide.unpivot(row, [c for c in wide.columns if c != row], col, value)
    total = F.sum(value).over(Window.partitionBy(col))
    return long.withColumn("percent", ratio(F.col(value) * 100.0, total))


def fold_summary(reps: DataFrame, fold: str, excluded: list[str] = ()) -> DataFrame:
    """Representatives, members, hits, hit rate, redundancy and log columns.

    ``reps`` has one row per representative cluster with members and hits.
    """
    kept = reps.filter(~F.col(fold).isin(list(excluded))) if excluded else reps
    zero = F.lit(0)
    g = kept.groupBy(fold).agg(
        F.count("*").alias("representatives"), F.sum(F.coalesce("members", zero)).alias("members"), F.sum(F.coalesce("hits", zero)).alias("hits")
    )
    return g.withColumns(
        {
            "hit_rate": ratio(F.col("hits"), F.col("members")),
            "redundancy": ratio(F.col("members"), F.col("representatives")),
            "log_members": F.log10(F.greatest("members", F.lit(1))),
            "log_hits": F.log10(F.greatest("hits", F.lit(1))),
        }
    )


def mode_label(df: DataFrame, family: str, cluster: str) -> DataFrame:
    """Per family the commonest cluster (lowest id on ties), its count and share."""
    counts = df.groupBy(family, cluster).agg(F.count("*").alias("_n"))
    return counts.groupBy(family).agg(
        F.max_by(cluster, F.struct("_n", -F.col(cluster))).alias("top_cluster"),
        F.max("_n").alias("top_count"),
        (F.max("_n") / F.sum("_n")).alias("top_share"),
    )


def repertoire_ratios(rows: DataFrame, ours: str, others: list[str], recovered: str, parts: list[str]) -> DataFrame:
    """Fold expansion against reference collections, percent recovered and missed.

    ``rows`` is (category, value), one row per category.
    """
    names = sorted({ours, recovered, *others, *parts})
    one = rows.agg(*[F.max(F.when(F.col("category") == n, F.col("value"))).alias(f"_{n}") for n in names])
    pct = 100.0 * F.col(f"_{recovered}") / reduce(lambda a, b: a + b, [F.col(f"_{p}") for p in parts])
    return one.select(
        *[ratio(F.col(f"_{ours}"), F.col(f"_{o}"), None).alias(f"{ours}_vs_{o}") for o in others],
        pct.alias("percent_recovered"),
        (100.0 - pct).alias("percent_missed"),
    )


def evidence_crosstab(df: DataFrame, tier: str, a: str, b: str) -> DataFrame:
    return df.groupBy(tier, a, b).agg(F.count("*").alias("n")).withColumn("agree", F.col(a) == F.col(b))


def parameter_scan_best(scan: DataFrame, layer: str, score: str, params: list[str]) -> DataFrame:
    """Per layer the scan row of the best score, the lowest parameters on ties."""
    best = scan.groupBy(layer).agg(F.max(F.round(score, 9)).alias("_top"))
    tied = scan.join(best, layer).filter(F.round(score, 9) == F.col("_top"))
    g = tied.groupBy(layer).agg(F.min(F.struct(*params, score)).alias("_r"))
    return g.select(layer, *[F.col(f"_r.{c}").alias(c) for c in [*params, score]])


def group_assignment_load(df: DataFrame, group: str, cluster: str, targets: list[str] = ()) -> DataFrame:
    """Group to its sorted distinct integer clusters; non-numeric entries leave
    and a target group without clusters is an error."""
    numbers = df.select(group, F.col(cluster).try_cast("int").alias("_c")).filter("_c IS NOT NULL").distinct()
    out = numbers.groupBy(group).agg(F.array_sort(F.collect_list("_c")).alias("clusters"))
    if targets:
        found = {r[0] for r in out.filter(F.col(group).isin(list(targets))).select(group).collect()}
        missing = [t for t in targets if t not in found]
        if missing:
            raise ValueError(f"target groups without clusters: {missing}")
    return out
