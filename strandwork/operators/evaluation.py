"""Classifier metrics, threshold sweeps, ranking metrics, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_list, ratio
from .aggregate import fold_mean_std
from .ordering import ordered_scan


BINARY_METRICS = ["accuracy", "precision", "recall", "specificity", "fpr", "f1", "balanced_accuracy"]


def binary_rates(df: DataFrame) -> DataFrame:
    """Ratios from tp, fp, tn, fn; 0 on a zero denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = df.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "specificity": ratio(tn, tn + fp),
            "fpr": ratio(fp, fp + tn),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": ratio(2 * p * r, p + r), "balanced_accuracy": (r + F.col("specificity")) / 2})


def binary_metrics(df: DataFrame, y: str, pred: str, group=()) -> DataFrame:
    t, h = F.col(y), F.col(pred)
    counts = df.groupBy(*as_list(group)).agg(
        F.count_if((t == 1) & (h == 1)).alias("tp"),
        F.count_if((t == 0) & (h == 1)).alias("fp"),
        F.count_if((t == 0) & (h == 0)).alias("tn"),
        F.count_if((t == 1) & (h == 0)).alias("fn"),
    )
    return binary_rates(counts)


def confusion_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(true, pred).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    return counts.groupBy(true).pivot(pred, labels).agg(F.sum("n")).fillna(0)


def multiclass_metrics(counts: DataFrame, true: str, pred: str, labels: DataFrame) -> DataFrame:
    """accuracy, macro-F1 over ALL known labels, support-weighted F1.

    ``labels`` is a one-column table of the known labels.
    """
    col = labels.columns[0]
    sup = counts.groupBy(F.col(true).alias(col)).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    got = counts.groupBy(F.col(pred).alias(col)).agg(F.sum("n").alias("predicted"))
    per = labels.join(sup, col, "left").join(got, col, "left").fillna(0, ["support", "tp", "predicted"])
    prec, rec = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    per = per.withColumn("f1", ratio(2 * prec * rec, prec + rec))
    return per.agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def cascade(s1: Column, s2: Column, t1: float, t2: float) -> Column:
    """1 only when both stage scores reach their thresholds."""
    return F.when((s1 >= t1) & (s2 >= t2), 1).otherwise(0)


def _score_counts(df: DataFrame, y: str, score: str, group: list) -> DataFrame:
    return df.groupBy(*group, score).agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))


def threshold_sweep(df: DataFrame, y: str, score: str, group=(), grid: int | None = None) -> DataFrame:
    """Metrics at each threshold (score >= t).

    Thresholds are the distinct scores; ``grid`` asks for that many equal steps
    from 0 to 1 in their place, which bounds the result. Scores are counted first,
    then the counts are summed from the top, so no row meets more than one threshold.
    """
    group = as_list(group)
    counts = _score_counts(df, y, score, group)
    if grid is None and group:
        # The thresholds are shared: every group is read at every distinct score.
        # Groups (folds, models) are few; the list of them rides on each score.
        every = counts.select(F.struct(*group).alias("_g")).distinct().agg(F.collect_list("_g")).scalar()
        frame = counts.select(score).distinct().withColumn("_g", F.explode(every)).select("_g.*", score)
        counts = frame.join(counts, [*group, score], "left").fillna(0, ["_pos", "_neg"])
        cells = counts.withColumnRenamed(score, "threshold")
    elif grid is None:
        cells = counts.withColumnRenamed(score, "threshold")
    else:
        step = float(grid - 1)
        at = F.floor(F.col(score) * step + 1e-9)
        binned = counts.withColumn("_i", F.least(F.greatest(at, F.lit(-1)), F.lit(grid - 1))).groupBy(*group, "_i").agg(
            F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
        )
        below = F.array(*[F.lit(-1)])
        points = F.concat(below, F.sequence(F.lit(0), F.lit(grid - 1))).cast("array<long>")
        if group:
            frame = counts.select(*group).distinct().withColumn("_i", F.explode(points))
        else:
            frame = df.sparkSession.range(-1, grid).select(F.col("id").alias("_i"))
        cells = frame.join(binned, [*group, "_i"], "left").fillna(0, ["_pos", "_neg"]).withColumn("threshold", F.col("_i") / step)
    scanned = ordered_scan(cells, [F.desc("threshold")], {"tp": F.col("_pos"), "fp": F.col("_neg")}, group, -F.floor(F.col("threshold") * 16))
    tot = cells.groupBy(*group).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    if group:
        both = scanned.join(tot, group)
    else:
        t = tot.select(F.struct("_P", "_N").alias("t")).scalar()
        both = scanned.withColumn("_t", t).select("*", "_t._P", "_t._N").drop("_t")
    both = both.filter("threshold >= 0").withColumns({"fn": F.col("_P") - F.col("tp"), "tn": F.col("_N") - F.col("fp")})
    return binary_rates(both.select(*group, "threshold", "tp", "fp", "tn", "fn"))


# The four threshold rules: bound column and, for a row inside and outside the
# bound, the keys in order (negative = smaller is better).
RULES = {
    "max_fpr": ("fpr", ["recall", "precision", "-fpr", "threshold"], ["-fpr", "recall", "precision", "threshold"]),
    "max_fpr_max_precision": ("fpr", ["precision", "recall", "-fpr", "threshold"], ["-fpr", "precision", "recall", "threshold"]),
    "min_recall": ("recall", ["-fpr", "precision", "recall", "threshold"], ["recall", "-fpr", "precision", "threshold"]),
    "min_recall_max_precision": ("recall", ["precision", "-fpr", "recall", "threshold"], ["recall", "precision", "-fpr", "threshold"]),
}


def pick_threshold(sweep: DataFrame, rule: str, bound: float, group=()) -> DataFrame:
    """The best sweep row under a rule; outside rows compete only when no row
    is inside the bound."""
    col, inside_keys, outside_keys = RULES[rule]
    inside = F.col(col) <= bound if col == "fpr" else F.col(col) >= bound

    def key(k):
        return -F.col(k[1:]) if k.startswith("-") else F.col(k)

    order = F.struct(
        inside.alias("inside"),
        *[F.when(inside, key(a)).otherwise(key(b)).alias(f"k{i}") for i, (a, b) in enumerate(zip(inside_keys, outside_keys))],
    )
    cols = [c for c in sweep.columns if c not in as_list(group)]
    best = sweep.groupBy(*as_list(group)).agg(F.max_by(F.struct(*cols), order).alias("_b"), F.max(inside).alias("bound_met"))
    return best.select(*as_list(group), F.lit(rule).alias("rule"), "bound_met", *[F.col(f"_b.{c}").alias(c) for c in cols])


def threshold_rules(sweep: DataFrame, bounds: dict[str, float], group=()) -> DataFrame:
    return reduce(DataFrame.unionByName, [pick_threshold(sweep, r, b, group) for r, b in bounds.items()])


def ranking_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """AP, ROC-AUC, MCC, balanced accuracy and F1 at 0.5, best F1 with its threshold.

    Ties are counted together; the running totals are taken over distinct scores.
    """
    counts = _score_counts(df, y, score, [])
    scanned = ordered_scan(counts, [F.desc(score)], {"_tp": F.col("_pos"), "_fp": F.col("_neg")})
    tot = counts.agg(F.struct(F.sum("_pos").cast("double").alias("P"), F.sum("_neg").cast("double").alias("N")).alias("t")).scalar()
    s = scanned.withColumn("_t", tot)
    P, N = F.col("_t.P"), F.col("_t.N")
    tp, fp = F.col("_tp").cast("double"), F.col("_fp").cast("double")
    pos, neg = F.col("_pos"), F.col("_neg")
    at = F.col(score) >= 0.5
    prec, rec = tp / (tp + fp), tp / P
    f1 = 2 * prec * rec / (prec + rec + 1e-12)
    g = s.withColumn("_f1", f1).agg(
        F.sum(pos / P * prec).alias("average_precision"),
        F.sum(neg * (tp - pos / 2) / (P * N)).alias("roc_auc"),
        F.max("_f1").alias("f1_best"),
        F.max_by(score, F.struct(F.round("_f1", 12), -F.col(score))).alias("threshold_best"),
        F.sum(F.when(at, pos).otherwise(0)).cast("double").alias("_tp5"),
        F.sum(F.when(at, neg).otherwise(0)).cast("double").alias("_fp5"),
        F.max(P).alias("_P"),
        F.max(N).alias("_N"),
    )
    a, b = F.col("_tp5"), F.col("_fp5")
    c, d = F.col("_N") - b, F.col("_P") - a
    p5, r5 = ratio(a, a + b), ratio(a, a + d)
    return g.select(
        "average_precision", "roc_auc", "f1_best", "threshold_best",
        ratio(2 * p5 * r5, p5 + r5).alias("f1_at_05"),
        ((ratio(a, a + d) + ratio(c, c + b)) / 2).alias("balanced_at_05"),
        ratio(a * c - b * d, F.sqrt((a + b) * (a + d) * (c + b) * (c + d))).alias("mcc_at_05"),
    )


def fold_concat_summary(folds: DataFrame, y: str, preds: dict[str, str], fold: str = "fold") -> DataFrame:
    """Pooled metrics per model next to the fold mean and std of each metric.

    The rows are read once: counts per (model, fold), then everything else from
    that small table.
    """
    long = folds.select(fold, y, *[F.col(c).cast("int").alias(m) for m, c in preds.items()]).unpivot([fold, y], list(preds), "model", "_pred")
    per_fold = binary_metrics(long, y, "_pred", ["model", fold])
    pooled = binary_rates(per_fold.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))
    return pooled.join(fold_mean_std(per_fold, BINARY_METRICS, ["model"]), "model")
