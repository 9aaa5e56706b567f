"""Two-stage evaluation: early filter, hard negatives, late head, cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, sampling
from ..session import cut_lineage


def stage_thresholds(scored: DataFrame, min_recall: float, max_fpr: float, fold: str = "fold") -> DataFrame:
    """(fold, t1, t2) from the calibration rows of every fold at once.

    ``scored`` is (id, y, s1, s2, fold, role): the early threshold keeps the
    recall floor at the best precision, the late one the false-positive cap at
    the best recall.
    """
    cal = scored.filter("role = 'calibration'")
    early = evaluation.pick_threshold(evaluation.threshold_sweep(cal, "y", "s1", [fold]), "min_recall", min_recall, [fold])
    late = evaluation.pick_threshold(evaluation.threshold_sweep(cal, "y", "s2", [fold]), "max_fpr", max_fpr, [fold])
    return early.select(fold, F.col("threshold").alias("t1")).join(late.select(fold, F.col("threshold").alias("t2")), fold)


def two_stage_evaluation(scored: DataFrame, ident: str = "id", min_recall: float = 0.95, max_fpr: float = 0.01, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(fold predictions, pooled and per-fold summary) of given stage scores."""
    folded = sampling.stratified_kfold(scored, ident, "y", k)
    folded = cut_lineage(folded)  # read by the limits and by the predictions
    roles = sampling.calibration_split(folded, ident, "y", 0.2, group=["fold"])
    limits = stage_thresholds(cut_lineage(roles), min_recall, max_fpr)
    pred = folded.join(limits, "fold").withColumns(
        {
            "early_pred": (F.col("s1") >= F.col("t1")).cast("int"),
            "late_pred": (F.col("s2") >= F.col("t2")).cast("int"),
        }
    )
    pred = pred.withColumn("cascade_pred", F.col("early_pred") * F.col("late_pred"))
    pred = cut_lineage(pred)
    models = {"early": "early_pred", "late": "late_pred", "cascade": "cascade_pred"}
    return pred, evaluation.fold_concat_summary(pred, "y", models)
