"""Incremental runs, replaceable stages, gating, models."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import r6
from ..operators import encoding, models, sampling
from ..plans import screening, two_stage
from ..session import scratch_folder
from ..streaming import increment
from ..operators.evaluation import RULES
from .evaluation import COUNTS, FOLD_SQL, pooled_sql, rates, scored
from .registry import query, table
from .vectors import STD_X, UNIT_X, head_sql, property_tasks, screening_heads, vectors


@query(
    "resumable_increment",
    "SELECT event_type AS chunk_id, user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
)
def resumable_increment_q(spark, d):
    base = scratch_folder(spark, "run")
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.col("event_type").alias("chunk_id"))
    e.repartition("chunk_id").write.parquet(f"{base}/in")

    def count_tokens(rows):
        return rows.groupBy("chunk_id", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    schema = "event_id long, user_id long, value double, chunk_id string"
    for _ in range(2):  # the second run finds nothing to do
        increment.run_increment(spark, f"{base}/in", schema, f"{base}/out", f"{base}/cp", {"count": count_tokens})
    out = increment.stage_output(spark, f"{base}/out", "count", "user_id long, n long, total double, chunk_id string")
    return out.withColumn("total", r6("total"))


def fake_encoder(batches):
    """Deterministic stand-in for a model: sum and largest place of each vector."""
    for b in batches:
        if len(b):
            v = b["vec"]
            yield pd.DataFrame({"row_id": b["row_id"], "total": v.map(lambda x: float(x.astype("float64").sum())), "top_dim": v.map(lambda x: int(x.argmax()))})


@query(
    "stage_user_function",
    "SELECT vec_id AS row_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, (list_position(embedding, list_max(embedding)) - 1)::INT AS top_dim FROM embeddings",
)
def stage_user_function_q(spark, d):
    return screening.apply_rows(vectors(spark, d).select("row_id", "vec"), fake_encoder, "row_id long, total double, top_dim int").withColumn("total", r6("total"))


@query(
    "candidate_gate",
    f"""WITH {STD_X}, {head_sql('n', 'sx', 3, 5, 12, 2)}, {head_sql('q', 'sx', 2, 9, 12, 2)}, {UNIT_X}, {head_sql('f', 'ux', 4, 7, 10, 3)},
    s AS (SELECT e.vec_id, label <> 3 AS valid, n_p.p AS a, q_p.p AS b, n_p.p >= 0.4 AND q_p.p >= 0.6 AS ok FROM embeddings e JOIN n_p ON n_p.vec_id = e.vec_id AND n_p.c = 1 JOIN q_p ON q_p.vec_id = e.vec_id AND q_p.c = 1),
    o AS (SELECT vec_id, c, p FROM f_p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) = 1)
    SELECT s.vec_id AS row_id, valid, CASE WHEN valid THEN round(a, 6) END AS normal_score, CASE WHEN valid THEN round(b, 6) END AS hardneg_score,
    CASE WHEN valid THEN 'completed' ELSE 'invalid_input' END AS screen_status, CASE WHEN NOT valid THEN 'invalid_input' WHEN ok THEN 'completed' ELSE 'not_applicable' END AS embed_status,
    CASE WHEN valid AND ok THEN CASE WHEN p >= 0.5 THEN 'c' || c ELSE 'Unknown' END END AS fold_pred FROM s JOIN o ON o.vec_id = s.vec_id""",
)
def candidate_gate_q(spark, d):
    rows = vectors(spark, d).withColumn("valid", F.col("label") != 3).select("row_id", "vec", "valid")

    def screen(df):
        return encoding.two_head_score(df, screening_heads()).select("row_id", "normal_score", "hardneg_score", "passed")

    def annotate(df):
        scores = encoding.multi_head_property_score(df, property_tasks())
        return encoding.property_table(scores, ["fold", "host"]).select("row_id", "fold_pred")

    out = screening.candidate_gate(rows, screen, lambda df: df.select("row_id", "vec"), annotate, "predict")
    out = out.select("row_id", "valid", "normal_score", "hardneg_score", "screen_status", "embed_status", "fold_pred")
    return out.withColumns({c: r6(c) for c in ("normal_score", "hardneg_score")})


@query("probe_cross_validation")
def probe_cross_validation_q(spark, d):
    rows = sampling.stratified_kfold(vectors(spark, d), "row_id", "label", 5)
    return models.probe_cross_validation(rows, "row_id", "label")


@query("head_training")
def head_training_q(spark, d):
    curve = models.head_training(vectors(spark, d), "row_id", "label")[2]
    return curve.withColumns({c: r6(c) for c in ("train_loss", "valid_accuracy")})


@query("sparse_probe_eval")
def sparse_probe_eval_q(spark, d):
    relu = F.transform("vec", lambda x: F.greatest(x, F.lit(0.0)))
    rows = vectors(spark, d).select("row_id", array_to_vector(relu.cast("array<double>")).alias("features"), "label", F.when(F.col("label") < 5, "low").otherwise("high").alias("half"))
    return models.sparse_probe_eval(rows, "row_id", ["label", "half"], floor=50, class_floor=20)


def limit_sql(score: str, rule: str, bound: float) -> str:
    """(fold, threshold) that ``rule`` picks from the calibration rows of each fold."""
    column, inside, outside = RULES[rule]
    key = lambda k: f"-{k[1:]}" if k.startswith("-") else k
    order = ", ".join(f"CASE WHEN inside THEN {key(i)} ELSE {key(o)} END DESC" for i, o in zip(inside, outside))
    counted = f"(SELECT fold, threshold, {COUNTS.format(y='y', h=f'{score} >= threshold')} FROM (SELECT DISTINCT {score} AS threshold FROM cal), cal GROUP BY 1, 2)"
    return f"""SELECT fold, threshold FROM (SELECT *, {column} {'<=' if column == 'fpr' else '>='} {bound}::DOUBLE AS inside FROM {rates(counted)})
    QUALIFY row_number() OVER (PARTITION BY fold ORDER BY inside DESC, {order}) = 1"""


MIN_RECALL, MAX_FPR = 0.9, 0.1
TWO_STAGE_SQL = f"""WITH {FOLD_SQL}, cal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, y ORDER BY md5(doc_id || '|42'), doc_id) AS rn, count(*) OVER (PARTITION BY fold, y) AS n FROM fo)
    WHERE n > 1 AND rn <= least(n - 1, greatest(1, round_even(n * 0.2::DOUBLE, 0)))),
    l1 AS ({limit_sql('s1', 'min_recall', MIN_RECALL)}), l2 AS ({limit_sql('s2', 'max_fpr', MAX_FPR)}),
    pd AS (SELECT fo.*, s1 >= l1.threshold AS e, s2 >= l2.threshold AS l FROM fo JOIN l1 ON l1.fold = fo.fold JOIN l2 ON l2.fold = fo.fold)
    """ + " UNION ALL ".join(pooled_sql(m, h).replace("FROM fo", "FROM pd") for m, h in (("early", "e"), ("late", "l"), ("cascade", "e AND l")))


@query("two_stage_evaluation", TWO_STAGE_SQL)
def two_stage_evaluation_q(spark, d):
    s = scored(spark, d).withColumnRenamed("doc_id", "id").drop("toxic")
    out = two_stage.two_stage_evaluation(s, min_recall=MIN_RECALL, max_fpr=MAX_FPR)[1]
    keep = ["model", "tp", "fp", "tn", "fn"]
    return out.select(*keep, *[r6(c).alias(c) for c in out.columns if c not in keep])
