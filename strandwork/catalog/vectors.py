"""Vectors, neighbours, votes, encoders and heads over ``embeddings``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import r6
from ..functions.vectors import l2_normalize, pad_to_multiple
from ..operators import encoding, neighbours
from ..session import scratch_folder
from .registry import query, table

K = 20
NOISE = 9  # this label stands for "noise" in the voting queries

VEC = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
UNIT = f"""unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u
  FROM ({VEC}))"""


def knn_sql(k: int) -> str:
    return f"""{UNIT}, sims AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id,
    CASE WHEN r.label = {NOISE} THEN -1 ELSE r.label END AS label, q.label AS true_label,
    round(list_dot_product(q.u, r.u), 9) AS sim FROM unit q, unit r),
  knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM sims) WHERE rank <= {k})"""


SEQ_VOTE_SQL = f"""{knn_sql(K)},
  w AS (SELECT *, sim - min(sim) OVER (PARTITION BY query_id) + 1e-6 AS wt FROM knn WHERE label <> -1),
  s AS (SELECT query_id, label, sum(wt) AS score, min(rank) AS fr FROM w GROUP BY 1, 2),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fr) AS o,
     sum(score) OVER (PARTITION BY query_id) AS tot FROM s),
  pred AS (SELECT e.vec_id AS query_id, coalesce(b.label, -1)::INT AS pred_label, coalesce(score / tot, 0.0) AS confidence
     FROM embeddings e LEFT JOIN (SELECT * FROM best WHERE o = 1) b ON b.query_id = e.vec_id)"""

TOKEN_VOTE_SQL = f"""{knn_sql(K)},
  w AS (SELECT *, sim - min(sim) OVER (PARTITION BY query_id) + 1e-6 AS wt FROM knn),
  s AS (SELECT query_id, label, sum(wt) AS score FROM w WHERE label >= 0 GROUP BY 1, 2),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, label) AS o,
     sum(score) OVER (PARTITION BY query_id) AS tot FROM s),
  pred AS (SELECT e.vec_id AS query_id, coalesce(b.label, -1)::INT AS pred_label, coalesce(score / tot, 0.0) AS confidence
     FROM embeddings e LEFT JOIN (SELECT * FROM best WHERE o = 1) b ON b.query_id = e.vec_id)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")


def sides(spark, d):
    e = vectors(spark, d)
    return e.select(F.col("row_id").alias("query_id"), "vec"), e.select(F.col("row_id").alias("ref_id"), "vec")


def ref_labels(spark, d):
    return vectors(spark, d).select(
        F.col("row_id").alias("ref_id"), F.when(F.col("label") == NOISE, -1).otherwise(F.col("label")).alias("label")
    )


@query(
    "l2_normalize",
    f"""WITH {UNIT} SELECT vec_id, i::INT AS dim, round(u[i + 1], 6) AS value
    FROM unit, unnest(range(64)) t(i)""",
)
def l2_normalize_q(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(l2_normalize("embedding")).alias("dim", "x")).select("vec_id", "dim", r6("x").alias("value"))


@query(
    "dimension_pad",
    f"""SELECT vec_id, i::INT AS dim, CASE WHEN i < 64 THEN round(v[i + 1], 6) ELSE 0.0::DOUBLE END AS value
    FROM ({VEC}), unnest(range(72)) t(i)""",
)
def dimension_pad_q(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(pad_to_multiple("embedding", 24)).alias("dim", "x")).select("vec_id", "dim", r6("x").alias("value"))


@query("exact_cosine_topk", f"WITH {knn_sql(10)} SELECT query_id, rank::INT AS rank, ref_id, round(sim, 6) AS sim FROM knn")
def exact_cosine_topk_q(spark, d):
    q, r = sides(spark, d)
    return neighbours.exact_cosine_topk(q, r, 10).select("query_id", "rank", "ref_id", r6("sim").alias("sim"))


def labelled(spark, d):
    q, r = sides(spark, d)
    return neighbours.with_ref_labels(neighbours.exact_cosine_topk(q, r, K), ref_labels(spark, d)), q


def sequence_votes(spark, d):
    return neighbours.vote_sequence(*labelled(spark, d))


@query("vote_sequence", f"WITH {SEQ_VOTE_SQL} SELECT query_id, pred_label, round(confidence, 6) AS confidence FROM pred")
def vote_sequence_q(spark, d):
    return sequence_votes(spark, d).withColumn("confidence", r6("confidence"))


@query("vote_token", f"WITH {TOKEN_VOTE_SQL} SELECT query_id, pred_label, round(confidence, 6) AS confidence FROM pred")
def vote_token_q(spark, d):
    return neighbours.vote_token(*labelled(spark, d)).withColumn("confidence", r6("confidence"))


@query(
    "transfer_accuracy",
    f"""WITH {SEQ_VOTE_SQL} SELECT count(*) AS n_eval, round(avg((pred_label = label)::INT), 6) AS accuracy
    FROM pred JOIN (SELECT vec_id, CASE WHEN label = {NOISE} THEN -1 ELSE label END AS label FROM embeddings) t
    ON vec_id = query_id WHERE pred_label >= 0 AND label >= 0""",
)
def transfer_accuracy_q(spark, d):
    truth = ref_labels(spark, d).select(F.col("ref_id").alias("query_id"), F.col("label").alias("true_label"))
    return neighbours.transfer_accuracy(sequence_votes(spark, d), truth).withColumn("accuracy", r6("accuracy"))


@query(
    "prediction_stats",
    f"""WITH {SEQ_VOTE_SQL} SELECT count(*) AS n_rows, round(avg((pred_label = -1)::INT), 6) AS noise_ratio,
    count(DISTINCT CASE WHEN pred_label <> -1 THEN pred_label END) AS n_labels,
    count(*) FILTER (pred_label >= 0) AS mapped_valid,
    round(avg(confidence) FILTER (pred_label >= 0), 6) AS confidence_mean,
    round(median(round(confidence, 9)) FILTER (pred_label >= 0), 6) AS confidence_median FROM pred""",
)
def prediction_stats_q(spark, d):
    s = neighbours.prediction_stats(sequence_votes(spark, d))
    return s.withColumns({c: r6(c) for c in ("noise_ratio", "confidence_mean", "confidence_median")})


# The vectors of the sixteen least ids are the centroids: fitted ones depend on
# the fit, given ones make cells and search checkable.
CELLS, PROBES = 16, 8
IVF_SQL = f"""WITH {UNIT}, centre AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, u AS c FROM (SELECT * FROM unit ORDER BY vec_id LIMIT {CELLS})),
  away AS (SELECT vec_id, u, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(c, c) / 2 - list_dot_product(u, c), 9), cell) AS o FROM unit, centre),
  hit AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, round(list_dot_product(q.u, r.u), 9) AS sim FROM away q JOIN away r ON r.cell = q.cell AND q.o <= {PROBES} AND r.o = 1)
  SELECT query_id, rank::INT AS rank, ref_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM hit) WHERE rank <= 10"""


@query("ivf_search", IVF_SQL)
def ivf_search_q(spark, d):
    q, r = sides(spark, d)
    first = r.select("ref_id", l2_normalize("vec").alias("u")).orderBy("ref_id").limit(CELLS).collect()
    centers = np.array([x.u for x in first])
    cells = neighbours.assign_cells(r, centers, 1, "ref_id")
    return neighbours.search_cells(q, cells, centers, 10, PROBES).select("query_id", "rank", "ref_id", r6("sim").alias("sim"))


def fitted_index(spark, d):
    q, r = sides(spark, d)
    path = scratch_folder(spark, "index")
    neighbours.build_index(r, path, CELLS)
    return q, r, neighbours.read_index_rows(spark, path, r), spark.read.parquet(f"{path}/cells")


@query("index_search", f"WITH {knn_sql(10)} SELECT query_id, rank::INT AS rank, ref_id, round(sim, 6) AS sim FROM knn")
def index_search_q(spark, d):
    q, _, rows, cells = fitted_index(spark, d)
    return neighbours.search_index(q, rows, cells, 10, 2).select("query_id", "rank", "ref_id", r6("sim").alias("sim"))


@query("ivf_recall")
def ivf_recall_q(spark, d):
    """Recall of the nearest PROBES fitted cells alone, for every twentieth vector."""
    q, r, rows, cells = fitted_index(spark, d)
    asked = q.filter("query_id % 20 = 0")
    centers = np.array([c.centre for c in cells.orderBy("cell").collect()])
    found = neighbours.search_cells(asked, rows, centers, 10, PROBES)
    return neighbours.recall_at_k(found, neighbours.exact_cosine_topk(asked, r, 10)).withColumn("recall", r6("recall"))


# Encoder weights of the checkable form: W(i, j) = sin(7 i + 13 j), no bias,
# centre 0.1, scale 2, clip to [-3, 3].
D_IN, D_DICT, TOPK = 64, 96, 8


def encoder():
    i, j = np.arange(D_IN)[:, None], np.arange(D_DICT)[None, :]
    return np.sin(i * 7 + j * 13)


ENCODE_SQL = f"""x AS (SELECT vec_id, i, greatest(least((v[i + 1] - 0.1) * 2.0, 3.0), -3.0) AS x
    FROM ({VEC}), unnest(range({D_IN})) t(i)),
  act AS (SELECT vec_id, j, sum(x * sin((i * 7 + j * 13)::DOUBLE)) AS a FROM x, unnest(range({D_DICT})) u(j) GROUP BY 1, 2),
  sp AS (SELECT vec_id, j::INT AS feature, a AS value FROM
    (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(a, 9) DESC, j) AS o FROM act WHERE a > 0) WHERE o <= {TOPK})"""


def encoded(spark, d):
    return encoding.topk_sparse_encode(
        vectors(spark, d), encoder(), np.zeros(D_DICT), np.full(D_IN, 0.1), np.full(D_IN, 2.0), TOPK, clip=(-3.0, 3.0)
    )


@query("topk_sparse_encode", f"WITH {ENCODE_SQL} SELECT vec_id, feature, round(value, 6) AS value FROM sp")
def topk_sparse_encode_q(spark, d):
    return encoded(spark, d).select(F.col("row_id").alias("vec_id"), "feature", r6("value").alias("value"))


@query(
    "sparse_decode",
    f"""WITH {ENCODE_SQL} SELECT vec_id, dim::INT AS dim, round(sum(value * sin((dim * 7 + feature * 13)::DOUBLE)) / 2.0 + 0.1, 6) AS x
    FROM sp, unnest(range({D_IN})) t(dim) GROUP BY vec_id, dim""",
)
def sparse_decode_q(spark, d):
    dims = spark.range(D_IN).select(
        F.col("id").cast("int").alias("dim"), F.lit(0.0).alias("bias"), F.lit(0.1).alias("center"), F.lit(2.0).alias("alpha")
    )
    decoder = spark.range(D_DICT).select(F.col("id").cast("int").alias("feature"), F.explode(F.sequence(F.lit(0), F.lit(D_IN - 1))).alias("dim"))
    decoder = decoder.withColumn("w", F.sin((F.col("dim") * 7 + F.col("feature") * 13).cast("double")))
    out = encoding.sparse_decode(encoded(spark, d), decoder, dims)
    return out.select(F.col("row_id").alias("vec_id"), "dim", r6("x").alias("x"))


def head(a: int, b: int, hidden: int, n_out: int):
    """Closed-form two-layer head: sin/cos weights, zero bias."""
    i, h, c = np.arange(D_IN)[:, None], np.arange(hidden), np.arange(n_out)[None, :]
    return [
        (np.sin(i * a + h[None, :] * b), np.zeros(hidden)),
        (np.cos(h[:, None] * a + c * b) * 0.5, np.zeros(n_out)),
    ]


def head_sql(name: str, src: str, a: int, b: int, hidden: int, n_out: int) -> str:
    return f"""{name}_h AS (SELECT vec_id, h, greatest(sum(x * sin((i * {a} + h * {b})::DOUBLE)), 0.0) AS a
      FROM {src}, unnest(range({hidden})) u(h) GROUP BY 1, 2),
    {name}_z AS (SELECT vec_id, c, sum(a * cos((h * {a} + c * {b})::DOUBLE) * 0.5) AS z
      FROM {name}_h, unnest(range({n_out})) u(c) GROUP BY 1, 2),
    {name}_p AS (SELECT vec_id, c, exp(z - max(z) OVER w) / sum(exp(z - m)) OVER w AS p
      FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM {name}_z) WINDOW w AS (PARTITION BY vec_id))"""


STD_X = f"sx AS (SELECT vec_id, i, (v[i + 1] - 0.05) / 0.5 AS x FROM ({VEC}), unnest(range({D_IN})) t(i))"
UNIT_X = f"{UNIT}, ux AS (SELECT vec_id, i, u[i + 1] AS x FROM unit, unnest(range({D_IN})) t(i))"


def screening_heads():
    norm = {"mean": np.full(D_IN, 0.05), "std": np.full(D_IN, 0.5)}
    return {
        "normal": {"layers": head(3, 5, 12, 2), "threshold": 0.4, **norm},
        "hardneg": {"layers": head(2, 9, 12, 2), "threshold": 0.6, **norm},
    }


@query(
    "two_head_score",
    f"""WITH {STD_X}, {head_sql('n', 'sx', 3, 5, 12, 2)}, {head_sql('q', 'sx', 2, 9, 12, 2)}
    SELECT n_p.vec_id, round(n_p.p, 6) AS normal_score, round(q_p.p, 6) AS hardneg_score,
      (n_p.p >= 0.4)::INT AS normal_pass, (q_p.p >= 0.6)::INT AS hardneg_pass, (n_p.p >= 0.4 AND q_p.p >= 0.6)::INT AS passed
    FROM n_p JOIN q_p ON n_p.vec_id = q_p.vec_id AND n_p.c = 1 AND q_p.c = 1""",
)
def two_head_score_q(spark, d):
    out = encoding.two_head_score(vectors(spark, d), screening_heads()).withColumnRenamed("row_id", "vec_id")
    return out.withColumns({c: r6(c) for c in ("normal_score", "hardneg_score")})


def property_tasks():
    return [
        {"name": "fold", "layers": head(4, 7, 10, 3), "classes": ["c0", "c1", "c2"], "threshold": 0.5, "task_order": 1},
        {"name": "host", "layers": head(5, 3, 10, 4), "classes": ["c0", "c1", "c2", "c3"], "threshold": 0.4, "task_order": 2},
    ]


@query(
    "multi_head_property_score",
    f"""WITH {UNIT_X}, {head_sql('f', 'ux', 4, 7, 10, 3)}, {head_sql('h', 'ux', 5, 3, 10, 4)},
    b AS (SELECT vec_id, 'fold' AS task, c, p, 0.5 AS th FROM f_p UNION ALL SELECT vec_id, 'host', c, p, 0.4 FROM h_p),
    o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, task ORDER BY p DESC, c) AS k FROM b)
    SELECT vec_id, task, CASE WHEN p >= th THEN 'c' || c ELSE 'Unknown' END AS pred, round(p, 6) AS conf FROM o WHERE k = 1""",
)
def multi_head_property_score_q(spark, d):
    out = encoding.multi_head_property_score(vectors(spark, d), property_tasks())
    return out.select(F.col("row_id").alias("vec_id"), "task", "pred", r6("conf").alias("conf"))
