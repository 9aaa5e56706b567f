"""Metrics, thresholds, splits and samples over labels, documents, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hash_key, hash_uniform, r6
from ..operators import aggregate, evaluation, sampling
from .registry import query, table
from .relational import U_SQL, by_id


def scored(spark, d):
    """doc_id, y, late score s2 and early score s1 from hashed uniforms."""
    lab = table(spark, d, "labels")
    u1, u2 = hash_uniform(hash_key("doc_id", "s1")), hash_uniform(hash_key("doc_id", "s2"))
    q = F.col("quality")
    return lab.select(
        "doc_id", q.alias("y"), "toxic",
        F.round(q * 0.35 + u1 * 0.65, 6).alias("s1"), F.round(q * 0.45 + u2 * 0.55, 6).alias("s2"),
    )


SCORED_SQL = f"""sc AS (SELECT doc_id, quality AS y, toxic, round(quality * 0.35::DOUBLE + ({U_SQL.format(id='doc_id', seed='s1')}) * 0.65::DOUBLE, 6) AS s1,
    round(quality * 0.45::DOUBLE + ({U_SQL.format(id='doc_id', seed='s2')}) * 0.55::DOUBLE, 6) AS s2 FROM labels)"""

COUNTS = "count(*) FILTER ({y} = 1 AND {h}) AS tp, count(*) FILTER ({y} = 0 AND {h}) AS fp, count(*) FILTER ({y} = 0 AND NOT ({h})) AS tn, count(*) FILTER ({y} = 1 AND NOT ({h})) AS fn"


def rates(src: str, extra: str = "") -> str:
    return f"""(SELECT *, (recall + specificity) / 2 AS balanced_accuracy, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM
    (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity,
    CASE WHEN tn + fp > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr FROM {src}))"""


METRIC_COLS = "accuracy, precision, recall, specificity, fpr, f1, balanced_accuracy".split(", ")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in METRIC_COLS)


def rounded(df):
    return df.withColumns({c: r6(c) for c in METRIC_COLS})


@query("binary_metrics", f"WITH {SCORED_SQL}, c AS (SELECT toxic, {COUNTS.format(y='y', h='s1 >= 0.5')} FROM sc GROUP BY toxic) SELECT toxic, tp, fp, tn, fn, {ROUNDED} FROM {rates('c')}")
def binary_metrics_q(spark, d):
    s = scored(spark, d).withColumn("pred", (F.col("s1") >= 0.5).cast("int"))
    return rounded(evaluation.binary_metrics(s, "y", "pred", ["toxic"]))


@query(
    "cascade",
    f"WITH {SCORED_SQL} SELECT doc_id, s1, s2, (s1 >= 0.4 AND s2 >= 0.5)::INT AS cascade_pred FROM sc",
)
def cascade_q(spark, d):
    return scored(spark, d).select("doc_id", "s1", "s2", evaluation.cascade(F.col("s1"), F.col("s2"), 0.4, 0.5).alias("cascade_pred"))


@query(
    "fp_per_million",
    f"""WITH {SCORED_SQL} SELECT toxic, count(*) FILTER (y = 0 AND s1 >= 0.4) AS fp, count(*) FILTER (y = 0) AS n_negative,
    round(CASE WHEN count(*) FILTER (y = 0) > 0 THEN count(*) FILTER (y = 0 AND s1 >= 0.4) * 1e6 / count(*) FILTER (y = 0) ELSE 0.0 END, 6) AS fp_per_million FROM sc GROUP BY toxic""",
)
def fp_per_million_q(spark, d):
    g = scored(spark, d).groupBy("toxic").agg(F.count_if((F.col("y") == 0) & (F.col("s1") >= 0.4)).alias("fp"), F.count_if(F.col("y") == 0).alias("n_negative"))
    return g.withColumn("fp_per_million", r6(aggregate.fp_per_million(F.col("fp"), F.col("n_negative"))))


# The true and the predicted priority class of an order.
CONF_SQL = """cf AS (SELECT substring(o_orderpriority, 1, 1)::INT AS t, CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_orderstatus = 'F' THEN substring(o_orderpriority, 1, 1)::INT
    WHEN o_orderstatus = 'O' THEN 2 ELSE 4 END AS p FROM orders)"""


def confusion(spark, d):
    t = F.substring("o_orderpriority", 1, 1).cast("int")
    p = F.when(F.col("o_totalprice") > 300000, 1).when(F.col("o_orderstatus") == "F", t).when(F.col("o_orderstatus") == "O", 2).otherwise(4)
    return evaluation.confusion_counts(table(spark, d, "orders").select(t.alias("t"), p.alias("p")), "t", "p")


@query(
    "confusion_multiclass",
    f"""WITH {CONF_SQL}, l AS (SELECT unnest(range(1, 8))::INT AS c),
    per AS (SELECT c, (SELECT count(*) FROM cf WHERE t = c) AS sup, (SELECT count(*) FROM cf WHERE p = c) AS pr, (SELECT count(*) FROM cf WHERE t = c AND p = c) AS tp FROM l),
    f AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * (tp / pr) * (tp / sup) / (tp / pr + tp / sup) ELSE 0.0 END AS f1 FROM per)
    SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1 FROM f""",
)
def confusion_multiclass_q(spark, d):
    labels = spark.range(1, 8).select(F.col("id").cast("int").alias("label"))
    m = evaluation.multiclass_metrics(confusion(spark, d), "t", "p", labels)
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query(
    "confusion_matrix",
    f"WITH {CONF_SQL} SELECT t, count(*) FILTER (p = 1) AS \"1\", count(*) FILTER (p = 2) AS \"2\", count(*) FILTER (p = 3) AS \"3\", count(*) FILTER (p = 4) AS \"4\", count(*) FILTER (p = 5) AS \"5\" FROM cf GROUP BY t",
)
def confusion_matrix_q(spark, d):
    return evaluation.confusion_matrix(confusion(spark, d), "t", "p", [1, 2, 3, 4, 5])


SWEEP_SQL = f"""{SCORED_SQL}, th AS (SELECT DISTINCT s1 AS threshold FROM sc),
    cs AS (SELECT threshold, {COUNTS.format(y='y', h='s1 >= threshold')} FROM th, sc GROUP BY threshold), sw AS (SELECT threshold, tp, fp, tn, fn, {', '.join(METRIC_COLS)} FROM {rates('cs')})"""


@query("threshold_sweep", f"WITH {SWEEP_SQL} SELECT threshold, tp, fp, tn, fn, {ROUNDED} FROM sw")
def threshold_sweep_q(spark, d):
    return rounded(evaluation.threshold_sweep(scored(spark, d), "y", "s1"))


@query(
    "threshold_sweep_grid",
    f"""WITH {SCORED_SQL}, th AS (SELECT i / 2000.0::DOUBLE AS threshold FROM range(2001) t(i)),
    cs AS (SELECT toxic, threshold, {COUNTS.format(y='y', h='s2 >= threshold')} FROM th, sc GROUP BY 1, 2)
    SELECT toxic, round(threshold, 6) AS threshold, tp, fp, tn, fn, {ROUNDED} FROM {rates('cs')}""",
)
def threshold_sweep_grid_q(spark, d):
    return rounded(evaluation.threshold_sweep(scored(spark, d), "y", "s2", ["toxic"], grid=2001)).withColumn("threshold", r6("threshold"))


BOUNDS = {"max_fpr": 0.2, "max_fpr_max_precision": 0.0001, "min_recall": 0.9, "min_recall_max_precision": 1.5}


def rule_sql(rule: str, bound: float) -> str:
    col, inside, outside = evaluation.RULES[rule]
    op = "<=" if col == "fpr" else ">="

    def keys(ks):
        return ", ".join(f"{k[1:]} ASC" if k.startswith("-") else f"{k} DESC" for k in ks)

    base = f"SELECT *, {col} {op} {bound} AS bound_met, max(({col} {op} {bound})::INT) OVER () AS any_in FROM sw"
    return f"""(SELECT '{rule}' AS rule, bound_met, threshold, tp, fp, tn, fn, {ROUNDED} FROM ({base}) WHERE any_in = 1 AND bound_met ORDER BY {keys(inside)} LIMIT 1)
    UNION ALL (SELECT '{rule}', bound_met, threshold, tp, fp, tn, fn, {ROUNDED} FROM ({base}) WHERE any_in = 0 ORDER BY {keys(outside)} LIMIT 1)"""


@query("threshold_rules", f"WITH {SWEEP_SQL} " + " UNION ALL ".join(rule_sql(r, b) for r, b in BOUNDS.items()))
def threshold_rules_q(spark, d):
    sweep = evaluation.threshold_sweep(scored(spark, d), "y", "s1")
    return rounded(evaluation.threshold_rules(sweep, BOUNDS))


@query(
    "ranking_metrics",
    f"""WITH {SCORED_SQL}, g AS (SELECT s1, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sc GROUP BY 1),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY s1 DESC)),
    f AS (SELECT *, 2 * (tp / (tp + fp)) * (tp / pp) / (tp / (tp + fp) + tp / pp + 1e-12) AS f1 FROM c),
    h AS (SELECT sum(pos) FILTER (s1 >= 0.5)::DOUBLE AS a, sum(neg) FILTER (s1 >= 0.5)::DOUBLE AS b, sum(neg) FILTER (s1 < 0.5)::DOUBLE AS c, sum(pos) FILTER (s1 < 0.5)::DOUBLE AS d FROM g)
    SELECT round(sum(pos / pp * tp / (tp + fp)), 6) AS average_precision, round(sum(neg * (tp - pos / 2.0) / (pp::DOUBLE * nn)), 6) AS roc_auc, round(max(f1), 6) AS f1_best,
    (SELECT s1 FROM f ORDER BY round(f1, 12) DESC, s1 LIMIT 1) AS threshold_best, (SELECT round(2 * a / (2 * a + b + d), 6) FROM h) AS f1_at_05,
    (SELECT round((a / (a + d) + c / (c + b)) / 2, 6) FROM h) AS balanced_at_05, (SELECT round((a * c - b * d) / sqrt((a + b) * (a + d) * (c + b) * (c + d)), 6) FROM h) AS mcc_at_05 FROM f""",
)
def ranking_metrics_q(spark, d):
    m = evaluation.ranking_metrics(scored(spark, d), "y", "s1")
    return m.select(*[r6(c).alias(c) for c in m.columns])


FOLD_SQL = f"""{SCORED_SQL}, fo AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5(doc_id || '|42'), doc_id) - 1) % 5)::INT AS fold FROM sc)"""


def folded(spark, d):
    return sampling.stratified_kfold(scored(spark, d), "doc_id", "y", 5)


@query("stratified_kfold", f"WITH {FOLD_SQL} SELECT doc_id, y, fold FROM fo")
def stratified_kfold_q(spark, d):
    return folded(spark, d).select("doc_id", "y", "fold")


STATS_SQL = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in METRIC_COLS)


@query(
    "fold_mean_std",
    f"""WITH {FOLD_SQL}, c AS (SELECT fold, {COUNTS.format(y='y', h='s1 >= 0.5')} FROM fo GROUP BY fold), m AS (SELECT * FROM {rates('c')})
    SELECT 'fold' AS kind, {STATS_SQL} FROM m UNION ALL SELECT 'seed', {STATS_SQL.replace('stddev_pop', 'stddev_samp')} FROM m""",
)
def fold_mean_std_q(spark, d):
    f = folded(spark, d).withColumn("pred", (F.col("s1") >= 0.5).cast("int"))
    m = evaluation.binary_metrics(f, "y", "pred", ["fold"])
    both = aggregate.fold_mean_std(m, METRIC_COLS).withColumn("kind", F.lit("fold")).unionByName(
        aggregate.fold_mean_std(m, METRIC_COLS, sample=True).withColumn("kind", F.lit("seed"))
    )
    return both.select("kind", *[r6(c).alias(c) for c in both.columns if c != "kind"])


def pooled_sql(model, h):
    stats = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in METRIC_COLS)
    return f"""SELECT '{model}' AS model, a.*, b.* FROM (SELECT tp, fp, tn, fn, {ROUNDED} FROM {rates(f"(SELECT {COUNTS.format(y='y', h=h)} FROM fo)")}) a,
    (SELECT {stats} FROM {rates(f"(SELECT fold, {COUNTS.format(y='y', h=h)} FROM fo GROUP BY fold)")}) b"""


@query("fold_concat_summary", f"WITH {FOLD_SQL} " + " UNION ALL ".join([pooled_sql("early", "s1 >= 0.4"), pooled_sql("late", "s2 >= 0.5"), pooled_sql("cascade", "s1 >= 0.4 AND s2 >= 0.5")]))
def fold_concat_summary_q(spark, d):
    f = folded(spark, d).withColumns(
        {
            "early": (F.col("s1") >= 0.4).cast("int"), "late": (F.col("s2") >= 0.5).cast("int"),
            "casc": evaluation.cascade(F.col("s1"), F.col("s2"), 0.4, 0.5),
        }
    )
    out = evaluation.fold_concat_summary(f, "y", {"early": "early", "late": "late", "cascade": "casc"})
    keep = ["model", "tp", "fp", "tn", "fn"]
    return out.select(*keep, *[r6(c).alias(c) for c in out.columns if c not in keep])


@query(
    "metric_panel_union",
    """WITH a AS (SELECT o_orderstatus AS model, round(avg(o_totalprice), 4) AS m1, max(o_totalprice) AS m2 FROM orders GROUP BY 1),
    b AS (SELECT l_linestatus AS model, round(avg(l_quantity), 4) AS m1, max(l_quantity) AS m2 FROM lineitem GROUP BY 1)
    SELECT split, model, metric, value FROM (SELECT 'orders' AS split, model, 'm1' AS metric, m1 AS value FROM a UNION ALL SELECT 'orders', model, 'm2', m2 FROM a
    UNION ALL SELECT 'lines', model, 'm1', m1 FROM b UNION ALL SELECT 'lines', model, 'm2', m2 FROM b) WHERE model IN ('F', 'O')""",
)
def metric_panel_union_q(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.max("o_totalprice").alias("top"))
    b = table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg("l_quantity"), 4).alias("q"), F.max("l_quantity").alias("qmax"))
    tables = {
        "orders": (a, {"status": "model", "mean_price": "m1", "top": "m2"}),
        "lines": (b, {"l_linestatus": "model", "q": "m1", "qmax": "m2"}),
    }
    return aggregate.metric_panel_union(tables, ["m1", "m2"], ["F", "O"])


@query("class_counts", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_long FROM documents GROUP BY lang")
def class_counts_q(spark, d):
    from ..operators.clean import class_counts

    docs = table(spark, d, "documents")
    after = class_counts(docs.filter("n_chars > 1000"), "lang").withColumnRenamed("n", "n_long")
    return class_counts(docs, "lang").join(after, "lang", "left").fillna(0, ["n_long"])


# ---- splits and samples ----------------------------------------------------------

RANK_SQL = "row_number() OVER (PARTITION BY {by} ORDER BY md5({id} || '|{seed}'), {id}) AS rn, count(*) OVER (PARTITION BY {by}) AS n"


@query(
    "stratified_fraction",
    f"SELECT doc_id, lang FROM (SELECT *, {RANK_SQL.format(by='lang', id='doc_id', seed=42)} FROM documents) WHERE rn <= greatest(1, ceil(n * 0.1::DOUBLE))",
)
def stratified_fraction_q(spark, d):
    return sampling.stratified_fraction(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.1)


@query(
    "train_test_split",
    f"""SELECT doc_id, lang, CASE WHEN rn <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS split,
    CASE WHEN r2 <= ceil(m * 0.2::DOUBLE) THEN 'test' WHEN r2 <= ceil(m * 0.2::DOUBLE) + ceil((m - ceil(m * 0.2::DOUBLE)) * 0.25::DOUBLE) THEN 'valid' ELSE 'train' END AS three_way
    FROM (SELECT *, {RANK_SQL.format(by='lang', id='doc_id', seed=42)}, row_number() OVER (ORDER BY md5(doc_id || '|7'), doc_id) AS r2, count(*) OVER () AS m FROM documents)""",
)
def train_test_split_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    three = sampling.three_way_split(docs.select("doc_id"), "doc_id", 0.2, 0.25, seed=7).withColumnRenamed("split", "three_way")
    return sampling.train_test_split(docs, "doc_id", "lang", 0.2).join(three, "doc_id")


@query(
    "calibration_split",
    f"""WITH {FOLD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fold, y ORDER BY md5(doc_id || '|42'), doc_id) AS rn, count(*) OVER (PARTITION BY fold, y) AS n FROM fo)
    SELECT doc_id, fold, y, CASE WHEN n > 1 AND rn <= least(n - 1, greatest(1, round_even(n * 0.2::DOUBLE, 0))) THEN 'calibration' ELSE 'train' END AS role FROM r""",
)
def calibration_split_q(spark, d):
    return sampling.calibration_split(folded(spark, d), "doc_id", "y", 0.2, group=["fold"]).select("doc_id", "fold", "y", "role")


@query(
    "grouped_folds",
    """WITH RECURSIVE c AS (SELECT l_suppkey, count(*) AS sz, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS i FROM lineitem GROUP BY 1),
    w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS l_suppkey, 0::BIGINT AS sz, 0::INT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
      SELECT c.i, c.l_suppkey, c.sz, list_position(loads, list_min(loads))::INT,
        list_concat(list_concat(loads[1:list_position(loads, list_min(loads)) - 1], [list_min(loads) + c.sz]), loads[list_position(loads, list_min(loads)) + 1:])
      FROM w JOIN c ON c.i = w.i + 1)
    SELECT l_orderkey, l_linenumber, l.l_suppkey, sz AS cluster_size, fold FROM lineitem l JOIN w ON w.l_suppkey = l.l_suppkey""",
)
def grouped_folds_q(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return sampling.grouped_folds(li, "l_suppkey", 5)


@query(
    "leave_one_taxon_out",
    "SELECT t.p_type AS held_out, p.p_partkey, CASE WHEN p.p_type = t.p_type THEN 'test' ELSE 'train' END AS role FROM part p, (SELECT DISTINCT p_type FROM part) t",
)
def leave_one_taxon_out_q(spark, d):
    return sampling.leave_one_taxon_out(table(spark, d, "part"), "p_partkey", "p_type")


@query(
    "quota_subset",
    f"""WITH r AS (SELECT doc_id, lang, {RANK_SQL.format(by="(lang = 'en')", id='doc_id', seed=42)} FROM documents),
    k AS (SELECT count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang <> 'en') AS b FROM documents),
    q AS (SELECT a, b, greatest(1, least(round_even(a * 0.1::DOUBLE, 0), a)) AS wr FROM k),
    f AS (SELECT CASE WHEN 150 - wr > b THEN least(a, 150 - b) ELSE wr END AS fr, least(150 - wr, b) AS fo FROM q)
    SELECT doc_id, lang FROM r, f WHERE CASE WHEN lang = 'en' THEN rn <= fr ELSE rn <= fo END""",
)
def quota_subset_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.quota_subset(docs, "doc_id", F.col("lang") == "en", 150, 0.1)


DRAW_U = "('0x' || substring(md5(md5(i || '|42') || '{tag}'), 1, 13))::BIGINT / 4503599627370496.0"


@query(
    "balanced_weighted_sample",
    f"""WITH v AS (SELECT doc_id, n_chars, (lang = 'de')::INT AS t, row_number() OVER (PARTITION BY lang = 'de' ORDER BY doc_id) AS rn FROM documents WHERE n_chars > 0),
    k AS (SELECT sum(t) AS a, sum(1 - t) AS b FROM v),
    g AS (SELECT i, (({DRAW_U.format(tag='g')}) < 3.5::DOUBLE / 4.5::DOUBLE)::INT AS t, {DRAW_U.format(tag='s')} AS us, {DRAW_U.format(tag='o')} AS uo FROM range((SELECT count(*) FROM documents)) r(i))
    SELECT i AS draw, doc_id, floor(uo * n_chars)::BIGINT AS "offset" FROM g, k, v WHERE v.t = g.t AND v.rn = floor(us * CASE WHEN g.t = 1 THEN a ELSE b END)::BIGINT + 1""",
)
def balanced_weighted_sample_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return sampling.balanced_weighted_sample(docs, "doc_id", "n_chars", F.col("lang") == "de", 3.5, docs.count(), shard=by_id("doc_id"))


@query(
    "block_sample",
    f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM orders), q AS (SELECT 0::BIGINT AS b, 1000::BIGINT AS remaining, 0::BIGINT AS quota UNION ALL
      SELECT b + 1, remaining - least(round_even(remaining * least(4096, n - b * 4096)::DOUBLE / (n - b * 4096), 0), least(4096, n - b * 4096))::BIGINT,
        CASE WHEN n - b * 4096 <= 4096 THEN remaining ELSE least(round_even(remaining * least(4096, n - b * 4096)::DOUBLE / (n - b * 4096), 0), least(4096, n - b * 4096))::BIGINT END
      FROM q, n WHERE b * 4096 < n),
    r AS (SELECT o_orderkey, o_orderkey // 4096 AS blk, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS rn FROM orders)
    SELECT o_orderkey FROM r JOIN q ON q.b = r.blk + 1 WHERE rn <= quota""",
)
def block_sample_q(spark, d):
    return sampling.block_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 4096)


MINE_SQL = f"""{SCORED_SQL}, k AS (SELECT count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn, count(*) FILTER (y = 0 AND s1 >= 0.6) AS nh FROM sc),
    m AS (SELECT *, row_number() OVER (ORDER BY s1 DESC, doc_id) AS rs, sum((s1 >= 0.6)::INT) OVER (ORDER BY doc_id) AS ri FROM sc WHERE y = 0)"""


@query(
    "hard_negative_mining",
    f"""WITH {MINE_SQL} SELECT 'top_up' AS form, doc_id, y FROM sc WHERE y = 1 UNION ALL
    SELECT 'top_up', doc_id, y FROM m, k WHERE s1 >= 0.6 OR (nh < least(nn, greatest(5, np)) AND rs <= least(nn, greatest(5, np)))
    UNION ALL SELECT 'low_fpr', doc_id, y FROM sc WHERE y = 1 UNION ALL
    SELECT 'low_fpr', doc_id, y FROM m, k WHERE CASE WHEN nh < least(nn, greatest(3, round_even(np * 0.01::DOUBLE, 0))) THEN s1 >= 0.6 OR rs <= least(nn, greatest(3, round_even(np * 0.01::DOUBLE, 0)))
      ELSE s1 >= 0.6 AND ri <= least(nn, greatest(3, round_even(np * 0.01::DOUBLE, 0))) END""",
)
def hard_negative_mining_q(spark, d):
    s = scored(spark, d)
    a = sampling.hard_negative_mining(s, "doc_id", "y", "s1", 0.6, 5).withColumn("form", F.lit("top_up"))
    b = sampling.ultra_low_fpr_mining(s, "doc_id", "y", "s1", 0.6, 3, 0.01).withColumn("form", F.lit("low_fpr"))
    return a.unionByName(b).select("form", "doc_id", "y")


@query(
    "uniform_subset",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS rn, count(*) OVER () AS n FROM documents)
    SELECT 'fraction' AS kind, doc_id FROM r WHERE rn <= greatest(1, ceil(n * 0.15::DOUBLE)) UNION ALL SELECT 'target', doc_id FROM r WHERE rn <= least(n, 77)""",
)
def uniform_subset_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    a = sampling.uniform_subset(docs, "doc_id", frac=0.15).withColumn("kind", F.lit("fraction"))
    return a.unionByName(sampling.uniform_subset(docs, "doc_id", target=77).withColumn("kind", F.lit("target")))


@query(
    "capped_class_sample",
    f"""WITH caps(lang, cap) AS (VALUES ('en', 100), ('de', 50), ('fr', NULL)), r AS (SELECT doc_id, lang, {RANK_SQL.format(by='lang', id='doc_id', seed=42)} FROM documents)
    SELECT doc_id, r.lang FROM r LEFT JOIN caps ON caps.lang = r.lang WHERE cap IS NULL OR rn <= cap""",
)
def capped_class_sample_q(spark, d):
    caps = spark.createDataFrame([("en", 100), ("de", 50), ("fr", None)], "lang string, cap int")
    return sampling.capped_class_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", caps)
