"""Motif sequences on ``events`` (user = sequence, event type = motif label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r6
from ..functions.text import mask_sequence
from ..operators import motifs
from ..operators.clean import category_map
from ..operators.windows import cumulative_offsets
from .ingest import mask_sql
from .registry import query, table
from .relational import POINT_SQL, by_id, points


def tokens(spark, d):
    """Event rows as tokens with 0-based place and sequence length."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("label"), "value")
    month = F.year("ts") * 12 + F.month("ts")
    t = motifs.indexed_tokens(e, "user_id", ["ts", "event_id"], month)
    return t.join(lengths(spark, d), "user_id").withColumn("rel", F.col("idx") / F.col("length"))


def lengths(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("length"))


TOK = """tok AS (SELECT event_id, user_id, event_type AS label, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    count(*) OVER (PARTITION BY user_id) AS length FROM events)"""

PATTERNS = ["click view", "error error", "signup purchase view", "purchase", "view click click"]


def patterns(spark):
    return spark.createDataFrame([(p,) for p in PATTERNS], "motif string")


GRAM_SQL = f"""{TOK}, g AS (SELECT user_id, idx, label AS l0, lead(label, 1) OVER w AS l1, lead(label, 2) OVER w AS l2 FROM tok WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
    grams AS (SELECT user_id, idx, 1 AS n, l0 AS ngram FROM g UNION ALL SELECT user_id, idx, 2, l0 || ' ' || l1 FROM g WHERE l1 IS NOT NULL
      UNION ALL SELECT user_id, idx, 3, l0 || ' ' || l1 || ' ' || l2 FROM g WHERE l2 IS NOT NULL),
    hits AS (SELECT user_id, ngram AS motif, idx AS "start", idx + n - 1 AS "end" FROM grams WHERE ngram IN ({", ".join(f"'{p}'" for p in PATTERNS)}))"""


@query(
    "token_table",
    f"""WITH s AS (SELECT p_partkey, {mask_sql('p_name')} AS seq FROM part), o AS (SELECT *, (sum(length(seq) + 1) OVER (ORDER BY p_partkey))::BIGINT AS tok_end FROM s),
    t AS (SELECT p_partkey AS "Seq_ID", seq, tok_end - length(seq) - 1 AS tok_start, i FROM o, unnest(range(0, length(seq) + 1)) u(i))
    SELECT "Seq_ID", tok_start + i AS token_idx_global, i::INT AS token_idx_in_sequence, (i + 1)::INT AS sequence_position,
    CASE WHEN i < length(seq) THEN substring(seq, i + 1, 1) ELSE 'X' END AS aa, ((tok_start + i) * 7 % 11 - 1)::INT AS label FROM t""",
)
def token_table_q(spark, d):
    seqs = table(spark, d, "part").select(F.col("p_partkey").alias("Seq_ID"), mask_sequence("p_name").alias("seq"))
    manifest = cumulative_offsets(seqs.withColumn("n", F.length("seq") + 1), "n", "Seq_ID", by_id("Seq_ID"))
    rows = manifest.select(F.explode(F.sequence("tok_start", F.col("tok_end") - 1)).alias("token_idx_global"))
    labels = rows.withColumn("label", (F.col("token_idx_global") * 7 % 11 - 1).cast("int"))
    return motifs.token_table(manifest, labels)


@query("ngram_hits", f'WITH {GRAM_SQL} SELECT user_id, motif, "start", "end" FROM hits')
def ngram_hits_q(spark, d):
    return motifs.ngram_hits(tokens(spark, d), patterns(spark), "user_id", "idx", "label", [1, 2, 3])


def residues(spark, d):
    t = tokens(spark, d)
    return t.select(
        "user_id", (F.col("idx") + 1).alias("pos"),
        F.concat(F.upper(F.substring("label", 1, 1)), F.col("event_id").cast("string")).alias("residue"), (F.col("value") / 500).alias("radial"),
    )


ANN_SQL = f"""{GRAM_SQL}, spans AS (SELECT h.user_id, motif, "start", "end", count(*) AS n, median(value / 500) AS radial,
      string_agg(upper(label[1]) || event_id, ',' ORDER BY idx) AS mapped_residues, max(length) AS length
      FROM hits h JOIN tok t ON t.user_id = h.user_id AND idx BETWEEN "start" AND "end" GROUP BY 1, 2, 3, 4),
    ann AS (SELECT *, "start" / length AS rel_start, (("start" + "end" + 2) / 2.0 - 1.0) / length AS rel_center,
      CASE WHEN radial < 0.33 THEN 'inner' WHEN radial < 0.67 THEN 'middle' ELSE 'outer' END AS radial_class FROM spans)"""


@query(
    "hit_annotation",
    f"""WITH {ANN_SQL} SELECT user_id, motif, "start", "end", round(rel_start, 6) AS rel_start, round(rel_center, 6) AS rel_center,
    round(radial, 6) AS radial, radial_class, mapped_residues FROM ann""",
)
def hit_annotation_q(spark, d):
    a = annotated(spark, d)
    return a.withColumns({c: r6(c) for c in ("rel_start", "rel_center", "radial")})


def annotated(spark, d):
    return motifs.hit_annotation(ngram_hits_q(spark, d), lengths(spark, d), residues(spark, d), "user_id")


@query(
    "motif_hit_summary",
    f"""WITH {ANN_SQL}, s AS (SELECT motif, count(*) AS n_total_hits, count(DISTINCT user_id) AS n_structures_with_hit, avg(rel_center) AS c,
      max(rel_center) - min(rel_center) AS sp, median(radial) AS m FROM ann GROUP BY motif)
    SELECT motif, n_total_hits, n_structures_with_hit, round(c, 6) AS mean_rel_center, round(sp, 6) AS position_span, round(m, 6) AS median_radial,
    CASE WHEN m < 0.33 THEN 'inner' WHEN m < 0.67 THEN 'middle' ELSE 'outer' END AS radial_class FROM s""",
)
def motif_hit_summary_q(spark, d):
    s = motifs.motif_hit_summary(annotated(spark, d), "user_id")
    return s.withColumns({c: r6(c) for c in ("mean_rel_center", "position_span", "median_radial")})


COV_SQL = f"""{GRAM_SQL}, cov AS (SELECT h.user_id, i AS pos0, count(*) AS c FROM hits h, unnest(range("start", "end" + 1)) u(i) GROUP BY 1, 2),
    cb AS (SELECT least(pos0 * 20 // length, 19) AS bin, sum(c) AS s FROM cov JOIN (SELECT DISTINCT user_id, length FROM tok) l ON l.user_id = cov.user_id GROUP BY 1)"""


@query(
    "coverage_bins",
    f"""WITH {COV_SQL} SELECT b::INT AS bin, coalesce(s, 0)::BIGINT AS coverage_sum, round(coalesce(s, 0) / (SELECT sum(c) FROM cov), 6) AS coverage_frac
    FROM range(20) r(b) LEFT JOIN cb ON bin = b""",
)
def coverage_bins_q(spark, d):
    cov = motifs.coverage(ngram_hits_q(spark, d), "user_id")
    return motifs.coverage_bins(cov, lengths(spark, d), "user_id").withColumn("coverage_frac", r6("coverage_frac"))


@query(
    "radial_shares",
    f"""WITH {COV_SQL}, r AS (SELECT c, value / 500 AS x FROM cov JOIN tok ON tok.user_id = cov.user_id AND tok.idx = cov.pos0)
    SELECT CASE WHEN x < 0.33 THEN 'inner' WHEN x < 0.67 THEN 'middle' ELSE 'outer' END AS radial_class, sum(c)::BIGINT AS coverage_sum, round(sum(c) / (SELECT sum(c) FROM cov), 6) AS share FROM r GROUP BY 1""",
)
def radial_shares_q(spark, d):
    cov = motifs.coverage(ngram_hits_q(spark, d), "user_id")
    return motifs.radial_shares(cov, residues(spark, d), "user_id").withColumn("share", r6("share"))


HIST_SQL = f"""{TOK}, n AS (SELECT label, user_id, least(idx * 20 // length, 19) AS bin, count(*) AS n FROM tok GROUP BY 1, 2, 3),
    hist AS (SELECT p.label, p.user_id, b::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT label, user_id FROM tok) p CROSS JOIN range(20) r(b)
      LEFT JOIN n ON n.label = p.label AND n.user_id = p.user_id AND n.bin = b)"""


def histogram(spark, d):
    return motifs.position_histogram(tokens(spark, d), "user_id", "label", "idx", "length")


@query("position_histogram", f"WITH {HIST_SQL} SELECT label, user_id, bin, n FROM hist")
def position_histogram_q(spark, d):
    return histogram(spark, d)


JSD_SQL = f"""{HIST_SQL}, p AS (SELECT label, user_id, bin, n / sum(n) OVER (PARTITION BY label, user_id) AS p FROM hist),
    pr AS (SELECT a.label, a.user_id AS u, b.user_id AS v, sum(CASE WHEN a.p > 0 THEN 0.5 * a.p * ln(a.p / ((a.p + b.p) / 2)) ELSE 0 END
      + CASE WHEN b.p > 0 THEN 0.5 * b.p * ln(b.p / ((a.p + b.p) / 2)) ELSE 0 END) AS jsd FROM p a JOIN p b ON a.label = b.label AND a.bin = b.bin AND a.user_id < b.user_id GROUP BY 1, 2, 3),
    js AS (SELECT label, count(*) AS n_pairs, avg(jsd) AS mean_jsd, median(jsd) AS median_jsd, max(jsd) AS max_jsd FROM pr GROUP BY label)"""


@query("pairwise_jsd", f"WITH {JSD_SQL} SELECT label, n_pairs, round(mean_jsd, 6) AS mean_jsd, round(median_jsd, 6) AS median_jsd, round(max_jsd, 6) AS max_jsd FROM js")
def pairwise_jsd_q(spark, d):
    j = motifs.pairwise_jsd(histogram(spark, d), "label", "user_id")
    return j.withColumns({c: r6(c) for c in ("mean_jsd", "median_jsd", "max_jsd")})


@query(
    "divergence_summary",
    f"""WITH {JSD_SQL} SELECT CASE WHEN label IN ('click', 'view') THEN 'browse' ELSE 'act' END AS family, count(*) AS n_labels, round(avg(mean_jsd), 6) AS mean_jsd,
    round(avg((mean_jsd > 0.42)::INT), 6) AS fraction_high FROM js GROUP BY 1""",
)
def divergence_summary_q(spark, d):
    j = motifs.mean_jsd(histogram(spark, d), "label", "user_id")
    j = j.withColumn("family", category_map([(F.col("label").isin("click", "view"), "browse")], "act"))
    out = motifs.divergence_summary(j, "family", high=0.42)
    return out.withColumns({c: r6(c) for c in ("mean_jsd", "fraction_high")})


@query(
    "position_span",
    f"""WITH {TOK}, r AS (SELECT label, user_id, idx / length AS rel FROM tok), m AS (SELECT label, user_id, avg(rel) AS m FROM r GROUP BY 1, 2)
    SELECT r.label, (SELECT count(*) FROM m WHERE m.label = r.label) AS n_sequences, round((SELECT max(m) - min(m) FROM m WHERE m.label = r.label), 6) AS mean_position_span,
    round(avg(rel), 6) AS mean_position, round(stddev_pop(rel), 6) AS std_position FROM r GROUP BY r.label""",
)
def position_span_q(spark, d):
    s = motifs.position_span(tokens(spark, d), "user_id", "label", "rel")
    return s.withColumns({c: r6(c) for c in ("mean_position_span", "mean_position", "std_position")})


@query(
    "consensus_site",
    f"""WITH {TOK}, g AS (SELECT label, user_id, idx + 1 AS pos, length, idx - row_number() OVER (PARTITION BY label, user_id ORDER BY idx) AS g FROM tok),
    runs AS (SELECT label, user_id, min(pos) AS "start", max(pos) AS "end", ((min(pos) + max(pos)) / 2.0 - 1.0) / max(length) AS c FROM g GROUP BY label, user_id, g),
    m AS (SELECT label, user_id, median(c) AS m FROM runs GROUP BY 1, 2), k AS (SELECT label, median(m) AS consensus FROM m GROUP BY 1)
    SELECT label, user_id, "start", "end", round(consensus, 6) AS consensus FROM (SELECT r.*, consensus, row_number() OVER (PARTITION BY r.label, user_id ORDER BY round(abs(c - consensus), 12), "start") AS o
      FROM runs r JOIN k ON k.label = r.label) WHERE o = 1""",
)
def consensus_site_q(spark, d):
    t = tokens(spark, d).withColumn("pos", F.col("idx") + 1)
    out = motifs.consensus_site(t, lengths(spark, d), "user_id", "label", "pos", F.floor(F.col("pos") / 65536))
    return out.withColumn("consensus", r6("consensus"))


PT = f"(WITH {POINT_SQL} SELECT id AS vec_id, chain AS label, x, y, z FROM pts)"


@query(
    "radial_fraction",
    f"""WITH p AS {PT}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1),
    d AS (SELECT vec_id, p.label, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS dist FROM p JOIN c ON c.label = p.label),
    e AS (SELECT *, min(dist) OVER w AS lo, max(dist) OVER w AS hi FROM d WINDOW w AS (PARTITION BY label))
    SELECT vec_id, label, round((dist - lo) / greatest(hi - lo, 1e-6), 6) AS radial, round(cume_dist() OVER (PARTITION BY label ORDER BY round(dist, 9)), 6) AS percentile FROM e""",
)
def radial_fraction_q(spark, d):
    e = points(spark, d).select(F.col("id").alias("vec_id"), F.col("chain").alias("label"), "x", "y", "z")
    return motifs.radial_fraction(e, "label").select("vec_id", "label", r6("radial").alias("radial"), r6("percentile").alias("percentile"))


# ---- clusters of sequences, their n-gram profiles ----------------------------------

CLUSTER_SQL = f"""{GRAM_SQL}, tf AS (SELECT user_id % 12 AS cluster, ngram, count(*) AS tf FROM grams GROUP BY 1, 2),
    dfq AS (SELECT ngram, count(*) AS df FROM tf GROUP BY 1), nn AS (SELECT count(DISTINCT cluster) AS n FROM tf),
    w AS (SELECT cluster, tf.ngram, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfq ON dfq.ngram = tf.ngram, nn),
    tfidf AS (SELECT cluster, ngram, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS tfidf FROM w),
    prof AS (SELECT cluster % 3 AS grp, ngram, sum(tfidf) / max(sz) AS mean_tfidf, count(*) / max(sz) AS presence_ratio, count(*) AS n_clusters
      FROM tfidf JOIN (SELECT c % 3 AS g, count(*) AS sz FROM (SELECT DISTINCT cluster AS c FROM tf) GROUP BY 1) z ON z.g = cluster % 3 GROUP BY 1, 2)"""


def clustered(spark, d):
    return tokens(spark, d).withColumn("cluster", F.col("user_id") % 12)


def tfidf(spark, d):
    return motifs.ngram_tfidf(clustered(spark, d), "cluster", "user_id", "idx", "label", [1, 2, 3])


def profile(spark, d):
    t = tfidf(spark, d)
    groups = t.select("cluster").distinct().withColumn("grp", F.col("cluster") % 3)
    return motifs.group_profile(t, groups, "cluster", "grp").withColumns({c: F.round(c, 9) for c in ("mean_tfidf", "presence_ratio")})


@query("ngram_tfidf", f"WITH {CLUSTER_SQL} SELECT grp, ngram, round(mean_tfidf, 6) AS mean_tfidf, round(presence_ratio, 6) AS presence_ratio, n_clusters FROM prof")
def ngram_tfidf_q(spark, d):
    return profile(spark, d).withColumns({c: r6(c) for c in ("mean_tfidf", "presence_ratio")})


@query("profile_cosine", f"WITH {CLUSTER_SQL} SELECT a.cluster AS i, b.cluster AS j, round(sum(a.tfidf * b.tfidf), 6) AS sim FROM tfidf a JOIN tfidf b ON a.ngram = b.ngram GROUP BY 1, 2")
def profile_cosine_q(spark, d):
    return motifs.profile_cosine(tfidf(spark, d), "cluster").withColumn("sim", r6("sim"))


FAM = "CASE WHEN len(list_distinct(string_split(ngram, ' '))) = 1 THEN string_split(ngram, ' ')[1] ELSE ngram END"
FAM_SQL = f"""{CLUSTER_SQL}, top AS (SELECT grp, ngram, round(mean_tfidf, 9) AS s FROM prof QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(mean_tfidf, 9) DESC, ngram) <= 8),
    fam AS (SELECT grp, {FAM} AS family, max(s) AS score, string_agg(ngram, ', ' ORDER BY s DESC, ngram) AS members, max(len(string_split(ngram, ' '))) AS mx FROM top GROUP BY 1, 2)"""


@query(
    "motif_family",
    f"""WITH {FAM_SQL} SELECT grp, family, round(score, 6) AS score, members, CASE WHEN NOT contains(family, ' ') AND mx > 1 THEN family || 'x1-' || mx ELSE family END AS label FROM fam""",
)
def motif_family_q(spark, d):
    return motifs.group_top_families(profile(spark, d), "grp", "ngram", "mean_tfidf", 8).withColumn("score", r6("score"))


@query(
    "group_motif_matrix",
    f"""WITH {FAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, family) AS pos FROM fam),
    o AS (SELECT family, arg_min(grp, (grp, pos)) AS owner, row_number() OVER (ORDER BY min((grp, pos)), family) AS position FROM r GROUP BY family)
    SELECT o.family, owner, position::INT AS position, r.grp, round(score, 6) AS score FROM o JOIN r ON r.family = o.family""",
)
def group_motif_matrix_q(spark, d):
    fam = motifs.group_top_families(profile(spark, d), "grp", "ngram", "mean_tfidf", 8)
    wide, order = motifs.group_motif_matrix(fam, "grp", F.col("grp"))
    long = wide.unpivot("grp", [c for c in wide.columns if c != "grp"], "family", "score").filter("score IS NOT NULL")
    return order.join(long, "family").withColumn("score", r6("score"))


@query(
    "presence_sharing",
    f"""WITH {GRAM_SQL}, p AS (SELECT DISTINCT user_id % 12 AS cluster, ngram FROM grams WHERE n = 3), z AS (SELECT cluster % 3 AS grp, count(*) AS sz FROM (SELECT DISTINCT user_id % 12 AS cluster FROM tok) GROUP BY 1)
    SELECT cluster % 3 AS grp, ngram, count(*) AS clusters_with, max(sz) AS n_clusters, round(count(*) / max(sz), 6) AS fraction, count(*) / max(sz) >= 0.8 AS shared
    FROM p JOIN z ON z.grp = cluster % 3 GROUP BY 1, 2""",
)
def presence_sharing_q(spark, d):
    t = clustered(spark, d)
    grams = motifs.ngrams(t, ["cluster", "user_id"], "idx", "label", [3])
    members = t.select("cluster").distinct().withColumn("grp", F.col("cluster") % 3)
    return motifs.presence_sharing(grams, members, "grp", "cluster", "ngram").withColumn("fraction", r6("fraction"))


@query(
    "position_profile",
    f"""WITH {TOK}, b AS (SELECT least(idx * 20 // length, 19) AS bin, count(*) AS a, count(*) FILTER (label IN ('click', 'view')) AS c, count(*) FILTER (label = 'error') AS e FROM tok GROUP BY 1),
    f AS (SELECT *, a / sum(a) OVER () AS fa, c / sum(c) OVER () AS fc, e / sum(e) OVER () AS fe FROM b)
    SELECT bin::INT AS bin, a AS n_background, c AS n_core, e AS n_driver, round(fa, 6) AS frac_background, round(fc, 6) AS frac_core, round(fe, 6) AS frac_driver,
    round(fc / fa, 6) AS ratio_core, round(fe / fa, 6) AS ratio_driver FROM f""",
)
def position_profile_q(spark, d):
    sets = {"core": F.col("label").isin("click", "view"), "driver": F.col("label") == "error"}
    p = motifs.position_profile(tokens(spark, d), motifs.whole_bin("idx", "length"), sets)
    return p.withColumns({c: r6(c) for c in p.columns if c.startswith(("frac", "ratio"))})


# ---- subgroups -----------------------------------------------------------------------

SIL_SQL = """c AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS m FROM embeddings, unnest(range(64)) t(i) GROUP BY 1, 2),
    nr AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1),
    d AS (SELECT a.label AS i, b.label AS j, greatest(1 - sum(a.m * b.m) / max(x.n * y.n), 0) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label
      JOIN nr x ON x.label = a.label JOIN nr y ON y.label = b.label GROUP BY 1, 2),
    fo AS (SELECT DISTINCT label AS cluster, CASE WHEN label < 6 THEN 'a' WHEN label < 9 THEN 'b' ELSE 'c' END AS fold FROM embeddings),
    asg AS (SELECT fold, k, cluster, (cluster * 5 + cluster // 3) % k AS sg FROM fo, range(2, 6) r(k) WHERE (fold = 'a' AND k <= 5) OR (fold = 'b' AND k <= 2)),
    mm AS (SELECT a.fold, a.k, a.cluster, a.sg, b.sg AS og, avg(d) AS m FROM asg a JOIN asg b ON a.fold = b.fold AND a.k = b.k AND a.cluster <> b.cluster JOIN d ON d.i = a.cluster AND d.j = b.cluster GROUP BY ALL),
    ab AS (SELECT fold, k, cluster, min(m) FILTER (sg = og) AS a, min(m) FILTER (sg <> og) AS b FROM mm GROUP BY 1, 2, 3),
    sc AS (SELECT fold, k, avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS score FROM ab GROUP BY 1, 2),
    best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(score, 12) DESC, k) = 1),
    ch AS (SELECT asg.fold, asg.cluster, asg.sg, asg.k, score FROM asg JOIN best ON best.fold = asg.fold AND best.k = asg.k),
    nm AS (SELECT fold, sg, row_number() OVER (PARTITION BY fold ORDER BY min(cluster)) AS s FROM ch GROUP BY 1, 2)"""


@query(
    "subgroup_silhouette",
    f"""WITH {SIL_SQL} SELECT ch.fold, cluster, s::INT AS subgroup, k::INT AS k, round(score, 6) AS score FROM ch JOIN nm ON nm.fold = ch.fold AND nm.sg = ch.sg
    UNION ALL SELECT fold, cluster, 1, 1, NULL FROM fo WHERE fold = 'c'""",
)
def subgroup_silhouette_q(spark, d):
    from ..operators.aggregate import pair_cosine

    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    centers = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("w"))
    fold = F.when(F.col("label") < 6, "a").when(F.col("label") < 9, "b").otherwise("c")
    folds = table(spark, d, "embeddings").select(F.col("label").alias("cluster"), fold.alias("fold")).distinct()
    ks = F.when(F.col("fold") == "a", F.array(*[F.lit(k) for k in (2, 3, 4, 5)])).when(F.col("fold") == "b", F.array(F.lit(2)))
    given = folds.filter("fold <> 'c'").withColumn("k", F.explode(ks))
    given = given.withColumn("subgroup", F.expr("(cluster * 5 + cluster div 3) % k").cast("int"))
    out = motifs.subgroup_silhouette(pair_cosine(centers, "label", "dim", "w"), given, folds)
    return out.withColumn("score", r6("score"))
