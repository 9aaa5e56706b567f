"""Joins, windows, rank rules and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hash_key, hash_uniform, r6
from ..operators import joins, windows
from ..session import cut_lineage
from .ingest import SEQ_SQL, sequences
from .registry import query, table

WIDTH = 1_000_000  # ids per shard of an id-ordered scan


def by_id(col: str):
    return F.floor(F.col(col) / WIDTH)


@query("inner_key_join", "SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def inner_key_join_q(spark, d):
    return joins.inner_key_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("validated_left_join", "SELECT l.doc_id, quality, toxic, lang, n_chars FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def validated_left_join_q(spark, d):
    return joins.validated_left_join(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query(
    "multi_key_left_join_metrics",
    """WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity::INT AS q, avg(l_extendedprice) AS price, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY 1, 2, 3, 4),
    b AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity::INT AS q, avg(l_extendedprice) AS price, avg(l_tax) AS tax FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1, 2, 3, 4)
    SELECT a.l_returnflag, a.l_linestatus, a.l_linenumber, a.q, n, round(a.price, 8) AS price_arch, round(b.price, 8) AS price_iface, round(tax, 6) AS tax,
    round(a.price / b.price, 6) AS price_ratio, round(a.price - b.price, 8) AS price_delta
    FROM a LEFT JOIN b ON a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.l_linenumber = b.l_linenumber AND a.q = b.q""",
)
def multi_key_left_join_metrics_q(spark, d):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "q"]
    li = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    a = li.filter("l_discount < 0.05").groupBy(*keys).agg(F.avg("l_extendedprice").alias("price"), F.count("*").alias("n"))
    b = li.filter("l_discount >= 0.05").groupBy(*keys).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax"))
    out = joins.ratio_and_delta(joins.multi_key_left_join(a, b, keys, ("_arch", "_iface")), {"price": ("price_arch", "price_iface")})
    return out.withColumns(
        {"tax": r6("tax"), "price_ratio": r6("price_ratio"), **{c: F.round(c, 8) for c in ("price_arch", "price_iface", "price_delta")}}
    )


@query(
    "report_join",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS o FROM lineitem)
    SELECT o_orderkey, o_orderstatus, coalesce(l_partkey, -1) AS l_partkey, l_quantity FROM orders LEFT JOIN m ON o_orderkey = l_orderkey AND o = 1""",
)
def report_join_q(spark, d):
    pred = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    motif = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("row_index")
    )
    return joins.report_join(pred, motif, "o_orderkey", "row_index").fillna(-1, ["l_partkey"])


@query(
    "last_wins_lookup",
    """WITH dim AS (SELECT user_id AS c_custkey, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1)
    SELECT c.c_custkey, c_nationkey, last_type FROM customer c JOIN dim ON dim.c_custkey = c.c_custkey""",
)
def last_wins_lookup_q(spark, d):
    fact = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    dim = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("last_type"), "event_id")
    return joins.last_wins_lookup(fact, dim, "c_custkey", "event_id")


@query("semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_q(spark, d):
    return joins.semi_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_q(spark, d):
    return joins.anti_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def offsets(spark, d):
    lens = cut_lineage(sequences(spark, d).select("doc_id", F.length("seq").alias("aa_len")))  # the text is read once
    return windows.cumulative_offsets(lens, "aa_len", "doc_id", by_id("doc_id"))


OFFSET_SQL = f"""{SEQ_SQL}, offs AS (SELECT doc_id, length(seq)::INT AS aa_len,
    (sum(length(seq)) OVER (ORDER BY doc_id))::BIGINT AS tok_end FROM seqs)"""


@query("cumulative_offsets", f"WITH {OFFSET_SQL} SELECT doc_id, aa_len, tok_end - aa_len AS tok_start, tok_end FROM offs")
def cumulative_offsets_q(spark, d):
    return offsets(spark, d)


@query(
    "interval_join",
    f"""WITH {OFFSET_SQL}, t AS (SELECT event_id, floor(value * 1000)::BIGINT * 7 AS tok FROM events)
    SELECT event_id, tok, doc_id FROM t JOIN offs ON tok >= tok_end - aa_len AND tok < tok_end""",
)
def interval_join_q(spark, d):
    tokens = table(spark, d, "events").select("event_id", (F.floor(F.col("value") * 1000) * 7).alias("tok"))
    hits = joins.interval_join(tokens, "tok", offsets(spark, d), "tok_start", "tok_end", width=4096)
    return hits.select("event_id", "tok", "doc_id")


@query(
    "pair_join",
    """SELECT a.s_nationkey, a.s_suppkey AS s_suppkey1, b.s_suppkey AS s_suppkey2 FROM supplier a JOIN supplier b
    ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
)
def pair_join_q(spark, d):
    return joins.pair_join(table(spark, d, "supplier"), "s_suppkey", ["s_nationkey"])


def points(spark, d):
    e = table(spark, d, "embeddings")
    # Every place of the vector counts for one coordinate, in order of its index.
    xyz = [F.round(F.aggregate(F.expr(f"filter(embedding, (v, i) -> i % 3 = {k})"), F.lit(0.0), lambda a, v: a + v.cast("double")) * 8, 6).alias(c) for k, c in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("chain"), F.col("vec_id").alias("label_seq"), *xyz)


POINT_SQL = "pts AS (SELECT vec_id AS id, label AS chain, " + ", ".join(
    f"round(list_sum(list_transform(range({k + 1}, 65, 3), lambda i: embedding[i]::DOUBLE)) * 8, 6) AS {c}" for k, c in enumerate("xyz")
) + " FROM embeddings)"
DIST_SQL = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query(
    "distance_join",
    f"""WITH {POINT_SQL} SELECT a.id AS id1, b.id AS id2, round({DIST_SQL}, 6) AS dist FROM pts a JOIN pts b ON a.id < b.id
    AND {DIST_SQL} <= 2.0 AND NOT (a.chain = b.chain AND abs(a.id - b.id) <= 2)""",
)
def distance_join_q(spark, d):
    return joins.contact_pairs(points(spark, d), 2.0).withColumn("dist", r6("dist"))


@query(
    "nearest_within",
    f"""WITH {POINT_SQL} SELECT a.id, round(min({DIST_SQL}), 6) AS dist FROM pts a JOIN pts b ON b.chain = 0 AND {DIST_SQL} <= 4.0 GROUP BY a.id""",
)
def nearest_within_q(spark, d):
    p = points(spark, d)
    return joins.nearest_within(p, p.filter("chain = 0"), 4.0).withColumn("dist", r6("dist"))


@query(
    "complete_grid",
    """WITH g AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT a.p_brand, b.p_size, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT p_brand FROM g) a CROSS JOIN (SELECT DISTINCT p_size FROM g) b
    LEFT JOIN g ON g.p_brand = a.p_brand AND g.p_size = b.p_size""",
)
def complete_grid_q(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return joins.complete_grid(counts, "p_brand", "p_size", ["n"])


@query(
    "token_translation",
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part),
    t AS (SELECT p_partkey, i, string_split(p_name, ' ')[i + 1] AS token FROM part, unnest(range(len(string_split(p_name, ' ')))) u(i))
    SELECT p_partkey, p_name, string_agg('t' || length(t.token) || '_' || substring(t.token, 1, 1), ' ' ORDER BY i) AS translated
    FROM part JOIN t USING (p_partkey) JOIN w ON w.token = t.token GROUP BY 1, 2""",
)
def token_translation_q(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    words = p.select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    names = words.withColumn("name", F.concat(F.lit("t"), F.length("token").cast("string"), F.lit("_"), F.substring("token", 1, 1)))
    return joins.token_translation(p, "p_partkey", "p_name", names)


TREE_EDGES_SQL = """edges AS (SELECT 'root' AS parent_id, 'r' || r_regionkey AS child_id FROM region WHERE r_name <> 'ASIA'
      UNION ALL SELECT CASE WHEN n_name LIKE '%1' THEN 'r99' ELSE 'r' || n_regionkey END, 'n' || n_nationkey FROM nation WHERE n_nationkey <> 7
      UNION ALL SELECT 'root', 'n777'),
    nodes AS (SELECT 'root' AS node_id UNION ALL SELECT 'r' || r_regionkey FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation)"""


@query(
    "edge_reference_check",
    f"""WITH {TREE_EDGES_SQL} SELECT DISTINCT parent_id AS node_id, 'missing_parent' AS violation FROM edges WHERE parent_id NOT IN (SELECT node_id FROM nodes)
    UNION ALL SELECT DISTINCT child_id, 'missing_child' FROM edges WHERE child_id NOT IN (SELECT node_id FROM nodes)
    UNION ALL SELECT node_id, 'parentless' FROM nodes WHERE node_id NOT IN (SELECT child_id FROM edges) AND node_id <> 'root'""",
)
def edge_reference_check_q(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    rid = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    nid = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    up = F.when(F.col("n_name").like("%1"), "r99").otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    root = spark.createDataFrame([("root", "n777")], "parent_id string, child_id string")
    edges = (
        r.filter("r_name <> 'ASIA'").select(F.lit("root").alias("parent_id"), rid.alias("child_id"))
        .unionByName(n.filter("n_nationkey <> 7").select(up.alias("parent_id"), nid.alias("child_id")))
        .unionByName(root)
    )
    nodes = root.select(F.col("parent_id").alias("node_id")).union(r.select(rid)).union(n.select(nid))
    return joins.edge_reference_check(nodes, edges, "root")


@query(
    "annotation_left_join",
    """WITH cells AS (SELECT n_regionkey AS main, n_nationkey AS sub, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    ann AS (SELECT n_regionkey AS main, n_nationkey AS sub, count(*) * 20 - 50 AS hits FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey <> 3 GROUP BY 1, 2),
    j AS (SELECT c.main, c.sub, total, CASE WHEN hits IS NOT NULL THEN least(greatest(hits, 0), total) END AS hits FROM cells c LEFT JOIN ann a ON a.main = c.main AND a.sub = c.sub)
    SELECT main, sub, total, hits::DOUBLE AS hits, (total - hits)::DOUBLE AS rest, round(hits / total, 6) AS rate FROM j""",
)
def annotation_left_join_q(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("main"), F.col("n_nationkey").alias("sub"))
    cells = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("sub")).groupBy("main", "sub").agg(F.count("*").alias("total"))
    ann = (
        table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("sub")).filter("sub <> 3")
        .groupBy("main", "sub").agg((F.count("*") * 20 - 50).alias("hits"))
    )
    out = joins.annotation_left_join(cells, ann, ["main", "sub"])
    return out.withColumns({"hits": F.col("hits").cast("double"), "rest": F.col("rest").cast("double"), "rate": r6("rate")})


# ---- windows ----------------------------------------------------------------


@query(
    "bounded_chunks",
    f"""WITH RECURSIVE {SEQ_SQL}, r AS (SELECT doc_id, length(seq) AS len, row_number() OVER (ORDER BY doc_id) AS i FROM seqs),
    w AS (SELECT i, doc_id, 1 AS chunk, 1 AS k, len AS aa FROM r WHERE i = 1 UNION ALL
      SELECT r.i, r.doc_id, CASE WHEN k >= 40 OR aa + len > 100000 THEN chunk + 1 ELSE chunk END,
        CASE WHEN k >= 40 OR aa + len > 100000 THEN 1 ELSE k + 1 END, CASE WHEN k >= 40 OR aa + len > 100000 THEN len ELSE aa + len END
      FROM w JOIN r ON r.i = w.i + 1)
    SELECT doc_id, printf('chunk_%05d', chunk) AS chunk_id, k::BIGINT AS sequence_index_in_chunk FROM w""",
)
def bounded_chunks_q(spark, d):
    seqs = sequences(spark, d).select("doc_id", F.length("seq").alias("aa_len"))
    return windows.bounded_chunks(seqs, "doc_id", "aa_len", 40, 100_000).drop("aa_len")


@query(
    "contiguous_runs",
    """WITH p AS (SELECT DISTINCT user_id, (epoch_us(ts) // 86400000000)::BIGINT AS day FROM events),
    g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM p)
    SELECT user_id, min(day) AS start, max(day) AS "end" FROM g GROUP BY user_id, g""",
)
def contiguous_runs_q(spark, d):
    e = table(spark, d, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day"))
    return windows.contiguous_runs(e, "day", ["user_id"], F.floor(F.col("day") / 4096))


@query(
    "column_group_ranges",
    """WITH a AS (SELECT event_type, event_id, row_number() OVER (ORDER BY event_id) AS rn, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS vn FROM events)
    SELECT event_type, min(rn) - 1 AS start, max(rn) - 1 AS "end" FROM a GROUP BY event_type, rn - vn""",
)
def column_group_ranges_q(spark, d):
    return windows.column_group_ranges(table(spark, d, "events"), "event_type", "event_id", by_id("event_id"))


CANDIDATE_SQL = """cand AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source || '_' || (doc_id % 7) END AS dir_name, (doc_id % 5)::INT AS model_index,
      CASE WHEN lang <> 'fr' THEN n_chars::DOUBLE END AS score FROM documents), jobs AS (SELECT DISTINCT source AS job_name FROM documents)"""


@query(
    "best_candidate",
    f"""WITH {CANDIDATE_SQL}, m AS (SELECT job_name, c.*, lower(dir_name) = job_name AS exact FROM jobs JOIN cand c
      ON lower(dir_name) = job_name OR regexp_full_match(lower(dir_name), job_name || '_\\d+'))
    SELECT job_name, n AS candidate_dir_count, doc_id, dir_name, model_index, score FROM (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY coalesce(score, '-inf'::DOUBLE) DESC,
      exact DESC, model_index, lower(dir_name) DESC, doc_id DESC) AS o, count(DISTINCT dir_name) OVER (PARTITION BY job_name) AS n FROM m) WHERE o = 1""",
)
def best_candidate_q(spark, d):
    docs = table(spark, d, "documents")
    cand = docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.concat("source", F.lit("_"), (F.col("doc_id") % 7).cast("string"))).alias("dir_name"),
        (F.col("doc_id") % 5).cast("int").alias("model_index"),
        F.when(F.col("lang") != "fr", F.col("n_chars").cast("double")).alias("score"),
    )
    return windows.best_candidate(docs.select(F.col("source").alias("job_name")).distinct(), cand, "doc_id")


@query(
    "top_k_per_group",
    """SELECT source, doc_id, n_chars, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 8""",
)
def top_k_per_group_q(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return windows.top_k_per_group(docs, "source", [F.desc("n_chars"), "doc_id"], 8)


@query(
    "order_by_total",
    """WITH t AS (SELECT p_type, sum(p_size)::BIGINT AS p_size FROM part GROUP BY 1)
    SELECT p_type, p_size, (row_number() OVER (ORDER BY CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END, p_size DESC, p_type))::INT AS position FROM t""",
)
def order_by_total_q(spark, d):
    from ..operators.clean import order_position

    return order_position(table(spark, d, "part"), "p_type", "p_size", ["PROMO", "SMALL"])


@query(
    "percentile_rank",
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 6) AS percentile FROM lineitem",
)
def percentile_rank_q(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return windows.percentile_rank(li, "l_quantity", ["l_returnflag"]).withColumn("percentile", r6("percentile"))


@query("even_split", "SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS part FROM orders")
def even_split_q(spark, d):
    return windows.even_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, shard=by_id("o_orderkey"))


def p_values(spark, d):
    u = hash_uniform(hash_key("doc_id", "p"))
    return table(spark, d, "documents").select("doc_id", F.round(u * u * u, 9).alias("p"))


U_SQL = "('0x' || substring(md5({id} || '|{seed}'), 1, 13))::BIGINT / 4503599627370496.0"
P_SQL = f"""u AS (SELECT doc_id, {U_SQL.format(id='doc_id', seed='p')} AS u FROM documents), pv AS (SELECT doc_id, round(u * u * u, 9) AS p FROM u),
    rk AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS r, count(*) OVER () AS m FROM pv)"""


@query(
    "holm_adjust",
    f"""WITH {P_SQL}, a AS (SELECT doc_id, p, max(least(1.0, p * (m - r + 1))) OVER (ORDER BY r) AS x FROM rk)
    SELECT doc_id, p, round(x, 6) AS p_adjusted, CASE WHEN x < 0.0001 THEN '****' WHEN x < 0.001 THEN '***' WHEN x < 0.01 THEN '**' WHEN x < 0.05 THEN '*' ELSE 'ns' END AS stars FROM a""",
)
def holm_adjust_q(spark, d):
    return windows.holm_adjust(p_values(spark, d), "p", "doc_id").withColumn("p_adjusted", r6("p_adjusted"))


@query(
    "bh_adjust",
    f"WITH {P_SQL} SELECT doc_id, p, round(min(least(1.0, p * m / r)) OVER (ORDER BY r DESC), 6) AS q_value FROM rk",
)
def bh_adjust_q(spark, d):
    return windows.bh_adjust(p_values(spark, d), "p", "doc_id").withColumn("q_value", r6("q_value"))


@query(
    "stage_layer_choice",
    """WITH l AS (SELECT l_quantity::INT AS layer, round(avg(l_discount), 4) AS recall, round(avg(l_tax), 4) AS prec FROM lineitem GROUP BY 1),
    t AS (SELECT *, row_number() OVER (ORDER BY layer) AS i, count(*) OVER () AS n FROM l),
    e AS (SELECT layer, recall FROM t WHERE i <= greatest(1, ceil(n * 0.5)) ORDER BY recall DESC, layer LIMIT 1),
    f AS (SELECT layer, prec FROM t WHERE i > n - greatest(1, ceil(n * 0.4)) AND layer <> (SELECT layer FROM e) ORDER BY prec DESC, layer DESC LIMIT 1)
    SELECT 'early' AS stage, layer, recall AS metric_value FROM e UNION ALL SELECT 'late', layer, prec FROM f""",
)
def stage_layer_choice_q(spark, d):
    li = table(spark, d, "lineitem")
    layers = li.groupBy(F.col("l_quantity").cast("int").alias("layer")).agg(
        F.round(F.avg("l_discount"), 4).alias("recall"), F.round(F.avg("l_tax"), 4).alias("prec")
    )
    return windows.stage_layer_choice(layers, "recall", "prec", 0.5, 0.4)


@query(
    "first_seen_order",
    """WITH f AS (SELECT p_type, arg_min(p_brand, (p_size, p_partkey)) AS owner, min((p_size, p_partkey)) AS k FROM part GROUP BY 1)
    SELECT p_type, owner, (row_number() OVER (ORDER BY k, p_type))::INT AS position FROM f""",
)
def first_seen_order_q(spark, d):
    return windows.first_seen_order(table(spark, d, "part"), "p_size", "p_partkey", "p_type", "p_brand")


# ---- set operations ----------------------------------------------------------


@query("intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_ids_q(spark, d):
    return joins.intersect_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids_q(spark, d):
    return joins.except_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query(
    "shared_labels",
    """WITH p AS (SELECT DISTINCT lang AS family, n_chars // 250 AS label, source AS member FROM documents)
    SELECT family, label FROM p GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT member) FROM p q WHERE q.family = p.family)""",
)
def shared_labels_q(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("lang").alias("family"), F.floor(F.col("n_chars") / 250).alias("label"), F.col("source").alias("member")
    )
    return joins.in_every_member(docs, "label", "member", ["family"])
