"""Scans, sinks, cleaning and data quality on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r6
from ..functions.text import compact_number, compact_number_bands, mask_sequence, safe_identifier, strict_sequence, structured_id
from ..operators import checks, clean
from ..operators.aggregate import pair_cosine
from ..operators.ordering import rank_rows
from ..session import cut_lineage, scratch_folder
from ..sources import readers, writers
from .registry import query, table

# The same whitespace class as the library rule, for RE2; German sharp s
# upper-cases to SS as in Java and Python.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def up_sql(col: str) -> str:
    return f"upper(replace(regexp_replace({col}, '{WS}', '', 'g'), 'ß', 'SS'))"


def mask_sql(col: str) -> str:
    return f"regexp_replace({up_sql(col)}, '[^A-Z]', 'X', 'g')"


def sequences(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id"), mask_sequence("text").alias("seq"))


SEQ_SQL = f"seqs AS (SELECT doc_id, {mask_sql('text')} AS seq FROM documents)"


@query("mask_sequence", f"WITH {SEQ_SQL} SELECT doc_id, seq FROM seqs")
def mask_sequence_q(spark, d):
    return sequences(spark, d)


@query(
    "strict_sequence_check",
    f"""WITH u AS (SELECT doc_id, {up_sql('text')} AS s FROM documents),
    b AS (SELECT doc_id, ends_with(s, '*') AS terminal_stop, CASE WHEN ends_with(s, '*') THEN s[:-2] ELSE s END AS seq FROM u),
    f AS (SELECT *, list_sort(list_distinct(regexp_extract_all(seq, '[^A-Z]'))) AS bad FROM b)
    SELECT doc_id, seq, terminal_stop, CASE WHEN seq = '' THEN 'empty_sequence'
      WHEN len(bad) > 0 THEN 'invalid_characters:' || array_to_string(bad, '') END AS issue FROM f""",
)
def strict_sequence_check_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", strict_sequence("text").alias("s"))
    return docs.select("doc_id", "s.*")


SAFE_SQL = r"""CASE WHEN regexp_extract({h}, '^\s*(\S+)', 1) = '' THEN printf('seq_%06d', {i})
  ELSE regexp_replace(regexp_extract({h}, '^\s*(\S+)', 1), '[^\p{{L}}\p{{N}}._-]', '_', 'g') END"""


@query("safe_identifier", f"SELECT doc_id, {SAFE_SQL.format(h='text', i='doc_id')} AS safe_id FROM documents")
def safe_identifier_q(spark, d):
    return table(spark, d, "documents").select("doc_id", safe_identifier("text", "doc_id").alias("safe_id"))


@query(
    "dedupe_ids",
    f"""WITH b AS (SELECT doc_id, {SAFE_SQL.format(h='source', i='doc_id')} AS base FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS k FROM b)
    SELECT doc_id, base AS "Seq_ID_Base", CASE WHEN k = 1 THEN base ELSE base || printf('__dup%03d', k) END AS "Seq_ID" FROM n""",
)
def dedupe_ids_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", safe_identifier("source", "doc_id").alias("Seq_ID"))
    return clean.dedupe_ids(docs, order="doc_id", shard=F.floor(F.col("doc_id") / 1_000_000))


@query(
    "internal_ids",
    """SELECT conv_id, turn, role, printf('seq_%09d', row_number() OVER (ORDER BY conv_id, turn, role, text)) AS internal_id FROM conversations""",
)
def internal_ids_q(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return clean.internal_ids(c, ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", "role", "internal_id")


@query(
    "quarantine_split",
    f"""WITH {SEQ_SQL}, all_rows AS (SELECT doc_id, seq FROM seqs UNION ALL
      SELECT -page_id - 1, {mask_sql("regexp_replace(html, '[A-Za-z].*', '', 'gs')")} FROM pages)
    SELECT doc_id, length(seq)::INT AS aa_len, CASE WHEN seq = '' THEN 'empty_sequence_after_cleaning' END AS drop_reason,
      CASE WHEN seq = '' THEN 'dropped' ELSE 'kept' END AS side FROM all_rows""",
)
def quarantine_split_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("sequence"))
    pages = table(spark, d, "pages").select(
        (-F.col("page_id") - 1).alias("doc_id"), F.regexp_replace("html", "(?s)[A-Za-z].*", "").alias("sequence")
    )
    kept, dropped = clean.quarantine_split(clean.prepare_sequences(docs.unionByName(pages)))
    cols = ["doc_id", "aa_len", "drop_reason", "side"]
    return (
        kept.withColumns({"drop_reason": F.lit(None).cast("string"), "side": F.lit("kept")}).select(*cols)
        .unionByName(dropped.withColumn("side", F.lit("dropped")).select(*cols))
    )


@query(
    "binary_target",
    """SELECT e.event_id, (event_type = 'purchase')::INT AS target,
    CASE WHEN coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS numeric_target FROM events e""",
)
def binary_target_q(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        clean.binary_target("event_type", "purchase").alias("target"),
        clean.numeric_binary_target(F.get_json_object("props", "$.k")).alias("numeric_target"),
    )


P_SUFFIX = "('Tiny','SMALL'),('Wide','LARGE'),('Fresh','PROMO'),('Plain','ARD')"


@query(
    "taxon_clean",
    f"""WITH s(level, suffix) AS (VALUES {P_SUFFIX}),
    p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Tiny' WHEN 1 THEN 'Wide' WHEN 2 THEN 'Fresh' ELSE 'Plain' END AS level,
      ' ' || p_type || ' ' AS value FROM part)
    SELECT p_partkey, p.level, value, CASE WHEN trim(value) <> '' AND ends_with(trim(value), suffix) THEN trim(value) END AS taxon
    FROM p LEFT JOIN s ON p.level = s.level""",
)
def taxon_clean_q(spark, d):
    rules = spark.createDataFrame([("Tiny", "SMALL"), ("Wide", "LARGE"), ("Fresh", "PROMO"), ("Plain", "ARD")], "level string, suffix string")
    s = F.col("p_size") % 4
    level = F.when(s == 0, "Tiny").when(s == 1, "Wide").when(s == 2, "Fresh").otherwise("Plain")
    p = table(spark, d, "part").select("p_partkey", level.alias("level"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("value"))
    return clean.taxon_clean(p, "level", "value", rules)


@query(
    "unambiguous_label",
    """SELECT l_orderkey, min(l_linestatus || l_returnflag) AS tag FROM lineitem GROUP BY 1
    HAVING count(DISTINCT l_linestatus || l_returnflag) = 1""",
)
def unambiguous_label_q(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_linestatus", "l_returnflag").alias("tag"))
    return clean.unambiguous_label(li, "l_orderkey", "tag")


@query(
    "min_group_filter",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 6)",
)
def min_group_filter_q(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return clean.min_group_filter(li, "l_orderkey", 6).select("l_orderkey", "l_linenumber")


@query(
    "label_eligibility",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'Unknown' WHEN o_orderpriority LIKE '2%' THEN 'x unclassified y'
        ELSE o_orderpriority END AS priority, CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderstatus END AS status FROM orders),
    l AS (SELECT o_orderkey, 'priority' AS task, priority AS label FROM t UNION ALL SELECT o_orderkey, 'status', status FROM t),
    f AS (SELECT * FROM l WHERE label IS NOT NULL AND trim(label) <> '' AND label <> 'Unknown' AND NOT regexp_matches(label, '(?i)unclassified'))
    SELECT o_orderkey, task, label FROM f WHERE task IN (SELECT task FROM f GROUP BY 1 HAVING count(*) >= 100)""",
)
def label_eligibility_q(spark, d):
    p = F.col("o_orderpriority")
    o = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(p.startswith("1"), "Unknown").when(p.startswith("2"), "x unclassified y").otherwise(p).alias("priority"),
        F.when(F.col("o_totalprice") >= 100000, F.col("o_orderstatus")).alias("status"),
    )
    return clean.label_eligibility(o, ["priority", "status"], 100, "o_orderkey").select("o_orderkey", "task", "label")


@query(
    "vector_profile",
    """WITH c AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings),
    r AS (SELECT count(*) AS n_rows, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS n_zero_rows FROM embeddings)
    SELECT r.n_rows, r.n_zero_rows, count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (isinf(x)) AS n_inf, round(avg(x), 6) AS mean,
    round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, r.n_zero_rows = 0 AS passed FROM c, r GROUP BY r.n_rows, r.n_zero_rows""",
)
def vector_profile_q(spark, d):
    out = clean.vector_profile(table(spark, d, "embeddings").select(F.col("embedding").alias("vec")))
    return out.withColumns({c: r6(c) for c in ("mean", "std", "min", "max")})


@query(
    "constraint_checks",
    """SELECT 'duplicate_key' AS "check", md5(text) AS key, count(*)::VARCHAR AS detail FROM documents GROUP BY md5(text) HAVING count(*) > 1
    UNION ALL SELECT 'missing_match', doc_id::VARCHAR, '1' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'row_count', '', a || '<>' || b FROM (SELECT count(*) AS a, (SELECT count(*) FROM labels) AS b FROM documents) WHERE a <> b
    UNION ALL SELECT 'out_of_range', l_orderkey || '|' || l_linenumber, round(l_discount, 6)::VARCHAR FROM lineitem WHERE l_discount < 0 OR l_discount > 0.07
    UNION ALL SELECT 'not_positive', c_custkey::VARCHAR, round(c_acctbal, 6)::VARCHAR FROM customer WHERE c_acctbal <= 0""",
)
def constraint_checks_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"))
    labels = table(spark, d, "labels")
    return checks.violations(
        [
            checks.unique_key(docs, "text_key"),
            checks.missing_match(docs, labels, "doc_id"),
            checks.row_count_equal(docs, labels),
            checks.out_of_range(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_discount", 0.0, 0.07),
            checks.not_positive(table(spark, d, "customer"), "c_custkey", "c_acctbal"),
        ]
    )


@query(
    "truncation_account",
    f"WITH {SEQ_SQL} SELECT doc_id, least(length(seq), 1022)::BIGINT AS processed, length(seq) > 1022 AS truncated FROM seqs",
)
def truncation_account_q(spark, d):
    return sequences(spark, d).select("doc_id", clean.truncation_account(F.length("seq"), 1024).alias("t")).select("doc_id", "t.*")


@query(
    "category_map",
    """SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'red family' WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'house brand'
      WHEN p_size > 40 THEN p_type ELSE 'other' END AS category,
      CASE p_type WHEN 'SMALL' THEN 'compact' WHEN 'ECONOMY' THEN 'compact' WHEN 'LARGE' THEN 'bulky' ELSE p_type END AS merged FROM part""",
)
def category_map_q(spark, d):
    rules = [
        (F.col("p_name").startswith("red"), "red family"),
        (F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), "house brand"),
        (F.col("p_size") > 40, F.col("p_type")),
    ]
    merge = spark.createDataFrame([("SMALL", "compact"), ("ECONOMY", "compact"), ("LARGE", "bulky")], "old string, new string")
    p = table(spark, d, "part").withColumn("category", clean.category_map(rules, "other"))
    return clean.recode(p, "p_type", merge, "merged").select("p_partkey", "category", "merged")


@query(
    "bin_class",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS x, l_discount AS y, l_tax AS z FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN x < 0.33 THEN 'inner' WHEN x < 0.67 THEN 'middle' ELSE 'outer' END AS radial,
    CASE WHEN y <= 0.04 THEN 'low' WHEN y <= 0.08 THEN 'medium' ELSE 'high' END AS divergence,
    CASE WHEN z < 0.0001 THEN '****' WHEN z < 0.001 THEN '***' WHEN z < 0.01 THEN '**' WHEN z < 0.05 THEN '*' ELSE 'ns' END AS stars FROM r""",
)
def bin_class_q(spark, d):
    from ..functions.stats import significance_stars

    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        clean.bin_class(F.col("l_quantity") / 50.0, [0.33, 0.67], ["inner", "middle", "outer"], nan="na").alias("radial"),
        clean.bin_class("l_discount", [0.04, 0.08], ["low", "medium", "high"], inclusive=True).alias("divergence"),
        significance_stars("l_tax").alias("stars"),
    )


@query(
    "patch_overrides",
    """WITH p(s_suppkey, old_value, new_value) AS (VALUES (0, 15, 99), (1, 3, 98), (2, 16, 97))
    SELECT s.s_suppkey, s_nationkey, coalesce(new_value, s_nationkey)::INT AS s_nationkey_new, new_value IS NOT NULL AS applied
    FROM supplier s LEFT JOIN p ON p.s_suppkey = s.s_suppkey AND old_value = s_nationkey""",
)
def patch_overrides_q(spark, d):
    patches = spark.createDataFrame([(0, 15, 99), (1, 3, 98), (2, 16, 97)], "s_suppkey long, old_value int, new_value int")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return clean.patch_overrides(s, patches, "s_suppkey", "s_nationkey")


@query(
    "compact_number_format",
    """WITH n AS (SELECT o_orderkey, o_totalprice * o_totalprice / 1000.0 AS x FROM orders)
    SELECT o_orderkey, CASE WHEN x >= 1e6 THEN printf('%.2fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.1fK', x / 1e3) ELSE printf('%d', floor(x)::BIGINT) END AS two_band,
    CASE WHEN x >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN x >= 1e4 THEN printf('%.0fk', x / 1e3) WHEN x >= 1e3 THEN printf('%.1fk', x / 1e3)
      ELSE printf('%.0f', x) END AS four_band FROM n""",
)
def compact_number_format_q(spark, d):
    x = F.col("o_totalprice") * F.col("o_totalprice") / 1000.0
    return table(spark, d, "orders").select("o_orderkey", compact_number(x).alias("two_band"), compact_number_bands(x).alias("four_band"))


@query(
    "range_scale",
    """WITH b AS (SELECT min(s_acctbal) AS mn, max(s_acctbal) AS mx FROM supplier)
    SELECT s_suppkey, round(CASE WHEN mx > mn THEN 2.0 + (s_acctbal - mn) / (mx - mn) * 8.0 ELSE 6.0 END, 6) AS linear,
    round(CASE WHEN s_acctbal <= 0 THEN 0.0 ELSE 1.0 + pow(s_acctbal / mx, 0.5) * 4.0 END, 6) AS root FROM supplier, b""",
)
def range_scale_q(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    out = clean.power_scale(clean.range_scale(s, "s_acctbal", 2.0, 10.0, "linear"), "s_acctbal", 1.0, 5.0, "root")
    return out.select("s_suppkey", r6("linear").alias("linear"), r6("root").alias("root"))


@query(
    "numeric_coerce",
    "SELECT p_partkey, try_cast(replace(p_brand, 'Brand#', CASE WHEN p_size > 25 THEN '' ELSE 'x' END) AS DOUBLE) AS number FROM part",
)
def numeric_coerce_q(spark, d):
    text = F.when(F.col("p_size") > 25, F.replace("p_brand", F.lit("Brand#"), F.lit(""))).otherwise(F.replace("p_brand", F.lit("Brand#"), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", clean.numeric_coerce(text).alias("number"))


@query(
    "parse_structured_id",
    r"""WITH t AS (SELECT s_suppkey, printf('%04d_%d_Chain', s_suppkey % 10000, s_nationkey) || CASE WHEN s_nationkey < 5 THEN 's' WHEN s_nationkey > 20 THEN 'x' ELSE '' END AS id FROM supplier)
    SELECT s_suppkey, CASE WHEN regexp_matches(id, '^([0-9A-Za-z]{4})_(\d+)_Chains?$') THEN regexp_extract(id, '^([0-9A-Za-z]{4})_', 1) END AS pdb_id,
    CASE WHEN regexp_matches(id, '^([0-9A-Za-z]{4})_(\d+)_Chains?$') THEN regexp_extract(id, '_(\d+)_Chain', 1)::INT ELSE -1 END AS entity FROM t""",
)
def parse_structured_id_q(spark, d):
    n = F.col("s_nationkey")
    ident = F.concat(
        F.format_string("%04d_%d_Chain", F.col("s_suppkey") % 10000, n), F.when(n < 5, "s").when(n > 20, "x").otherwise("")
    )
    return table(spark, d, "supplier").select("s_suppkey", structured_id(ident).alias("p")).select(
        "s_suppkey", "p.pdb_id", F.coalesce("p.entity", F.lit(-1)).alias("entity")
    )


# ---- scans and sinks -------------------------------------------------------


@query(
    "fasta_scan",
    f"""WITH {SEQ_SQL} SELECT row_number() OVER (ORDER BY doc_id) AS record_index, doc_id || ' record' AS header, seq AS sequence
    FROM seqs WHERE seq <> ''""",
)
def fasta_scan_q(spark, d):
    path = scratch_folder(spark, "fasta")
    seqs = cut_lineage(sequences(spark, d)).filter("seq <> ''").withColumn("header", F.concat(F.col("doc_id").cast("string"), F.lit(" record")))
    writers.fasta_sink(seqs, path, "header", "seq", order="doc_id")
    return readers.fasta_scan(spark, path)


@query(
    "fasta_sink",
    f"""WITH {SEQ_SQL} SELECT '>' || doc_id AS line FROM seqs UNION ALL
    SELECT substring(seq, i * 80 + 1, 80) FROM seqs, unnest(range(0, greatest(1, ceil(length(seq) / 80.0)::INT))) t(i) WHERE i = 0 OR i * 80 < length(seq)""",
)
def fasta_sink_q(spark, d):
    path = scratch_folder(spark, "fasta")
    writers.fasta_sink(sequences(spark, d), path, "doc_id", "seq")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "csv_sequence_scan",
    f"""WITH {SEQ_SQL}, n AS (SELECT row_number() OVER (ORDER BY s.doc_id) - 1 AS i, s.doc_id, seq, lang FROM seqs s JOIN documents d ON s.doc_id = d.doc_id)
    SELECT CASE WHEN lang = 'de' THEN 'row_' || i ELSE 'd' || doc_id END AS prot_id, seq FROM n WHERE seq <> ''""",
)
def csv_sequence_scan_q(spark, d):
    path = scratch_folder(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "lang").join(sequences(spark, d), "doc_id")
    rows = docs.select(
        F.when(F.col("lang") != "de", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("Name"), F.col("seq").alias("SEQ"), "doc_id"
    )
    writers.table_sink(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path, ["Name", "SEQ"])
    return readers.csv_sequence_scan(spark, path)


@query("manifest_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def manifest_scan_q(spark, d):
    path = scratch_folder(spark, "tsv")
    fields = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    writers.table_sink(table(spark, d, "customer"), path, fields, sep="\t")
    return readers.manifest_scan(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("table_sink", "SELECT s_name::VARCHAR AS s_name, s_suppkey::VARCHAR AS s_suppkey FROM supplier")
def table_sink_q(spark, d):
    path = scratch_folder(spark, "csv")
    writers.table_sink(table(spark, d, "supplier"), path, ["s_name", "s_suppkey"])
    return spark.read.csv(path, header=True)


@query("parquet_sink", "SELECT event_id, user_id, value, event_type AS chunk_id FROM events")
def parquet_sink_q(spark, d):
    path = scratch_folder(spark, "tokens")
    e = table(spark, d, "events").withColumnRenamed("event_type", "chunk_id")
    writers.parquet_sink(e, path, ["event_id", "user_id", "value", "chunk_id"])
    return spark.read.schema("event_id long, user_id long, value double, chunk_id string").parquet(path)


@query(
    "union_chunks",
    """SELECT event_id, value, event_type AS chunk_id FROM events""",
)
def union_chunks_q(spark, d):
    path = scratch_folder(spark, "chunks")
    e = table(spark, d, "events").withColumnRenamed("event_type", "chunk_id")
    writers.parquet_sink(e, path, ["event_id", "value", "chunk_id"])
    return readers.union_chunks(spark, path, e.select("chunk_id").distinct(), "event_id long, value double, chunk_id string")


@query(
    "summary_json_scan",
    """SELECT source AS run, lang AS "group", count(*) AS n, sum(n_chars)::BIGINT AS total,
    (SELECT to_json(map_from_entries(list((l, c) ORDER BY l))) FROM (SELECT lang AS l, count(*) AS c FROM documents d2 WHERE d2.source = d.source GROUP BY 1)) AS label_counts
    FROM documents d GROUP BY source, lang""",
)
def summary_json_scan_q(spark, d):
    path = scratch_folder(spark, "json")
    per = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))
    entries = F.array_sort(F.collect_list(F.struct("lang", F.struct("n", "total").alias("v"))))  # a few languages per run
    runs = per.groupBy(F.col("source").alias("run")).agg(entries.alias("e"))
    runs.select(
        "run",
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["lang"], x["v"]))).alias("groups"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["lang"], x["v"]["n"]))).alias("label_counts"),
    ).repartition("run").write.option("maxRecordsPerFile", 1).json(path)
    schema = "run string, groups map<string, struct<n: long, total: long>>, label_counts map<string, long>"
    return readers.summary_json_scan(spark, path, schema)


@query(
    "sparse_matrix_scan",
    """WITH c AS (SELECT vec_id, i::INT AS feature, embedding[i + 1]::DOUBLE AS x FROM embeddings, unnest(range(64)) t(i))
    SELECT vec_id AS row_id, feature, round(x, 6) AS value FROM c WHERE x > 0 UNION ALL
    SELECT vec_id + (SELECT count(*) FROM embeddings), feature, round(-x, 6) FROM c WHERE x < 0""",
)
def sparse_matrix_scan_q(spark, d):
    c = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("feature", "value"))
    n = table(spark, d, "embeddings").count()
    pos, neg = c.filter("value > 0"), c.filter("value < 0").withColumn("value", -F.col("value"))
    return readers.sparse_matrix_scan([pos, neg], [n, n]).withColumn("value", r6("value"))


@query(
    "embedding_scan",
    """SELECT vec_id, label, len(embedding)::INT AS n_dims, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
)
def embedding_scan_q(spark, d):
    e = table(spark, d, "embeddings")
    out = readers.embedding_scan(e.select("vec_id", "embedding"), e.select("vec_id", "label"), "vec_id")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", "label", F.size("embedding").alias("n_dims"), r6(total).alias("total"))


@query(
    "atom_scan",
    """WITH a AS (SELECT vec_id, label, 1 + vec_id % 2 AS entity, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS serial,
      chr((65 + vec_id % 3)::INT) AS chain, """ + ", ".join(f"round(list_sum(list_transform(range({k + 1}, 65, 3), lambda i: embedding[i]::DOUBLE)) * 8, 6) AS {c}" for k, c in enumerate("xyz")) + """ FROM embeddings)
    SELECT printf('s%03d', label) AS pdb_id, entity::INT AS entity, chain, serial::INT AS label_seq, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z,
    chain = first_value(chain) OVER (PARTITION BY label, entity ORDER BY serial) AS is_representative FROM a""",
)
def atom_scan_q(spark, d):
    path = scratch_folder(spark, "atoms")
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    e = rank_rows(e, ["vec_id"], ["label"], "serial", F.floor(F.col("vec_id") / 1_000_000))
    # Every place of the vector counts for one coordinate, in order of its index.
    place = lambda k: F.aggregate(F.expr(f"filter(embedding, (v, i) -> i % 3 = {k})"), F.lit(0.0), lambda a, v: a + v.cast("double"))
    xyz = [F.format_string("%.3f", F.round(F.round(place(k) * 8, 6), 3)) for k in range(3)]
    chain = F.chr(F.lit(65) + F.col("vec_id") % 3)
    seq, ent = F.col("serial").cast("string"), (F.col("vec_id") % 2 + 1).cast("string")
    parts = [F.lit("ATOM"), seq, F.lit("C"), F.lit("CA"), F.lit("."), F.lit("ALA"), chain, ent, seq, F.lit("?"), *xyz]
    parts += [F.lit("1.00"), F.lit("0.00"), F.lit("?"), seq, F.lit("ALA"), chain, F.lit("CA"), F.lit("1")]
    # Half of the files list their columns the other way round.
    turned = F.col("label") % 2 == 1
    line = lambda tag: F.array_join(F.when(turned, F.concat(F.array(F.lit(tag)), F.reverse(F.array(*parts[1:])))).otherwise(F.array(F.lit(tag), *parts[1:])), " ")
    first, *others = readers.ATOM_COLUMNS
    header = F.transform(F.concat(F.array(F.lit(first)), F.when(turned, F.reverse(F.array(*map(F.lit, others)))).otherwise(F.array(*map(F.lit, others)))), lambda n: F.concat(F.lit(readers.ATOM_LOOP), n))
    pdb = F.format_string("s%03d", "label").alias("pdb")
    heads = e.select("label").distinct().select(pdb, F.posexplode(header).alias("at", "value")).select("pdb", (F.col("at") - 100).cast("long").alias("at"), "value")
    lines = [e.select(pdb, F.col("serial").cast("long").alias("at"), line(tag).alias("value")) for tag in ("ATOM", "HETATM")]
    ordered = heads.unionByName(lines[0]).unionByName(lines[1]).repartition("pdb").sortWithinPartitions("pdb", "at")
    ordered.select("pdb", "value").write.partitionBy("pdb").text(path)
    return readers.atom_scan(spark, path, r"pdb=([0-9A-Za-z]{4})/")


@query(
    "matrix_unpivot",
    """WITH c AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS m FROM embeddings, unnest(range(64)) t(i) GROUP BY 1, 2),
    n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1)
    SELECT a.label AS i, b.label::VARCHAR AS j, round(sum(a.m * b.m) / max(na.n * nb.n), 6) AS sim FROM c a JOIN c b USING (i)
    JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY 1, 2""",
)
def matrix_unpivot_q(spark, d):
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    profile = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("w"))
    pairs = pair_cosine(profile, "label", "dim", "w")
    wide = pairs.groupBy(F.col("i").alias("cluster")).pivot("j").agg(F.first("sim"))  # columns: the labels there are
    return readers.matrix_unpivot(wide).withColumn("sim", r6("sim"))


@query(
    "run_summary",
    f"""WITH {SEQ_SQL} SELECT count(*) AS input, count(*) FILTER (seq <> '') AS valid, count(*) FILTER (seq = '') AS invalid,
    count(*) FILTER (length(seq) > 1022) AS truncated FROM seqs""",
)
def run_summary_q(spark, d):
    flags = {"valid": F.col("seq") != "", "invalid": F.col("seq") == "", "truncated": F.length("seq") > 1022}
    return writers.run_summary(sequences(spark, d), flags)


@query(
    "embedding_row_map",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS embedding_row FROM documents WHERE n_chars > 500",
)
def embedding_row_map_q(spark, d):
    kept = table(spark, d, "documents").filter("n_chars > 500").select("doc_id")
    return writers.embedding_row_map(kept, "doc_id")
