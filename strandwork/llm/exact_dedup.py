"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import free_name, number_rows, text_of

PREFIX_CHARS = 64


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on more than one row. Rows are counted before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def exact_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, content, copies, keep_id, kept): one row per input row.

    Texts are equal when their bytes are equal; null counts as empty. Only rows
    that share their length are hashed over a prefix, and only rows that share
    both are hashed in full: ``content`` is that SHA-256, null for a row that
    was settled earlier. Of equal texts the row with the largest id stays; null
    is the smallest id, and of repeated rows with the largest id one stays. An
    empty table gives an empty table; other columns are not looked at.
    """
    rows = docs.select(F.col(ident).alias("id"), text_of(text).alias("t")).withColumn("len", F.octet_length("t"))
    prefix = F.xxhash64(F.substring("t", 1, PREFIX_CHARS))
    by_length = _shared(rows.select("len"), ["len"])
    narrow = rows.select("len", prefix.alias("prefix")).join(by_length, "len", "left_semi")
    by_prefix = _shared(narrow, ["len", "prefix"]).withColumn("by_prefix", F.lit(True))
    # Lengths and prefixes are settled on narrow rows; the texts are moved once.
    second = rows.withColumn("prefix", prefix).join(by_prefix.hint("merge"), ["len", "prefix"], "left")
    # The full text is read only here, and only where length and prefix are shared.
    hashed = cut_lineage(second.select("id", F.when(F.col("by_prefix"), F.sha2("t", 256)).alias("content")))
    many = hashed.filter("content is not null")
    groups = many.groupBy("content").agg(F.count("*").alias("copies"), F.max("id").alias("keep_id"))
    # Only rows with the id that stays compete, so a large group sends few rows here.
    ranked = many.join(groups, "content").withColumn("last", F.col("id").eqNullSafe(F.col("keep_id")))
    turn = F.row_number().over(Window.partitionBy("content", "id").orderBy("id"))
    stays = ranked.filter("last").withColumn("kept", turn == 1).drop("last")
    leaves = ranked.filter("not last").withColumn("kept", F.lit(False)).drop("last")
    alone = hashed.filter("content is null").select("content", "id", F.lit(1).cast("long").alias("copies"), F.col("id").alias("keep_id"), F.lit(True).alias("kept"))
    return stays.unionByName(leaves).unionByName(alone).select(F.col("id").alias(ident), "content", "copies", "keep_id", "kept")


def drop_exact_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without copies: the row with the largest id of every text stays, one
    where that row is repeated. Columns and their names are those of ``docs``."""
    row = free_name(docs, "_row")
    numbered = number_rows(docs, row, ident, text)
    groups = exact_groups(numbered.select(F.struct(F.col(ident).alias("id"), F.col(row).alias("row")).alias("id"), F.col(text).alias("text")), "id", "text")
    gone = groups.filter("not kept").select(F.col("id.row").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)
