"""Sinks: delimited text, Parquet, FASTA, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import wrap_lines
from ..operators.ordering import rank_rows


def table_sink(df: DataFrame, path: str, fields: list[str], sep: str = ",", mode: str = "errorifexists") -> None:
    df.select(*fields).write.mode(mode).csv(path, header=True, sep=sep)


def parquet_sink(df: DataFrame, path: str, fields: list[str], partition: str | None = "chunk_id", mode: str = "errorifexists") -> None:
    """Typed columns, one folder per chunk."""
    writer = df.select(*fields).write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def fasta_lines(df: DataFrame, ident: str, seq: str, width: int = 80) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(ident).cast("string"), F.lit("\n"), wrap_lines(seq, width)).alias("value"))


def fasta_sink(df: DataFrame, path: str, ident: str, seq: str, order: str | None = None, width: int = 80) -> None:
    """``>id`` and the sequence wrapped at ``width``; ``order`` keeps input
    order across part files by a range partitioning, not by one task."""
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    fasta_lines(df, ident, seq, width).write.text(path)


def run_summary(df: DataFrame, flags: dict) -> DataFrame:
    """One record of run counts: each flag is a boolean column expression."""
    return df.agg(F.count("*").alias("input"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def embedding_row_map(kept: DataFrame, order: str = "record_index", width: int = 1_000_000) -> DataFrame:
    """0-based dense row number over the rows a stage kept."""
    ranked = rank_rows(kept, [order], (), "_rn", F.floor(F.col(order) / width))
    return ranked.withColumn("embedding_row", F.col("_rn") - 1).drop("_rn")
