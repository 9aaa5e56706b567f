"""FASTA to annotated report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_identifier
from ..operators import aggregate, clean, motifs, windows
from ..operators.joins import report_join
from ..operators.ordering import rank_rows
from ..session import cut_lineage
from .label_transfer import transfer_labels


def prepare(records: DataFrame, max_n: int = 2000, max_aa: int = 800_000) -> tuple[DataFrame, DataFrame]:
    """(manifest, dropped): cleaned, uniquely named and chunked sequences."""
    named = clean.prepare_sequences(records).withColumn("Seq_ID", safe_identifier("header", "record_index"))
    kept, dropped = clean.quarantine_split(named)
    kept = clean.dedupe_ids(kept, shard=F.floor(F.col("record_index") / 1_000_000))
    kept = kept.select("record_index", "Seq_ID", "Seq_ID_Base", F.col("header").alias("Original_Header"), "seq", "aa_len")
    manifest = windows.bounded_chunks(kept, "record_index", "aa_len", max_n, max_aa)
    return cut_lineage(manifest), dropped.select("record_index", F.col("header").alias("Original_Header"), "drop_reason")


def annotate(manifest: DataFrame, encode: Callable[[DataFrame], DataFrame], token_refs: DataFrame, token_labels: DataFrame, seq_refs: DataFrame, seq_labels: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Token table, sequence summary, predictions and report.

    ``encode`` gives (Seq_ID, token_idx_in_sequence, vec); the references are
    (ref_id, vec) with (ref_id, label).
    """
    lens = windows.cumulative_offsets(manifest, "aa_len", "record_index", F.floor(F.col("record_index") / 1_000_000))
    tokens = encode(manifest).join(lens.select("Seq_ID", "tok_start"), "Seq_ID")
    tokens = cut_lineage(tokens.withColumn("query_id", F.col("tok_start") + F.col("token_idx_in_sequence")))
    voted = transfer_labels(tokens.select("query_id", "vec"), token_refs, token_labels, k, level="token")
    labels = voted.select(F.col("query_id").alias("token_idx_global"), F.col("pred_label").alias("label"), "confidence")
    table = motifs.token_table(lens, labels)
    summary = aggregate.weighted_top_label(table, manifest, "Seq_ID", "label", "confidence", "token_idx_in_sequence")
    pooled = aggregate.dense_mean_pool(tokens, "Seq_ID", "vec")
    ids = rank_rows(manifest, ["record_index"], (), "query_id", F.floor(F.col("record_index") / 1_000_000)).select("Seq_ID", "query_id")
    pred = transfer_labels(pooled.join(ids, "Seq_ID").select("query_id", "vec"), seq_refs, seq_labels, k)
    named = pred.join(ids, "query_id").select("Seq_ID", F.col("pred_label").alias("Pred_Label"), F.col("confidence").alias("Pred_Confidence"))
    named = named.join(manifest.select("Seq_ID", "chunk_id"), "Seq_ID")
    report = report_join(named, summary.withColumn("row_index", F.lit(0)), "Seq_ID", "row_index")
    return {"tokens": table, "summary": summary, "predictions": named, "report": report}
