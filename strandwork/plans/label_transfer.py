"""Nearest-neighbour label transfer end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import neighbours


def transfer_labels(queries: DataFrame, refs: DataFrame, labels: DataFrame, k: int = 20, level: str = "sequence", nlist: int | None = None, nprobe: int = 8, index: str | None = None) -> DataFrame:
    """(query_id, pred_label, confidence).

    ``queries`` is (query_id, vec), ``refs`` (ref_id, vec), ``labels`` (ref_id,
    label). ``index`` is a folder that ``neighbours.build_index`` made of the same
    references: it is searched exactly, without a fit. ``nlist`` fits cells for
    this call and searches the nearest only. ``level`` chooses the sequence or the
    token vote.
    """
    if index:
        spark = queries.sparkSession
        found = neighbours.search_index(queries, neighbours.read_index_rows(spark, index, refs), spark.read.parquet(f"{index}/cells"), k, nprobe)
    elif nlist:
        found = neighbours.ivf_search(queries, refs, k, nlist, nprobe)
    else:
        found = neighbours.exact_cosine_topk(queries, refs, k)
    voters = neighbours.with_ref_labels(found, labels)
    vote = neighbours.vote_sequence if level == "sequence" else neighbours.vote_token
    return vote(voters, queries)
