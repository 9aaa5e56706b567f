"""Reference vectors to a neighbour graph, communities and dense labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, neighbours


def motif_graph(refs: DataFrame, k: int = 50, resolution: float = 1.0, nlist: int | None = None, nprobe: int = 8, index: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, quality) for (ref_id, vec) with dense ids 0 .. n-1.

    ``index``, a folder of ``neighbours.build_index``, is searched exactly; ``nlist`` fits
    cells for this call and searches the nearest only.
    """
    queries = refs.select(F.col("ref_id").alias("query_id"), "vec")
    if index:
        spark = refs.sparkSession
        found = neighbours.search_index(queries, neighbours.read_index_rows(spark, index, refs), spark.read.parquet(f"{index}/cells"), k, nprobe)
    else:
        found = neighbours.ivf_search(queries, refs, k, nlist, nprobe) if nlist else neighbours.exact_cosine_topk(queries, refs, k)
    n = refs.count()
    edges = graph.undirected(graph.knn_to_edges(found.withColumnRenamed("sim", "value"), n, drop_self=True))
    parts = graph.community_detection(edges, resolution)
    return graph.densify_labels(parts, n), graph.modularity(edges, parts, resolution)
