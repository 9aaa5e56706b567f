"""What a vector search moves: no copies of vectors, and a fixed number of lists for a query."""

import numpy as np
from pyspark.sql import functions as F

from strandwork.operators import neighbours


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def vectors(spark, n, d):
    return spark.range(n).select("id", F.array(*[F.randn(i) for i in range(d)]).alias("vec"))


def moved(spark, found) -> int:
    before = shuffled(spark)
    found().write.format("noop").mode("overwrite").save()
    return shuffled(spark) - before


def test_an_exact_search_shuffles_each_vector_once(spark):
    """Twelve blocks a side: 36 MB of rows would be moved if every block were sent to every other."""
    x = vectors(spark, 3000, 64).localCheckpoint()
    q, r = x.withColumnRenamed("id", "query_id"), x.withColumnRenamed("id", "ref_id")
    assert moved(spark, lambda: neighbours.exact_cosine_topk(q, r, 5, block_rows=250)) < 8 << 20


def test_an_index_search_shuffles_each_vector_a_few_times(spark, tmp_path):
    """Radii of random vectors exclude no cell, so every query asks for all."""
    x = vectors(spark, 3000, 64).localCheckpoint()
    q, r = x.withColumnRenamed("id", "query_id"), x.withColumnRenamed("id", "ref_id")
    neighbours.build_index(r, str(tmp_path / "i"), 12)
    rows, cells = neighbours.read_index_rows(spark, str(tmp_path / "i"), r), spark.read.parquet(str(tmp_path / "i" / "cells"))
    assert moved(spark, lambda: neighbours.search_index(q, rows, cells, 5, 2)) < 10 << 20


def test_ids_of_any_type_and_repeated_or_missing_rows(spark):
    x = np.random.default_rng(4).integers(-1, 2, size=(60, 3)).astype("float64") + 0.5
    q = spark.createDataFrame([(i % 20, v.tolist()) for i, v in enumerate(x)], "query_id int, vec array<double>")
    r = spark.createDataFrame([(f"é{i}" if i % 2 else f"z{i}", v.tolist()) for i, v in enumerate(x)], "ref_id string, vec array<double>")
    names = [f"é{i}" if i % 2 else f"z{i}" for i in range(60)]
    got = {(g["query_id"], g["rank"]): (g["ref_id"], g["sim"]) for g in neighbours.exact_cosine_topk(q, r, 4, "l2", block_rows=7).collect()}
    for i in range(20):  # a repeated query has the best of all its rows
        near = sorted((round(float(((x[j] - v) ** 2).sum()), 9), n.encode()) for j in range(i, 60, 20) for v, n in zip(x, names))[:4]
        assert [got[i, k + 1] for k in range(4)] == [(n.decode(), -d) for d, n in near]
    assert neighbours.exact_cosine_topk(q, r.limit(0), 4).count() == 0 == neighbours.exact_cosine_topk(q.limit(0), r, 4).count()
