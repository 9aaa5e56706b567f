"""Sharded scans give the same as a plain window; hot groups included."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwork.operators import ordering, windows
from strandwork.operators.pairs import distance_matrix, pair_statistics


@pytest.fixture(scope="module")
def rows(spark):
    # group 0 holds a third and more of the rows
    g = F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 7)
    return spark.range(3000).select("id", g.alias("g"), (F.hash("id") % 50).cast("double").alias("v"))


@pytest.mark.parametrize("shard", [None, "id"])
def test_rank_matches_window(rows, shard):
    col = F.floor(F.col("id") / 100) if shard else None
    got = ordering.rank_rows(rows, ["id"], ["g"], "rn", col)
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")).cast("long"))
    assert got.select("id", "g", "rn").exceptAll(want.select("id", "g", "rn")).isEmpty()
    assert got.count() == 3000


def test_running_extremes(rows):
    got = ordering.ordered_scan(rows, ["id"], {"mx": ("max", F.col("v")), "s": F.col("v")}, ["g"], F.floor(F.col("id") / 64))
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", "g", F.max("v").over(w).alias("mx"), F.sum("v").over(w).alias("s"))
    assert got.select("id", "g", "mx", "s").exceptAll(want).isEmpty()


def test_quantiles_are_exact(rows):
    got = {r["g"]: r for r in ordering.interpolated_quantiles(rows, "v", {"a": 0.1, "m": 0.5}, ["g"]).collect()}
    for g, part in rows.toPandas().groupby("g"):
        assert got[g]["a"] == pytest.approx(np.percentile(part["v"], 10))
        assert got[g]["m"] == pytest.approx(np.median(part["v"]))


def test_lead_crosses_stretches(spark):
    t = spark.range(100).select(F.lit(1).alias("g"), F.col("id").alias("pos"), (F.col("id") * 3).alias("x"))
    got = ordering.lead_values(t, ["g"], "pos", ["x"], 2, width=10).orderBy("pos").collect()
    assert [(r["x_1"], r["x_2"]) for r in got] == [((p + 1) * 3 if p < 99 else None, (p + 2) * 3 if p < 98 else None) for p in range(100)]


def greedy(lengths, max_n, max_aa):
    out, chunk, n, aa = [], 1, 0, 0
    for x in lengths:
        if n >= max_n or (n and aa + x > max_aa):
            chunk, n, aa = chunk + 1, 0, 0
        n, aa = n + 1, aa + x
        out.append((f"chunk_{chunk:05d}", n))
    return out


@pytest.mark.parametrize("max_n,max_aa,block", [(7, 300, 20), (50, 120, 60), (3, 10**9, 10)])
def test_chunks_match_greedy_over_many_blocks(spark, max_n, max_aa, block):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(0, 90, 400)]
    lengths[37] = 5000  # an oversize record
    df = spark.createDataFrame(list(enumerate(lengths)), "i long, n int")
    got = windows.bounded_chunks(df, "i", "n", max_n, max_aa, block_rows=block).orderBy("i").collect()
    assert [(r["chunk_id"], r["sequence_index_in_chunk"]) for r in got] == greedy(lengths, max_n, max_aa)


def test_pair_statistics_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    pts = np.round(rng.random((60, 3)), 1)
    df = spark.createDataFrame([("g", [float(c) for c in p], 2.0) for p in pts], "g string, vec array<double>, top double")
    got = pair_statistics(df, "g", distance_matrix, block_rows=16).first()
    d = distance_matrix(pts, pts)[np.triu_indices(60, 1)]
    assert got["n_pairs"] == len(d)
    assert (got["mean"], got["median"], got["max"]) == pytest.approx((d.mean(), np.median(d), d.max()))
