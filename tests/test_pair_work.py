"""Pairs are spread over tasks and summed up without being shuffled."""

from pyspark.sql import functions as F

from strandwork.operators import aggregate
from strandwork.operators.joins import pair_join


def test_pairs_of_few_rows_are_made_by_many_tasks(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 5).alias("c"))
    per_task = pair_join(rows, "id", columns=["c"], block_rows=300).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in per_task) == 3000 * 2999 // 2
    assert len(per_task) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_recounted_summary_is_the_summary(spark):
    v = F.when(F.col("id") % 97 == 0, F.lit(None)).when(F.col("id") % 50 == 1, (F.col("id") - 2000) * 3.0).when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(7))
    rows = spark.range(6000).select(F.when(F.col("id") < 5, 0).when(F.col("id") < 6, 1).otherwise(2 + F.col("id") % 3).alias("g"), v.alias("v")).localCheckpoint()
    want = {r["g"]: r for r in aggregate.distribution_summary(rows, "v", ["g"]).collect()}
    got = aggregate.recounted_summary(rows, "v", ["g"], (0.0, 1.0)).collect()
    assert sorted(want) == sorted(r["g"] for r in got) and len(got) == 5
    for r in got:
        for c in want[r["g"]].asDict():
            assert abs(r[c] - want[r["g"]][c]) < 1e-9, (r["g"], c)
