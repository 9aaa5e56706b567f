"""Range joins, grid joins and the vector index against brute force, plain and with full bins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.operators import joins, neighbours
from strandwork.plans import label_transfer


@pytest.mark.parametrize("bin_points", [1_000_000, 20])
def test_intervals_of_all_lengths(spark, monkeypatch, bin_points):
    """One interval over everything, one bin with a third of all points, and empty ones."""
    monkeypatch.setattr(joins, "BIN_POINTS", bin_points)
    rng = random.Random(4)
    points = [(i, g, rng.randint(-500, 500) if i % 3 else 77) for i in range(300) for g in "ab"]
    spans = [(0, "a", -1000, 1000), (1, "b", -1000, 1000), (2, "a", 77, 78), (3, "a", 5, 5), (4, "b", 9, 3)]
    spans += [(10 + i, rng.choice("ab"), a := rng.randint(-600, 600), a + rng.choice([1, 7, 64, 65, 300])) for i in range(80)]
    p, s = spark.createDataFrame(points, "id long, g string, at long"), spark.createDataFrame(spans, "iv long, g string, s long, e long")
    got = sorted((r.id, r.iv) for r in joins.interval_join(p, "at", s, "s", "e", 16, ["g"]).collect())
    assert got == sorted((i, v) for i, g, x in points for v, h, a, b in spans if g == h and a <= x < b)
    assert joins.interval_join(p, "at", s.limit(0), "s", "e", 16, ["g"]).count() == 0
    assert joins.interval_join(p.limit(0), "at", s, "s", "e", 16, ["g"]).count() == 0


def test_long_intervals_are_copied_twice_at_most(spark):
    s = spark.createDataFrame([(1, 5, 5 + 10**9), (2, 0, 2)], "iv long, s long, e long")
    p = spark.range(10).withColumnRenamed("id", "at")
    plan = joins.interval_join(p, "at", s, "s", "e", 16)
    assert plan.count() == 7 and set(plan.columns) == {"at", "iv", "s", "e"}


@pytest.mark.parametrize("rows", [2_000, 5])
def test_dense_cells(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "CELL_ROWS", rows)
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(0, 0.3, (60, 3)), rng.uniform(-6, 6, (60, 3))])
    pts = [(i, int(i % 2), int(i), *map(float, v)) for i, v in enumerate(xyz)]
    df = spark.createDataFrame(pts, "id long, chain int, label_seq int, x double, y double, z double")
    far = lambda a, b: math.dist(a[3:], b[3:])
    got = sorted((r.id1, r.id2) for r in joins.contact_pairs(df, 1.0).collect())
    assert got == sorted((a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and far(a, b) <= 1.0 and not (a[1] == b[1] and abs(a[2] - b[2]) <= 2))
    near = {r.id: r.dist for r in joins.nearest_within(df, df.filter("chain = 0"), 1.0).collect()}
    want = {a[0]: min(d) for a in pts if (d := [x for b in pts if b[1] == 0 and (x := far(a, b)) <= 1.0])}
    assert near == pytest.approx(want)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_search_is_exact(spark, tmp_path, metric):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 3, (6, 8))
    vec = lambda n: [(i, (centres[i % 6] + rng.normal(0, 0.4, 8)).tolist()) for i in range(n)]
    refs, queries = spark.createDataFrame(vec(300), "ref_id long, vec array<double>"), spark.createDataFrame(vec(40), "query_id long, vec array<double>")
    path = str(tmp_path / "index")
    neighbours.build_index(refs, path, 12, metric)
    rows, cells = neighbours.read_index_rows(spark, path, refs), spark.read.parquet(f"{path}/cells")
    assert rows.count() == 300 and cells.agg(F.sum("members")).first()[0] == 300
    for k, nprobe in ((5, 1), (60, 2), (400, 1)):
        got = sorted(map(tuple, neighbours.search_index(queries, rows, cells, k, nprobe, metric).collect()))
        want = sorted(map(tuple, neighbours.exact_cosine_topk(queries, refs, k, metric).collect()))
        assert [g[:-1] for g in got] == [w[:-1] for w in want] and np.allclose([g[-1] for g in got], [w[-1] for w in want])
    if metric == "cosine":
        found = neighbours.search_cells(queries, rows, np.array([c.centre for c in cells.orderBy("cell").collect()]), 5, 3)
        assert neighbours.recall_at_k(found, neighbours.exact_cosine_topk(queries, refs, 5)).first()[0] >= 0.9
        labels = refs.select("ref_id", (F.col("ref_id") % 6).cast("int").alias("label"))
        one, two = (sorted(map(tuple, label_transfer.transfer_labels(queries, refs, labels, 5, index=i).collect())) for i in (None, path))
        assert [x[:2] for x in one] == [x[:2] for x in two]
