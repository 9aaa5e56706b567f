"""Blocks of a vector search: bounded memory, ties by id."""

import tracemalloc

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from strandwork.operators import neighbours
from strandwork.operators.neighbours import _block_kernel


def side(x, name):
    return pd.DataFrame({name: np.arange(len(x)), "vec": list(x)})


def test_a_large_block_pair_is_taken_in_slices():
    x = np.random.default_rng(1).normal(size=(6000, 8))
    tracemalloc.start()
    got = _block_kernel(3, "dot")(side(x[:4000], "query_id"), side(x, "ref_id"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    want = np.sort(np.argsort(-np.round(x[:4000] @ x.T, 9), axis=1, kind="stable")[:, :3], axis=1)
    assert (np.sort(got["ref_id"].to_numpy().reshape(4000, 3), axis=1) == want).all()


def test_ties_at_the_last_rank_go_to_the_least_ids():
    x = np.random.default_rng(2).integers(-1, 2, size=(300, 4)).astype("float64")
    for metric, s in (("dot", x @ x.T), ("l2", -((x[:, None] - x[None]) ** 2).sum(2))):
        for k in (1, 7, 400):
            got = _block_kernel(k, metric)(side(x, "query_id"), side(x, "ref_id"))
            for i, part in got.groupby("query_id"):
                assert sorted(part["ref_id"]) == sorted(np.argsort(-np.round(s[i], 9), kind="stable")[:k])


def test_columns_in_runs_give_the_same_best(monkeypatch):
    """Later runs hold better rows than the first, so bounds rise; ties lie in several runs."""
    monkeypatch.setattr(neighbours, "KERNEL_CELLS", 2000)
    monkeypatch.setattr(neighbours, "FIRST_COLUMNS", 8)
    x = np.sort(np.random.default_rng(3).integers(0, 40, size=(500, 1)), axis=0).astype("float64")
    q = np.ones((30, 1))
    for k in (1, 5, 499, 600):
        got = _block_kernel(k, "dot")(side(q, "query_id"), side(x, "ref_id"))
        want = sorted(np.argsort(-x[:, 0], kind="stable")[:k])
        for _, part in got.groupby("query_id"):
            assert sorted(part["ref_id"]) == want


def test_a_row_is_sent_to_a_fixed_number_of_blocks(spark):
    """Six times the rows make no more blocks: what is moved grows with the rows."""
    one = spark.range(600_000).select(F.array(*[F.lit(0.0)] * 64).alias("vec"))
    assert one.agg(neighbours._blocks(None)).first()[0] == neighbours.SIDE_BLOCKS
    assert one.limit(100_000).agg(neighbours._blocks(None)).first()[0] == neighbours.SIDE_BLOCKS
    wide = spark.range(50_000).select(F.array_repeat(F.lit(0.0), 4096).alias("vec"))
    assert wide.agg(neighbours._blocks(None)).first()[0] == 25  # a block holds 64 MB
