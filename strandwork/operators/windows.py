"""Offsets, runs, chunks, rank rules and p-value adjustments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_list
from ..functions.stats import significance_stars
from ..session import cut_lineage
from .ordering import compute_partitions, ordered_scan, rank_rows, top_k


def cumulative_offsets(df: DataFrame, length: str, order: str, shard: Column | None = None) -> DataFrame:
    """tok_start, tok_end from running lengths; also after subsetting."""
    scanned = ordered_scan(df, [order], {"tok_end": F.col(length).cast("long")}, (), shard)
    return scanned.withColumn("tok_start", F.col("tok_end") - F.col(length))


def contiguous_runs(df: DataFrame, pos: str, group=(), shard: Column | None = None) -> DataFrame:
    """Distinct integer positions to [start, end] runs."""
    group = as_list(group)
    ranked = rank_rows(df.select(*group, pos).distinct(), [pos], group, "_rn", shard)
    return ranked.groupBy(*group, (F.col(pos) - F.col("_rn")).alias("_g")).agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("_g")


def column_group_ranges(df: DataFrame, value: str, order: str, shard: Column | None = None) -> DataFrame:
    """(value, start, end) of equal adjacent values, counted in row places."""
    a = rank_rows(df.select(value, order), [order], (), "_rn", shard)
    b = rank_rows(a, [order], [value], "_vn", shard)
    runs = b.groupBy(value, (F.col("_rn") - F.col("_vn")).alias("_g")).agg((F.min("_rn") - 1).alias("start"), (F.max("_rn") - 1).alias("end"))
    return runs.drop("_g")


# ---- greedy chunks ---------------------------------------------------------


def _next_starts(idx: np.ndarray, length: np.ndarray, max_n: int, max_aa: int) -> np.ndarray:
    """Place of the next chunk start for a chunk that starts at each row."""
    cum = np.concatenate([[0], np.cumsum(length)])
    by_aa = np.searchsorted(cum, cum[:-1] + max_aa, side="right") - 1
    n = np.arange(len(idx))
    return np.maximum(np.minimum(by_aa, n + max_n), n + 1)


def bounded_chunks(df: DataFrame, order: str, length: str, max_n: int, max_aa: int, block_rows: int = 100_000) -> DataFrame:
    """Greedy sequential chunks, exact and in parallel.

    A chunk holds at most ``max_n`` rows and ``max_aa`` residues; one oversize
    record is a chunk of its own. Rows are numbered and cut into blocks. Since
    a chunk has at most ``max_n`` rows, a block can be entered only at one of
    its first ``max_n`` rows; each block maps these entries to where the chain
    of chunk starts leaves it. Composing the maps by pointer doubling over the
    (block, entry) table finds the true entry of every block, after which all
    blocks mark their starts independently.
    """
    if max_n < 1 or max_aa < 1:
        raise ValueError("max_n and max_aa must be >= 1")
    block_rows = max(block_rows, max_n)
    numbered = cut_lineage(rank_rows(cut_lineage(df), [order], (), "_rn").withColumn("_rn", F.col("_rn") - 1))
    thin = numbered.select("_rn", F.col(length).cast("long").alias("_len"))
    blk = F.floor(F.col("_rn") / block_rows)
    ahead = F.when((F.col("_rn") % block_rows < max_n) & (F.col("_rn") >= block_rows), F.array(blk, blk - 1)).otherwise(F.array(blk))
    haloed = thin.withColumn("_blk", F.explode(ahead))

    def walk(pdf: pd.DataFrame):
        pdf = pdf.sort_values("_rn")
        idx, length_ = pdf["_rn"].to_numpy(), pdf["_len"].to_numpy()
        block = int(pdf["_blk"].iloc[0])
        own = int((idx // block_rows == block).sum())
        return block, idx, own, _next_starts(idx, length_, max_n, max_aa)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        block, idx, own, nxt = walk(pdf)
        out = np.arange(len(idx) + 1)
        for i in range(own - 1, -1, -1):
            out[i] = out[nxt[i]]
        entries = np.arange(min(own, max_n))
        return pd.DataFrame({"entry": idx[0] + entries, "jump": idx[0] + out[entries]})

    jumps = cut_lineage(compute_partitions(haloed, "_blk").groupBy("_blk").applyInPandas(exits, "entry long, jump long"))
    reached = jumps.filter("entry = 0").select(F.col("entry").alias("at"))
    n_rows = numbered.count()
    n_blocks = max(1, -(-n_rows // block_rows))
    steps, span = jumps, 1
    while span < n_blocks:
        onward = reached.join(steps, reached["at"] == steps["entry"]).select(F.col("jump").alias("at"))
        reached = cut_lineage(reached.union(onward).distinct())
        nxt = steps.select(F.col("entry").alias("_e2"), F.col("jump").alias("_j2"))
        steps = cut_lineage(steps.join(nxt, steps["jump"] == nxt["_e2"]).select("entry", F.col("_j2").alias("jump")))
        span *= 2

    entries = reached.filter(F.col("at") < n_rows).select(  # the last jump leaves the table
        F.floor(F.col("at") / block_rows).alias("_blk"), "at"
    )

    def mark(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or entry.empty:
            return pd.DataFrame({"_rn": [], "_start": []}).astype("int64")
        block, idx, own, nxt = walk(rows)
        starts, i = [], int(entry["at"].iloc[0]) - int(idx[0])
        while i < own:
            starts.append(idx[i])
            i = int(nxt[i])
        return pd.DataFrame({"_rn": starts, "_start": 1}).astype("int64")

    starts = compute_partitions(haloed, "_blk").groupBy("_blk").cogroup(compute_partitions(entries, "_blk").groupBy("_blk")).applyInPandas(mark, "_rn long, _start long")
    chunked = numbered.join(starts, "_rn", "left").fillna(0, "_start")
    shard = F.floor(F.col("_rn") / block_rows)
    chunked = ordered_scan(
        chunked, ["_rn"], {"_chunk": F.col("_start"), "_from": ("max", F.when(F.col("_start") == 1, F.col("_rn")))}, (), shard
    )
    return chunked.withColumns(
        {
            "chunk_id": F.format_string("chunk_%05d", "_chunk"),
            "sequence_index_in_chunk": F.col("_rn") - F.col("_from") + 1,
        }
    ).drop("_rn", "_start", "_chunk", "_from")


# ---- rank rules ------------------------------------------------------------


def best_candidate(jobs: DataFrame, candidates: DataFrame, tie: str) -> DataFrame:
    """Per job the best candidate folder.

    A folder matches a job by its exact name or by the name plus ``_digits``,
    case-blind: both readings of the folder name become keys of an equi-join.
    Greatest (score, exact match, -model, folder name) wins.
    """
    name = F.lower("dir_name")
    keyed = candidates.withColumn("_key", F.explode(F.array_distinct(F.array(name, F.regexp_replace(name, r"_\d+$", "")))))
    met = jobs.withColumn("_key", F.lower("job_name")).join(keyed, "_key")
    order = F.struct(
        F.coalesce("score", F.lit(float("-inf"))).alias("s"),
        (F.lower("dir_name") == F.col("_key")).cast("int").alias("e"),
        (-F.col("model_index")).alias("m"),
        F.lower("dir_name").alias("d"),
        F.col(tie).alias("t"),
    )
    kept = [c for c in candidates.columns]
    best = met.groupBy("job_name").agg(F.max_by(F.struct(*kept), order).alias("_b"), F.count_distinct("dir_name").alias("candidate_dir_count"))
    return best.select("job_name", "candidate_dir_count", *[F.col(f"_b.{c}").alias(c) for c in kept])


def percentile_rank(df: DataFrame, value: str, group=(), out: str = "percentile") -> DataFrame:
    """Share of values <= x inside the group: counts per value, then a scan."""
    group = as_list(group)
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    scanned = ordered_scan(counts, [value], {"_le": F.col("_c")}, group)
    total = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    both = scanned.join(total, group) if group else scanned.withColumn("_n", total.scalar())
    share = both.select(*group, value, (F.col("_le") / F.col("_n")).alias(out))
    return df.join(share, [*group, value])


def even_split(df: DataFrame, order: str, n: int, out: str = "part", shard: Column | None = None) -> DataFrame:
    """n contiguous parts (0-based), the first parts one longer."""
    ranked = rank_rows(df, [order], (), "_rn", shard).withColumn("_n", df.agg(F.count("*")).scalar())
    size, rest, i = F.floor(F.col("_n") / n), F.col("_n") % n, F.col("_rn") - 1
    cut = rest * (size + 1)
    part = F.when(i < cut, F.floor(i / (size + 1))).otherwise(rest + F.floor((i - cut) / F.greatest(size, F.lit(1))))
    return ranked.withColumn(out, part.cast("int")).drop("_rn", "_n")


def holm_adjust(df: DataFrame, p: str, ident: str) -> DataFrame:
    """Step-down adjusted p and stars: running max of min(1, p * (m - rank))."""
    ranked = rank_rows(df, [p, ident], (), "_r").withColumn("_m", df.agg(F.count("*")).scalar())
    raw = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_r") + 1))
    out = ordered_scan(ranked, ["_r"], {"p_adjusted": ("max", raw)}, (), F.floor(F.col("_r") / 1_000_000))
    return out.withColumn("stars", significance_stars("p_adjusted")).drop("_r", "_m")


def bh_adjust(df: DataFrame, p: str, ident: str) -> DataFrame:
    """q = running min from the largest of p * m / rank."""
    ranked = rank_rows(df, [p, ident], (), "_r").withColumn("_m", df.agg(F.count("*")).scalar())
    raw = F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_r"))
    out = ordered_scan(ranked, [F.desc("_r")], {"q_value": ("min", raw)}, (), -F.floor(F.col("_r") / 1_000_000))
    return out.drop("_r", "_m")


def stage_layer_choice(rows: DataFrame, early_metric: str, late_metric: str, early_fraction: float = 0.5, late_fraction: float = 0.5) -> DataFrame:
    """Early and late layer from a layer table (one row per layer)."""
    w = Window.orderBy("layer")  # a model has tens of layers
    t = rows.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy())})
    n_early = F.greatest(F.lit(1), F.ceil(F.col("_n") * early_fraction))
    n_late = F.greatest(F.lit(1), F.ceil(F.col("_n") * late_fraction))
    early = t.filter(F.col("_i") <= n_early).agg(
        F.max_by("layer", F.struct(F.coalesce(early_metric, F.lit(0.0)), -F.col("layer"))).alias("layer"),
        F.max(F.coalesce(early_metric, F.lit(0.0))).alias("metric_value"),
    )
    pool = t.filter(F.col("_i") > F.col("_n") - n_late).withColumns({"_e": early.select("layer").scalar(), "_np": n_late})
    pool = pool.filter((F.col("layer") != F.col("_e")) | (F.col("_np") == 1))
    late = pool.agg(
        F.max_by("layer", F.struct(F.coalesce(late_metric, F.lit(0.0)), F.col("layer"))).alias("layer"),
        F.max(F.coalesce(late_metric, F.lit(0.0))).alias("metric_value"),
    )
    return early.withColumn("stage", F.lit("early")).unionByName(late.withColumn("stage", F.lit("late")))


def first_seen_order(df: DataFrame, group_rank: str, pos: str, column: str, owner: str) -> DataFrame:
    """Columns by first appearance over groups, with the group that owns them."""
    g = df.groupBy(column).agg(
        F.min(F.struct(group_rank, pos)).alias("_first"), F.min_by(owner, F.struct(group_rank, pos)).alias("owner")
    )
    w = Window.orderBy("_first", column)  # one row per displayed column
    return g.withColumn("position", F.row_number().over(w)).drop("_first")


def top_k_per_group(df: DataFrame, group, order, k: int) -> DataFrame:
    return top_k(df, order, k, group)
