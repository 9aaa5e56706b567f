"""Seeded samples and splits with exact counts.

Order inside a class is md5(id|seed). The first digits of the key are a shard,
so an exact rank inside a class never puts the class into one task.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_list, hash_key, hash_shard, hash_uniform
from .ordering import ordered_scan, rank_rows

KEY = "_key"


def hashed_rank(df: DataFrame, ident: str, seed, group=(), digits: int = 2) -> DataFrame:
    """Add ``_rn`` (rank by hash inside the group) and ``_n`` (group size)."""
    group = as_list(group)
    keyed = df.withColumn(KEY, hash_key(ident, seed))
    ranked = rank_rows(keyed, [KEY, ident], group, "_rn", hash_shard(F.col(KEY), digits))
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    ranked = ranked.join(sizes, group) if group else ranked.withColumn("_n", sizes.scalar())
    return ranked.drop(KEY)


def _done(df: DataFrame) -> DataFrame:
    return df.drop("_rn", "_n")


def stratified_fraction(df: DataFrame, ident: str, label: str, frac: float, seed=42) -> DataFrame:
    """ceil(n * frac), at least 1, per label."""
    r = hashed_rank(df, ident, seed, label)
    return _done(r.filter(F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * frac))))


def stratified_kfold(df: DataFrame, ident: str, label: str, k: int, seed=42) -> DataFrame:
    """Shuffled per class and dealt round-robin; a class under k rows fails."""
    r = hashed_rank(df, ident, seed, label)
    guard = F.assert_true(F.col("_n") >= k, F.lit(f"a class has fewer rows than {k} folds"))
    return _done(r.filter(guard.isNull()).withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")))


def train_test_split(df: DataFrame, ident: str, label, frac: float, seed=42) -> DataFrame:
    """Per label round-half-even(n * frac), at least 1, to test."""
    r = hashed_rank(df, ident, seed, label)
    n_test = F.greatest(F.lit(1), F.bround(F.col("_n") * frac).cast("long"))
    return _done(r.withColumn("split", F.when(F.col("_rn") <= n_test, "test").otherwise("train")))


def three_way_split(df: DataFrame, ident: str, test: float, valid: float, seed=42) -> DataFrame:
    """Test part of all rows, then validation part of the rest."""
    r = hashed_rank(df, ident, seed)
    n_test = F.ceil(F.round(F.col("_n") * test, 9))
    n_valid = F.ceil(F.round((F.col("_n") - n_test) * valid, 9))
    return _done(
        r.withColumn("split", F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_valid, "valid").otherwise("train"))
    )


def calibration_split(df: DataFrame, ident: str, label: str, frac: float = 0.2, seed=42, group=()) -> DataFrame:
    """Per class round(n * frac), between 1 and n - 1, to calibration; singletons train."""
    r = hashed_rank(df, ident, seed, [*as_list(group), label])
    n = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.bround(F.col("_n") * frac).cast("long")))
    return _done(r.withColumn("role", F.when((F.col("_n") > 1) & (F.col("_rn") <= n), "calibration").otherwise("train")))


def grouped_folds(df: DataFrame, cluster: str, k: int) -> DataFrame:
    """Whole clusters to folds: biggest first, to the least-loaded fold, ties to
    the lower fold (1-based folds).

    The greedy walk needs only how many clusters have each size. Distinct sizes
    number at most sqrt(2 * rows), so that table is small whatever the input;
    the walk keeps the fold loads before each size. Inside one size the j-th
    cluster (by id) goes to the j-th smallest (load + m * size, fold), which each
    row finds for itself.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    sizes = df.groupBy(cluster).agg(F.count("*").alias("_size"))
    if sizes.limit(k).count() < k:
        raise ValueError("not enough clusters for requested folds")
    ranked = rank_rows(sizes, [cluster], ["_size"], "_j")
    by_size = sizes.groupBy("_size").agg(F.count("*").alias("_c")).withColumn("_one", F.lit(0))

    def nth_place(loads, s, j):
        """Fold of the (0-based) j-th cluster of size s and the loads after j clusters."""
        lo, hi = min(loads), max(loads) + s * (j // k + 1)
        while lo < hi:  # the greatest level below which at most j clusters fall
            mid = (lo + hi + 1) // 2
            if sum(max(0, -(-(mid - x) // s)) for x in loads) <= j:
                lo = mid
            else:
                hi = mid - 1
        taken = [max(0, -(-(lo - x) // s)) for x in loads]
        left = j - sum(taken)
        at_level = [f for f in range(k) if loads[f] + taken[f] * s == lo]
        return at_level, left, taken

    def after(loads, s, c):
        at_level, left, taken = nth_place(loads, s, c)
        for f in at_level[:left]:
            taken[f] += 1
        return [x + t * s for x, t in zip(loads, taken)]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        loads, out = [0] * k, []
        for s, c in pdf.sort_values("_size", ascending=False)[["_size", "_c"]].itertuples(index=False):
            out.append((int(s), list(loads)))
            loads = after(loads, int(s), int(c))
        return pd.DataFrame(out, columns=["_size", "_loads"])

    loads = by_size.groupBy("_one").applyInPandas(walk, "_size long, _loads array<long>")

    @F.pandas_udf("int")
    def place(loads: pd.Series, size: pd.Series, j: pd.Series) -> pd.Series:
        out = []
        for ld, s, r in zip(loads, size, j):
            at_level, left, _ = nth_place([int(x) for x in ld], int(s), int(r) - 1)
            out.append(at_level[left] + 1)
        return pd.Series(out)

    folds = ranked.join(loads, "_size").select(cluster, F.col("_size").alias("cluster_size"), place("_loads", "_size", "_j").alias("fold"))
    return df.join(folds, cluster)


TAXON_LIMIT = 10_000


def leave_one_taxon_out(df: DataFrame, ident: str, taxon: str) -> DataFrame:
    """One split per taxon: its rows test, all others train. The result is rows
    x taxa by definition; the taxon list is size-checked and carried per row."""
    taxa = df.select(taxon).distinct()
    if taxa.limit(TAXON_LIMIT + 1).count() > TAXON_LIMIT:
        raise ValueError("too many taxa for one split each")
    listed = taxa.agg(F.array_sort(F.collect_list(taxon))).scalar()
    rows = df.select(ident, taxon).withColumn("held_out", F.explode(listed))
    return rows.select("held_out", ident, F.when(F.col(taxon) == F.col("held_out"), "test").otherwise("train").alias("role"))


def quota_subset(df: DataFrame, ident: str, is_rare: Column, total: int, rate: float, seed=42) -> DataFrame:
    """``rate`` of one class and the rest filled to ``total``; short rests are
    made up from the class."""
    r = hashed_rank(df.withColumn("_rare", is_rare.cast("int")), ident, seed, "_rare")
    n_rare = F.coalesce(df.filter(is_rare).agg(F.count("*")).scalar(), F.lit(0))
    n_other = df.filter(~is_rare).agg(F.count("*")).scalar()
    r = r.withColumns({"_nr": n_rare, "_no": n_other})
    want_rare = F.greatest(F.lit(1), F.least(F.bround(F.col("_nr") * rate).cast("long"), F.col("_nr")))
    want_other = F.least(F.lit(total) - want_rare, F.col("_no"))
    final_rare = F.when(F.lit(total) - want_rare > F.col("_no"), F.least(F.col("_nr"), F.lit(total) - F.col("_no"))).otherwise(want_rare)
    kept = r.filter(F.when(F.col("_rare") == 1, F.col("_rn") <= final_rare).otherwise(F.col("_rn") <= want_other))
    return _done(kept).drop("_rare", "_nr", "_no")


def balanced_weighted_sample(df: DataFrame, ident: str, length: str, is_target: Column, target_ratio: float, n: int, seed: int = 42, epoch: int = 0, shard: Column | None = None) -> DataFrame:
    """(draw, id, offset): n sequences with replacement, then a uniform token.

    Target and other sequences share the weight ratio : 1; empty sequences have
    none. Weights are equal inside a group, so a draw picks the group by its
    share and then a place in the group's id order: an equi-join on the place.
    """
    valid = df.filter(F.col(length) > 0).withColumn("_t", is_target.cast("int"))
    ranked = rank_rows(valid, [ident], ["_t"], "_rn", shard)
    sizes = valid.agg(F.struct(F.sum("_t").alias("a"), F.sum(1 - F.col("_t")).alias("b")).alias("s")).scalar()
    key = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed + epoch * 1000))))

    def uniform(tag):
        return hash_uniform(F.md5(F.concat(key, F.lit(tag))))

    draws = df.sparkSession.range(n).withColumn("_s", sizes)
    share = F.when(F.col("_s.a") == 0, 0.0).when(F.col("_s.b") == 0, 1.0).otherwise(target_ratio / (target_ratio + 1.0))
    draws = draws.withColumn("_t", (uniform("g") < share).cast("int"))
    size = F.when(F.col("_t") == 1, F.col("_s.a")).otherwise(F.col("_s.b"))
    draws = draws.select(F.col("id").alias("draw"), "_t", (F.floor(uniform("s") * size) + 1).alias("_rn"), uniform("o").alias("_u"))
    met = draws.join(ranked.select("_t", "_rn", ident, length), ["_t", "_rn"])
    return met.select("draw", ident, F.floor(F.col("_u") * F.col(length)).alias("offset"))


def block_quotas(n_rows: int, total: int, block: int) -> list[tuple[int, int]]:
    """(block, quota): proportional to the remaining rows, remainder to the last."""
    out, left, start, i = [], total, 0, 0
    while start < n_rows and left > 0:
        size = min(block, n_rows - start)
        quota = left if start + size == n_rows else min(int(round(left * size / (n_rows - start))), size)
        out.append((i, quota))
        left, start, i = left - quota, start + size, i + 1
    return out


def block_sample(df: DataFrame, index: str, total: int, block: int, seed=42) -> DataFrame:
    """Exactly ``total`` rows shared over fixed-size blocks of a dense 0-based index."""
    n_rows = df.count()
    if total > n_rows:
        raise ValueError("sample larger than the table")
    quotas = df.sparkSession.createDataFrame(block_quotas(n_rows, total, block), "_blk long, _quota long")
    r = hashed_rank(df.withColumn("_blk", F.floor(F.col(index) / block)), index, seed, "_blk")
    return _done(r.join(quotas, "_blk").filter("_rn <= _quota")).drop("_blk", "_quota")


def hard_negative_mining(df: DataFrame, ident: str, y: str, score: str, t: float, min_hard: int) -> DataFrame:
    """All positives, negatives scoring >= t, topped up with the best-scoring
    negatives to max(min_hard, positives)."""
    return _mined(df, ident, y, score, t, lambda n_pos: F.greatest(F.lit(min_hard), n_pos), None)


def ultra_low_fpr_mining(df: DataFrame, ident: str, y: str, score: str, t: float, min_hard: int, multiplier: float, by_score: bool = False) -> DataFrame:
    """As above with round(positives * multiplier); a surplus of hard negatives
    is cut in index order (``by_score`` cuts the lowest scores instead)."""
    return _mined(
        df, ident, y, score, t, lambda n_pos: F.greatest(F.lit(min_hard), F.bround(n_pos * multiplier).cast("long")), "score" if by_score else "index"
    )


def _mined(df, ident, y, score, t, want, cut):
    neg = df.filter(F.col(y) == 0)
    n_pos = df.filter(F.col(y) == 1).agg(F.count("*")).scalar()
    n_neg, n_hard = neg.agg(F.count("*")).scalar(), neg.filter(F.col(score) >= t).agg(F.count("*")).scalar()
    by_score = rank_rows(neg, [F.desc(score), ident], (), "_rs")
    if cut == "index":
        hard = F.col(score) >= t
        by_score = ordered_scan(by_score, [ident], {"_ri": hard.cast("long")})
    limits = by_score.withColumns({"_np": n_pos, "_nn": n_neg, "_nh": n_hard})
    target = F.least(F.col("_nn"), want(F.col("_np")))
    hard = F.col(score) >= t
    short = F.col("_nh") < target
    if cut is None:
        keep = hard | (short & (F.col("_rs") <= target))
    elif cut == "index":
        keep = F.when(short, hard | (F.col("_rs") <= target)).otherwise(hard & (F.col("_ri") <= target))
    else:
        keep = F.when(short, hard | (F.col("_rs") <= target)).otherwise(hard & (F.col("_rs") <= target))
    kept = limits.filter(keep).select(*df.columns)
    return df.filter(F.col(y) == 1).unionByName(kept)


def uniform_subset(df: DataFrame, ident: str, frac: float | None = None, target: int | None = None, seed=42) -> DataFrame:
    """ceil(n * frac) or min(n, target) rows without replacement; target first."""
    r = hashed_rank(df, ident, seed)
    n = F.least(F.col("_n"), F.lit(target)) if target else F.greatest(F.lit(1), F.ceil(F.col("_n") * frac))
    return _done(r.filter(F.col("_rn") <= n))


def capped_class_sample(df: DataFrame, ident: str, label: str, caps: DataFrame, seed=42) -> DataFrame:
    """At most cap rows per class; a null or missing cap keeps all. ``caps`` is
    (label, cap)."""
    r = hashed_rank(df, ident, seed, label).join(caps, label, "left")
    return _done(r.filter(F.col("cap").isNull() | (F.col("_rn") <= F.col("cap")))).drop("cap")
