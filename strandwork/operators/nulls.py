"""Random position sets that match a core, as keyed choices among candidate windows.

Every stretch of the core asks for a window of its length among the free
positions. Candidates carry the tolerance class of their covariate, and a keyed
hash ranks them per attempt, so a set is a chain of grouped minima and the same
in any engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Widening covariate tolerances, attempts per wanted set.
TOLERANCES = [0.03, 0.05, 0.08, 0.12, 0.20]
ATTEMPTS_PER_SET = 8


def core_segments(positions: DataFrame, item: str) -> DataFrame:
    """(item, start, size, centre): stretches of core positions and their median covariate."""
    nth = F.row_number().over(Window.partitionBy(item).orderBy("pos"))
    runs = positions.filter("core").withColumn("_run", F.col("pos") - nth)
    return runs.groupBy(item, "_run").agg(F.min("pos").alias("start"), F.count("*").alias("size"), F.median("radial").alias("centre")).drop("_run")


def free_windows(positions: DataFrame, segments: DataFrame, item: str) -> DataFrame:
    """(item, size, at, middle): windows of a wanted size whose positions are all there and free."""
    free = positions.filter("not core").select(item, "pos", "radial")
    asked = free.select(item, F.col("pos").alias("at")).join(segments.select(item, "size").distinct(), item)
    cells = asked.withColumn("pos", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)))
    whole = cells.join(free, [item, "pos"]).groupBy(item, "size", "at").agg(F.count("*").alias("_n"), F.median("radial").alias("middle"))
    return whole.filter("_n = size").drop("_n")


def tolerance_class(error: Column) -> Column:
    """0 for the tightest tolerance that holds, up to their number for none."""
    held = reduce(lambda out, i: out.when(error <= TOLERANCES[i], i), range(len(TOLERANCES)), F)
    return held.otherwise(len(TOLERANCES))


def open_offers(segments: DataFrame, windows: DataFrame, item: str) -> DataFrame:
    """(item, start, at, error, class, far): windows that a segment can take at all.

    The other segments of an item block at most (their size + own size - 1)
    windows each. Where more windows than these are of better classes, one of
    them stays free in every attempt, and no window of this class is chosen.
    Beyond all tolerances the same holds of nearer windows.
    """
    last = len(TOLERANCES)
    sums = segments.groupBy(item).agg(F.sum("size").alias("_all"), F.count("*").alias("_n"))
    block = (F.col("_all") - F.col("size") + (F.col("_n") - 1) * (F.col("size") - 1)).alias("_block")
    asked = cut_lineage(segments.join(sums, item).select(item, "start", "size", "centre", block))
    error = F.abs(F.col("middle") - F.col("centre"))
    every = asked.join(windows, [item, "size"]).select(item, "start", "at", error.alias("error"), tolerance_class(error).alias("class"), "_block")
    counts = every.groupBy(item, "start", "_block", "class").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(item, "start").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counts.withColumn("_before", before).filter("_before <= _block").select(item, "start", "class")  # at most six rows a segment
    kept = every.join(held, [item, "start", "class"])
    near = kept.filter(F.col("class") < last).select(item, "start", "at", "error", "class", F.lit(0.0).alias("far"))
    most = asked.agg(F.coalesce(F.max("_block"), F.lit(0))).first()[0]
    nearest = F.rank().over(Window.partitionBy(item, "start").orderBy("error"))
    far = kept.filter(F.col("class") == last).withColumn("_r", nearest).filter(F.col("_r") <= int(most) + 1)
    return near.unionAll(far.select(item, "start", "at", "error", "class", F.col("error").alias("far")))


def _key(item: str, seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (item, *parts)], F.lit(str(seed))))


def _attempts(segments: DataFrame, windows: DataFrame, item: str, first: int, last: int, seed: int, most: int) -> DataFrame:
    """(item, attempt, used): attempts first..last-1 in which every segment found a place."""
    tries = segments.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    # Long segments choose first; the key orders equal lengths anew in each attempt.
    turn = F.row_number().over(Window.partitionBy(item, "attempt").orderBy(F.desc("size"), _key(item, seed, "attempt", "start")))
    plan = cut_lineage(tries.withColumn("turn", turn))
    state = plan.select(item, "attempt").distinct().withColumn("used", F.expr("array()").cast("array<struct<at:bigint,size:bigint,error:double>>"))
    for k in range(1, most + 1):
        now = plan.filter(F.col("turn") == k)
        offers = now.join(windows, [item, "start"]).join(state, [item, "attempt"])
        offers = offers.filter(~F.exists("used", lambda u: (F.col("at") < u["at"] + u["size"]) & (F.col("at") + F.col("size") > u["at"])))
        # Beyond all tolerances only the nearest counts.
        rank = F.struct("class", "far", _key(item, seed, "attempt", "start", "at").alias("key"))
        place = F.struct(F.col("at").cast("long").alias("at"), F.col("size").cast("long").alias("size"), "error")
        chosen = offers.groupBy(item, "attempt").agg(F.min_by(place, rank).alias("place"))
        asked = now.select(item, "attempt", F.lit(True).alias("asked"))
        after = state.join(asked, [item, "attempt"], "left").join(chosen, [item, "attempt"], "left").filter("asked is null or place is not null")
        state = after.select(item, "attempt", F.when(F.col("place").isNull(), F.col("used")).otherwise(F.concat("used", F.array("place"))).alias("used"))
        state = cut_lineage(state)
    return state


def matched_null_sets(positions: DataFrame, item: str, n: int, seed: int = 42) -> DataFrame:
    """(item, iter, position, error): n random sets per structure.

    ``positions`` is (item, pos, radial, core). A set has segments of the core's
    lengths outside the core that do not overlap. Each takes the tightest
    tolerance of the median covariate that any open window meets, else the
    nearest window; the hash of (item, attempt, segment, window, seed) decides
    among equals. The first n attempts that place all segments are the sets, of at
    most 8n; fewer than max(n/2, 50) sets for a structure is an error.
    """
    segments = cut_lineage(core_segments(positions, item))
    windows = cut_lineage(open_offers(segments, free_windows(positions, segments, item), item))
    most = segments.groupBy(item).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    every = segments.select(item).distinct()
    open_, found = segments, []
    for turn in range(ATTEMPTS_PER_SET):
        found.append(_attempts(open_, windows, item, turn * n, (turn + 1) * n, seed, most))
        made = reduce(DataFrame.unionAll, found).groupBy(item).agg(F.count("*").alias("_made"))
        short = every.join(made, item, "left").filter(F.coalesce("_made", F.lit(0)) < n).select(item)
        if short.isEmpty():
            break
        open_ = segments.join(short, item, "left_semi")
    sets = reduce(DataFrame.unionAll, found)
    sets = sets.withColumn("iter", (F.row_number().over(Window.partitionBy(item).orderBy("attempt")) - 1).cast("long")).filter(F.col("iter") < n)
    counts = every.join(made, item, "left").withColumn("_made", F.coalesce("_made", F.lit(0)))
    guard = F.assert_true(F.col("_made") >= min(n, max(n // 2, 50)), F.lit("too few matched sets"))
    sets = counts.filter(guard.isNull()).join(sets, item).withColumn("error", F.aggregate("used", F.lit(0.0), lambda a, u: a + u["error"]) / F.size("used"))
    cells = sets.withColumn("u", F.explode("used"))
    return cells.select(item, "iter", F.explode(F.sequence(F.col("u.at"), F.col("u.at") + F.col("u.size") - 1)).alias("position"), "error")
