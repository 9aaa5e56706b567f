"""Exact ranks, prefix sums and look-ahead without a one-task window.

A window over the whole table, or over one very large group, runs in a single
task. The operators here cut every group into ordered shards, scan each shard
on its own and add the total of the earlier shards, so that a group holding a
third of the rows is spread over as many tasks as its shards.

A shard is any deterministic expression that never decreases along the order
(an id divided by a width, the first digits of a hash key, a calendar bucket).
Where no such expression is known the rows are range-partitioned on
(group, order) and the partition number of the materialised rows is the shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_col, as_list
from ..session import cut_lineage

SHARD = "_shard"


def compute_partitions(df: DataFrame, *keys) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of partitions.

    Adaptive execution merges partitions of few bytes; a numeric kernel may need
    much time for few bytes, so its input asks for a fixed number.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shard_rows(df: DataFrame, order, group=(), shard: Column | None = None) -> DataFrame:
    """Add ``_shard``; see the module text for the two ways."""
    if shard is not None:
        return df.withColumn(SHARD, shard)
    keys = [as_col(c) for c in as_list(group) + as_list(order)]
    ranged = df.repartitionByRange(*keys).withColumn(SHARD, F.spark_partition_id())
    return cut_lineage(ranged)


# How a running value is formed inside a shard and joined to earlier shards.
_KINDS = {
    "sum": (F.sum, lambda local, before: local + F.coalesce(before, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def ordered_scan(df: DataFrame, order, values: dict, group=(), shard: Column | None = None) -> DataFrame:
    """Inclusive running values along ``order`` inside ``group``.

    ``values`` maps a new column to an expression (running sum) or to a pair
    ("sum" | "max" | "min", expression).
    """
    specs = {n: v if isinstance(v, tuple) else ("sum", v) for n, v in values.items()}
    group = as_list(group)
    keys = group + [SHARD]
    sharded = shard_rows(df, order, group, shard)
    local = Window.partitionBy(*keys).orderBy(*as_list(order)).rowsBetween(Window.unboundedPreceding, 0)
    scanned = sharded.withColumns({n: _KINDS[k][0](v).over(local) for n, (k, v) in specs.items()})
    sizes = sharded.groupBy(*keys).agg(*[_KINDS[k][0](v).alias(f"_t_{n}") for n, (k, v) in specs.items()])
    before = Window.partitionBy(*group).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_k_{c}") for c in keys],
        *[_KINDS[k][0](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (k, v) in specs.items()],
    )
    if not group:
        offsets = F.broadcast(offsets)  # one row per shard of the whole table
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = scanned.join(offsets, cond, "left")
    return joined.select(
        *[c for c in df.columns if c not in specs],
        *[_KINDS[k][1](F.col(n), F.col(f"_o_{n}")).alias(n) for n, (k, v) in specs.items()],
    )


def rank_rows(df: DataFrame, order, group=(), name: str = "rn", shard: Column | None = None) -> DataFrame:
    """Exact 1-based row number; ``order`` must be total for a stable result."""
    return ordered_scan(df, order, {name: F.lit(1).cast("long")}, group, shard)


def running_total(df: DataFrame, value: Column | str, order, group=(), name: str = "total", shard: Column | None = None) -> DataFrame:
    return ordered_scan(df, order, {name: as_col(value)}, group, shard)


def lead_values(df: DataFrame, group, pos: str, columns: list[str], steps: int, width: int = 4096) -> DataFrame:
    """Values of the next ``steps`` positions as ``<col>_1 .. <col>_steps``.

    ``pos`` counts 0, 1, 2 ... inside a group. Groups are cut into stretches of
    ``width`` positions; the first ``steps`` rows of a stretch are also sent to
    the stretch before it, so one shuffle serves groups of any length.
    """
    group = as_list(group)
    own = F.floor(F.col(pos) / width)
    reach = F.when((F.col(pos) % width < steps) & (F.col(pos) >= width), F.array(own, own - 1)).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn(SHARD, F.explode(reach))
    w = Window.partitionBy(*group, SHARD).orderBy(pos)
    out = {f"{c}_{s}": F.lead(c, s).over(w) for c in columns for s in range(1, steps + 1)}
    return spread.withColumns(out).filter(F.col("_own") == F.col(SHARD)).drop("_own", SHARD)


def top_k(df: DataFrame, order, k: int, group=(), name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark limits every group before the shuffle."""
    w = Window.partitionBy(*as_list(group)).orderBy(*as_list(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


#: Value cells per group of ``value_cells``.
CELLS = 256


def _value_cell(value: str, bounds: tuple[float, float]) -> Column:
    v, (lo, hi) = F.col(value), bounds
    inner = F.least(F.floor((v - lo) * (CELLS / (hi - lo))).cast("int"), F.lit(CELLS - 1))
    return F.when(v >= hi, CELLS - 1).when(v < lo, 0).otherwise(inner)


def value_cells(df: DataFrame, value: str, group, bounds: tuple[float, float]) -> DataFrame:
    """(group, _cell, _c, _mean, _var, _min, _max): the values of a group by cells along
    ``bounds``. Values beyond them fall into the cells at the ends, so cells follow the
    order of the values whatever the bounds are."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(*as_list(group), _value_cell(value, bounds).alias("_cell"))
    return cut_lineage(rows.agg(
        F.count("*").alias("_c"), F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"), F.min(value).alias("_min"), F.max(value).alias("_max")
    ))


def _middle_counts(df: DataFrame, value: str, probs: dict[str, float], group: list[str], bounds, cells: DataFrame) -> DataFrame:
    """(group, value, _c, _hi): values of the cells that hold a wanted rank, with running counts over all."""
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_cell"))  # at most CELLS rows per group
    cum = cells.withColumns({"_upto": upto, "_n": F.sum("_c").over(Window.partitionBy(*group))})
    h = [F.lit(float(q)) * (F.col("_n") - 1) for q in probs.values()]
    holds = [(at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c")) for x in h for at in (F.floor(x), F.ceil(x))]
    hot = cut_lineage(cum.filter(reduce(lambda a, b: a | b, holds)).select(*group, "_cell", (F.col("_upto") - F.col("_c")).alias("_before")))
    rows = df(hot) if callable(df) else df.filter(F.col(value).isNotNull()).withColumn("_cell", _value_cell(value, bounds))
    near = rows.join(hot, [*group, "_cell"]).groupBy(*group, "_cell", "_before", value).agg(F.count("*").alias("_c"))
    return ordered_scan(near, [value], {"_hi": F.col("_c")}, [*group, "_cell"]).withColumn("_hi", F.col("_hi") + F.col("_before"))


def interpolated_quantiles(df: DataFrame, value: str, probs: dict[str, float], group=(), bounds: tuple[float, float] | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group.

    Equal values are counted first; the distinct values are then ranked in
    shards, and only the values that straddle a wanted rank are kept.

    With ``bounds`` and the ``value_cells`` made by them, only values of the cells that
    hold a wanted rank are counted: for rows that are computed again at less cost than
    they are shuffled, such as pairs. ``df`` may then be a function that returns the rows
    of such cells (group, _cell, ...) as (group, _cell, value).
    """
    group = as_list(group)
    if cells is None:
        counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
        scanned = ordered_scan(counts, [value], {"_hi": F.col("_c")}, group)
    else:
        counts, scanned = cells, _middle_counts(df, value, probs, group, bounds, cells)
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    if group:
        ranked = scanned.join(sizes, group)
    else:
        ranked = scanned.withColumn("_n", sizes.scalar())
    lo0, hi0 = F.col("_hi") - F.col("_c"), F.col("_hi") - 1  # 0-based ranks held by the value
    wanted = {}
    for name, q in probs.items():
        h = F.lit(float(q)) * (F.col("_n") - 1)
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            wanted[f"_{name}_{side}"] = F.max(F.when((at >= lo0) & (at <= hi0), F.col(value)))
    got = ranked.groupBy(*group).agg(F.max("_n").alias("_n"), *[c.alias(n) for n, c in wanted.items()])
    exprs = []
    for name, q in probs.items():
        h = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        exprs.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return got.select(*group, *exprs)
