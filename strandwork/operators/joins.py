"""Joins: keyed, interval, distance, pairs, grids, translation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_list, ratio
from ..session import cut_lineage
from . import checks
from .ordering import compute_partitions


def inner_key_join(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return a.join(b, key, "inner")


def validated_left_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Left join declared one-to-one: duplicate keys and unmatched rows fail."""
    checks.enforce(
        checks.violations([checks.unique_key(a, key, "left_key"), checks.unique_key(b, key, "right_key"), checks.missing_match(a, b, key)])
    )
    return a.join(b, key, "left")


def multi_key_left_join(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Left join on several keys; value columns of equal name take a suffix."""
    both = (set(a.columns) & set(b.columns)) - set(keys)
    left = a.select(*keys, *[F.col(c).alias(c + suffixes[0] if c in both else c) for c in a.columns if c not in keys])
    right = b.select(*keys, *[F.col(c).alias(c + suffixes[1] if c in both else c) for c in b.columns if c not in keys])
    return left.join(right, keys, "left")


def ratio_and_delta(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """<name>_ratio and <name>_delta of two columns, null where either is missing."""
    out = {}
    for name, (x, y) in pairs.items():
        out[f"{name}_ratio"] = ratio(F.col(x), F.col(y), None)
        out[f"{name}_delta"] = F.col(x) - F.col(y)
    return df.withColumns(out)


def last_row_per_key(df: DataFrame, key: str, row_index: str) -> DataFrame:
    """The row with the greatest index per key; partial aggregation before the shuffle."""
    cols = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(row_index)).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def report_join(pred: DataFrame, motif: DataFrame, key: str, row_index: str) -> DataFrame:
    """Predictions left-joined to the last motif row per id."""
    return pred.join(last_row_per_key(motif, key, row_index).drop(row_index), key, "left")


def last_wins_lookup(fact: DataFrame, dim: DataFrame, key: str, row_index: str) -> DataFrame:
    """Inner match to a dimension whose last duplicate wins; blank keys leave."""
    present = F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")
    return fact.filter(present).join(last_row_per_key(dim.filter(present), key, row_index).drop(row_index), key)


def semi_join(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return a.join(b, key, "left_semi")


def anti_join(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return a.join(b, key, "left_anti")


#: Points of one bin that are matched by one task; fuller bins are dealt out.
BIN_POINTS = 1_000_000
#: Bins that can be dealt out at most, at each level: none holds less than this part of all points.
HOT_PARTS = 1_000


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, width: int, group=()) -> DataFrame:
    """Points with start <= at < end, as an equi-join on nested bins.

    An interval lies in the bins of its own level, whose width is the least of ``width``
    times a power of two that is no less than its length: two bins at most, however long
    it is. A point asks its bin at each level that is in use. Bins that hold many
    points are dealt out over salts, and their intervals go to each. Empty intervals own no point.
    """
    group = as_list(group)
    length = (F.col(end) - F.col(start)).cast("double") / F.lit(float(width))
    spans = intervals.filter(F.col(start) < F.col(end)).withColumn("_l", F.greatest(F.ceil(F.log2(length)), F.lit(0)).cast("int"))
    levels = sorted(r._l for r in spans.select("_l").distinct().collect())  # no more than bits in a number
    size = F.pow(F.lit(2.0), F.col("_l")) * width
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / size), F.ceil(F.col(end) / size) - 1)))
    used = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    probes = points.withColumn("_l", F.explode(used)).withColumn("_b", F.floor(F.col(at) / size))
    keys = [*group, "_l", "_b"]
    counts = cut_lineage(probes.groupBy(*keys).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") > max(BIN_POINTS, total // HOT_PARTS)).withColumn("_s", F.ceil(F.col("_n") / BIN_POINTS).cast("int")).drop("_n")
    if not hot.isEmpty():
        hot = F.broadcast(hot)  # HOT_PARTS rows a level
        probes = probes.join(hot, keys, "left").withColumn("_s", F.pmod(F.xxhash64(*points.columns), F.coalesce("_s", F.lit(1))).cast("int"))
        spans = spans.join(hot, keys, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1)))
        keys = [*keys, "_s"]
    hits = probes.join(spans, keys)
    return hits.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_l", "_b", "_s")


def pair_join(df: DataFrame, ident: str, group=(), block_rows: int = 2000, columns=()) -> DataFrame:
    """Every unordered pair (id1 < id2), optionally only inside a group.

    Ids are hashed into blocks per group and every block pair is its own join
    key, so a large group becomes many bounded pieces. They keep their partitions:
    the rows are few for the pairs they make, and adaptive execution would merge them.
    """
    group = as_list(group)
    carried = [ident, *as_list(columns)]
    n = df.groupBy(*group).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
    base = df.select(*group, *carried)
    base = base.join(n, group) if group else base.withColumn("_n", n.scalar())
    base = base.withColumn("_blk", F.pmod(F.xxhash64(ident), "_n").cast("int"))
    left = base.withColumn("_hi", F.explode(F.sequence(F.col("_blk"), F.col("_n") - 1))).select(
        *group, F.col("_blk").alias("_lo"), "_hi", *[F.col(c).alias(f"_l_{c}") for c in carried]
    )
    right = base.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.col("_blk")))).select(
        *group, "_lo", F.col("_blk").alias("_hi"), *[F.col(c).alias(f"_r_{c}") for c in carried]
    )
    a, b = F.col(f"_l_{ident}"), F.col(f"_r_{ident}")
    keys = [*group, "_lo", "_hi"]
    met = compute_partitions(left, *keys).join(compute_partitions(right, *keys), keys).filter(F.when(F.col("_lo") == F.col("_hi"), a < b).otherwise(a != b))
    first = a < b
    out = []
    for c in carried:
        lo, hi = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        out += [F.when(first, lo).otherwise(hi).alias(f"{c}1"), F.when(first, hi).otherwise(lo).alias(f"{c}2")]
    return met.select(*group, *out)


def _cell(c: Column, r: float) -> Column:
    return F.floor(c / F.lit(r)).cast("long")


def _distance(p: str, q: str) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f"{p}{c}") - F.col(f"{q}{c}"), 2) for c in "xyz"]))


#: Rows of a cell that one task takes from either side.
CELL_ROWS = 2_000
#: Cells with more rows than that whose list is broadcast at most; more are joined by shuffle.
BROADCAST_CELLS = 500_000
_AXES = ["_cx", "_cy", "_cz"]
# The neighbours of a cell; half of them, with the cell itself, reach every pair of cells once.
AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
FORWARD = [s for s in AROUND if s >= (0, 0, 0)]


def _in_blocks(points: DataFrame, r: float, group: list[str], ident: str) -> tuple[DataFrame, DataFrame]:
    """(points with their cell and their block of it, (cell, blocks) of cells that have several)."""
    placed = points.withColumns({a: _cell(F.col(c), r) for a, c in zip(_AXES, "xyz")})
    full = placed.groupBy(*group, *_AXES).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_n")).filter("_n > 1")
    full = cut_lineage(full)
    near = F.broadcast(full) if full.count() <= BROADCAST_CELLS else full
    dealt = placed.join(near, [*group, *_AXES], "left")
    return dealt.withColumn("_own", F.pmod(F.xxhash64(ident), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n"), near


def _grid_pairs(a: DataFrame, b: DataFrame, r: float, group: list[str], shifts: list[tuple[int, int, int]], ident: str) -> DataFrame:
    """Rows of ``a`` (a_*) with rows of ``b`` (b_*) within ``r`` in the cells at ``shifts`` from theirs.

    A full cell is dealt into blocks, and a block of one cell meets a block of the other
    under a key of its own, so a dense cell becomes many pieces of bounded size.
    """
    left, blocks_a = _in_blocks(a, r, group, ident)
    right, blocks_b = (left, blocks_a) if a is b else _in_blocks(b, r, group, ident)
    every = F.array(*[F.struct(*[F.lit(s).cast("long").alias(c) for c, s in zip(_AXES, shift)]) for shift in shifts])

    def sided(rows: DataFrame, prefix: str, sign: int, others: DataFrame, own: str, other: str) -> DataFrame:
        """Rows under (cell of ``a``, shift, block of either side)."""
        cells = rows.select(*group, *_AXES, F.col("_own").alias(own), *[F.col(c).alias(f"{prefix}{c}") for c in rows.columns if c not in [*group, *_AXES, "_own"]])
        cells = cells.withColumn("_s", F.explode(every)).withColumns({f"_t{c}": F.col(c) + sign * F.col(f"_s.{c}") for c in _AXES})
        there = others.select(*group, *[F.col(c).alias(f"_t{c}") for c in _AXES], "_n")
        cells = cells.join(there, [*group, *[f"_t{c}" for c in _AXES]], "left")
        cells = cells.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
        home = _AXES if sign > 0 else [f"_t{c}" for c in _AXES]
        return cells.withColumns({f"_k{c}": F.col(h) for c, h in zip(_AXES, home)}).drop(*_AXES, *[f"_t{c}" for c in _AXES])

    one, two = sided(left, "a_", 1, blocks_b, "_ba", "_bb"), sided(right, "b_", -1, blocks_a, "_bb", "_ba")
    keys = [*group, *[f"_k{c}" for c in _AXES], "_s", "_ba", "_bb"]
    met = one.join(two, keys)
    inside = F.forall(F.array(*[F.col("_s")[c] for c in _AXES]), lambda v: v == 0)
    met = met.withColumn("_same", inside).drop(*keys[len(group):])
    return met.withColumn("dist", _distance("a_", "b_")).filter(F.col("dist") <= r)


def contact_pairs(points: DataFrame, r: float, group=(), chain: str = "chain", index: str = "label_seq", backbone: int = 2, ident: str = "id") -> DataFrame:
    """Pairs within ``r``; same-chain neighbours up to ``backbone`` apart leave.

    A pair of cells meets once: each cell looks at itself and at half of its neighbours.
    """
    a, b = F.col(f"a_{ident}"), F.col(f"b_{ident}")
    near = _grid_pairs(points, points, r, as_list(group), FORWARD, ident).filter(F.when(F.col("_same"), a < b).otherwise(a != b))
    close = (F.col(f"a_{chain}") == F.col(f"b_{chain}")) & (F.abs(F.col(f"a_{index}") - F.col(f"b_{index}")) <= backbone)
    return near.filter(~close).select(*as_list(group), F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), "dist")


def nearest_within(points: DataFrame, reference: DataFrame, r: float, group=(), ident: str = "id") -> DataFrame:
    """Smallest distance of each point to the reference set, if within ``r``."""
    near = _grid_pairs(points, reference, r, as_list(group), AROUND, ident)
    return near.groupBy(*as_list(group), F.col(f"a_{ident}").alias(ident)).agg(F.min("dist").alias("dist"))


CATEGORY_LIMIT = 100_000


def complete_grid(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Every row label with every column label; missing values become 0.

    Column labels are categories: their number is checked before they are
    attached to each row label as one array.
    """
    cols = df.select(col).distinct()
    if cols.limit(CATEGORY_LIMIT + 1).count() > CATEGORY_LIMIT:
        raise ValueError(f"{col} is no category column")
    labels = cols.agg(F.array_sort(F.collect_list(col))).scalar()
    frame = df.select(row).distinct().withColumn(col, F.explode(labels))
    return frame.join(df.groupBy(row, col).agg(*[F.sum(v).alias(v) for v in values]), [row, col], "left").fillna(0, values)


def token_translation(df: DataFrame, ident: str, text: str, mapping: DataFrame, out: str = "translated") -> DataFrame:
    """Each id of a space-separated text through a (token, name) table, order
    kept; an unmapped id is an error."""
    tokens = df.select(ident, F.posexplode(F.split(text, " ")).alias("_p", "token"))
    named = tokens.join(mapping, "token", "left").withColumn(
        "_name", F.coalesce("name", F.raise_error(F.concat(F.lit("unmapped token: "), F.col("token"))))
    )
    words = F.array_sort(F.collect_list(F.struct("_p", "_name")))  # the tokens of one text
    joined = named.groupBy(ident).agg(F.array_join(F.transform(words, lambda s: s["_name"]), " ").alias(out))
    return df.join(joined, ident)


def edge_reference_check(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Endpoints that do not exist and parentless nodes other than the root."""
    ids = nodes.select("node_id")

    def lost(col, kind):
        return edges.select(F.col(col).alias("node_id")).distinct().join(ids, "node_id", "left_anti").withColumn("violation", F.lit(kind))

    orphan = ids.join(edges.select(F.col("child_id").alias("node_id")), "node_id", "left_anti").filter(F.col("node_id") != root)
    return lost("parent_id", "missing_parent").unionByName(lost("child_id", "missing_child")).unionByName(
        orphan.withColumn("violation", F.lit("parentless"))
    )


def annotation_left_join(cells: DataFrame, ann: DataFrame, keys: list[str], total: str = "total", hits: str = "hits") -> DataFrame:
    """Hits clamped to [0, total], the rest and the rate recomputed; null when absent."""
    out = cells.join(ann, keys, "left")
    clamped = F.when(F.col(hits).isNotNull(), F.least(F.greatest(F.col(hits), F.lit(0)), F.col(total)))
    return out.withColumn(hits, clamped).withColumns(
        {"rest": F.col(total) - F.col(hits), "rate": F.when(F.col(total) > 0, F.col(hits) / F.col(total))}
    )


def intersect_ids(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).intersect(b.select(col))


def in_every_member(df: DataFrame, item: str, member: str, group=()) -> DataFrame:
    """Items present in all members of a group (all members overall without one)."""
    group = as_list(group)
    pairs = df.select(*group, item, member).distinct()
    have = pairs.groupBy(*group, item).agg(F.count("*").alias("_have"))
    size = df.select(*group, member).distinct().groupBy(*group).agg(F.count("*").alias("_size"))
    both = have.join(size, group) if group else have.withColumn("_size", size.scalar())
    return both.filter("_have = _size").select(*group, item)


def except_ids(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).subtract(b.select(col))
