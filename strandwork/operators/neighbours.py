"""Nearest neighbours and label votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_list
from ..functions.vectors import l2_normalize
from ..session import cut_lineage
from .ordering import compute_partitions, interpolated_quantiles, top_k

CENTROID_BYTES_LIMIT = 256 << 20
#: A side makes up to so many blocks, of at least so many rows; more only where a block would
#: pass its bytes. A row is sent to every block of the other side: that many times at most,
#: however many rows there are, until blocks are full.
SIDE_BLOCKS = 12
LEAST_ROWS = 4096
BLOCK_BYTES = 1 << 26
#: Similarities that a task holds at a time.
KERNEL_CELLS = 4_000_000
FIRST_COLUMNS = 4096
#: Vectors of a packed row, and tasks that share the references of a query: a query's best
#: come from so many tasks, however many references there are.
PACK_ROWS = 4096
REF_PARTS = 4


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def _similarity(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Of vectors that ``_scaled`` gave."""
    if metric == "l2":
        d2 = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2.0 * (q @ r.T)
        return -np.maximum(d2, 0.0)
    return q @ r.T


def _first_k(rows: np.ndarray, cols: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` greatest values of every row, equal ones by the least column, in that order."""
    order = np.lexsort((cols, -v, rows))
    rows, cols, v = rows[order], cols[order], v[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], v[keep]


def _best_of_rows(q: np.ndarray, r: np.ndarray, k: int, metric: str, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value to nine places) of the best ``k`` of every row; of the ties at rank k
    the least columns fill the places that are left. Columns are taken in runs: once k values of
    a row are known, only those that may reach the kth of them are kept. Values below ``least``,
    one per row, are left out."""
    width = max(k, KERNEL_CELLS // max(1, len(q)))
    found, n = [], 0
    bound = np.full(len(q), -np.inf) if least is None else least.copy()
    cuts = sorted({0, *range(min(width, max(k + 1, FIRST_COLUMNS)), len(r), width)})  # few columns give the first bounds
    for at, end in zip(cuts, [*cuts[1:], len(r)]):
        s = _similarity(q, r[at:end], metric)
        if at == 0 and s.shape[1] > k and np.isneginf(bound).any():
            bound = np.maximum(bound, np.partition(s, -k, axis=1)[:, -k])
        rows, cols = np.divmod(np.flatnonzero(s >= (bound - 2e-9)[:, None]), s.shape[1])  # all that may round to the kth value or more
        found.append((rows, cols + at, np.round(s[rows, cols], 9)))
        n += len(rows)
        if n * 8 > KERNEL_CELLS or end == len(r):
            found = [_first_k(*(np.concatenate(x) for x in zip(*found)), k)]
            rows, _, v = found[0]
            n, full = len(rows), np.bincount(rows, minlength=len(q)) == k
            last = np.cumsum(np.bincount(rows, minlength=len(q))) - 1
            bound[full] = v[last[full]]
    return found[0]


def _block_kernel(k: int, metric: str):
    def best_of_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "ref_id": [], "sim": []})
        right = right.sort_values("ref_id")
        q = _scaled(np.stack(left["vec"].to_numpy()).astype(np.float64), metric)
        r = _scaled(np.stack(right["vec"].to_numpy()).astype(np.float64), metric)
        step = 1024
        parts = [_best_of_rows(q[at : at + step], r, k, metric) for at in range(0, len(q), step)]
        rows = np.concatenate([i + at * step for at, (i, _, _) in enumerate(parts)])
        return pd.DataFrame(
            {
                "query_id": left["query_id"].to_numpy()[rows],
                "ref_id": right["ref_id"].to_numpy()[np.concatenate([j for _, j, _ in parts])],
                "sim": np.concatenate([v for _, _, v in parts]),
            }
        )

    return best_of_block


def _blocks(block_rows: int | None, sides: int | None = None) -> Column:
    """Blocks of the rows that are aggregated."""
    n = F.count("*")
    if block_rows:
        return F.ceil(n / block_rows).cast("int")
    held = F.ceil(n * F.max(F.size("vec")) * 8 / BLOCK_BYTES)  # by this many no block passes its bytes, but for chance
    return F.greatest(F.least(F.ceil(n / LEAST_ROWS), F.lit(sides or SIDE_BLOCKS)), held).cast("int")


def blocked_topk(queries: DataFrame, refs: DataFrame, k: int, cells, metric: str = "cosine", block_rows: int | None = None) -> DataFrame:
    """Top-k of every query against every reference row of the same cell.

    Both sides are hashed into blocks, a block pair is one task-sized unit, and a
    unit returns only its own best k. A cell holding most of the rows therefore
    becomes many units, not one large one. Blocks are as many as ``_blocks`` says,
    or hold about ``block_rows`` rows.
    """
    cells = as_list(cells)
    count_q = queries.groupBy(*cells).agg(_blocks(block_rows).alias("_nq"))
    count_r = refs.groupBy(*cells).agg(_blocks(block_rows, 1).alias("_nr"))  # a query is in several cells, a reference in one
    blocks = count_q.join(count_r, cells)
    left, right = queries.join(blocks, cells), refs.join(blocks, cells)

    def others(c):
        return F.explode(F.sequence(F.lit(0), F.greatest(F.col(c) - 1, F.lit(0))))

    left = left.withColumn("_qb", F.pmod(F.xxhash64("query_id"), "_nq").cast("int")).withColumn("_rb", others("_nr"))
    right = right.withColumn("_rb", F.pmod(F.xxhash64("ref_id"), "_nr").cast("int")).withColumn("_qb", others("_nq"))
    keys = cells + ["_qb", "_rb"]
    types = dict(queries.dtypes), dict(refs.dtypes)
    schema = f"query_id {types[0]['query_id']}, ref_id {types[1]['ref_id']}, sim double"
    best = (
        compute_partitions(left.select(*keys, "query_id", "vec"), *keys)
        .groupBy(*keys)
        .cogroup(compute_partitions(right.select(*keys, "ref_id", "vec"), *keys).groupBy(*keys))
        .applyInPandas(_block_kernel(k, metric), schema)
    )
    return top_k(best, [F.desc("sim"), "ref_id"], k, "query_id")


def _packed(rows: DataFrame, ident: str, blocks: int, block_rows: int | None = None, cell: str | None = None, kth: str | None = None) -> DataFrame:
    """(no, ids, vecs, cell, kth): a written table with up to PACK_ROWS vectors in a row, as bytes,
    in ``blocks`` files. A packed row holds vectors of one ``cell``."""
    size = block_rows or PACK_ROWS
    types = dict(rows.dtypes)
    kind = "float" if types["vec"] == "array<float>" else "double"
    values = F.col("vec") if kind == "float" else F.col("vec").cast("array<double>")
    rows = rows.select(F.col(ident).alias("id"), values.alias("vec"), F.col(cell).alias("cell") if cell else F.lit(0).alias("cell"), (F.col(kth) if kth else F.lit(None)).cast("double").alias("kth"))
    rows = rows.repartitionByRange(blocks, "cell", "id").sortWithinPartitions("cell") if cell else rows.repartition(blocks, "id")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            vec = whole.column("vec")
            sizes = np.diff(vec.offsets.to_numpy())
            if vec.null_count or (sizes != sizes[0]).any():
                raise ValueError("vectors must have one length and not be null")
            columns = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(n)) for n in ("id", "kth")]
            data = pa.array([vec.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if kind == "float" else np.float64).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([columns[0], data, whole.column("cell").slice(0, 1), columns[1]], ["ids", "vecs", "cell", "kth"])

        n, last = 0, None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for at, end in zip(cuts, cuts[1:]):
                if held and cells[at] != last:
                    yield row()
                    n = 0
                last = cells[at]
                while at < end:
                    part = batch.slice(at, min(end - at, size - n))
                    held.append(part)
                    at, n = at + part.num_rows, n + part.num_rows
                    if n == size:
                        yield row()
                        n = 0
        if held:
            yield row()

    packed = rows.mapInArrow(run, f"ids array<{types[ident]}>, vecs binary, cell int, kth array<double>")
    return cut_lineage(packed.withColumn("no", F.monotonically_increasing_id()))


def _ids(values: pa.Array) -> np.ndarray:
    """A copy that numpy sorts as Spark does."""
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return np.array(values.to_pylist(), dtype=str)
    return np.array(values.to_numpy(zero_copy_only=False))


def _grid_best(queries: DataFrame, refs: DataFrame, k: int, metric: str, kinds: tuple[str, str], wide: tuple[str, str], wanted=None) -> DataFrame:
    """(query_id, far, ref_ids): the best ``k`` of every query in each of REF_PARTS parts of the
    references, for two packed tables.

    Every part of one table meets every file of the other as one task, which reads both where they
    are written: no copy of a vector is shuffled. A task holds its queries and their best, and
    takes the references one packed row at a time. ``wanted(x, cell, bound)`` tells which of the
    queries x need the references of a cell, given the least value that counts.
    """
    dtypes = [np.float32 if w == "array<float>" else np.float64 for w in wide]
    left = refs.select(F.col("no").alias("r_no"), F.col("ids").alias("r_ids"), F.col("vecs").alias("r_vecs"), "cell").coalesce(REF_PARTS)
    right = queries.select(F.col("no").alias("q_no"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "kth")

    def stack(data: pa.Scalar, n: int, dtype) -> np.ndarray:
        return _scaled(np.frombuffer(data.as_buffer(), dtype).reshape(n, -1).astype(np.float64), metric)

    def settle(state: dict) -> None:
        if not state["new"]:
            return
        rows, refs_, v = (np.concatenate(x) for x in zip(*state["best"], *state["new"]))
        state["best"], state["new"], state["more"] = [_first_k(rows, refs_, v, k)], [], 0
        rows, _, v = state["best"][0]
        per_row = np.bincount(rows, minlength=len(state["bound"]))
        full = per_row == k
        state["bound"][full] = np.maximum(state["bound"][full], v[(np.cumsum(per_row) - 1)[full]])

    def run(batches):
        kept: dict[int, dict] = {}
        now, ids, r = None, None, None
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for i, (r_no, q_no, cell) in enumerate(zip(*(col[n].to_pylist() for n in ("r_no", "q_no", "cell")))):
                if r_no != now:
                    now, ids = r_no, _ids(col["r_ids"][i].values)
                    order = np.argsort(ids, kind="stable")
                    ids, r = ids[order], stack(col["r_vecs"][i], len(ids), dtypes[1])[order]
                if q_no not in kept:
                    kth = col["kth"][i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                    kept[q_no] = {"ids": _ids(col["q_ids"][i].values), "bound": np.where(np.isnan(kth), -np.inf, kth), "best": [], "new": [], "more": 0}
                state = kept[q_no]
                q = stack(col["q_vecs"][i], len(state["ids"]), dtypes[0])
                need = np.arange(len(q)) if wanted is None else np.flatnonzero(wanted(q, cell, state["bound"]))
                for at in range(0, len(need), 1024):
                    some = need[at : at + 1024]
                    rows, cols, v = _best_of_rows(q[some], r, k, metric, state["bound"][some])
                    if len(rows):
                        state["new"].append((some[rows], ids[cols], v))
                        state["more"] += len(rows)
                if not state["best"] or state["more"] * 2 > len(q) * k:
                    settle(state)
        for state in kept.values():
            settle(state)
            if state["best"]:
                rows, refs_, v = state["best"][0]
                per_row = np.bincount(rows, minlength=len(state["ids"]))
                some = np.flatnonzero(per_row)
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_row[some])]).astype(np.int32))
                far = pa.ListArray.from_arrays(offsets, pa.array(0.0 - v))
                yield pa.RecordBatch.from_arrays([pa.array(state["ids"][some]), far, pa.ListArray.from_arrays(offsets, pa.array(refs_))], ["query_id", "far", "ref_ids"])

    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, f"query_id {kinds[0]}, far array<double>, ref_ids array<{kinds[1]}>")


def _nearest_lists(best: DataFrame, k: int) -> DataFrame:
    """(query_id, near): the first ``k`` (far, ref_ids) of all lists of a query, in order."""
    lists = best.repartition("query_id").groupBy("query_id").agg(F.flatten(F.collect_list("far")).alias("far"), F.flatten(F.collect_list("ref_ids")).alias("ref_ids"))
    return lists.select("query_id", F.slice(F.sort_array(F.arrays_zip("far", "ref_ids")), 1, k).alias("near"))


def _ranked(lists: DataFrame) -> DataFrame:
    rows = lists.select("query_id", F.posexplode("near").alias("at", "n"))
    return rows.select("query_id", F.col("n.ref_ids").alias("ref_id"), (F.lit(0.0) - F.col("n.far")).alias("sim"), (F.col("at") + 1).alias("rank"))


def _sides(queries: DataFrame, refs: DataFrame) -> tuple[tuple[str, str], tuple[str, str]]:
    """Types of the ids and of the vectors."""
    q, r = dict(queries.dtypes), dict(refs.dtypes)
    return (q["query_id"], r["ref_id"]), (q["vec"], r["vec"])


def _block_count(rows: DataFrame, block_rows: int | None) -> int:
    return max(1, rows.agg(_blocks(block_rows)).first()[0] or 0)


def exact_cosine_topk(queries: DataFrame, refs: DataFrame, k: int, metric: str = "cosine", block_rows: int | None = None) -> DataFrame:
    """(query_id, ref_id, sim, rank): a row's match with itself is kept. Every query meets every
    reference; packed rows hold ``block_rows`` vectors."""
    q = _packed(queries, "query_id", _block_count(queries, block_rows), block_rows)
    r = _packed(refs, "ref_id", _block_count(refs, block_rows), block_rows)
    return _ranked(_nearest_lists(_grid_best(q, r, k, metric, *_sides(queries, refs)), k))


def fit_cells(refs: DataFrame, nlist: int, sample_rows: int = 200_000, seed: int = 42, metric: str = "cosine") -> np.ndarray:
    """Coarse centroids from a training sample of about ``sample_rows`` vectors at most.

    The sample bounds the fit only; every row is assigned afterwards. Vectors are
    normalised for the cosine metric and no other.
    """
    share = min(1.0, sample_rows / max(1, refs.count()))
    train = refs.sample(fraction=share, seed=seed).select(array_to_vector(l2_normalize("vec") if metric == "cosine" else F.col("vec").cast("array<double>")).alias("features")).persist()
    try:
        centers = np.asarray(KMeans(k=nlist, seed=seed, maxIter=10).fit(train).clusterCenters())
    finally:
        train.unpersist()
    if centers.nbytes > CENTROID_BYTES_LIMIT:
        raise ValueError("centroid table too large to ship to every task")
    return centers


def _near_cells(x: np.ndarray, c: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
    """Whether a centre is among the ``n`` nearest of a vector; ties go to the lower centre."""
    away = np.round(half[None, :] - x @ c.T, 9)
    some = np.partition(away, n - 1, axis=1)[:, n - 1 :][:, :1]
    near, level = away < some, away == some
    level &= np.cumsum(level, axis=1) <= (n - near.sum(1))[:, None]
    return near | level


def assign_cells(df: DataFrame, centers: np.ndarray, nprobe: int, ident: str, metric: str = "cosine", slice_rows: int = 256) -> DataFrame:
    """One row per vector and each of its ``nprobe`` nearest cells; ties go to the lower cell."""
    shared = df.sparkSession.sparkContext.broadcast(centers)
    schema = T.StructType([df.schema[ident], df.schema["vec"], T.StructField("cell", T.IntegerType())])

    def assign(batches):
        c = shared.value
        half, n = (c * c).sum(1) / 2, min(nprobe, len(c))
        for b in batches:
            for at in range(0, len(b), slice_rows):
                part = b.iloc[at : at + slice_rows]
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                if metric == "cosine":
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                near = np.nonzero(_near_cells(x, c, half, n))[1].reshape(len(x), n)
                yield part.loc[part.index.repeat(n)].reset_index(drop=True).assign(cell=near.reshape(-1).astype("int32"))

    return df.select(ident, "vec").mapInPandas(assign, schema)


def search_cells(queries: DataFrame, cells: DataFrame, centers: np.ndarray, k: int, nprobe: int, metric: str = "cosine", block_rows: int | None = None) -> DataFrame:
    """Top-k over the ``nprobe`` nearest cells of a query, from fitted centroids and the
    reference table (ref_id, vec, cell) that ``assign_cells`` made once."""
    return blocked_topk(assign_cells(queries, centers, nprobe, "query_id", metric), cells, k, ["cell"], metric, block_rows)


def ivf_search(queries: DataFrame, refs: DataFrame, k: int, nlist: int, nprobe: int, metric: str = "cosine", block_rows: int | None = None) -> DataFrame:
    """Fit, assign and search in one go; keep the centroids and cells to search again."""
    centers = fit_cells(refs, nlist, metric=metric)
    return search_cells(queries, assign_cells(refs, centers, 1, "ref_id", metric), centers, k, nprobe, metric, block_rows)


def build_index(refs: DataFrame, path: str, nlist: int, metric: str = "cosine", **fit) -> None:
    """Train once: fit cells, then write the reference table (ref_id, vec) by cell, and the cells
    (cell, centre, radius, members) beside it. A radius is the distance of the farthest row of the cell."""
    spark = refs.sparkSession
    centers = fit_cells(refs, nlist, metric=metric, **fit)
    assign_cells(refs, centers, 1, "ref_id", metric).write.partitionBy("cell").parquet(f"{path}/rows")
    rows = read_index_rows(spark, path, refs)
    shared = spark.sparkContext.broadcast(centers)

    def reach(batches):
        for b in batches:
            if len(b):
                x = _placed(b["vec"], metric)
                away = np.sqrt(((x - shared.value[b["cell"].to_numpy()]) ** 2).sum(1))
                yield pd.DataFrame({"cell": b["cell"], "away": away})

    sizes = rows.select("cell", "vec").mapInPandas(reach, "cell int, away double").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("members"))
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centre array<double>")
    listed.join(sizes, "cell", "left").fillna({"radius": 0.0, "members": 0}).write.parquet(f"{path}/cells")


def _placed(vectors: pd.Series, metric: str) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def read_index_rows(spark, path: str, like: DataFrame) -> DataFrame:
    """(ref_id, vec, cell): one folder per cell, so a join on cells reads those that are asked for."""
    fields = [like.schema["ref_id"], like.schema["vec"], T.StructField("cell", T.IntegerType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/rows")


def search_index(queries: DataFrame, rows: DataFrame, cells: DataFrame, k: int, nprobe: int, metric: str = "cosine", block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, ref_id, sim): the exact top-k, from ``build_index``'s rows and cells.

    First the ``nprobe`` nearest cells of a query are searched. By the triangle
    inequality no row of a cell is nearer than the distance of its centre less its
    radius, so of the other cells only those are searched that this bound does not put
    behind the k-th row found. Without ``k`` rows found all are. Works for the cosine
    and l2 metrics. The cells are as many as were fitted, read on the driver and sent once.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("bounds need the cosine or l2 metric")
    listed = cells.orderBy("cell").collect()
    centers, radii = np.array([c.centre for c in listed]), np.array([c.radius for c in listed])
    shared = queries.sparkSession.sparkContext.broadcast((centers, radii))
    n = min(nprobe, len(centers))

    def nearest(x, cell, bound):
        c, _ = shared.value
        return _near_cells(x, c, (c * c).sum(1) / 2, n)[:, cell]

    def further(x, cell, bound):
        c, radius = shared.value
        d2 = np.maximum((x * x).sum(1) + (c[cell] * c[cell]).sum() - 2.0 * x @ c[cell], 0.0)
        least = np.maximum(np.sqrt(d2) - radius[cell], 0.0) ** 2
        limit = np.where(np.isneginf(bound), np.inf, (2.0 - 2.0 * bound) if metric == "cosine" else -bound)
        return (least <= limit * (1 + 1e-9) + 1e-7) & ~nearest(x, cell, bound)  # room for rounding

    blocks, types = _block_count(queries, block_rows), _sides(queries, rows)
    packed = _packed(rows, "ref_id", _block_count(rows, block_rows), block_rows, "cell")
    first = cut_lineage(_nearest_lists(_grid_best(_packed(queries, "query_id", blocks, block_rows), packed, k, metric, *types, nearest), k))
    kth = first.select("query_id", F.when(F.size("near") == k, 0.0 - F.element_at("near", -1)["far"]).alias("kth"))
    asked = _packed(queries.join(kth, "query_id", "left"), "query_id", blocks, block_rows, kth="kth")
    rest = _grid_best(asked, packed, k, metric, *types, further)
    both = first.select("query_id", F.col("near.far").alias("far"), F.col("near.ref_ids").alias("ref_ids")).unionByName(rest)
    return _ranked(_nearest_lists(both, k))


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    hit = truth.select("query_id", "ref_id").join(found.select("query_id", "ref_id", F.lit(1).alias("hit")), ["query_id", "ref_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def with_ref_labels(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the label of each neighbour, -1 where it has none; ``labels`` is (ref_id, label)."""
    return neighbours.join(labels.select("ref_id", "label"), "ref_id", "left").fillna(-1, ["label"])


def _winner(votes: DataFrame, queries: DataFrame, tie) -> DataFrame:
    won = votes.groupBy("query_id").agg(
        F.max_by("label", F.struct(F.round("score", 9), tie)).alias("pred_label"),
        (F.max("score") / F.sum("score")).alias("confidence"),
    )
    return queries.select("query_id").join(won, "query_id", "left").select(
        "query_id",
        F.coalesce("pred_label", F.lit(-1)).alias("pred_label"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def vote_sequence(neighbours: DataFrame, queries: DataFrame, include_noise: bool = False) -> DataFrame:
    """Similarity-weighted vote; noise leaves before the minimum is taken and
    the first label met in neighbour order wins a tie."""
    voters = neighbours if include_noise else neighbours.filter(F.col("label") != -1)
    per_query = Window.partitionBy("query_id")  # at most k rows each
    weight = F.col("sim") - F.min("sim").over(per_query) + 1e-6
    votes = (
        voters.withColumn("w", weight)
        .groupBy("query_id", "label")
        .agg(F.sum("w").alias("score"), F.min("rank").alias("first_rank"))
    )
    return _winner(votes, queries, -F.col("first_rank"))


def vote_token(neighbours: DataFrame, queries: DataFrame, mode: str = "weighted", metric: str = "cosine") -> DataFrame:
    """Vote whose minimum covers all k neighbours, noise included; the lowest
    label wins a tie."""
    per_query = Window.partitionBy("query_id")
    if mode == "unweighted":
        weight = F.lit(1.0)
    elif metric == "l2":
        weight = 1.0 / (1.0 - F.col("sim"))  # sim holds the negated squared distance
    else:
        weight = F.col("sim") - F.min("sim").over(per_query) + 1e-6
    votes = (
        neighbours.withColumn("w", weight)
        .filter(F.col("label") >= 0)
        .groupBy("query_id", "label")
        .agg(F.sum("w").alias("score"))
    )
    return _winner(votes, queries, -F.col("label"))


def transfer_accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Top-1 accuracy where both sides carry a real label."""
    both = pred.join(truth, "query_id").filter((F.col("pred_label") >= 0) & (F.col("true_label") >= 0))
    return both.agg(
        F.count("*").alias("n_eval"),
        F.coalesce(F.avg((F.col("pred_label") == F.col("true_label")).cast("double")), F.lit(0.0)).alias("accuracy"),
    )


def prediction_stats(pred: DataFrame) -> DataFrame:
    """Noise share, label count, confidence mean and median of mapped rows."""
    pred = cut_lineage(pred.select("pred_label", "confidence"))  # read twice: the search before it runs once
    valid = F.col("pred_label") >= 0
    exact = pred.select(F.when(valid, F.round("confidence", 9)).alias("c"))
    median = interpolated_quantiles(exact, "c", {"median": 0.5}).select("median").scalar()
    stats = pred.agg(
        F.count("*").alias("n_rows"),
        F.avg((F.col("pred_label") == -1).cast("double")).alias("noise_ratio"),
        F.count_distinct(F.when(F.col("pred_label") != -1, F.col("pred_label"))).alias("n_labels"),
        F.count_if(valid).alias("mapped_valid"),
        F.coalesce(F.avg(F.when(valid, F.col("confidence"))), F.lit(0.0)).alias("confidence_mean"),
    )
    return stats.withColumn("confidence_median", F.coalesce(median, F.lit(0.0)))


def top_labels(pred: DataFrame, n: int = 20) -> DataFrame:
    counts = pred.filter(F.col("pred_label") >= 0).groupBy("pred_label").count()
    return counts.orderBy(F.desc("count"), F.desc("pred_label")).limit(n)
