"""Sparse top-k encoding, decoding, head scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import top_k

MODEL_BYTES_LIMIT = 1 << 30


def _shared(df: DataFrame, arrays):
    size = sum(np.asarray(a).nbytes for a in arrays)
    if size > MODEL_BYTES_LIMIT:
        raise ValueError(f"model of {size} bytes is too large to ship to every task")
    return df.sparkSession.sparkContext.broadcast([np.asarray(a, dtype=np.float64) for a in arrays])


def topk_sparse_encode(df: DataFrame, w, b, center, alpha, k: int, clip=None, ident: str = "row_id", keep_zeros: bool = False) -> DataFrame:
    """(row, feature, value): ReLU(clip((x - center) * alpha) @ W + b), k largest.

    ``alpha`` may be a vector; zeros are dropped unless ``keep_zeros``.
    """
    lo, hi = clip if clip is not None else (-np.inf, np.inf)
    shared = _shared(df, [w, b, center, alpha, lo, hi])
    schema = T.StructType(
        [df.schema[ident], T.StructField("feature", T.IntegerType()), T.StructField("value", T.DoubleType())]
    )

    def encode(batches):
        W, bias, mid, scale, low, high = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            act = np.maximum(np.clip((x - mid) * scale, low, high) @ W + bias, 0.0)
            order = np.argsort(-np.round(act, 9), axis=1, kind="stable")[:, :k]
            vals = np.take_along_axis(act, order, axis=1)
            keep = np.ones_like(vals, dtype=bool) if keep_zeros else vals > 0
            rows, _ = np.nonzero(keep)
            yield pd.DataFrame(
                {ident: pdf[ident].to_numpy()[rows], "feature": order[keep].astype("int32"), "value": vals[keep]}
            )

    return df.select(ident, "vec").mapInPandas(encode, schema)


def topk_sparse_encode_joined(cells: DataFrame, weights: DataFrame, bias: DataFrame, k: int, ident: str = "row_id") -> DataFrame:
    """The same encoding with the weight matrix as a table (dim, feature, w),
    for matrices beyond the broadcast bound. ``cells`` is (row, dim, x) scaled."""
    acts = (
        cells.join(weights, "dim")
        .groupBy(ident, "feature")
        .agg(F.sum(F.col("x") * F.col("w")).alias("s"))
        .join(bias, "feature")
        .select(ident, "feature", F.greatest(F.col("s") + F.col("b"), F.lit(0.0)).alias("value"))
        .filter("value > 0")
    )
    return top_k(acts, [F.desc(F.round("value", 9)), "feature"], k, ident, "_rank").drop("_rank")


def sparse_decode(sparse: DataFrame, decoder: DataFrame, dims: DataFrame, ident: str = "row_id") -> DataFrame:
    """(row, dim, recon, x): sum of value * decoder row + bias, then raw space.

    ``decoder`` is (feature, dim, w); ``dims`` is (dim, bias, center, alpha).
    """
    recon = sparse.join(decoder, "feature").groupBy(ident, "dim").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    return recon.join(dims, "dim").select(
        ident,
        "dim",
        (F.col("s") + F.col("bias")).alias("recon"),
        ((F.col("s") + F.col("bias")) / F.col("alpha") + F.col("center")).alias("x"),
    )


def _mlp(x: np.ndarray, layers) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _flat(layers):
    return [a for wb in layers for a in wb]


def two_head_score(df: DataFrame, heads: dict[str, dict], ident: str = "row_id") -> DataFrame:
    """P(class 1) of each screening head and pass flags; passed = all heads.

    A head holds ``layers`` [(w, b), ...], ``mean``, ``std`` and ``threshold``.
    """
    for name, h in heads.items():
        if not 0 <= h["threshold"] <= 1:
            raise ValueError(f"invalid threshold: {name}")
        if not np.isfinite(h["mean"]).all() or not np.isfinite(h["std"]).all() or (np.asarray(h["std"]) <= 0).any():
            raise ValueError(f"invalid normalisation: {name}")
    shared = _shared(df, [a for h in heads.values() for a in [h["mean"], h["std"], *_flat(h["layers"])]])
    names = list(heads)
    depth = {n: len(heads[n]["layers"]) for n in names}
    limit = {n: heads[n]["threshold"] for n in names}
    schema = T.StructType([df.schema[ident]] + [T.StructField(f"{n}_score", T.DoubleType()) for n in names])

    def score(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            out, at = {ident: pdf[ident].to_numpy()}, 0
            for n in names:
                mean, std = shared.value[at : at + 2]
                flat = shared.value[at + 2 : at + 2 + 2 * depth[n]]
                at += 2 + 2 * depth[n]
                p = _softmax(_mlp((x - mean) / std, list(zip(flat[::2], flat[1::2]))))[:, 1]
                if not np.isfinite(p).all():
                    raise ValueError(f"invalid scores: {n}")
                out[f"{n}_score"] = p
            yield pd.DataFrame(out)

    scored = df.select(ident, "vec").mapInPandas(score, schema)
    flags = {f"{n}_pass": (F.col(f"{n}_score") >= limit[n]).cast("int") for n in names}
    passed = F.lit(True)
    for n in names:
        passed = passed & (F.col(f"{n}_score") >= limit[n])
    return scored.withColumns(flags).withColumn("passed", passed.cast("int"))


def multi_head_property_score(df: DataFrame, tasks: list[dict], ident: str = "row_id") -> DataFrame:
    """(row, task, pred, conf): argmax class or ``Unknown`` under the threshold.

    Tasks run in (task_order, name) order; each holds ``name``, ``layers``,
    ``classes`` and ``threshold``.
    """
    tasks = sorted(tasks, key=lambda t: (t.get("task_order", 9999), t["name"]))
    if not tasks:
        raise ValueError("no property heads given")
    if len({t["name"] for t in tasks}) != len(tasks):
        raise ValueError("duplicate property task")
    for t in tasks:
        if not 0 <= t["threshold"] <= 1:
            raise ValueError(f"invalid threshold: {t['name']}")
    shared = _shared(df, [a for t in tasks for a in _flat(t["layers"])])
    meta = [(t["name"], [str(c) for c in t["classes"]], float(t["threshold"]), len(t["layers"])) for t in tasks]
    schema = T.StructType(
        [df.schema[ident], T.StructField("task", T.StringType()), T.StructField("pred", T.StringType()), T.StructField("conf", T.DoubleType())]
    )

    def score(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            at = 0
            for name, classes, threshold, n in meta:
                flat = shared.value[at : at + 2 * n]
                at += 2 * n
                p = _softmax(_mlp(x, list(zip(flat[::2], flat[1::2]))))
                best = p.argmax(axis=1)
                conf = p[np.arange(len(p)), best]
                pred = np.where(conf >= threshold, np.asarray(classes, dtype=object)[best], "Unknown")
                yield pd.DataFrame({ident: pdf[ident].to_numpy(), "task": name, "pred": pred, "conf": conf})

    return df.select(ident, "vec").mapInPandas(score, schema)


def property_table(scores: DataFrame, tasks: list[str], ident: str = "row_id") -> DataFrame:
    """One row per input with ``<task>_pred`` and ``<task>_conf`` columns."""
    wide = scores.groupBy(ident).pivot("task", tasks).agg(F.first("pred").alias("pred"), F.first("conf").alias("conf"))
    return wide
