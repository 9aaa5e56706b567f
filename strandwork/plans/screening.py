"""Screen all rows, encode only candidates, annotate only encoded rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("predict", "embed", "annotate", "screen-only")


def apply_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Replaceable per-row stage: ``fn`` maps an iterator of pandas batches."""
    return df.mapInPandas(fn, schema)


def apply_groups(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """Replaceable per-group stage for groups of bounded size."""
    return df.groupBy(key).applyInPandas(fn, schema)


def check_mode(mode: str, has_encoder: bool, has_heads: bool) -> None:
    """Option conflicts are rejected before any job runs."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if mode in ("embed", "annotate") and not has_encoder:
        raise ValueError(f"mode {mode!r} needs an encoder")
    if mode == "annotate" and not has_heads:
        raise ValueError("mode 'annotate' needs property heads")
    if mode == "screen-only" and has_heads:
        raise ValueError("mode 'screen-only' takes no property heads")


def candidate_gate(rows: DataFrame, screen: Callable[[DataFrame], DataFrame], encode: Callable | None = None, annotate: Callable | None = None, mode: str = "predict", ident: str = "row_id") -> DataFrame:
    """Every input row with its screening scores, stage results and statuses.

    ``rows`` has a boolean ``valid``; ``screen`` returns (id, ..., passed);
    ``encode`` and ``annotate`` return one row per id. The costly stages read
    only the rows that passed the stage before; no candidate at all is a success.
    """
    check_mode(mode, encode is not None, annotate is not None)
    scores = screen(rows.filter("valid").drop("valid"))
    out = rows.select(ident, "valid").join(scores, ident, "left")
    candidate = F.coalesce(F.col("passed") == 1, F.lit(False))
    out = out.withColumn("screen_status", F.when(F.col("valid"), "completed").otherwise("invalid_input"))
    if encode is None or mode == "screen-only":
        return out.withColumn("embed_status", F.when(~F.col("valid"), "invalid_input").otherwise("not_run"))
    wanted = rows.join(scores.filter("passed = 1").select(ident), ident, "left_semi")
    vectors = encode(wanted)
    status = F.when(~F.col("valid"), "invalid_input").when(~candidate, "not_applicable").when(F.col("_got"), "completed").otherwise("not_run")
    if annotate is not None and mode in ("predict", "annotate"):
        vectors = vectors.join(annotate(vectors), ident, "left")
    out = out.join(vectors.withColumn("_got", F.lit(True)).drop("valid"), ident, "left")
    return out.withColumn("embed_status", status).drop("_got")
