"""Cleaning, identifiers, eligibility and display rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_col, as_list
from ..functions.text import mask_sequence
from .ordering import rank_rows


def dedupe_ids(df: DataFrame, base: str = "Seq_ID", order: str = "record_index", shard: Column | None = None) -> DataFrame:
    """n-th repeat of a base id (n >= 2) becomes ``base__dupNNN``."""
    ranked = rank_rows(df.withColumn("Seq_ID_Base", F.col(base)), [order], ["Seq_ID_Base"], "_n", shard)
    return ranked.withColumn(
        base, F.when(F.col("_n") == 1, F.col("Seq_ID_Base")).otherwise(F.concat("Seq_ID_Base", F.format_string("__dup%03d", "_n")))
    ).drop("_n")


def internal_ids(df: DataFrame, order, shard: Column | None = None) -> DataFrame:
    """Collision-proof ``seq_%09d`` from the input order."""
    ranked = rank_rows(df, order, (), "_n", shard)
    return ranked.withColumn("internal_id", F.format_string("seq_%09d", "_n")).drop("_n")


def prepare_sequences(records: DataFrame) -> DataFrame:
    """Masked sequence, length and, for rows to leave, the reason."""
    return records.withColumn("seq", mask_sequence("sequence")).withColumns(
        {
            "aa_len": F.length("seq"),
            "drop_reason": F.when(F.col("seq") == "", F.lit("empty_sequence_after_cleaning")),
        }
    )


def quarantine_split(df: DataFrame, reason: str = "drop_reason") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): both are filters over one plan."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def binary_target(label: Column | str, positive: str) -> Column:
    return F.when(as_col(label) == positive, 1).otherwise(0)


def numeric_binary_target(value: Column | str) -> Column:
    return F.when(F.coalesce(as_col(value).try_cast("double"), F.lit(0.0)) > 0, 1.0).otherwise(0.0)


# Taxon name endings by rank.
RANK_SUFFIXES = {"Realm": "viria", "Kingdom": "virae", "Phylum": "viricota", "Class": "viricetes", "Family": "viridae"}


def taxon_clean(df: DataFrame, level: str, value: str, suffixes: DataFrame) -> DataFrame:
    """Keep a taxon only when it ends in its rank's suffix; ``suffixes`` is
    (level, suffix), one row per rank."""
    v = F.trim(F.col(value))
    rules = suffixes.select(F.col("level").alias(level), "suffix")
    return df.join(rules, level, "left").withColumn(
        "taxon", F.when((v != "") & v.endswith(F.col("suffix")), v)
    ).drop("suffix")


def unambiguous_label(df: DataFrame, ident: str, value: str) -> DataFrame:
    """(id, value) where the distinct trimmed non-empty values are exactly one."""
    v = F.nullif(F.trim(F.col(value)), F.lit(""))
    g = df.groupBy(ident).agg(F.min(v).alias(value), F.max(v).alias("_hi"))
    return g.filter((F.col(value) == F.col("_hi"))).drop("_hi")


def min_group_filter(df: DataFrame, col: str, n: int) -> DataFrame:
    """Drop groups under a size floor (counts are pre-aggregated, then a semi-join)."""
    return df.join(df.groupBy(col).count().filter(F.col("count") >= n), col, "left_semi")


def class_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def class_counts_json(counts: DataFrame, col: str) -> DataFrame:
    """Bounded label counts as one JSON object."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(col).cast("string").alias("k"), F.col("n").alias("v"))))
    return counts.agg(F.to_json(F.map_from_entries(entries)).alias("counts_json"))


def label_eligibility(df: DataFrame, columns: list[str], floor: int, ident: str) -> DataFrame:
    """Long (id, task, label): unusable labels leave, then tasks under ``floor`` rows."""
    long = df.unpivot(ident, columns, "task", "label").filter(
        F.col("label").isNotNull() & (F.trim("label") != "") & (F.col("label") != "Unknown") & ~F.col("label").rlike("(?i)unclassified")
    )
    return min_group_filter(long, "task", floor)


def truncation_account(length: Column | str, max_tokens: int, reserved: int = 2) -> Column:
    """struct(processed, truncated) under a token limit with reserved places."""
    n = as_col(length)
    return F.struct(
        F.least(n, F.lit(max_tokens - reserved)).cast("long").alias("processed"), (n > max_tokens - reserved).alias("truncated")
    )


def category_map(rules: list[tuple[Column, Column | str]], default: Column | str) -> Column:
    """First matching rule wins."""
    expr = None
    for cond, out in rules:
        out = F.lit(out) if isinstance(out, str) else out
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    default = F.lit(default) if isinstance(default, str) else default
    return default if expr is None else expr.otherwise(default)


def recode(df: DataFrame, col: str, mapping: DataFrame, out: str) -> DataFrame:
    """Replace by a small map table (old, new); unmapped values stay."""
    m = mapping.select(F.col("old").alias(col), "new")
    return df.join(m, col, "left").withColumn(out, F.coalesce("new", col)).drop("new")


def unmapped(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    return df.select(col).distinct().join(mapping.select(F.col("old").alias(col)), col, "left_anti")


def bin_class(x: Column | str, edges: list[float], names: list[str], inclusive: bool = False, nan: str | None = None) -> Column:
    """Ordered class of a value: below (or at) an edge takes that edge's name."""
    x = as_col(x)
    expr = F.when(F.isnan(x.cast("double")), F.lit(nan)) if nan is not None else None
    for e, n in zip(edges, names):
        cond = x <= e if inclusive else x < e
        expr = F.when(cond, n) if expr is None else expr.when(cond, n)
    return expr.otherwise(names[-1])


def patch_overrides(df: DataFrame, patches: DataFrame, key: str, col: str) -> DataFrame:
    """Correct listed rows; key and old value must both match. ``applied`` reports them."""
    p = patches.select(F.col(key), F.col("old_value").alias(col), "new_value")
    out = df.join(p, [key, col], "left")
    return out.withColumns({"applied": F.col("new_value").isNotNull(), f"{col}_new": F.coalesce("new_value", col)}).drop("new_value")


def range_scale(df: DataFrame, col: str, lo: float, hi: float, out: str, power: float = 1.0) -> DataFrame:
    """Min-max scale into [lo, hi]; the middle where max = min."""
    x = F.col(col).cast("double")
    t = F.pow((x - F.col("_b.mn")) / (F.col("_b.mx") - F.col("_b.mn")), F.lit(power))
    bounds = df.agg(F.struct(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx")).alias("b"))
    return (
        df.withColumn("_b", bounds.scalar())
        .withColumn(out, F.when(F.col("_b.mx") > F.col("_b.mn"), F.lit(lo) + t * (hi - lo)).otherwise(F.lit((lo + hi) / 2)))
        .drop("_b")
    )


def power_scale(df: DataFrame, col: str, lo: float, hi: float, out: str, power: float = 0.5) -> DataFrame:
    """Size scale against the largest value; non-positive values become 0."""
    x = F.col(col).cast("double")
    mx = df.agg(F.max(col).cast("double")).scalar()
    return df.withColumn(out, F.when(x <= 0, F.lit(0.0)).otherwise(F.lit(lo) + F.pow(x / mx, F.lit(power)) * (hi - lo)))


def numeric_coerce(col: Column | str) -> Column:
    return as_col(col).try_cast("double")


def stage_status(valid: Column, screened: Column, candidate: Column, embedded: Column) -> dict[str, Column]:
    """Status columns that keep every input row."""
    screen = F.when(~valid, "invalid_input").when(screened, "completed").otherwise("not_run")
    embed = F.when(~valid, "invalid_input").when(~candidate, "not_applicable").when(embedded, "completed").otherwise("not_run")
    return {"screen_status": screen, "embed_status": embed}


def vector_profile(df: DataFrame, vec: str = "vec") -> DataFrame:
    """NaN, Inf and all-zero counts, mean, std, min, max and a pass flag.

    Each vector is summed in its own row; the spread of all values is that inside the
    vectors and that of their means. Null vectors count as rows only.
    """
    v = F.coalesce(F.col(vec).cast("array<double>"), F.array().cast("array<double>"))
    finite = F.filter(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(vec).alias("_v"), v.alias("_x"), finite.alias("_f"))
    rows = rows.withColumns({"_k": F.size("_f").cast("double"), "_m": F.try_divide(F.aggregate("_f", F.lit(0.0), lambda a, x: a + x), F.size("_f").cast("double"))})
    rows = rows.withColumn("_q", F.aggregate("_f", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))))
    got = rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.forall("_v", lambda x: x == 0)).alias("n_zero_rows"),
        F.coalesce(F.sum(F.size(F.filter("_x", F.isnan))), F.lit(0)).cast("long").alias("n_nan"),
        F.coalesce(F.sum(F.size(F.filter("_x", lambda x: F.abs(x) == float("inf")))), F.lit(0)).cast("long").alias("n_inf"),
        F.sum("_k").alias("_n"), F.sum(F.col("_k") * F.col("_m")).alias("_s"), F.sum("_q").alias("_in"), F.sum(F.col("_k") * F.col("_m") * F.col("_m")).alias("_sq"),
        F.min(F.array_min("_f")).alias("min"), F.max(F.array_max("_f")).alias("max"),
    )
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    std = F.sqrt(F.greatest((F.col("_in") + F.col("_sq") - F.col("_s") * F.col("_s") / F.col("_n")) / F.col("_n"), F.lit(0.0)))
    return got.select(
        "n_rows", "n_zero_rows", "n_nan", "n_inf", mean.alias("mean"), F.when(F.col("_n") > 0, std).alias("std"), "min", "max",
        ((F.col("n_nan") == 0) & (F.col("n_inf") == 0) & (F.col("n_zero_rows") == 0)).alias("passed"),
    )


def order_position(df: DataFrame, key: str, total: str, fixed: list[str] = ()) -> DataFrame:
    """Labels by a fixed list first, the rest by total desc then name; the
    label table is one row per category."""
    pos = F.array_position(F.array(*[F.lit(f) for f in fixed]), F.col(key)) if fixed else F.lit(0)
    w = Window.orderBy(F.when(pos > 0, pos).otherwise(len(fixed) + 1), F.desc(total), key)
    return df.groupBy(key).agg(F.sum(total).alias(total)).withColumn("position", F.row_number().over(w))


def all_true(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def keys_text(cols) -> Column:
    return F.concat_ws("|", *[as_col(c).cast("string") for c in as_list(cols)])
