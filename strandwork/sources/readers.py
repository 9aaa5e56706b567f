"""File scans: FASTA, CSV, manifests, JSON summaries, atoms, matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mask_sequence
from ..session import cut_lineage
from ..operators.ordering import rank_rows


def in_input_order(df: DataFrame, name: str = "record_index") -> DataFrame:
    """Number the rows 1, 2, ... by file, split and place in the split.

    ``df`` carries ``_file``, ``_block`` (split start) and ``_at`` (a number
    that rises inside a split). A split is the shard, so no global sort runs.
    """
    numbered = rank_rows(df, ["_at"], (), name, F.struct("_file", "_block"))
    return numbered.drop("_file", "_block", "_at")


def _placed(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )


def fasta_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record_index, header, sequence) from FASTA files, plain or gzip.

    The text source is split at record starts, so one row is one record and
    large files are read by many tasks. Blank lines and lines starting with
    ``;`` or ``#`` are skipped; sequence text before the first header and an
    input without records are errors.
    """
    raw = _placed(spark.read.option("lineSep", "\n>").text(path))
    first = raw.groupBy("_file", "_block").agg(F.min("_at").alias("_first"))
    rows = raw.join(F.broadcast(first), ["_file", "_block"])  # one row per file split
    # The separator swallowed the mark of every record but the first of a file.
    head = (F.col("_block") == 0) & (F.col("_at") == F.col("_first"))
    text = F.when(head, F.col("value")).otherwise(F.concat(F.lit(">"), "value"))
    lines = F.filter(
        F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)),
        lambda x: (x != "") & ~x.startswith(";") & ~x.startswith("#"),
    )
    rows = rows.withColumn("_lines", lines).filter(~(head & (F.size("_lines") == 0)))
    header = F.col("_lines")[0]
    rows = rows.select(
        "_file", "_block", "_at",
        F.when(header.startswith(">"), F.trim(F.expr("substring(_lines[0], 2)")))
        .otherwise(F.raise_error(F.lit("sequence line before header"))).alias("header"),
        F.array_join(F.slice("_lines", F.lit(2), F.size("_lines")), "").alias("sequence"),
    )
    if rows.isEmpty():
        raise ValueError(f"no FASTA records found in {path}")
    return in_input_order(rows).select("record_index", "header", "sequence")


def resolve_column(df: DataFrame, expected: str, aliases: list[str] = ()) -> str:
    """Exact name, then case-blind, then the same for each alias."""
    lower = {c.lower(): c for c in df.columns}
    for name in [expected, *aliases]:
        if name in df.columns:
            return name
        if name.lower() in lower:
            return lower[name.lower()]
    raise ValueError(f"missing required column {expected!r}; available: {df.columns}")


def csv_sequence_scan(spark: SparkSession, path: str | list[str], seq_col: str = "seq", id_col: str | None = None) -> DataFrame:
    """(prot_id, seq): blank ids become ``row_<n>`` (0-based), empty sequences leave."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    seq = resolve_column(raw, seq_col, ["sequence"])
    ident = resolve_column(raw, id_col) if id_col else resolve_column(raw, "prot_id", ["id", "name"])
    rows = in_input_order(_placed(raw), "_idx")
    return rows.select(
        F.coalesce(F.nullif(F.trim(F.col(ident)), F.lit("")), F.concat(F.lit("row_"), (F.col("_idx") - 1).cast("string"))).alias("prot_id"),
        mask_sequence(F.coalesce(F.col(seq), F.lit(""))).alias("seq"),
    ).filter("seq <> ''")


def manifest_scan(spark: SparkSession, path: str | list[str], schema: str | T.StructType, sep: str = "\t") -> DataFrame:
    """Delimited manifest with a declared schema."""
    return spark.read.csv(path, header=True, sep=sep, schema=schema)


def summary_json_scan(spark: SparkSession, path: str | list[str], schema: str | T.StructType, groups: str = "groups") -> DataFrame:
    """Per-run JSON summaries to one row per (run, group); map columns that are
    no group map stay JSON text."""
    docs = spark.read.schema(schema).json(path, multiLine=True)
    plain = [
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
        for f in docs.schema
        if f.name != groups
    ]
    rows = docs.select(*plain, F.explode(F.map_entries(groups)).alias("_g"))
    keep = [c for c in rows.columns if c != "_g"]
    return rows.select(*keep, F.col("_g.key").alias("group"), F.col("_g.value.*"))


def sparse_matrix_scan(parts: list[DataFrame], shapes: list[int]) -> DataFrame:
    """Stack long (row_id, feature, value) matrices vertically."""
    if len(parts) != len(shapes):
        raise ValueError("one row count per matrix is needed")
    for p in parts:
        missing = {"row_id", "feature", "value"} - set(p.columns)
        if missing:
            raise ValueError(f"missing matrix columns: {sorted(missing)}")
    shifted, base = [], 0
    for p, n in zip(parts, shapes):
        shifted.append(p.select((F.col("row_id") + base).alias("row_id"), "feature", "value"))
        base += n
    return reduce(DataFrame.unionByName, shifted)


def embedding_scan(vectors: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Vectors with their metadata by key; differing row counts are an error."""
    n = F.struct(vectors.agg(F.count("*")).scalar().alias("v"), metadata.agg(F.count("*")).scalar().alias("m"))
    guard = F.assert_true(n["v"] == n["m"], F.lit("vector and metadata row counts differ"))
    return vectors.join(metadata, key).filter(guard.isNull())


# Columns of an atom loop by their names in its header, in the usual order
# of a row, which stands for files without a header.
ATOM_COLUMNS = {
    "group_PDB": "group", "id": "serial", "type_symbol": "element", "label_atom_id": "atom", "label_alt_id": "alt", "label_comp_id": "residue",
    "label_asym_id": "subchain", "label_entity_id": "entity", "label_seq_id": "label_seq", "pdbx_PDB_ins_code": "ins",
    "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "occupancy": "occupancy", "B_iso_or_equiv": "b_factor", "pdbx_formal_charge": "charge",
    "auth_seq_id": "auth_seq", "auth_comp_id": "auth_residue", "auth_asym_id": "chain", "auth_atom_id": "auth_atom", "pdbx_PDB_model_num": "model",
}
ATOM_LOOP = "_atom_site."
#: Files with a header whose column names are broadcast at most; more are joined by shuffle.
BROADCAST_HEADERS = 50_000


def atom_scan(spark: SparkSession, path: str | list[str], id_pattern: str = r"([0-9A-Za-z]{4})[^/]*$") -> DataFrame:
    """C-alpha rows of many coordinate files with the representative chain.

    Columns are found by the names in the file's loop header, in any order; they are
    read once per file and joined to the rows of all its splits. A column that the
    header lacks is null. ``ATOM`` rows only (het residues carry another tag), first
    model, atom name CA. The representative chain of an entity is the chain of its first atom.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    named = text.filter(F.col("value").startswith(ATOM_LOOP)).select("_file", F.struct("_start", F.monotonically_increasing_id().alias("at"), F.trim(F.substring("value", len(ATOM_LOOP) + 1, 64)).alias("name")).alias("h"))
    headers = named.groupBy("_file").agg(F.array_sort(F.collect_list("h")).alias("h"))  # the columns of one file
    headers = cut_lineage(headers.select("_file", F.transform("h", lambda x: x["name"]).alias("_names")))
    near = F.broadcast(headers) if headers.limit(BROADCAST_HEADERS + 1).count() <= BROADCAST_HEADERS else headers
    usual = F.array(*map(F.lit, ATOM_COLUMNS))
    lines = text.filter(F.col("value").startswith("ATOM ")).join(near, "_file", "left").withColumns({"_names": F.coalesce("_names", usual), "_cells": F.split(F.trim("value"), r"\s+")})
    cell = lambda name: F.get("_cells", F.array_position("_names", name).cast("int") - 1)
    rows = lines.select(F.regexp_extract("_file", id_pattern, 1).alias("pdb_id"), *[cell(k).alias(v) for k, v in ATOM_COLUMNS.items() if v in ("atom", "model", "label_seq", "entity", "chain", "serial", "x", "y", "z")])
    ca = rows.filter((F.col("atom") == "CA") & (F.col("model") == "1") & F.col("label_seq").rlike(r"^\d+$")).select(
        "pdb_id",
        F.col("entity").cast("int").alias("entity"),
        "chain",
        F.col("serial").cast("long").alias("serial"),
        F.col("label_seq").cast("int").alias("label_seq"),
        *[F.col(c).cast("double").alias(c) for c in "xyz"],
    )
    first = ca.groupBy("pdb_id", "entity").agg(F.min_by("chain", "serial").alias("rep_chain"))
    return ca.join(first, ["pdb_id", "entity"]).select(
        "pdb_id", "entity", "chain", "label_seq", "x", "y", "z", (F.col("chain") == F.col("rep_chain")).alias("is_representative")
    )


def matrix_unpivot(wide: DataFrame, row: str = "cluster") -> DataFrame:
    """Wide square matrix to (i, j, sim)."""
    return wide.unpivot(row, [c for c in wide.columns if c != row], "j", "sim").withColumnRenamed(row, "i")


def union_chunks(spark: SparkSession, base: str, expected: DataFrame, schema) -> DataFrame:
    """Append the outputs of all chunks under ``<base>/chunk_id=<id>``.

    ``expected`` is (chunk_id); one of them without output is an error, raised
    before rows are given out. Chunks are found by Spark's reader, not by a list.
    """
    df = spark.read.schema(schema).parquet(base)
    lost = missing_chunks(expected, df)
    if not lost.isEmpty():
        raise ValueError(f"chunks without output, among them {lost.first()[0]!r}")
    return df.join(expected.select("chunk_id").distinct(), "chunk_id", "left_semi").select(*df.columns)


def missing_chunks(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.select("chunk_id").distinct().join(found.select("chunk_id").distinct(), "chunk_id", "left_anti")


def union_tables(tables: dict[str, DataFrame], tag: str = "chunk_id") -> DataFrame:
    """Append tables of the same columns with a tag naming their origin."""
    return reduce(DataFrame.unionByName, [t.withColumn(tag, F.lit(k)) for k, t in tables.items()])
