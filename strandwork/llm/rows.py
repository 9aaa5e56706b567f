"""Row numbers and small plan helpers shared by the document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, free_shuffles


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def number_rows(df: DataFrame, row: str = "_row", ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``df`` in the order of ``ident`` with a unique number that rises along it.

    Nulls come first; rows of one id are ordered by the hash of their text, so
    one id may stand on any number of rows. The number is the range partition
    in the upper bits and the place in it below; it is unique, not gapless. The
    rows lie in a written table: lost executors cannot renumber them.
    """
    order = [F.col(ident).asc_nulls_first(), F.xxhash64(text_of(text))]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    out = cut_lineage(ranged.withColumn(row, F.monotonically_increasing_id()))
    free_shuffles(df.sparkSession)
    return out
