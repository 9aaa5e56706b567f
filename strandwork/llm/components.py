"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of ``links`` (a, b) reaches.

    Every round a node takes the least label of itself and its neighbours, and
    then the label of that label, so that chains shorten by half and more. Labels
    only fall, and the rounds end when none does.
    """
    both = cut_lineage(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = cut_lineage(low.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")))
        changed = new.filter("comp <> old").limit(1).count()
        drop_table(label)
        label = new
        if not changed:
            drop_table(both)
            return label.select("node", "comp")
