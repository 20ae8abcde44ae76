"""Connected components of a table of links, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, comp) for each end of a link: comp is the least node that can be reached.

    ``links`` has the columns a and b. Each round takes the least label among the
    neighbours and then that label's own label, so chains halve; every round is a written
    table. A node with very many links is one key of an aggregate that combines before its
    shuffle, and the labels joined to the links have one row a node. No links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.filter("a <> b").distinct(), f"{tag}-ends", 2 * links.count())
    rows = both.count()
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                          .select("node", F.least("node", "low").alias("comp")), f"{tag}-0", rows)
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("comp").alias("low"))
        own = labels.join(near, "node").select("node", F.least("comp", "low").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = scratch.keep(own.join(jump, "comp").select("node", F.least("comp", "next").alias("comp"), "was"),
                           f"{tag}-{turn}", rows)
        moved = new.filter("comp < was").limit(1).count()
        scratch.drop(f"{tag}-{turn - 1}")
        labels = new.select("node", "comp")
        if not moved:
            return labels
