"""Connected components of a graph given by its edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (u, v): comp is the least node reachable.

    Labels spread over the edges and are then replaced by their own labels (pointer jumping), until none
    changes; a star takes two rounds.  Sums at hot nodes are map-side combined; every round is written to the
    shared folder.
    """
    both = stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "cc-labels")
    while True:
        spread = both.join(labels, F.col("u") == F.col("node")).groupBy(F.col("v").alias("n")).agg(F.min("comp").alias("c"))
        lower = labels.join(spread, F.col("node") == F.col("n")).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("to"))
        new = stored(lower.join(jump, F.col("comp") == F.col("at"), "left").select("node", "old", F.least("comp", F.coalesce("to", "comp")).alias("comp")), "cc-labels")
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return labels
