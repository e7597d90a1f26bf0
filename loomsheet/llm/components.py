"""Connected components of a graph of links, as joins: least labels over the links, then labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, label): label is the least node of the component. Only nodes with links are in it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a != b").distinct(), "links-both-ways")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("was")
        )
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("above"))
        new = least.join(up, F.col("label") == F.col("via"), "left").select(
            "node", F.least("label", "above").alias("label"), "was"
        )
        new = stored(new, "labels")
        labels = new.select("node", "label")
        if not new.where("label != was").head(1):
            return labels
