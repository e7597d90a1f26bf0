"""Selectors over trees of named nodes (node, parent, ord), as joins and windows over siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.plans import ordered
from loomsheet.sources.tables import stored

#: Steps down a tree before a cycle is suspected.
DEEPEST = 64


def children(nodes: DataFrame) -> DataFrame:
    """(node, child, ord)."""
    return nodes.where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("child"), "ord")


def preceding(nodes: DataFrame, value: str, name: str = "v") -> DataFrame:
    """(node, v): the sum of value over the siblings before each node, in blocks: a parent of many children is not one task."""
    placed = ordered.in_blocks(nodes.select("node", "parent", "ord", F.col(value).alias("__x")), "parent", "ord")
    rows = ordered.scan(placed, ["ord"], name, F.sum, F.col("__x"), ["parent"], before=True)
    return rows.select("node", F.coalesce(name, F.lit(0.0)).alias(name))


def following(nodes: DataFrame, value: str, name: str = "v") -> DataFrame:
    return preceding(nodes.withColumn("ord", -F.col("ord")), value, name)


def ancestors(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, ancestor, distance): nearest first, the root left out."""
    up = nodes.select(F.col("node").alias("at"), "parent")
    level = stored(starts.select("node", F.col("node").alias("at")), "tree")
    found = None
    for distance in range(1, DEEPEST):
        level = level.join(up, "at").where("parent is not null").select("node", F.col("parent").alias("at"))
        level = stored(level, "tree")
        if not level.head(1):
            break
        part = level.join(up, "at").where("parent is not null").select(
            "node", F.col("at").alias("ancestor"), F.lit(distance).alias("distance")
        )
        found = part if found is None else found.unionByName(part)
    else:
        raise ValueError("deeper than DEEPEST: a cycle of parents?")
    if found is None:
        return starts.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).limit(0)
    return found


def descendants(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, descendant, path): path sorts in pre-order."""
    down = nodes.select(F.col("parent").alias("at"), F.col("node").alias("child"), "ord")
    step = F.format_string("%010d", F.col("ord").cast("long"))
    level = starts.select("node", F.col("node").alias("at"), F.lit("").alias("path"))
    found = None
    for _ in range(DEEPEST):
        level = level.join(down, "at").select("node", F.col("child").alias("at"), F.concat("path", step).alias("path"))
        level = stored(level, "tree")
        if not level.head(1):
            break
        found = level if found is None else found.unionByName(level)
    else:
        raise ValueError("deeper than DEEPEST: a cycle of parents?")
    if found is None:
        found = level
    return found.select("node", F.col("at").alias("descendant"), "path")


def at_paths(nodes: DataFrame, paths: DataFrame, name: str = "name") -> DataFrame:
    """paths(path: array of names from the root's children on) with node, null where a step names no child.

    nodes has node, parent, ord and a name. A step is a join on (parent, name), and there are as many as the deepest path has.
    """
    down = nodes.select(F.col("parent").alias("__p"), F.col(name).alias("__name"), F.col("node").alias("__n"))
    deepest = paths.agg(F.max(F.size("path"))).first()[0] or 0
    root = nodes.where("parent is null").select(F.col("node").alias("node"))
    rows = paths.join(F.broadcast(root))
    for i in range(deepest):
        step = F.get("path", F.lit(i))
        rows = rows.join(down, (F.col("node") == F.col("__p")) & (step == F.col("__name")), "left")
        rows = rows.withColumn("node", F.when(step.isNull(), F.col("node")).otherwise(F.col("__n"))).drop("__p", "__name", "__n")
    return rows


def sibling_at(nodes: DataFrame, by: int) -> DataFrame:
    """(node, sibling): the node ``by`` places further among its siblings, null beyond the first or last."""
    placed = ordered.in_blocks(nodes.where("parent is not null").select("node", "parent", "ord"), "parent", "ord")
    at = ordered.scan(placed, ["ord"], "at", F.sum, F.lit(1), ["parent"]).select("node", "parent", "at")
    other = at.select(F.col("node").alias("sibling"), F.col("parent").alias("__p"), F.col("at").alias("__at"))
    return at.join(other, (F.col("parent") == F.col("__p")) & (F.col("at") + by == F.col("__at")), "left").select("node", "sibling")
