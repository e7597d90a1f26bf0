"""Dynamic arrays: extents, blockage between extents and what stands in their way, and published cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.sources.tables import stored

#: Grid bounds.
MAX_ROWS, MAX_COLS = 1_048_576, 16_384
#: Cells to a side of a block of the spatial join.
SIDE = 256


def _blocks(df: DataFrame) -> DataFrame:
    part = lambda c: F.floor(F.col(c) / SIDE)
    rows = df.withColumn("__r", F.explode(F.sequence(part("top"), part("bottom"))))
    return rows.withColumn("__c", F.explode(F.sequence(part("left"), part("right"))))


def blocked(extents: DataFrame, blockers: DataFrame) -> DataFrame:
    """extents(anchor, top, left, bottom, right) with blocked: out of the grid, or met by a blocker other than its own anchor.

    blockers has the same rectangle columns and an owner, the anchor of the extent that it belongs to, or null.
    """
    outside = (F.col("bottom") > MAX_ROWS) | (F.col("right") > MAX_COLS)
    a = _blocks(extents.where(~outside))
    b = _blocks(blockers).select("owner", *(F.col(c).alias(f"b_{c}") for c in ("top", "left", "bottom", "right")), "__r", "__c")
    meet = (F.col("top") <= F.col("b_bottom")) & (F.col("b_top") <= F.col("bottom"))
    meet &= (F.col("left") <= F.col("b_right")) & (F.col("b_left") <= F.col("right"))
    other = F.col("owner").isNull() | (F.col("owner") != F.col("anchor"))
    hit = a.join(b, ["__r", "__c"]).where(meet & other).select("anchor").distinct().withColumn("__hit", F.lit(True))
    return extents.join(hit, "anchor", "left").withColumn("blocked", outside | F.col("__hit").isNotNull()).drop("__hit")


def arbitrated(extents: DataFrame, blockers: DataFrame) -> DataFrame:
    """Extents against fixed blockers and each other's: mutual overlap blocks both."""
    own = extents.select(F.col("anchor").alias("owner"), "top", "left", "bottom", "right")
    return blocked(extents, blockers.unionByName(own))


def published(extents: DataFrame, values: DataFrame) -> DataFrame:
    """(anchor, row, col, v, e): the cells of unblocked extents from values(anchor, i, j, v), and #SPILL! at blocked anchors."""
    free = extents.where("not blocked").join(values, "anchor").select(
        "anchor", (F.col("top") + F.col("i")).alias("row"), (F.col("left") + F.col("j")).alias("col"), "v", F.lit(None).cast("string").alias("e")
    )
    stuck = extents.where("blocked").select(
        "anchor", F.col("top").alias("row"), F.col("left").alias("col"), F.lit(None).cast("double").alias("v"), F.lit("#SPILL!").alias("e")
    )
    return free.unionByName(stuck)


def epochs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Spill facts (anchor, rows, blocked, digest, epoch) after a recalculation: the epoch rises only where a fact changed."""
    a = old.select("anchor", F.struct("rows", "blocked", "digest").alias("was"), "epoch")
    same = F.col("was").eqNullSafe(F.struct("rows", "blocked", "digest"))
    return new.join(a, "anchor", "left").select(
        "anchor", "rows", "blocked", "digest", (F.coalesce("epoch", F.lit(0)) + F.when(same, 0).otherwise(1)).alias("epoch")
    )


def repaired(facts: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """Facts (anchor, rows, blocked) after evaluating them again from the facts before until none changes.

    step gives the new facts; formulas that read other spills see those of the round before. Raises where they do not settle.
    """
    now = stored(facts.select("anchor", "rows", "blocked"), "spill-facts")
    for _ in range(most):
        new = stored(step(now).select("anchor", "rows", "blocked"), "spill-facts")
        if not new.exceptAll(now).head(1):
            return new
        now = new
    raise ValueError(f"spills do not settle in {most} rounds")


def vacated(old: DataFrame, new: DataFrame) -> DataFrame:
    """(anchor, row): the rows of old extents (anchor, top, bottom) that the new ones no longer reach, to be cleared."""
    both = old.select("anchor", F.col("top").alias("__t"), F.col("bottom").alias("__b")).join(new.select("anchor", "top", "bottom"), "anchor", "left")
    cells = both.select("anchor", "top", "bottom", F.explode(F.sequence("__t", "__b")).alias("row"))
    return cells.where("top is null or row < top or row > bottom").select("anchor", "row")


def consumers_to_run(before: DataFrame, after: DataFrame, consumers: DataFrame) -> DataFrame:
    """(consumer): those of consumers(consumer, anchor) that read a spill whose epoch rose."""
    was = before.select("anchor", F.col("epoch").alias("__was"))
    risen = after.join(was, "anchor", "left").where(F.col("__was").isNull() | (F.col("epoch") > F.col("__was")))
    return consumers.join(risen.select("anchor"), "anchor", "left_semi").select("consumer").distinct()
