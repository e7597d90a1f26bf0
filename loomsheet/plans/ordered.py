"""Row addresses, running values and row-offset references over ordered sheets, without one task that sees all rows.

Rows are put into blocks by ranges of their order, as many blocks as it takes to keep each near BLOCK_ROWS rows, and stored
once. Sorting stays inside blocks; what a block needs from those before it is one value a block (a count, sum or maximum), or
copies of the last rows before it (a halo).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomsheet.sources.tables import stored

#: Rows of a block, about.
BLOCK_ROWS = 1 << 16
BLOCK = "__block"
Order = Sequence[Column | str]


def in_blocks(df: DataFrame, *order: Column | str, rows: int = BLOCK_ROWS) -> DataFrame:
    """df with __block, counted up along the order; rows of one order value are in one block. Runs the job that deals them."""
    n = max(1, -(-df.count() // rows))
    return stored(df.repartitionByRange(n, *order).withColumn(BLOCK, F.spark_partition_id()), "ordered")


def scan(
    placed: DataFrame,
    order: Order,
    name: str,
    aggregate: Callable[[Column], Column],
    value: Column,
    by: Sequence[str] = (),
    before: bool = False,
) -> DataFrame:
    """placed (as :func:`in_blocks` gives it, in order of ``by`` and then ``order``) with name: the sum or maximum of value over
    the rows of equal ``by`` up to this one, or before it; null where there is none."""
    if aggregate not in (F.sum, F.max):
        raise ValueError("a sum or a maximum")
    last = -1 if before else W.currentRow
    inside = W.partitionBy(BLOCK, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, last)
    parts = placed.groupBy(BLOCK, *by).agg(aggregate(value).alias("__part"))
    upto = W.partitionBy(*by).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    names = {c: f"__of_{c}" for c in (BLOCK, *by)}
    base = parts.select(*(F.col(c).alias(n) for c, n in names.items()), aggregate("__part").over(upto).alias("__base"))
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    own, base_value = F.col(name), F.col("__base")
    both = F.greatest(own, base_value) if aggregate is F.max else F.coalesce(own + base_value, own, base_value)
    joined = placed.withColumn(name, aggregate(value).over(inside)).join(base, same)
    return joined.withColumn(name, both).drop("__base", *names.values())


def numbered(placed: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """placed with its row number, from 1."""
    return scan(placed, order, name, F.sum, F.lit(1).cast("long"))


def addressed(df: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """df with its row number (from 1) along the order; order values must be unique."""
    return numbered(in_blocks(df, *order), *order, name=name).drop(BLOCK)


def running_sum(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return scan(in_blocks(df, key), [key], name, F.sum, value).drop(BLOCK)


def _block_spans(placed: DataFrame) -> DataFrame:
    """(__at, __before, __count): for each block the rows before it and in it."""
    counts = placed.groupBy(F.col(BLOCK).alias("__at")).agg(F.count(F.lit(1)).alias("__count"))
    upto = W.orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum("__count").over(upto), F.lit(0)))


def rows_at(df: DataFrame, *order: Column | str, first: int, last: int, name: str = "row") -> DataFrame:
    """Rows first to last along the order, with their numbers: only the blocks that hold them are sorted."""
    placed = in_blocks(df, *order)
    spans = _block_spans(placed).where((F.col("__before") < last) & (F.col("__before") + F.col("__count") >= first))
    held = placed.join(spans, F.col(BLOCK) == F.col("__at"))
    number = F.row_number().over(W.partitionBy(BLOCK).orderBy(*order)) + F.col("__before")
    held = held.withColumn(name, number).drop(BLOCK, "__at", "__before", "__count")
    return held.where(F.col(name).between(first, last))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles, interpolated between neighbours: block counts lead to the blocks of the ranks, only those are sorted."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    placed = in_blocks(values, "x")
    n = placed.count()
    if not n:
        return []
    spots = [s * (n - 1) for s in shares]
    ranks = sorted({r for s in spots for r in (int(s) + 1, min(n, int(s) + 2))})
    spans = _block_spans(placed)
    asked = spans.withColumn("__rank", F.explode(F.array(*map(F.lit, ranks))))
    asked = asked.where((F.col("__rank") > F.col("__before")) & (F.col("__rank") <= F.col("__before") + F.col("__count")))
    place = F.row_number().over(W.partitionBy(BLOCK).orderBy("x"))
    near = placed.join(asked.select("__at").distinct(), F.col(BLOCK) == F.col("__at"), "left_semi").withColumn("__place", place)
    found = near.join(asked, (F.col(BLOCK) == F.col("__at")) & (F.col("__place") + F.col("__before") == F.col("__rank")))
    # a row for each rank that was asked for
    at = {r: x for r, x in found.select("__rank", "x").collect()}
    return [at[int(s) + 1] + (s - int(s)) * (at[min(n, int(s) + 2)] - at[int(s) + 1]) for s in spots]


def thresholds(df: DataFrame, column: str, kinds: Sequence[tuple[str, float | None]]) -> list[float]:
    """Numbers for (kind, value): min, mid and max of the column, number, percent of its range, exact percentile."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    ranks = [v / 100 for kind, v in kinds if kind == "percentile"]
    found = iter(quantiles(df, column, ranks) if ranks else ())
    def one(kind: str, value: float | None) -> float:
        if kind == "number":
            return float(value)
        if kind == "percentile":
            return next(found)
        if kind == "mid":
            return (low + high) / 2
        if kind in ("min", "max"):
            return low if kind == "min" else high
        if kind == "percent":
            return low + value / 100 * (high - low)
        raise ValueError(kind)

    return [one(*k) for k in kinds]


def offset_frames(df: DataFrame, halo: int, columns: dict[str, Column], row: str = "row", rows: int = BLOCK_ROWS) -> DataFrame:
    """Window expressions (over :func:`frame`) that look at most ``halo`` rows back, by blocks with copies of the rows before."""
    block = F.floor((F.col(row) - 1) / rows)
    near_end = (F.col(row) - 1) % rows >= rows - halo
    places = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    wide = df.withColumn("__home", block).withColumn("__frame", F.explode(places))
    return wide.withColumns(columns).where("__home = __frame").drop("__home", "__frame")


def frame(row: str = "row") -> W:
    return W.partitionBy("__frame").orderBy(row)
