"""Aggregates over whole columns and areas: one pass with partial sums, the first error in row order ends them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.functions.cells import error_of_rank, error_rank


def column_aggregates(df: DataFrame, num: Column, err: Column | None = None, order: Column | None = None) -> DataFrame:
    """One row: s, q, n, p, a, lo, hi of num and e, the error that comes first in order (they are null beside it)."""
    first = F.lit(None).cast("string")
    if err is not None:
        first = F.min_by(F.when(err.isNotNull(), err), F.when(err.isNotNull(), order))
    n = F.count(num)
    rows = df.agg(
        first.alias("e"),
        F.coalesce(F.sum(num), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(num * num), F.lit(0.0)).alias("q"),
        n.cast("double").alias("n"),
        F.when(n == 0, 0.0).otherwise(F.product(num)).alias("p"),
        F.try_divide(F.sum(num), n).alias("a"),
        F.coalesce(F.min(num), F.lit(0.0)).alias("lo"),
        F.coalesce(F.max(num), F.lit(0.0)).alias("hi"),
    )
    names = ("s", "q", "n", "p", "a", "lo", "hi")
    return rows.select("e", *(F.when(F.col("e").isNull(), F.col(c)).alias(c) for c in names))


def dominant_error(df: DataFrame, err: Column) -> DataFrame:
    """One row: the error of least rank."""
    return df.agg(error_of_rank(F.min(error_rank(err))).alias("e"))


#: SUBTOTAL function numbers and what they compute; from 101 on rows hidden by hand are left out too.
SUBTOTALS = {
    1: lambda x: F.try_divide(F.sum(x), F.count(x)),
    2: lambda x: F.count(x).cast("double"),
    3: lambda x: F.count(x).cast("double"),
    4: lambda x: F.coalesce(F.max(x), F.lit(0.0)),
    5: lambda x: F.coalesce(F.min(x), F.lit(0.0)),
    6: lambda x: F.coalesce(F.product(x), F.lit(0.0)),
    7: lambda x: F.stddev_samp(x),
    8: lambda x: F.stddev_pop(x),
    9: lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    10: lambda x: F.var_samp(x),
    11: lambda x: F.var_pop(x),
}


def subtotal(df: DataFrame, code: int, num: Column, filtered: Column, hidden: Column) -> DataFrame:
    """One row: v. Rows hidden by a filter never count; rows hidden by hand count for codes 1 to 11."""
    seen = ~filtered if code < 100 else ~filtered & ~hidden
    return df.where(seen).agg(SUBTOTALS[code % 100](num).alias("v"))


def aggregate_option(df: DataFrame, code: int, option: int, num: Column, err: Column, hidden: Column, nested: Column) -> DataFrame:
    """One row, v and e, of AGGREGATE(code, option, area): options 0 to 3 leave out cells that hold subtotals themselves, odd ones
    hidden rows, and 2, 3, 6 and 7 errors; an error that is not left out is the result, the first of ERRORS in rank."""
    rows = df.select(num.alias("x"), err.alias("e"), hidden.alias("h"), nested.alias("n"))
    if option < 4:
        rows = rows.where("not n")
    if option % 2:
        rows = rows.where("not h")
    if option % 4 >= 2:
        rows = rows.where("e is null")
    found = rows.agg(SUBTOTALS[code](F.when(F.col("e").isNull(), F.col("x"))).alias("v"), error_of_rank(F.min(error_rank(F.col("e")))).alias("e"))
    return found.select(F.when(F.col("e").isNull(), F.col("v")).alias("v"), "e")


def reduced(df: DataFrame, group: Column, order: Column, num: Column, policy: str) -> DataFrame:
    """(g, v): the sum of each group's numbers in a declared order, by left fold, pairwise tree or Kahan's compensation.

    The order is the numbers' own and not that of partitions, so results are the same in every layout. A group is one array:
    groups are blocks of bounded size, whose sums are reduced again in the same way for a larger whole.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), num.alias("x")))), lambda s: s["x"])
    grouped = df.groupBy(group.alias("g")).agg(values.alias("x"))
    if policy == "left_fold":
        value = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    elif policy == "kahan":
        value = _kahan(F.col("x"))
    elif policy == "pairwise":
        # neighbours are added until one number is left; each step halves the array
        longest = grouped.agg(F.max(F.size("x"))).first()[0] or 1
        for _ in range(max(1, longest - 1).bit_length()):
            even = F.filter("x", lambda x, i: i % 2 == 0)
            odd = F.filter("x", lambda x, i: i % 2 == 1)
            grouped = grouped.withColumn("x", F.zip_with(even, odd, lambda a, b: a + F.coalesce(b, F.lit(0.0))))
        value = F.coalesce(F.get("x", F.lit(0)), F.lit(0.0))
    else:
        raise ValueError(policy)
    return grouped.select("g", value.alias("v"))


def _kahan(values: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, x: Column) -> Column:
        y = x - a["c"]
        t = a["s"] + y
        return F.struct(t.alias("s"), ((t - a["s"]) - y).alias("c"))

    return F.aggregate(values, zero, add, lambda a: a["s"])


def pyramid(df: DataFrame, row: str, num: Column, sizes: tuple[int, ...]) -> DataFrame:
    """Sums of blocks of sizes[0] rows, of sizes[1] of those blocks, and so on: (level, g, v), each level from the one before."""
    level = df.groupBy(F.floor((F.col(row) - 1) / sizes[0]).alias("g")).agg(F.sum(num).alias("v"))
    found = level.withColumn("level", F.lit(1))
    for i, size in enumerate(sizes[1:], 2):
        level = level.groupBy(F.floor(F.col("g") / size).alias("g")).agg(F.sum("v").alias("v"))
        found = found.unionByName(level.withColumn("level", F.lit(i)))
    return found.select("level", "g", "v")


def compensated_sum(df: DataFrame, row: str, num: Column, rows: int = 4096) -> DataFrame:
    """One row: v, a Kahan sum in a fixed order that no partitioning changes: within blocks of rows, then over the blocks."""

    kahan = _kahan
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x["x"])
    blocks = df.groupBy(F.floor((F.col(row) - 1) / rows).alias("b")).agg(
        kahan(ordered(F.col(row).alias("k"), num.alias("x"))).alias("x")
    )
    above = blocks.groupBy(F.floor(F.col("b") / rows).alias("k")).agg(
        kahan(ordered(F.col("b").alias("k"), F.col("x"))).alias("x")
    )
    return above.agg(kahan(ordered(F.col("k"), F.col("x"))).alias("v"))
