"""Exact lookups as joins: the first hit in row order, #N/A for a miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vlookup(df: DataFrame, key: Column, table: DataFrame, on: str, value: str, order: str, name: str = "v", err: str = "e") -> DataFrame:
    """df with the value of the first row of table (in order) whose ``on`` equals key, and #N/A beside a miss."""
    first = table.where(F.col(on).isNotNull()).groupBy(F.col(on).alias("__on"))
    first = first.agg(F.min_by(F.col(value), F.col(order)).alias(name))
    joined = df.withColumn("__key", key).join(first, F.col("__key") == F.col("__on"), "left")
    missed = F.when(F.col("__on").isNull(), F.lit("#N/A"))
    return joined.withColumn(err, missed).drop("__key", "__on")


def match(df: DataFrame, key: Column, table: DataFrame, on: str, row: str, name: str = "v", err: str = "e") -> DataFrame:
    """df with the 1-based position, from table's row column, of the first row whose ``on`` equals key."""
    return vlookup(df, key, table, on, row, row, name, err)


def vlookup_column(
    df: DataFrame, key: Column, key_error: Column, k: Column, table: DataFrame, on: str, on_error: str, order: str, columns: list[str]
) -> DataFrame:
    """df with v and e of VLOOKUP(key, table, k, FALSE), where cells may be errors and k is data.

    In this order: k below 1 is #VALUE!, k beyond the columns #REF!, then the key's own error; an error in the key column before
    the first hit, or anywhere for a miss, is the result; else a miss is #N/A.
    """
    hits = table.where(F.col(on_error).isNull() & F.col(on).isNotNull()).groupBy(F.col(on).alias("__on"))
    hits = hits.agg(F.min(F.struct(F.col(order).alias("at"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))).alias("__hit"))
    bad = table.where(F.col(on_error).isNotNull()).agg(F.min(F.struct(F.col(order).alias("at"), F.col(on_error).alias("e"))).alias("__bad"))
    place = F.floor(k)
    rows = df.withColumns({"__key": key, "__key_error": key_error, "__k": place})
    rows = rows.join(hits, F.col("__key") == F.col("__on"), "left").join(F.broadcast(bad))
    before = F.col("__bad").isNotNull() & (F.col("__hit").isNull() | (F.col("__bad.at") < F.col("__hit.at")))
    err = (
        F.when(F.col("__k") < 1, F.lit("#VALUE!"))
        .when(F.col("__k") > len(columns), F.lit("#REF!"))
        .when(F.col("__key_error").isNotNull(), F.col("__key_error"))
        .when(before, F.col("__bad.e"))
        .when(F.col("__hit").isNull(), F.lit("#N/A"))
    )
    value = F.get(F.array(*(F.col(f"__hit.c{i}") for i in range(len(columns)))), (F.col("__k") - 1).cast("int"))
    return rows.select(*df.columns, F.when(err.isNull(), value).alias("v"), err.alias("e"))


def match_area(
    df: DataFrame, key: Column, key_error: Column, table: DataFrame, on: str, on_error: str, row: str, width: int = 1
) -> DataFrame:
    """df with v and e of MATCH(key, column, 0): the key's error first, #VALUE! for an area of several columns (and rows), an
    error in the column before the hit, #N/A for a miss."""
    if width > 1:
        return df.withColumns({"v": F.lit(None).cast("double"), "e": F.coalesce(key_error, F.lit("#VALUE!"))})
    found = vlookup_column(df, key, key_error, F.lit(1), table, on, on_error, row, [row])
    return found


def index_area(df: DataFrame, r: Column, c: Column, table: DataFrame, row: str, columns: list[str], rows: int) -> DataFrame:
    """df with v and e of INDEX(area, r, c): #VALUE! where r or c is below 1, #REF! beyond the area."""
    side = table.select(F.col(row).alias("__row"), F.array(*(F.col(x).cast("double") for x in columns)).alias("__cells"))
    at = df.withColumns({"__r": F.floor(r), "__c": F.floor(c)}).join(side, F.col("__r") == F.col("__row"), "left")
    low = (F.col("__r") < 1) | (F.col("__c") < 1)
    err = F.when(low, F.lit("#VALUE!")).when((F.col("__r") > rows) | (F.col("__c") > len(columns)), F.lit("#REF!"))
    value = F.get("__cells", (F.col("__c") - 1).cast("int"))
    return at.select(*df.columns, F.when(err.isNull(), value).alias("v"), err.alias("e"))


def index(df: DataFrame, at: Column, table: DataFrame, row: str, value: str, rows: Column, name: str = "v", err: str = "e") -> DataFrame:
    """df with table's value at row ``at``: #VALUE! below 1, #REF! beyond rows."""
    place = F.floor(at)
    side = table.select(F.col(row).alias("__row"), F.col(value).alias(name))
    joined = df.withColumn("__at", place).join(side, F.col("__at") == F.col("__row"), "left")
    bad = F.when(F.col("__at") < 1, F.lit("#VALUE!")).when(F.col("__at") > rows, F.lit("#REF!"))
    return joined.withColumn(err, bad).drop("__at", "__row")


def match_in_row(key: Column, values: list[Column]) -> tuple[Column, Column]:
    """MATCH over cells of one row: position and error."""
    place = F.array_position(F.array(*values), key)
    return F.when(place > 0, place), F.when(place == 0, F.lit("#N/A"))


def rects_hit(points: DataFrame, rects: DataFrame, size: int = 1024) -> DataFrame:
    """Points (point, row, col) with the rectangles (rect, top, left, bottom, right) that contain them.

    A range join: rectangles are listed under each block of size x size cells that they touch, points under their own, so the
    join is on equal blocks and the bounds are checked after it.
    """
    block = lambda c: F.floor(F.col(c) / size)
    wide = rects.withColumn("__r", F.explode(F.sequence(block("top"), block("bottom"))))
    wide = wide.withColumn("__c", F.explode(F.sequence(block("left"), block("right"))))
    own = points.withColumns({"__r": block("row"), "__c": block("col")})
    inside = F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    return own.join(wide, ["__r", "__c"]).where(inside).select("point", "rect")
