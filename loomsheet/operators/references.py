"""References as data: texts that name cells, moved and resized areas, areas between two references, lists of references.

Cells are in long form: (sheet, row, col, v, e), only those that hold something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.operators.lookups import rects_hit
from loomsheet.operators.spills import MAX_COLS, MAX_ROWS

_A1 = r"^(?:'?([^'!]+)'?!)?\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$"


def column_number(letters: Column) -> Column:
    """A is 1, Z is 26, AA is 27."""
    digits = F.transform(F.split(F.upper(letters), ""), lambda c: F.when(c != "", F.ascii(c) - 64).otherwise(0))
    return F.aggregate(digits, F.lit(0), lambda a, d: F.when(d > 0, a * 26 + d).otherwise(a))


def a1_address(text: Column) -> Column:
    """Struct(sheet, row, col) of a text like Sheet!$B$7, without sheet where it names none; null where it is no address."""
    part = lambda i: F.regexp_extract(text, _A1, i)
    row, col = part(3).try_cast("long"), column_number(part(2)).cast("long")
    sheet = F.when(part(1) != "", part(1))
    inside = row.between(1, MAX_ROWS) & col.between(1, MAX_COLS)
    return F.when((part(3) != "") & inside, F.struct(sheet.alias("sheet"), row.alias("row"), col.alias("col")))


def indirect(df: DataFrame, text: str, own_sheet: Column, sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """df with v and e of the cell that the column ``text`` names. sheets(sheet) are those that exist; an address that is none,
    or on a sheet that does not exist, is #REF!; a cell that holds nothing is blank."""
    at = df.withColumn("__at", a1_address(F.col(text)))
    at = at.withColumn("__sheet", F.when(F.col("__at").isNotNull(), F.lower(F.coalesce("__at.sheet", own_sheet))))
    known = sheets.select(F.lower("sheet").alias("__known")).distinct()
    at = at.join(known, F.col("__sheet") == F.col("__known"), "left")
    side = cells.select(F.lower("sheet").alias("__s"), F.col("row").alias("__r"), F.col("col").alias("__c"), "v", "e")
    same = (F.col("__sheet") == F.col("__s")) & (F.col("__at.row") == F.col("__r")) & (F.col("__at.col") == F.col("__c"))
    found = at.join(side, same, "left")
    err = F.when(F.col("__known").isNull(), F.lit("#REF!")).otherwise(F.col("e"))
    return found.select(*df.columns, F.when(err.isNull(), F.col("v")).alias("v"), err.alias("e"))


def offset_area(
    top: Column,
    left: Column,
    rows: Column,
    cols: Column,
    height: Column | int = 1,
    width: Column | int = 1,
    limits: tuple[int, int] | None = (MAX_ROWS, MAX_COLS),
) -> tuple[Column, ...]:
    """Top, left, bottom, right and error of OFFSET(cell, rows, cols, height, width); a negative extent reaches backwards.

    limits: the last row and column, beyond which an area is #REF!; None for a table, which may have more rows than a sheet.
    """
    height, width = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    t, l = top + F.floor(rows), left + F.floor(cols)
    t0, l0 = F.when(height < 0, t + height + 1).otherwise(t), F.when(width < 0, l + width + 1).otherwise(l)
    b, r = t0 + F.abs(height) - 1, l0 + F.abs(width) - 1
    bad = (height == 0) | (width == 0) | (t0 < 1) | (l0 < 1)
    if limits is not None:
        bad |= (b > limits[0]) | (r > limits[1])
    return (*(F.when(~bad, x) for x in (t0, l0, b, r)), F.when(bad, F.lit("#REF!")))


def area_sums(areas: DataFrame, cells: DataFrame, block: int = 1024) -> DataFrame:
    """(rect, v): the sum over each area (rect, top, left, bottom, right) of the cells (row, col, v) in it, blanks left out."""
    points = cells.select(F.struct("row", "col", "v").alias("point"), "row", "col")
    return rects_hit(points, areas, block).groupBy("rect").agg(F.sum("point.v").alias("v"))


def hull(a: Column, b: Column) -> tuple[Column, Column]:
    """The area between two cells (structs of sheet, row, col), and the error: an end without sheet takes the other's, ends on
    two sheets have no hull."""
    sheet = F.coalesce(a["sheet"], b["sheet"])
    apart = a["sheet"].isNotNull() & b["sheet"].isNotNull() & (F.lower(a["sheet"]) != F.lower(b["sheet"]))
    area = F.struct(
        sheet.alias("sheet"),
        F.least(a["row"], b["row"]).alias("top"),
        F.least(a["col"], b["col"]).alias("left"),
        F.greatest(a["row"], b["row"]).alias("bottom"),
        F.greatest(a["col"], b["col"]).alias("right"),
    )
    return F.when(~apart, area), F.when(apart, F.lit("#REF!"))


def gathered(df: DataFrame, references: Column, cells: DataFrame) -> DataFrame:
    """df's rows, one for each reference (struct of row and col) of the list, with place (from 0), v and e of its cell."""
    wide = df.select("*", F.posexplode(references).alias("place", "__to"))
    side = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "v", "e")
    found = wide.join(side, (F.col("__to.row") == F.col("__r")) & (F.col("__to.col") == F.col("__c")), "left")
    return found.drop("__to", "__r", "__c")


def moved_cells(df: DataFrame, axis: str, first: int, n: int) -> DataFrame:
    """Cells after n rows or columns (axis: their column) came in before first, or, with n below 0, went from first on."""
    if n >= 0:
        return df.withColumn(axis, F.when(F.col(axis) >= first, F.col(axis) + n).otherwise(F.col(axis)))
    kept = df.where(~F.col(axis).between(first, first - n - 1))
    return kept.withColumn(axis, F.when(F.col(axis) >= first - n, F.col(axis) + n).otherwise(F.col(axis)))


def moved_point(at: Column, first: int, n: int) -> tuple[Column, Column]:
    """A reference to a row or column after the same edit, and #REF! where what it names is gone."""
    gone = at.between(first, first - n - 1) if n < 0 else F.lit(False)
    return F.when(~gone, F.when(at >= first, at + n).otherwise(at)), F.when(gone, F.lit("#REF!"))
