"""Structural edits, overlays of written cells, and differences between two revisions of a sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_rows(df: DataFrame, row: str, before: int, n: int) -> DataFrame:
    return df.withColumn(row, F.when(F.col(row) >= before, F.col(row) + n).otherwise(F.col(row)))


def delete_rows(df: DataFrame, row: str, first: int, n: int) -> DataFrame:
    kept = df.where(~F.col(row).between(first, first + n - 1))
    return kept.withColumn(row, F.when(F.col(row) >= first + n, F.col(row) - n).otherwise(F.col(row)))


def range_after_insert(top: Column, bottom: Column, before: int, n: int, most: int) -> tuple[Column, Column, Column]:
    """Top, bottom and outcome of a range of rows: it shifts, or grows where rows come inside, and is clipped at most."""
    new_top = F.when(top >= before, top + n).otherwise(top)
    new_bottom = F.when(bottom >= before, bottom + n).otherwise(bottom)
    outcome = (
        F.when(new_top > most, "Deleted")
        .when(new_bottom > most, "Shrunk")
        .when(top >= before, "Shifted")
        .when(bottom >= before, "Expanded")
        .otherwise("Unchanged")
    )
    gone = new_top > most
    return F.when(~gone, new_top), F.when(~gone, F.least(new_bottom, F.lit(most))), outcome


def range_after_delete(top: Column, bottom: Column, first: int, n: int) -> tuple[Column, Column, Column]:
    """Top, bottom and outcome of a range of rows when n rows from first go; a range that goes whole is #REF!."""
    last = first + n - 1
    gone = (top >= first) & (bottom <= last)
    new_top = F.when(top > last, top - n).when(top >= first, F.lit(first)).otherwise(top)
    new_bottom = F.when(bottom > last, bottom - n).when(bottom >= first, F.lit(first - 1)).otherwise(bottom)
    outcome = (
        F.when(gone, "Deleted").when(bottom < first, "Unchanged").when(top > last, "Shifted").otherwise("Shrunk")
    )
    return F.when(~gone, new_top), F.when(~gone, new_bottom), outcome


def overlaid(df: DataFrame, key: str, written: DataFrame, value: str) -> DataFrame:
    """df with the values of written(key, value) in place of its own, and its new keys; other columns of those are null."""
    new = written.select(F.col(key), F.col(value).alias("__new"), F.lit(True).alias("__set"))
    both = df.join(new, key, "full_outer")
    picked = F.when(F.col("__set"), F.col("__new")).otherwise(F.col(value))
    return both.withColumn(value, picked).select(df.columns)


def cleared(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def delta(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, change (set, cleared, changed), and for each value old_ and new_: only the rows that differ."""
    a = old.select(F.col(key), *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("__a"))
    b = new.select(F.col(key), *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("__b"))
    both = a.join(b, key, "full_outer")
    same = reduce(lambda x, y: x & y, (F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")) for v in values))
    change = F.when(F.col("__a").isNull(), "set").when(F.col("__b").isNull(), "cleared").when(~same, "changed")
    columns = [c for v in values for c in (f"old_{v}", f"new_{v}")]
    return both.withColumn("change", change).where("change is not null").select(key, "change", *columns)


def recalculated(old: DataFrame, inputs: DataFrame, changed: DataFrame, key: str, formula: Column, value: str) -> DataFrame:
    """old(key, value) with the formula worked out anew for the changed keys only, from inputs; the others keep their value."""
    anew = inputs.join(changed.select(key), key, "left_semi").select(key, formula.alias(value))
    kept = old.select(key, value).join(changed.select(key), key, "left_anti")
    return kept.unionByName(anew)


def really_changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key): of what was worked out anew, the keys whose value is another than before; only they go on to dependents."""
    before = old.select(key, F.col(value).alias("__before"))
    return new.join(before, key).where(~F.col(value).eqNullSafe(F.col("__before"))).select(key)


def moved(nodes: DataFrame, node: str, parent: str, order: int) -> DataFrame:
    """nodes(node, parent, ord, ...) with one node under another parent; siblings after the place make room."""
    own = F.col("node") == node
    shift = (F.col("parent") == parent) & (F.col("ord") >= order) & ~own
    place = F.when(own, F.lit(order)).when(shift, F.col("ord") + 1).otherwise(F.col("ord"))
    return nodes.withColumns({"ord": place.cast("long"), "parent": F.when(own, F.lit(parent)).otherwise(F.col("parent"))})
