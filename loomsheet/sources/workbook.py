"""Workbooks: named sheets and scoped names over them, saved to and read from a folder in any of Spark's file formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Reference:
    """A sheet's name in a formula, bound to a sheet, dormant (no such sheet yet) or broken (its sheet was deleted)."""

    workbook: Workbook
    name: str
    bound: str | None
    broken: bool = False


@dataclass
class Workbook:
    """Sheets by name and names by (scope, name); names of sheets and of names compare without regard to case.

    A name stands for a function of the workbook, so it is looked up anew at each use and follows what it refers to. A name
    scoped to a sheet goes before one of the whole workbook (scope None).
    """

    sheets: dict[str, DataFrame]
    names: dict[tuple[str | None, str], Callable[[Workbook], DataFrame]] = field(default_factory=dict)
    references: list[Reference] = field(default_factory=list)

    def sheet(self, name: str) -> DataFrame | None:
        """The sheet, or None where it does not exist (yet): a reference to it is dormant, not broken."""
        return next((df for n, df in self.sheets.items() if n.casefold() == name.casefold()), None)

    def refer(self, name: str) -> Reference:
        """A reference bound to the sheet of that name as it is now, or dormant until a sheet of that name is added."""
        found = next((n for n in self.sheets if n.casefold() == name.casefold()), None)
        made = Reference(self, name, found)
        self.references.append(made)
        return made

    def add(self, name: str, df: DataFrame) -> None:
        """A new sheet at the end; dormant references to its name heal, broken ones do not."""
        self.sheets[name] = df
        for r in self.references:
            if r.bound is None and not r.broken and r.name.casefold() == name.casefold():
                r.bound = name

    def rename(self, old: str, new: str) -> None:
        """References follow their sheet, whose place stays."""
        self.sheets = {new if n == old else n: df for n, df in self.sheets.items()}
        for r in self.references:
            if r.bound == old:
                r.bound = new

    def delete(self, name: str) -> None:
        """References to the sheet break for good: a later sheet of that name is another one."""
        del self.sheets[name]
        for r in self.references:
            if r.bound == name:
                r.bound, r.broken = None, True

    def read(self, reference: Reference, rows: DataFrame, key: str, on: str, value: str) -> DataFrame:
        """rows with v and e of the referred sheet's value where its ``on`` equals key; #REF! for a sheet that is not there."""
        none = F.lit(None).cast("double")
        if reference.bound is None:
            return rows.withColumns({"v": none, "e": F.lit("#REF!")})
        side = self.sheets[reference.bound].select(F.col(on).alias("__on"), F.col(value).cast("double").alias("v"))
        return rows.join(side, F.col(key) == F.col("__on"), "left").withColumn("e", none.cast("string")).drop("__on")

    def define(self, name: str, meaning: Callable[[Workbook], DataFrame], scope: str | None = None) -> None:
        self.names[(scope and scope.casefold(), name.casefold())] = meaning

    def resolve(self, name: str, sheet: str | None = None) -> DataFrame:
        """What a name means on a sheet. An unknown name raises KeyError."""
        for scope in (sheet and sheet.casefold(), None):
            if (meaning := self.names.get((scope, name.casefold()))) is not None:
                return meaning(self)
        raise KeyError(f"#NAME? {name}")

    def span(self, first: str, last: str, columns: list[str]) -> DataFrame:
        """The columns, by position, of all sheets from first to last in the present order."""
        order = list(self.sheets)
        at = {n.casefold(): i for i, n in enumerate(order)}
        lo, hi = sorted((at[first.casefold()], at[last.casefold()]))
        parts = [self.sheets[n].toDF(*columns) if self.sheets[n].columns != columns else self.sheets[n] for n in order[lo : hi + 1]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def save(self, folder: str, kind: str = "parquet", **options) -> None:
        for name, df in self.sheets.items():
            df.write.format(kind).options(**options).save(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, schemas: dict[str, str], kind: str = "parquet", **options) -> Workbook:
        read = lambda n, s: spark.read.format(kind).options(**options).schema(s).load(f"{folder}/{n}")
        return cls({n: read(n, s) for n, s in schemas.items()})


def unaccounted(observed: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Kinds that were observed and are not in the ledger, with how often: nothing is lost in silence."""
    return observed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(ledger, key, "left_anti")


def with_cached(rows: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """rows(key, v, e) with the cached value and provenance Degraded where the formula could not be read (#NAME?)."""
    bad = F.coalesce(F.col("e") == "#NAME?", F.lit(False))
    old = cached.select(key, F.col("v").alias("__old"))
    both = rows.join(old, key, "left")
    return both.select(
        key,
        F.when(bad, F.col("__old")).otherwise(F.col("v")).alias("v"),
        F.when(~bad, F.col("e")).alias("e"),
        F.when(bad, "Degraded").otherwise("Calculated").alias("provenance"),
    )
