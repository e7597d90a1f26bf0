"""Structured references: a table's columns and sections, and edits of the catalog of tables and names."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_name(text: str) -> str:
    """A column specifier without its escapes: an apostrophe makes the character after it plain."""
    out, plain = [], False
    for c in text:
        if c == "'" and not plain:
            plain = True
            continue
        out.append(c)
        plain = False
    return "".join(out)


@dataclass(frozen=True)
class Table:
    """Rows with a key in order, headings in order with the columns that they name, and the totals row's expressions."""

    rows: DataFrame
    key: str
    columns: dict[str, str]
    totals: dict[str, Column]

    def _named(self, heading: str) -> str:
        """The heading as written in the table; headings compare without regard to case."""
        wanted = column_name(heading).casefold()
        found = next((h for h in self.columns if h.casefold() == wanted), None)
        if found is None:
            raise KeyError(f"#REF! {heading}")
        return found

    def slice(self, first: str, last: str | None = None) -> list[str]:
        """The headings from first to last."""
        order = list(self.columns)
        lo, hi = sorted((order.index(self._named(first)), order.index(self._named(last or first))))
        return order[lo : hi + 1]

    def this_row(self, heading: str) -> Column:
        """T[@c]: the column itself, in the row of the formula."""
        return F.col(self.columns[self._named(heading)])

    def section(self, *sections: str, first: str, last: str | None = None) -> DataFrame:
        """(section, k, heading, v): the cells of #Headers, #Data, #Totals or #All of these columns, values as texts."""
        wanted = {"#Headers", "#Data", "#Totals"} if "#All" in sections else set(sections)
        headings = self.slice(first, last)
        spark = self.rows.sparkSession
        none = F.lit(None).cast("long")
        cells = lambda values: F.inline(F.array(*(F.struct(F.lit(h).alias("heading"), v.cast("string").alias("v")) for h, v in values)))
        parts = []
        if "#Headers" in wanted:
            parts.append(spark.range(1).select(F.lit("Headers").alias("section"), none.alias("k"), cells([(h, F.lit(h)) for h in headings])))
        if "#Data" in wanted:
            values = [(h, F.col(self.columns[h])) for h in headings]
            parts.append(self.rows.select(F.lit("Data").alias("section"), F.col(self.key).cast("long").alias("k"), cells(values)))
        if "#Totals" in wanted:
            named = {f"__t{i}": self.totals.get(h, F.lit(None)) for i, h in enumerate(headings)}
            row = self.rows.agg(*(F.first(F.lit(1)), *(c.alias(n) for n, c in named.items())))
            parts.append(row.select(F.lit("Totals").alias("section"), none.alias("k"), cells([(h, F.col(n)) for n, h in zip(named, headings, strict=True)])))
        return reduce(DataFrame.unionByName, parts)


def edited(catalog: DataFrame, renamed: DataFrame, deleted: DataFrame, resized: DataFrame) -> DataFrame:
    """catalog(name, top, left, bottom, right) after edits: deleted(name), resized(name, bottom, right), renamed(name, to)."""
    kept = catalog.join(deleted.select("name"), "name", "left_anti")
    new = resized.select("name", F.col("bottom").alias("__b"), F.col("right").alias("__r"))
    kept = kept.join(new, "name", "left").withColumns({"bottom": F.coalesce("__b", "bottom"), "right": F.coalesce("__r", "right")})
    kept = kept.join(renamed.select("name", F.col("to").alias("__to")), "name", "left")
    return kept.select(F.coalesce("__to", "name").alias("name"), "top", "left", "bottom", "right")


def rewritten(uses: DataFrame, renamed: DataFrame, deleted: DataFrame) -> DataFrame:
    """uses(..., name) of names in formulas after the edits: renamed ones follow, deleted ones are #NAME? (column e)."""
    gone = deleted.select("name", F.lit("#NAME?").alias("e"))
    both = uses.join(renamed.select("name", F.col("to").alias("__to")), "name", "left").join(gone, "name", "left")
    name = F.when(F.col("e").isNull(), F.coalesce("__to", "name"))
    return both.withColumn("name", name).drop("__to")
