"""Evaluation bounded by what is seen: of a row's formulas only those that the wanted ones need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def cone(df: DataFrame, keep: Sequence[str], formulas: dict[str, tuple[Sequence[str], Column]], wanted: Sequence[str]) -> DataFrame:
    """keep and the wanted columns of df, formulas being name: (columns that it reads, expression), in any order.

    A circle of names, or a name that is neither formula nor column, raises ValueError.
    """
    levels: list[list[str]] = []
    need, seen = [n for n in wanted if n in formulas], set(wanted)
    while need:
        levels.append(need)
        reads = dict.fromkeys(r for n in need for r in formulas[n][0])
        if missing := [r for r in reads if r not in formulas and r not in df.columns]:
            raise ValueError(f"no column {missing[0]}")
        need = [r for r in reads if r in formulas]
        seen.update(reads)
        if len(levels) > len(formulas):
            raise ValueError("formulas refer to each other in a circle")
    done: set[str] = set()
    for level in reversed(levels):
        fresh = {n: formulas[n][1] for n in level if n not in done}
        df = df.withColumns(fresh)
        done |= set(fresh)
    return df.select(*dict.fromkeys([*keep, *wanted]))
