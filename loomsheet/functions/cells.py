"""Cells as pairs of Columns: a number (DOUBLE) and an error text; of two errors the left one wins.

A formula over cells of one row is an ordinary Column expression, so a region of one formula is one projection. A number is
null wherever its error is set. Blank (null) numbers count as 0 in arithmetic and comparisons, and are left out of aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error texts in the order of their rank.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")
#: Byte codes of the errors in interchange files, in the same order.
ERROR_CODES = (0x00, 0x07, 0x0F, 0x17, 0x1D, 0x24, 0x2A)


@dataclass(frozen=True)
class Cell:
    num: Column
    err: Column

    def __add__(self, other):
        return _arith(self, other, lambda a, b: a + b)

    def __sub__(self, other):
        return _arith(self, other, lambda a, b: a - b)

    def __mul__(self, other):
        return _arith(self, other, lambda a, b: a * b)

    def __truediv__(self, other):
        other = cell(other)
        zero = F.coalesce(other.num, F.lit(0.0)) == 0
        err = F.coalesce(self.err, other.err, F.when(zero, F.lit("#DIV/0!")))
        return Cell(F.when(err.isNull(), F.try_divide(_zero(self.num), _zero(other.num))), err)

    def __neg__(self):
        return Cell(-self.num, self.err)

    def __lt__(self, other):
        return _compare(self, other, lambda a, b: a < b)

    def __le__(self, other):
        return _compare(self, other, lambda a, b: a <= b)

    def __gt__(self, other):
        return _compare(self, other, lambda a, b: a > b)

    def __ge__(self, other):
        return _compare(self, other, lambda a, b: a >= b)

    def equals(self, other):
        return _compare(self, other, lambda a, b: a == b)

    def differs(self, other):
        return _compare(self, other, lambda a, b: a != b)

    def columns(self, num: str = "v", err: str = "e") -> tuple[Column, Column]:
        return self.num.alias(num), self.err.alias(err)


@dataclass(frozen=True)
class Logical:
    """A truth value with an error beside it."""

    value: Column
    err: Column

    def columns(self, value: str = "v", err: str = "e") -> tuple[Column, Column]:
        return self.value.alias(value), self.err.alias(err)


def none() -> Column:
    return F.lit(None).cast("string")


def cell(x) -> Cell:
    """A Cell of a number, a Column or a Cell."""
    if isinstance(x, Cell):
        return x
    if isinstance(x, str):
        x = F.col(x)
    num = x.cast("double") if isinstance(x, Column) else F.lit(float(x) + 0.0)
    return Cell(num, none())


def error(text: str) -> Cell:
    return Cell(F.lit(None).cast("double"), F.lit(text))


def _zero(num: Column) -> Column:
    return F.coalesce(num, F.lit(0.0))


def _arith(a: Cell, b, f) -> Cell:
    b = cell(b)
    err = F.coalesce(a.err, b.err)
    return Cell(F.when(err.isNull(), f(_zero(a.num), _zero(b.num))), err)


def _compare(a: Cell, b, f) -> Logical:
    b = cell(b)
    err = F.coalesce(a.err, b.err)
    return Logical(F.when(err.isNull(), f(_zero(a.num), _zero(b.num))), err)


def _all(parts: tuple[Logical, ...], f) -> Logical:
    """The first error in argument order wins, even where another argument decides."""
    err = F.coalesce(*(p.err for p in parts), none())
    return Logical(F.when(err.isNull(), reduce(f, (p.value for p in parts))), err)


def and_(*parts: Logical) -> Logical:
    return _all(parts, lambda a, b: a & b)


def or_(*parts: Logical) -> Logical:
    return _all(parts, lambda a, b: a | b)


def not_(part: Logical) -> Logical:
    return Logical(~part.value, part.err)


def if_(condition: Logical, then, otherwise) -> Cell:
    """The branch not taken does not leak its error."""
    then, otherwise = cell(then), cell(otherwise)
    pick = lambda a, b: F.when(condition.err.isNull() & condition.value, a).when(condition.err.isNull(), b)
    err = F.when(condition.err.isNotNull(), condition.err).otherwise(pick(then.err, otherwise.err))
    return Cell(pick(then.num, otherwise.num), err)


def iferror(value, fallback) -> Cell:
    value, fallback = cell(value), cell(fallback)
    good = value.err.isNull()
    return Cell(F.when(good, value.num).otherwise(fallback.num), F.when(good, none()).otherwise(fallback.err))


# aggregates over arguments and ranges of one row ------------------------------------------------------------------------


def _row(values, finish) -> Cell:
    """All values left to right; an error ends the aggregate, blanks are left out."""
    cells = [cell(v) for v in values]
    err = F.coalesce(*(c.err for c in cells), none())
    n = reduce(lambda a, b: a + b, (c.num.isNotNull().cast("double") for c in cells))
    num, own = finish([c.num for c in cells], n)
    err = F.coalesce(err, own)
    return Cell(F.when(err.isNull(), num), err)


def _fold(nums, start: float, f) -> Column:
    return reduce(lambda a, b: F.when(b.isNull(), a).otherwise(f(a, b)), nums, F.lit(start))


def sum_(*values) -> Cell:
    return _row(values, lambda x, n: (_fold(x, 0.0, lambda a, b: a + b), none()))


def sumsq(*values) -> Cell:
    return _row(values, lambda x, n: (_fold(x, 0.0, lambda a, b: a + b * b), none()))


def count(*values) -> Cell:
    return _row(values, lambda x, n: (n, none()))


def product(*values) -> Cell:
    return _row(values, lambda x, n: (F.when(n == 0, 0.0).otherwise(_fold(x, 1.0, lambda a, b: a * b)), none()))


def average(*values) -> Cell:
    total = lambda x, n: (F.try_divide(_fold(x, 0.0, lambda a, b: a + b), n), F.when(n == 0, F.lit("#DIV/0!")))
    return _row(values, total)


def min_(*values) -> Cell:
    return _row(values, lambda x, n: (F.coalesce(F.least(*x, F.lit(None).cast("double")), F.lit(0.0)), none()))


def max_(*values) -> Cell:
    return _row(values, lambda x, n: (F.coalesce(F.greatest(*x, F.lit(None).cast("double")), F.lit(0.0)), none()))


# errors ------------------------------------------------------------------------------------------------------------------


def error_rank(err: Column) -> Column:
    """The place of an error in ERRORS; the least rank dominates."""
    return F.array_position(F.array(*map(F.lit, ERRORS)), err) - 1


def error_of_rank(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, ERRORS)), rank.cast("int"))


def error_code(err: Column) -> Column:
    return F.get(F.array(*map(F.lit, ERROR_CODES)), error_rank(err).cast("int"))


def error_of_code(code: Column) -> Column:
    """The error of a byte code; an unknown code is #VALUE!."""
    place = F.array_position(F.array(*map(F.lit, ERROR_CODES)), code.cast("int"))
    return F.when(place > 0, error_of_rank(place - 1)).otherwise(F.lit("#VALUE!"))
