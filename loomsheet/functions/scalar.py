"""Scalar spreadsheet functions as Column expressions, with their error values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsheet.functions.cells import Cell, cell, none

_WHOLE = float(1 << 52)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def _apply(args: list[Cell], num: Column, *checks: tuple[Column, str]) -> Cell:
    """num, unless an argument has an error or a check fails; a result that is not finite is #NUM!."""
    err = F.coalesce(*(a.err for a in args), none())
    for bad, text in checks:
        err = F.coalesce(err, F.when(bad, F.lit(text)))
    num = F.when(err.isNull(), num)
    err = F.coalesce(err, F.when(~_finite(num), F.lit("#NUM!")))
    return Cell(F.when(err.isNull(), num + 0.0), err)


def _num(x: Cell) -> Column:
    return F.coalesce(x.num, F.lit(0.0))


def _floor(x: Column) -> Column:
    """The floor as a double; numbers from 2**52 on are whole already."""
    return F.when(F.abs(x) >= _WHOLE, x).otherwise(F.floor(x).cast("double"))


def abs_(x) -> Cell:
    x = cell(x)
    return _apply([x], F.abs(_num(x)))


def sqrt(x) -> Cell:
    x = cell(x)
    return _apply([x], F.sqrt(_num(x)), (_num(x) < 0, "#NUM!"))


def power(x, y) -> Cell:
    x, y = cell(x), cell(y)
    return _apply([x, y], F.pow(_num(x), _num(y)))


def mod(x, d) -> Cell:
    """The remainder with the sign of the divisor."""
    x, d = cell(x), cell(d)
    by = F.when(_num(d) != 0, _num(d))
    return _apply([x, d], _num(x) - by * _floor(_num(x) / by), (_num(d) == 0, "#DIV/0!"))


def _rounded(x, digits, whole) -> Cell:
    """Scale by a power of ten, round by whole, scale back."""
    x, digits = cell(x), cell(digits)
    d = F.when(_num(digits) < 0, -_floor(-_num(digits))).otherwise(_floor(_num(digits)))
    scale = F.pow(F.lit(10.0), F.abs(d))
    t = F.when(d >= 0, _num(x) * scale).otherwise(_num(x) / scale)
    r = F.when(F.abs(t) >= _WHOLE, t).otherwise(whole(t))
    out = F.when(d >= 0, r / scale).otherwise(r * scale)
    return _apply([x, digits], out, ((F.abs(d) > 308) | ~_finite(_num(x)), "#NUM!"))


def round_(x, digits=0) -> Cell:
    """Half away from zero, on the binary product with the power of ten."""

    def half(t: Column) -> Column:
        a = F.abs(t)
        low = _floor(a)
        return F.signum(t) * (low + F.when(a - low >= 0.5, 1.0).otherwise(0.0))

    return _rounded(x, digits, half)


def roundup(x, digits=0) -> Cell:
    return _rounded(x, digits, lambda t: F.when(t < 0, _floor(t)).otherwise(-_floor(-t)))


def rounddown(x, digits=0) -> Cell:
    return _rounded(x, digits, lambda t: F.signum(t) * _floor(F.abs(t)))


def trunc(x, digits=0) -> Cell:
    return rounddown(x, digits)


def int_(x) -> Cell:
    x = cell(x)
    return _apply([x], _floor(_num(x)), (~_finite(_num(x)), "#NUM!"))


def exp(x) -> Cell:
    x = cell(x)
    return _apply([x], F.exp(_num(x)))


def _log(x, f) -> Cell:
    x = cell(x)
    good = F.when(_num(x) > 0, _num(x))
    return _apply([x], f(good), (_num(x) <= 0, "#NUM!"))


def ln(x) -> Cell:
    return _log(x, F.ln)


def log10(x) -> Cell:
    return _log(x, F.log10)


def log(x, base=10) -> Cell:
    x, base = cell(x), cell(base)
    a, b = F.when(_num(x) > 0, _num(x)), F.when(_num(base) > 0, _num(base))
    num = F.when(b == math.e, F.ln(a)).when(b == 10, F.log10(a)).when(b == 2, F.log2(a))
    num = num.otherwise(F.try_divide(F.ln(a), F.ln(b)))
    return _apply([x, base], num, ((_num(x) <= 0) | (_num(base) <= 0), "#NUM!"), (_num(base) == 1, "#DIV/0!"))


def _trig(x, f) -> Cell:
    x = cell(x)
    return _apply([x], f(_num(x)), (~_finite(_num(x)), "#NUM!"))


def sin(x) -> Cell:
    return _trig(x, F.sin)


def cos(x) -> Cell:
    return _trig(x, F.cos)


def tan(x) -> Cell:
    return _trig(x, F.tan)


def radians(x) -> Cell:
    return _trig(x, lambda a: a * math.pi / 180.0)


def degrees(x) -> Cell:
    return _trig(x, lambda a: a * 180.0 / math.pi)


def pi() -> Cell:
    return cell(math.pi)
