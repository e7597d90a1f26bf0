"""Text functions that count UTF-16 code units.

A slice that would cut a pair of surrogates apart ends in U+FFFD, since a lone surrogate has no UTF-8 form. A null text is a
blank cell, which these functions refuse with #VALUE!.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsheet.functions.cells import Cell, cell, none


def _units(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def len_(text: Column) -> Cell:
    err = F.when(text.isNull(), F.lit("#VALUE!"))
    return Cell((F.octet_length(_units(text)) / 2).cast("double"), err)


def _slice(text: Column, count, from_left: bool) -> tuple[Column, Column]:
    n = cell(count)
    whole = F.floor(F.coalesce(n.num, F.lit(0.0))).cast("int")
    err = F.coalesce(F.when(text.isNull(), F.lit("#VALUE!")), n.err, F.when(n.num < 0, F.lit("#VALUE!")))
    size = F.octet_length(_units(text))
    take = F.least(whole * 2, size)
    start = F.lit(1) if from_left else size - take + 1
    plain = F.left(text, whole) if from_left else F.right(text, whole)
    wide = F.decode(F.substring(_units(text), start, take), "UTF-16LE")
    # texts inside the basic plane, nearly all, are sliced as they are
    value = F.when(size == 2 * F.char_length(text), plain).otherwise(wide)
    return F.when(err.isNull(), value), err


def left(text: Column, count) -> tuple[Column, Column]:
    """The first count code units, and the error."""
    return _slice(text, count, True)


def right(text: Column, count) -> tuple[Column, Column]:
    return _slice(text, count, False)


def concat(*texts: Column) -> tuple[Column, Column]:
    err = F.coalesce(*(F.when(t.isNull(), F.lit("#VALUE!")) for t in texts), none())
    return F.concat(*texts), err
