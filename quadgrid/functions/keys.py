"""Column functions on positions and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def morton(row: Column, col: Column, bits: int = 16) -> Column:
    """The bits of row and col in turn: near positions have near keys."""
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        for shift, axis in ((1, row), (0, col)):
            bit = F.shiftright(axis.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint"))
            out = out.bitwiseOR(F.shiftleft(bit, 2 * b + shift))
    return out


def zigzag(delta: Column) -> Column:
    """Signed differences as natural numbers: d <= 0 gives -2d, else 2d - 1."""
    return F.when(delta <= 0, -2 * delta).otherwise(2 * delta - 1).cast("bigint")


def unzigzag(code: Column) -> Column:
    return F.when(code % 2 == 0, -(code / 2)).otherwise((code + 1) / 2).cast("bigint")


def half_up(x: Column) -> Column:
    """Rounding of halves towards positive infinity, as the viewer rounds."""
    return F.floor(x + 0.5).cast("bigint")


def in_window(row: Column, col: Column, xini, xend, yini, yend) -> Column:
    return row.between(xini, xend) & col.between(yini, yend)


def color_ramp(value: Column, low: int = 0, high: int = 100) -> dict[str, Column]:
    """Red and blue shares of a value clamped to low..high."""
    t = (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / float(high - low)
    return {"r": half_up(255 * t).cast("int"), "g": F.lit(0), "b": half_up(255 * (1 - t)).cast("int")}
