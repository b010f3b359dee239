"""Morton codes of coordinates in units of 1e-7 degree (F20, F21): 63 bits, so signed order is code order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: units a degree.
UNITS = 1e7


def to_ints(x: Column, y: Column) -> tuple[Column, Column]:
    return F.floor((x + 180.0) * UNITS + 0.5).cast("long"), F.floor((y + 90.0) * UNITS + 0.5).cast("long")


def _bits(v: Column, n: int, move) -> Column:
    total = F.lit(0).cast("long")
    for i in range(n):
        total = total + move(v, i)
    return total


def pack_ints(ix: Column, iy: Column) -> Column:
    """x on even bits, y on odd bits."""
    spread = lambda v, i: F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 2 * i)
    return _bits(ix, 32, spread) + F.shiftleft(_bits(iy, 31, spread), 1)


def pack(x: Column, y: Column) -> Column:
    return pack_ints(*to_ints(x, y))


def unpack_ints(code: Column) -> tuple[Column, Column]:
    gather = lambda v, i: F.shiftleft(F.shiftright(v, 2 * i).bitwiseAND(F.lit(1).cast("long")), i)
    return _bits(code, 32, gather), _bits(F.shiftright(code, 1), 31, gather)


def unpack(code: Column) -> tuple[Column, Column]:
    """Degrees to 7 decimals."""
    ix, iy = unpack_ints(code)
    return F.round(ix / UNITS - 180.0, 7), F.round(iy / UNITS - 90.0, 7)


def to_l2(code: Column) -> Column:
    """Both coordinates rounded to multiples of 8, which frees the low 6 bits."""
    ix, iy = unpack_ints(code)
    near = lambda v: F.shiftleft(F.shiftright(v + 4, 3), 3)
    return pack_ints(near(ix), near(iy))


def weight(is_l1: Column, stored: Column) -> Column:
    """Rank 0..63; exact (L1) nodes have the highest."""
    return F.when(is_l1, F.lit(63)).otherwise(stored)
