"""Coordinate expressions: wrapping, quantising, deltas, duplicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(x) with value computed once, also where x is used inside lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def wrap_lng(x: Column) -> Column:
    """Longitude into [-180, 180] by whole turns; both ends stay."""
    turned = F.pmod(x + 180.0, F.lit(360.0)) - 180.0
    return F.when((x >= -180.0) & (x <= 180.0), x).when((turned == -180.0) & (x > 0), F.lit(180.0)).otherwise(turned)


def wrap_lng_half_open(x: Column) -> Column:
    """Longitude into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def quantise(v: Column, precision: int) -> Column:
    """Whole units of 10^-precision; halves go up, also below zero."""
    return F.floor(v * F.lit(float(10**precision)) + 0.5).cast("long")


def dequantise(q: Column, precision: int) -> Column:
    return q / F.lit(float(10**precision))


def rounded(v: Column, precision: int) -> Column:
    return dequantise(quantise(v, precision), precision)


def delta_encode(values: Column) -> Column:
    """First value, then differences."""
    return F.transform(values, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(values, i - 1)))


def delta_decode(deltas: Column) -> Column:
    """Running sums of deltas."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("seen"))
    return F.aggregate(
        deltas,
        start,
        lambda a, d: F.struct((a["at"] + d).alias("at"), F.concat(a["seen"], F.array(a["at"] + d)).alias("seen")),
        lambda a: a["seen"],
    )


def dedupe(vertices: Column) -> Column:
    """Without vertices that equal the one before."""
    return let(vertices, lambda vs: F.filter(vs, lambda v, i: (i == 0) | (v != F.get(vs, i - 1))))


def ring_sum(ring: Column) -> Column:
    """Sum of (x2 - x1)(y2 + y1): clockwise rings have it at 0 or above."""
    return F.aggregate(
        F.sequence(F.lit(1), F.size(ring) - 1),
        F.lit(0.0),
        lambda a, i: a + (F.get(ring, i)["x"] - F.get(ring, i - 1)["x"]) * (F.get(ring, i)["y"] + F.get(ring, i - 1)["y"]),
    )


def clockwise(ring: Column) -> Column:
    return F.when(F.size(ring) < 2, F.lit(True)).otherwise(ring_sum(ring) >= 0)


def orient(polys: Column) -> Column:
    """Outer rings clockwise, holes counter-clockwise."""

    def turned(ring: Column, i: Column) -> Column:
        return F.when((i == 0) == clockwise(ring), ring).otherwise(F.reverse(ring))

    return F.transform(polys, lambda rings: F.transform(rings, turned))
