"""Distances and arcs on the sphere, projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import vertex

#: Fixed value: radius of the sphere for distances, in kilometres.
EARTH_KM = 6371.0


def _sin2_half(d: Column) -> Column:
    return F.pow(F.sin(d / 2), 2)


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """h in [0, 1], ascending with great-circle distance."""
    p1, p2 = F.radians(y1), F.radians(y2)
    return _sin2_half(p1 - p2) + F.cos(p1) * F.cos(p2) * _sin2_half(F.radians(x1) - F.radians(x2))


def kilometres(h: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def h_limit(km: Column) -> Column:
    """h of a distance; half a turn and beyond is everything."""
    return F.when(km >= EARTH_KM * 3.141592653589793, F.lit(1.0)).otherwise(_sin2_half(km / EARTH_KM))


def box_bound(box: Column, x: Column, y: Column) -> Column:
    """Least h from a point to anything in a box: latitude alone within its longitudes, else its nearer side."""
    straight = F.when(y < box["ymin"], _sin2_half(F.radians(box["ymin"] - y))).when(
        y > box["ymax"], _sin2_half(F.radians(y - box["ymax"]))
    ).otherwise(0.0)

    def side(lng: Column) -> Column:
        d = F.radians(x - lng)
        # the point of the side's meridian nearest to (x, y), kept within the side
        top = F.when(F.cos(d) <= 0, F.when(y > 0, F.lit(90.0)).otherwise(-90.0)).otherwise(
            F.degrees(F.atan2(F.sin(F.radians(y)), F.cos(F.radians(y)) * F.cos(d)))
        )
        within = F.least(F.greatest(top, box["ymin"]), box["ymax"])
        # beyond a quarter turn the far end of the side may be nearer by way of the other pole
        return F.least(*(haversine(x, y, lng, lat) for lat in (within, box["ymin"], box["ymax"])))

    ends = F.least(side(box["xmin"]), side(box["xmax"]))
    return F.when(x.between(box["xmin"], box["xmax"]), straight).otherwise(ends)


def great_circle_arc(x1: Column, y1: Column, x2: Column, y2: Column, n: Column) -> Column:
    """The n - 1 points that cut the great circle from one point to the other in n equal arcs."""
    h = haversine(x1, y1, x2, y2)
    d = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    p1, p2, l1, l2 = F.radians(y1), F.radians(y2), F.radians(x1), F.radians(x2)

    def at(i: Column) -> Column:
        f = i / n
        a = F.when(d == 0, 1 - f).otherwise(F.sin((1 - f) * d) / F.sin(d))
        b = F.when(d == 0, f).otherwise(F.sin(f * d) / F.sin(d))
        x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
        y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
        z = a * F.sin(p1) + b * F.sin(p2)
        return vertex(F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))

    return F.when(n < 2, F.array().cast("array<struct<x:double,y:double>>")).otherwise(
        F.transform(F.sequence(F.lit(1), n.cast("int") - 1), at)
    )


def fit_scale(box: Column, width: float, height: float) -> Column:
    """Scale that fits a box, its width shrunk by the cosine of the middle latitude."""
    dx = (box["xmax"] - box["xmin"]) * F.cos(F.radians((box["ymin"] + box["ymax"]) / 2))
    return F.least(F.lit(width) / dx, F.lit(height) / (box["ymax"] - box["ymin"])) * 50


def project(kind: str, x: Column, y: Column, scale, x0=0.0, y0=0.0, tx=0.0, ty=0.0) -> Column:
    """Plane coordinates by orthographic, mercator or equirectangular projection turned to (x0, y0)."""
    lam, phi = F.radians(x - x0), F.radians(y)
    c = F.radians(F.lit(y0)) if not isinstance(y0, Column) else F.radians(y0)
    if kind == "orthographic":
        u = F.cos(phi) * F.sin(lam)
        v = F.cos(c) * F.sin(phi) - F.sin(c) * F.cos(phi) * F.cos(lam)
    elif kind == "mercator":
        mercator = lambda p: F.log(F.tan(F.pi() / 4 + p / 2))
        u, v = lam, mercator(phi) - mercator(c)
    elif kind == "equirectangular":
        u, v = lam, phi - c
    else:
        raise ValueError(f"unknown projection {kind}")
    return vertex(u * scale + tx, -v * scale + ty)
