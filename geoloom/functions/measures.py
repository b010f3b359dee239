"""Measures of a geometry column: extent, centroid, area, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model
from .coords import let, rounded

#: Fixed value: radius of the sphere for areas, in metres.
RADIUS = 6378137.0


def vertices(geom: Column) -> Column:
    """All vertices in order."""
    return F.flatten(F.flatten(F.flatten(F.transform(geom["members"], lambda m: m["polys"]))))


def bbox(geom: Column, precision: int = model.DEFAULT_PRECISION) -> Column:
    """Extent of the vertices, rounded; null without vertices."""

    def extent(vs: Column) -> Column:
        xs, ys = F.transform(vs, lambda v: v["x"]), F.transform(vs, lambda v: v["y"])
        sides = (("xmin", F.array_min(xs)), ("ymin", F.array_min(ys)), ("xmax", F.array_max(xs)), ("ymax", F.array_max(ys)))
        box = F.struct(*(rounded(v, precision).alias(k) for k, v in sides))
        return F.when(F.size(vs) > 0, box)

    return let(vertices(geom), extent)


def is_bbox(box: Column) -> Column:
    """Ordered and within longitude and latitude ranges."""
    return F.coalesce(
        (box["xmin"] <= box["xmax"]) & (box["ymin"] <= box["ymax"]) & (box["xmin"] >= -180) & (box["xmax"] <= 180)
        & (box["ymin"] >= -90) & (box["ymax"] <= 90),
        F.lit(False),
    )


def centroid(geom: Column, precision: int = model.DEFAULT_PRECISION) -> Column:
    """Mean of all vertices, closing ones included; (0, 0) without any."""

    def mean(vs: Column) -> Column:
        n = F.size(vs)
        total = lambda c: F.aggregate(vs, F.lit(0.0), lambda a, v: a + v[c])
        of = lambda c: F.when(n > 0, rounded(total(c) / n, precision)).otherwise(0.0)
        return F.struct(of("x").alias("x"), of("y").alias("y"))

    return let(vertices(geom), mean)


def ring_area(ring: Column) -> Column:
    """Square metres inside a closed ring on the sphere."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.size(ring) - 1),
        F.lit(0.0),
        lambda a, i: a
        + F.radians(F.get(ring, i)["x"] - F.get(ring, i - 1)["x"])
        * (F.sin(F.radians(F.get(ring, i - 1)["y"])) + F.sin(F.radians(F.get(ring, i)["y"]))),
    )
    return F.when(F.size(ring) < 2, F.lit(0.0)).otherwise(F.abs(total * (RADIUS * RADIUS / 2)))


def polygon_area(rings: Column) -> Column:
    return F.aggregate(
        F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda a, x: a + x
    )


def area(geom: Column) -> Column:
    """Whole square metres, holes subtracted; 0 for what has no polygon."""
    member = lambda m: F.when(
        m["gtype"].isin(model.POLYGON, model.MULTIPOLYGON),
        F.aggregate(m["polys"], F.lit(0.0), lambda a, p: a + polygon_area(p)),
    ).otherwise(F.lit(0.0))
    return F.floor(F.aggregate(geom["members"], F.lit(0.0), lambda a, m: a + member(m)) + 0.5).cast("long")


def counts(geom: Column) -> Column:
    """points, lines, polygons (parts of multi types count each) and coords, closing vertices included."""

    def parts(kinds: tuple[int, ...], size) -> Column:
        return F.aggregate(
            F.filter(geom["members"], lambda m: m["gtype"].isin(*kinds)), F.lit(0), lambda a, m: a + size(m)
        ).cast("long")

    return F.struct(
        parts((model.POINT, model.MULTIPOINT), lambda m: F.size(F.flatten(F.flatten(m["polys"])))).alias("points"),
        parts((model.LINE, model.MULTILINE), lambda m: F.size(F.flatten(m["polys"]))).alias("lines"),
        parts((model.POLYGON, model.MULTIPOLYGON), lambda m: F.size(m["polys"])).alias("polygons"),
        F.size(vertices(geom)).cast("long").alias("coords"),
    )
