"""Spatial predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model


def in_box(box: Column, px: Column, py: Column) -> Column:
    """Point in box, borders included."""
    return px.between(box["xmin"], box["xmax"]) & py.between(box["ymin"], box["ymax"])


def boxes_meet(a: Column, b: Column) -> Column:
    """Closed boxes overlap."""
    return (a["xmax"] >= b["xmin"]) & (a["xmin"] <= b["xmax"]) & (a["ymax"] >= b["ymin"]) & (a["ymin"] <= b["ymax"])


def ray_cast(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd test of a point against a closed ring, half-open at borders."""

    def cross(inside: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i - 1)
        meets = (a["y"] > py) != (b["y"] > py)
        left = px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(meets, inside != left).otherwise(inside)

    test = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(False), cross)
    return F.when(F.size(ring) < 2, F.lit(False)).otherwise(test)


def in_polygon(rings: Column, px: Column, py: Column) -> Column:
    """Inside the outer ring and no hole."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.when(F.size(rings) == 0, F.lit(False)).otherwise(
        ray_cast(F.get(rings, F.lit(0)), px, py) & F.forall(holes, lambda h: ~ray_cast(h, px, py))
    )


def contains(geom: Column, px: Column, py: Column) -> Column:
    """Any polygon part holds the point (F05); other types hold none."""
    return F.exists(
        geom["members"],
        lambda m: m["gtype"].isin(model.POLYGON, model.MULTIPOLYGON) & F.exists(m["polys"], lambda p: in_polygon(p, px, py)),
    )
