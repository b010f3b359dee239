"""Point-in-polygon joins.

The polygon side is broadcast behind a check of its rows and vertices; beyond, both sides meet on cells of a
hierarchical grid: a polygon goes to the level whose cells are about its size (at most four cells), a point to its
cell of each level in use, and the equi-join is skew-safe under adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures, predicates

BROADCAST_ROWS, BROADCAST_VERTICES = 10_000, 1_000_000
LEVELS = 20


def with_bbox(polygons: DataFrame) -> DataFrame:
    """polygons with their extent, materialised as the pruning column."""
    return polygons if "bbox" in polygons.columns else polygons.withColumn("bbox", measures.bbox(F.col("geom"), 12))


def containing(polygons: DataFrame, x: float, y: float, first: bool = False) -> DataFrame:
    """fid of the polygons that hold a point, ascending; with first, the smallest or -1."""
    px, py = F.lit(float(x)), F.lit(float(y))
    hit = with_bbox(polygons).filter(predicates.in_box(F.col("bbox"), px, py)).filter(predicates.contains(F.col("geom"), px, py))
    return hit.agg(F.coalesce(F.min("fid"), F.lit(-1)).alias("fid")) if first else hit.select("fid").orderBy("fid")


def _fits(polygons: DataFrame) -> bool:
    n, v = polygons.agg(F.count("*"), F.coalesce(F.sum(F.size(measures.vertices(F.col("geom")))), F.lit(0))).first()
    return n <= BROADCAST_ROWS and v <= BROADCAST_VERTICES


def _cell(v: Column, level: Column | int, low: float) -> Column:
    return F.floor((v - low) / (360.0 / F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level)))).cast("long")


def _by_grid(points: DataFrame, polys: DataFrame, how: str, x: str, y: str) -> DataFrame:
    side = F.greatest(F.col("bbox.xmax") - F.col("bbox.xmin"), F.col("bbox.ymax") - F.col("bbox.ymin"), F.lit(360.0 / 2**LEVELS))
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.lit(360.0) / side)))).cast("int")
    polys = polys.withColumn("_grid_level", level)
    used = sorted(r[0] for r in polys.select("_grid_level").distinct().collect())  # at most LEVELS + 1 values
    ends = lambda c, low: [_cell(F.col(f"bbox.{c}{e}"), F.col("_grid_level"), low) for e in ("min", "max")]
    right = polys.select("*", F.explode(F.sequence(*ends("x", -180.0))).alias("_grid_x"))
    right = right.select("*", F.explode(F.sequence(*ends("y", -90.0))).alias("_grid_y"))
    cells = [
        F.struct(F.lit(n).alias("l"), _cell(F.col(x), n, -180.0).alias("x"), _cell(F.col(y), n, -90.0).alias("y")) for n in used
    ]
    none = F.lit(None).cast("struct<l:int,x:bigint,y:bigint>")
    left = points.select("*", (F.explode(F.array(*cells)) if cells else none).alias("_grid"))
    on = (F.col("_grid.l") == F.col("_grid_level")) & (F.col("_grid.x") == F.col("_grid_x")) & (F.col("_grid.y") == F.col("_grid_y"))
    test = predicates.in_box(F.col("bbox"), F.col(x), F.col(y)) & predicates.contains(F.col("geom"), F.col(x), F.col(y))
    inner = left.join(right, on).filter(test).drop("_grid", "_grid_level", "_grid_x", "_grid_y")
    if how == "inner":
        return inner
    key = F.struct(*points.columns)
    hits = inner.select(*(points.columns)).distinct()
    joined = points.join(hits.select(key.alias("k")), key.eqNullSafe(F.col("k")), how)
    return joined


def contain_join(
    points: DataFrame, polygons: DataFrame, how: str = "inner", x: str = "lng", y: str = "lat", broadcast: bool | None = None
) -> DataFrame:
    """Rows of points with the polygon (poly_fid, geom, bbox and the rest) that holds them; semi and anti forms.

    how: inner, left_semi or left_anti. broadcast: None checks the polygon side's size.
    """
    polys = with_bbox(polygons).withColumnRenamed("fid", "poly_fid")
    clash = set(points.columns) & (set(polys.columns) - {"geom", "bbox"})
    polys = polys.select(*(F.col(c).alias(f"poly_{c}" if c in clash else c) for c in polys.columns))
    points = points.select(*(c for c in points.columns if c not in ("geom", "bbox")))
    if _fits(polygons) if broadcast is None else broadcast:
        px, py = points[x], points[y]
        test = predicates.in_box(polys["bbox"], px, py) & predicates.contains(polys["geom"], px, py)
        return points.join(F.broadcast(polys), test, how)
    return _by_grid(points, polys, how, x, y)


def contain_first(points: DataFrame, polygons: DataFrame, fid: str = "fid", **options) -> DataFrame:
    """fid, poly_fid: the smallest polygon that holds each point, -1 if none."""
    hits = contain_join(points, polygons, **options).groupBy(fid).agg(F.min("poly_fid").alias("poly_fid"))
    return points.select(fid).join(hits, fid, "left").select(fid, F.coalesce("poly_fid", F.lit(-1)).alias("poly_fid"))


def in_view(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose box meets a viewport; with a stored bbox the test reaches the Parquet statistics."""
    b = F.col("bbox")
    return with_bbox(features).filter((b["xmax"] >= xmin) & (b["xmin"] <= xmax) & (b["ymax"] >= ymin) & (b["ymin"] <= ymax))
