"""Nearest features on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geodesy
from ..model import exploded
from ..session import materialise

#: First search radius in km; a round multiplies it by STEP until it spans the globe.
START_KM, STEP = 50.0, 4.0


def point_vertices(features: DataFrame) -> DataFrame:
    """fid, lng, lat of all vertices of points and multipoints, also within collections."""
    return exploded(features, "fid").filter("mtype IN (0, 1)").select("fid", F.col("x").alias("lng"), F.col("y").alias("lat"))


def nearest(sites: DataFrame, x: float, y: float, k: int, max_km: float = math.inf) -> DataFrame:
    """fid, km of the k nearest rows (fid, lng, lat), nearest first, ties by fid; max_km is inclusive."""
    near = sites
    if max_km < geodesy.EARTH_KM * math.pi:
        band = math.degrees(max_km / geodesy.EARTH_KM) + 1e-9
        near = near.filter(F.col("lat").between(y - band, y + band))
    h = geodesy.haversine(F.lit(float(x)), F.lit(float(y)), F.col("lng"), F.col("lat"))
    near = near.select("fid", h.alias("h"))
    if max_km < geodesy.EARTH_KM * math.pi:
        near = near.filter(F.col("h") <= math.sin(max_km / geodesy.EARTH_KM / 2) ** 2)
    return near.orderBy("h", "fid").limit(k).select("fid", geodesy.kilometres(F.col("h")).alias("km"))


def _cube(x: Column, y: Column, size: float) -> Column:
    """The cell of a point of the unit sphere in a grid of cubes."""
    lam, phi = F.radians(x), F.radians(y)
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return F.array(*(F.floor(a / size).cast("long") for a in axes))


def knn_join(queries: DataFrame, sites: DataFrame, k: int, max_km: float = math.inf, start_km: float = START_KM) -> DataFrame:
    """qid, rank, fid, km: the k nearest sites (fid, lng, lat) of each query (qid, lng, lat), ties by fid.

    Exact in rounds of equi-joins: points are cells of a grid of cubes around the sphere, as wide as the chord of
    the round's radius, so poles and the antimeridian need no care; a query meets its 27 cells. It is done when k
    sites lie within the radius; the others go on with a wider one.
    """
    order = W.partitionBy("qid").orderBy("h", "fid")
    left, done, km = queries.select("qid", "lng", "lat"), None, min(start_km, max_km)
    near = range(-1, 2)
    steps = F.array(*(F.array(F.lit(a), F.lit(b), F.lit(c)) for a in near for b in near for c in near))
    while True:
        whole = km >= max_km or km >= geodesy.EARTH_KM * math.pi / 3
        radius = min(max_km, geodesy.EARTH_KM * math.pi) if whole else km
        limit = math.sin(radius / geodesy.EARTH_KM / 2) ** 2
        size = 2 * math.sin(min(radius / geodesy.EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-9
        q = left.withColumn("cell", _cube(F.col("lng"), F.col("lat"), size)).select(
            "qid", F.col("lng").alias("qx"), F.col("lat").alias("qy"),
            F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda a, b: a + b))).alias("cell"),
        )
        s = sites.select("fid", F.col("lng").alias("sx"), F.col("lat").alias("sy"), _cube(F.col("lng"), F.col("lat"), size).alias("cell"))
        h = geodesy.haversine(F.col("qx"), F.col("qy"), F.col("sx"), F.col("sy"))
        met = q.join(s, "cell").select("qid", "fid", h.alias("h")).filter(F.col("h") <= limit)
        ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if whole:
            found = ranked
        else:
            ranked = materialise(ranked)
            full = ranked.filter(F.col("rank") == k).select("qid")
            found = ranked.join(full, "qid", "left_semi")
        done = found if done is None else done.unionByName(found)
        if whole:
            break
        left = materialise(left.join(full, "qid", "left_anti"))
        if left.isEmpty():
            break
        km *= STEP
    return done.select("qid", "rank", "fid", geodesy.kilometres(F.col("h")).alias("km"))
