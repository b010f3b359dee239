"""Geographic views of the driver's tables: whole-number arithmetic first, one division, so engines agree exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import model
from ..model import FeatureFrame, Meta

#: The same views in SQL, to stand behind WITH.
SQL = {
    "points": """points AS (
  SELECT event_id AS fid, (event_id * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lng,
    (event_id * 104729 % 170000) / 1000.0::DOUBLE - 85 AS lat, event_type, value, user_id, ts, props FROM events)""",
    "customers": """customers AS (
  SELECT c_custkey AS fid, (c_custkey * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lng,
    (c_custkey * 104729 % 170000) / 1000.0::DOUBLE - 85 AS lat, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer)""",
    "suppliers": """suppliers AS (
  SELECT s_suppkey AS fid, (s_suppkey * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lng,
    (s_suppkey * 104729 % 170000) / 1000.0::DOUBLE - 85 AS lat, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier)""",
    "cells": """cells AS (
  SELECT n_nationkey::BIGINT AS fid, n_name, n_regionkey, -180.0::DOUBLE + (n_nationkey % 5) * 72 AS x0, -85.0::DOUBLE + (n_nationkey // 5) * 34 AS y0,
    -108.0::DOUBLE + (n_nationkey % 5) * 72 AS x1, -51.0::DOUBLE + (n_nationkey // 5) * 34 AS y1 FROM nation)""",
    "cell_vertices": """cell_vertices AS (
  SELECT fid, seq, CASE WHEN seq IN (2, 3) THEN x1 ELSE x0 END AS x, CASE WHEN seq IN (1, 2) THEN y1 ELSE y0 END AS y
  FROM cells, (SELECT unnest(range(5)) AS seq))""",
    "cell_segments": """cell_segments AS (
  SELECT c.fid, n_regionkey, a.x AS ax, a.y AS ay, b.x AS tx, b.y AS ty,
    CASE WHEN (a.x, a.y) <= (b.x, b.y) THEN concat_ws(' ', a.x, a.y, b.x, b.y) ELSE concat_ws(' ', b.x, b.y, a.x, a.y) END AS seg
  FROM cells c JOIN cell_vertices a USING (fid) JOIN cell_vertices b ON b.fid = c.fid AND b.seq = a.seq + 1)""",
    "triangle_edges": """triangle_edges AS (
  SELECT fid, x0 AS ax, y0 AS ay, x0 AS tx, y1 AS ty FROM cells UNION ALL SELECT fid, x0, y1, x1, y0 FROM cells
  UNION ALL SELECT fid, x1, y0, x0, y0 FROM cells)""",
    "track_points": """track_points AS (
  SELECT user_id AS fid, lng AS x, lat AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, fid) - 1 AS seq FROM points)""",
}
_NEEDS = {
    "cell_vertices": ["cells"], "cell_segments": ["cells", "cell_vertices"], "triangle_edges": ["cells"], "track_points": ["points"],
}


def with_views(*names: str) -> str:
    """WITH and the named views, those they need first."""
    found: list[str] = []
    for n in names:
        found += [x for x in [*_NEEDS.get(n, []), n] if x not in found]
    return "WITH " + ", ".join(SQL[n] for n in found)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str):
    k = F.col(key).cast("long")
    return ((k * 7919 % 360000) / F.lit(1000.0) - 180).alias("lng"), ((k * 104729 % 170000) / F.lit(1000.0) - 85).alias("lat")


def points(spark: SparkSession, d: str) -> DataFrame:
    """fid, lng, lat and the event's columns."""
    return read(spark, d, "events").select(
        F.col("event_id").alias("fid"), *_place("event_id"), "event_type", "value", "user_id", F.col("ts").cast("timestamp").alias("ts"), "props"
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("fid"), *_place("c_custkey"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal")
    )


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("fid"), *_place("s_suppkey"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal")
    )


def _corners(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    x0, y0 = F.lit(-180.0) + (k % 5) * 72, F.lit(-85.0) + F.floor(k / 5) * 34
    return read(spark, d, "nation").select(
        k.cast("long").alias("fid"), "n_name", "n_regionkey", x0.alias("x0"), y0.alias("y0"), (x0 + 72).alias("x1"), (y0 + 34).alias("y1")
    )


def cells(spark: SparkSession, d: str) -> DataFrame:
    """fid, geom, n_name, n_regionkey: a rectangle for each nation, a grid of 5 x 5."""
    c = F.col
    return _corners(spark, d).select("fid", model.rectangle(c("x0"), c("y0"), c("x1"), c("y1")).alias("geom"), "n_name", "n_regionkey")


def triangles(spark: SparkSession, d: str) -> DataFrame:
    """fid, geom, n_name: the lower left half of each cell."""
    v = lambda x, y: model.vertex(F.col(x), F.col(y))
    ring = F.array(v("x0", "y0"), v("x0", "y1"), v("x1", "y0"), v("x0", "y0"))
    return _corners(spark, d).select("fid", model.polygon(F.array(ring)).alias("geom"), "n_name")


def cell_frame(spark: SparkSession, d: str) -> FeatureFrame:
    """Cells as a frame with properties."""
    return FeatureFrame(cells(spark, d).select("fid", "geom", F.struct("n_name", "n_regionkey").alias("props")), Meta("cells"))


def point_frame(spark: SparkSession, d: str) -> FeatureFrame:
    rows = points(spark, d)
    return FeatureFrame(rows.select("fid", model.point(F.col("lng"), F.col("lat")).alias("geom"), F.struct("event_type", "value").alias("props")), Meta("points"))


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """fid, geom: a line for each user through their points in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "fid", model.vertex(F.col("lng"), F.col("lat")).alias("v"))))
    by = points(spark, d).groupBy("user_id").agg(F.transform(ordered, lambda x: x["v"]).alias("vs"))
    return by.select(F.col("user_id").alias("fid"), model.linestring(F.col("vs")).alias("geom"))
