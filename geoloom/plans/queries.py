"""Registered queries, one or more for each operator family, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import coords, geodesy, measures, morton, predicates, values
from ..model import FeatureFrame
from ..operators import knn, normalise, profile, relational, spatial_join, topology
from ..session import shared_path
from ..sources import catalog, container, geojson, gml, kml, shapefile, topojson
from ..streaming import features as streams
from . import views
from .views import with_views

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


_R6 = "floor({v} * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"
_IN_CELL = "lng >= x0 AND lng < x1 AND lat >= y0 AND lat < y1"
_CONTAIN = with_views("points", "cells") + f" SELECT n_name, count(*) AS n FROM points JOIN cells ON {_IN_CELL} GROUP BY n_name"
_RAY = """hits AS (
  SELECT p.fid, t.fid AS poly_fid FROM points p JOIN triangle_edges t ON (ty > lat) <> (ay > lat)
    AND lng < (ax - tx) * (lat - ty) / (ay - ty) + tx
  GROUP BY p.fid, t.fid HAVING count(*) % 2 = 1)"""


@query(_CONTAIN)
def contain_join(spark, d):
    """Points counted by the cell that holds them."""
    return spatial_join.contain_join(views.points(spark, d), views.cells(spark, d)).groupBy("n_name").agg(F.count("*").alias("n"))


@query(_CONTAIN)
def contain_join_grid(spark, d):
    """The same by the grid join for polygon sides too large to broadcast."""
    hit = spatial_join.contain_join(views.points(spark, d), views.cells(spark, d), broadcast=False)
    return hit.groupBy("n_name").agg(F.count("*").alias("n"))


@query(with_views("points", "triangle_edges") + f", {_RAY} SELECT fid, poly_fid FROM hits")
def contain_triangles(spark, d):
    """Points in triangles: the ray cast with slanted edges."""
    return spatial_join.contain_join(views.points(spark, d), views.triangles(spark, d)).select("fid", "poly_fid")


@query(with_views("points", "triangle_edges") + f", {_RAY} SELECT p.fid, coalesce(min(poly_fid), -1) AS poly_fid FROM points p LEFT JOIN hits USING (fid) GROUP BY p.fid")
def contain_first(spark, d):
    """The first polygon of each point, or -1."""
    return spatial_join.contain_first(views.points(spark, d), views.triangles(spark, d))


@query(with_views("points", "triangle_edges") + f", {_RAY} SELECT fid, event_type FROM points WHERE fid IN (SELECT fid FROM hits)")
def contain_semi(spark, d):
    """Points that some polygon holds."""
    return spatial_join.contain_join(views.points(spark, d), views.triangles(spark, d), "left_semi").select("fid", "event_type")


@query(with_views("points", "triangle_edges") + f", {_RAY} SELECT fid, event_type FROM points WHERE fid NOT IN (SELECT fid FROM hits)")
def contain_anti(spark, d):
    """Points that no polygon holds, by the grid join."""
    return spatial_join.contain_join(views.points(spark, d), views.triangles(spark, d), "left_anti", broadcast=False).select("fid", "event_type")


@query(with_views("cells") + " SELECT fid FROM cells WHERE 10.5 >= x0 AND 10.5 < x1 AND 20.25 >= y0 AND 20.25 < y1")
def contain_point(spark, d):
    """Polygons that hold one point."""
    return spatial_join.containing(views.cells(spark, d), 10.5, 20.25)


_H = """pow(sin((radians(lat) - radians({y})) / 2), 2) + cos(radians(lat)) * cos(radians({y})) * pow(sin((radians(lng) - radians({x})) / 2), 2)"""
_H0 = _H.format(x="10.0::DOUBLE", y="20.0::DOUBLE")
_KM = "round(2 * 6371.0::DOUBLE * asin(sqrt({h})), 6)"


@query(with_views("points") + f", s AS (SELECT fid, {_H0} AS h FROM points) SELECT fid, {_KM.format(h='h')} AS km FROM s ORDER BY h, fid LIMIT 20")
def nearest_k(spark, d):
    """The 20 points nearest to (10, 20)."""
    return knn.nearest(views.points(spark, d), 10.0, 20.0, 20).select("fid", r6(F.col("km")).alias("km"))


@query(
    with_views("points") + f", s AS (SELECT fid, {_H0} AS h FROM points) SELECT fid, {_KM.format(h='h')} AS km FROM s"
    " WHERE h <= pow(sin(500.0::DOUBLE / 6371.0 / 2), 2) ORDER BY h, fid LIMIT 1000"
)
def nearest_within_km(spark, d):
    """Points within 500 km, nearest first."""
    return knn.nearest(views.points(spark, d), 10.0, 20.0, 1000, 500.0).select("fid", r6(F.col("km")).alias("km"))


@query(
    with_views("customers", "suppliers") + f""", pairs AS (SELECT q.fid AS qid, c.fid, {_H.format(x='q.lng', y='q.lat').replace('(lat)', '(c.lat)').replace('(lng)', '(c.lng)')} AS h FROM suppliers q, customers c),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, fid) AS rank FROM pairs)
 SELECT qid, rank, fid, {_KM.format(h='h')} AS km FROM ranked WHERE rank <= 3"""
)
def knn_join(spark, d):
    """The three customers nearest to each supplier."""
    q = views.suppliers(spark, d).withColumnRenamed("fid", "qid")
    return knn.knn_join(q, views.customers(spark, d), 3).select("qid", "rank", "fid", r6(F.col("km")).alias("km"))


@query(with_views("track_points") + f" SELECT fid, {_R6.format(v='min(x)')} AS xmin, {_R6.format(v='min(y)')} AS ymin, {_R6.format(v='max(x)')} AS xmax, {_R6.format(v='max(y)')} AS ymax FROM track_points GROUP BY fid")
def bbox_feature(spark, d):
    """Extent of each track."""
    return views.tracks(spark, d).select("fid", measures.bbox(F.col("geom")).alias("b")).select("fid", "b.*")


@query(with_views("points") + f" SELECT {_R6.format(v='min(lng)')} AS xmin, {_R6.format(v='min(lat)')} AS ymin, {_R6.format(v='max(lng)')} AS xmax, {_R6.format(v='max(lat)')} AS ymax FROM points")
def bbox_dataset(spark, d):
    """Extent of the data set."""
    return profile.extent(views.tracks(spark, d))


@query(with_views("cells") + " SELECT fid, n_name FROM cells WHERE x1 >= -40 AND x0 <= 40 AND y1 >= 0 AND y0 <= 20")
def viewport_filter(spark, d):
    """Cells whose box meets a viewport."""
    return spatial_join.in_view(views.cells(spark, d), -40, 0, 40, 20).select("fid", "n_name")


@query(
    with_views("track_points") + """, l AS (SELECT fid, list_prepend(0.0::DOUBLE, list(x ORDER BY seq)) AS xs, list_prepend(0.0::DOUBLE, list(y ORDER BY seq)) AS ys, count(*) AS n FROM track_points GROUP BY fid)
 SELECT fid, floor(list_reduce(xs, lambda a, b: a + b) / n * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS x,
   floor(list_reduce(ys, lambda a, b: a + b) / n * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS y FROM l"""
)
def centroid_vertex(spark, d):
    """Mean vertex of each track."""
    return views.tracks(spark, d).select("fid", measures.centroid(F.col("geom")).alias("c")).select("fid", "c.x", "c.y")


@query(
    with_views("cells") + " SELECT fid, floor(abs(6378137.0::DOUBLE * 6378137.0 / 2 * (radians(x1 - x0) * (sin(radians(y1)) + sin(radians(y1))) + radians(x0 - x1) * (sin(radians(y0)) + sin(radians(y0))))) + 0.5)::BIGINT AS area FROM cells"
)
def area_sphere(spark, d):
    """Area of each cell on the sphere."""
    return views.cells(spark, d).select("fid", measures.area(F.col("geom")).alias("area"))


@query(
    with_views("points") + """ SELECT (SELECT count(DISTINCT user_id) FROM points) AS lines, (SELECT count(*) FROM nation) AS polygons,
  (SELECT count(*) FROM supplier) AS points, (SELECT count(*) FROM points) + 5 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS coords"""
)
def count_parts(spark, d):
    """Points, lines, polygons and coordinates of a mixed set."""
    sites = views.suppliers(spark, d).select("fid", model.point(F.col("lng"), F.col("lat")).alias("geom"))
    return profile.totals(views.tracks(spark, d).union(views.cells(spark, d).select("fid", "geom")).union(sites))


@query(with_views("points") + " SELECT fid, upper(event_type) AS kind, value * 2 AS twice FROM points WHERE value > 50 AND lat > 0")
def filter_map(spark, d):
    """Filter and property map in one plan."""
    ff = relational.clone(
        views.point_frame(spark, d), "@busy", (F.col("props.value") > 50) & (F.col("geom.members")[0]["polys"][0][0][0]["y"] > 0),
        {"kind": F.upper("props.event_type"), "twice": F.col("props.value") * 2},
    )
    return relational.table(ff)


@query("SELECT 'cells@2026' AS name, 'grid' AS description, 'CC0' AS license, count(*) AS n FROM nation")
def rename_meta(spark, d):
    """Metadata set without touching rows, names put behind with @."""
    ff = relational.renamed(views.cell_frame(spark, d).header(description="grid", license="CC0"), "@2026")
    m = ff.meta
    return ff.df.agg(F.count("*").alias("n")).select(F.lit(m.name).alias("name"), F.lit(m.description).alias("description"), F.lit(m.license).alias("license"), "n")


@query(with_views("cells") + " SELECT fid, 'Polygon' AS type FROM cells")
def noprop_project(spark, d):
    """Types of features read without properties."""
    return relational.types(relational.without_properties(views.cell_frame(spark, d)))


@query(with_views("cells") + " SELECT n_name, n_regionkey FROM cells WHERE fid = 7")
def feature_at(spark, d):
    """Properties of one feature."""
    return relational.properties_of(views.cell_frame(spark, d), 7)


@query(with_views("points") + " SELECT event_type AS class, count(*) AS n FROM points WHERE event_type IS NOT NULL GROUP BY 1")
def classify_counts(spark, d):
    """Features by class."""
    return relational.classify(views.points(spark, d), F.col("event_type")).groupBy("class").agg(F.count("*").alias("n"))


@query(with_views("cells") + " SELECT 'cells@' || n_regionkey AS name, count(*) AS n FROM cells GROUP BY n_regionkey")
def classify_frames(spark, d):
    """A frame for each class, with its name."""
    parts = relational.classified(views.cell_frame(spark, d), F.col("props.n_regionkey"))
    rows = [p.df.agg(F.count("*").alias("n")).select(F.lit(p.meta.name).alias("name"), "n") for p in parts.values()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query(with_views("cells") + " SELECT row_number() OVER (ORDER BY n_regionkey::VARCHAR) - 1 AS fid, CASE WHEN count(*) = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS type, count(*) AS parts FROM cells GROUP BY n_regionkey")
def dissolve_collect(spark, d):
    """Polygons gathered by a property, borders kept."""
    ff = relational.dissolve(views.cell_frame(spark, d), "n_regionkey")
    return ff.df.select("fid", model.type_name(F.col("geom")).alias("type"), measures.counts(F.col("geom"))["polygons"].alias("parts"))


@query(with_views("cells") + " SELECT CASE WHEN count(*) = 1 THEN max(n_name) END AS n_name, n_regionkey FROM cells GROUP BY n_regionkey")
def dissolve_props(spark, d):
    """Properties that all members agree on."""
    return relational.dissolve(views.cell_frame(spark, d), "n_regionkey").df.select("props.*")


@query(
    with_views("cells") + ", r AS (SELECT n_regionkey, floor(abs(6378137.0::DOUBLE * 6378137.0 / 2 * (radians(x1 - x0) * (sin(radians(y1)) + sin(radians(y1))) + radians(x0 - x1) * (sin(radians(y0)) + sin(radians(y0))))) + 0.5) AS a FROM cells)"
    " SELECT n_regionkey, round(sum(a) / 1e7)::BIGINT AS area FROM r GROUP BY n_regionkey"
)
def dissolve_union(spark, d):
    """Groups with shared borders removed keep their area."""
    ff = relational.dissolve(views.cell_frame(spark, d), "n_regionkey", mode="union")
    return ff.df.select(F.col("props.n_regionkey").alias("n_regionkey"), F.round(measures.area(F.col("geom")) / 1e7).cast("long").alias("area"))


@query(
    with_views("customers", "suppliers") + """ SELECT fid, nationkey, acctbal, NULL::VARCHAR AS preferred FROM customers
 UNION ALL SELECT fid + (SELECT max(fid) + 1 FROM customers), nationkey, NULL, 'yes' FROM suppliers"""
)
def concat_union(spark, d):
    """Two frames with different properties one after the other."""
    frame = lambda df, *p: FeatureFrame(df.select("fid", model.point(F.col("lng"), F.col("lat")).alias("geom"), F.struct(*p).alias("props")))
    a = frame(views.customers(spark, d), "nationkey", "acctbal")
    b = frame(views.suppliers(spark, d), "nationkey", F.lit("yes").alias("preferred"))
    return relational.table(relational.concatenate([a, b], "sites"))


@query("SELECT 'Polygon' AS type, count(*) AS n FROM nation UNION ALL SELECT 'LineString', count(DISTINCT user_id) FROM events")
def lint_types(spark, d):
    """Features by type."""
    return profile.type_counts(views.tracks(spark, d).union(views.cells(spark, d).select("fid", "geom")))


@query("SELECT 'k' AS key, 'INTEGER' AS type, count(*) AS n FROM events WHERE props IS NOT NULL AND (props->'k') IS NOT NULL")
def lint_keys(spark, d):
    """Types of the properties' values by key."""
    return profile.key_types(views.points(spark, d), "props")


@query("SELECT event_id AS fid, (props->>'k')::BIGINT AS k, (props->>'k')::BIGINT + 1 AS sub FROM events")
def json_flatten(spark, d):
    """Nested properties flattened and back."""
    rows = views.points(spark, d).select("fid", F.from_json("props", "k bigint").alias("p"))
    nested = rows.select("fid", F.struct(F.col("p.k").alias("k"), F.struct((F.col("p.k") + 1).alias("b")).alias("a")).alias("props"))
    flat = relational.flattened(nested)
    back = relational.unflattened(flat)
    return flat.select("fid", "props.k", F.col("props.`a.b`").alias("sub")).join(back.filter("props.a.b IS NULL").select("fid"), "fid", "left_anti")


@query("SELECT DISTINCT 'k' AS key FROM events WHERE props IS NOT NULL")
def key_dictionary(spark, d):
    """Distinct property names."""
    return relational.keys(views.points(spark, d), "props")


@query("WITH h AS (SELECT DISTINCT props FROM events WHERE props IS NOT NULL) SELECT row_number() OVER (ORDER BY sha256(props)) - 1 AS buf_id, props AS data FROM h")
def binary_pool(spark, d):
    """Equal values share one number in the pool (A10)."""
    rows = views.points(spark, d).filter("props IS NOT NULL").select(F.col("props").cast("binary").alias("raw"))
    return relational.binary_pool(rows, "raw").select("buf_id", F.decode("data", "UTF-8").alias("data"))


@query("SELECT count(*) AS n, count(DISTINCT props) AS buffers FROM events WHERE props IS NOT NULL")
def pool_reference(spark, d):
    """References resolved through the pool."""
    rows = views.points(spark, d).filter("props IS NOT NULL").select("fid", F.col("props").cast("binary").alias("raw"))
    pool = relational.binary_pool(rows, "raw")
    refs = rows.join(pool, F.sha2("raw", 256) == F.col("hash")).select("fid", "raw", "buf_id")
    back = relational.with_buffers(refs, pool).filter(F.col("raw") == F.col("data"))
    return back.agg(F.count("*").alias("n"), F.count_distinct("buf_id").alias("buffers"))


@query(with_views("points") + " SELECT fid, floor((lng + 180) * 1e7::DOUBLE + 0.5)::BIGINT AS ix, floor(lat * 1000000.0::DOUBLE + 0.5)::BIGINT AS qy, floor(lat * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS y FROM points")
def quantise(spark, d):
    """Coordinates as whole units and back."""
    p = views.points(spark, d)
    q = coords.quantise(F.col("lat"), 6)
    return p.select("fid", morton.to_ints(F.col("lng"), F.col("lat"))[0].alias("ix"), q.alias("qy"), coords.dequantise(q, 6).alias("y"))


_Q = "floor(x * 1000000.0::DOUBLE + 0.5)::BIGINT"


@query(with_views("track_points") + f", q AS (SELECT fid, seq, {_Q} AS v FROM track_points) SELECT fid, seq, v - coalesce(lag(v) OVER (PARTITION BY fid ORDER BY seq), 0) AS dx FROM q")
def delta_encode(spark, d):
    """Differences along each track."""
    xs = F.transform(measures.vertices(F.col("geom")), lambda v: coords.quantise(v["x"], 6))
    rows = views.tracks(spark, d).select("fid", coords.let(xs, coords.delta_encode).alias("dx"))
    return rows.select("fid", F.posexplode("dx").alias("seq", "dx"))


@query(with_views("track_points") + f" SELECT fid, seq, {_Q} AS x FROM track_points")
def delta_decode(spark, d):
    """Running sums of the differences are the coordinates."""
    xs = F.transform(measures.vertices(F.col("geom")), lambda v: coords.quantise(v["x"], 6))
    rows = views.tracks(spark, d).select("fid", coords.delta_decode(coords.let(xs, coords.delta_encode)).alias("x"))
    return rows.select("fid", F.posexplode("x").alias("seq", "x"))


@query("SELECT event_id AS fid, ((event_id * 37 % 1440 - 720)::DOUBLE + 540) - floor(((event_id * 37 % 1440 - 720)::DOUBLE + 540) / 360) * 360 - 180 AS half_open, CASE WHEN abs(event_id * 37 % 1440 - 720) <= 180 THEN (event_id * 37 % 1440 - 720)::DOUBLE WHEN (event_id * 37 % 1440 - 720 + 540) % 360 = 0 AND event_id * 37 % 1440 > 720 THEN 180.0 ELSE ((event_id * 37 % 1440 - 720)::DOUBLE + 540) - floor(((event_id * 37 % 1440 - 720)::DOUBLE + 540) / 360) * 360 - 180 END AS closed FROM events")
def wrap_lng(spark, d):
    """Longitudes into range, with and without the eastern end."""
    x = (F.col("fid") * 37 % 1440 - 720).cast("double")
    return views.points(spark, d).select("fid", coords.wrap_lng_half_open(x).alias("half_open"), coords.wrap_lng(x).alias("closed"))


@query(with_views("track_points") + ", q AS (SELECT fid, seq, floor(x / 90) * 90 AS x, floor(y / 90) * 90 AS y FROM track_points), k AS (SELECT fid, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM q WINDOW w AS (PARTITION BY fid ORDER BY seq)) SELECT fid, count(*) AS n FROM k WHERE px IS NULL OR px <> x OR py <> y GROUP BY fid")
def dedupe_consecutive(spark, d):
    """Vertices left without those that equal the one before, on a coarse grid."""
    coarse = F.transform(measures.vertices(F.col("geom")), lambda v: model.vertex(F.floor(v["x"] / 90) * 90, F.floor(v["y"] / 90) * 90))
    return views.tracks(spark, d).select("fid", F.size(coords.dedupe(coarse)).cast("long").alias("n"))


_IX, _IY = "floor((lng + 180) * 1e7::DOUBLE + 0.5)::BIGINT", "floor((lat + 90) * 1e7::DOUBLE + 0.5)::BIGINT"
_SPREAD = "list_sum(list_transform(range(32), lambda i: (({v} >> i) & 1) << (2 * i)))::BIGINT"
_SPREAD31 = "list_sum(list_transform(range(31), lambda i: (({v} >> i) & 1) << (2 * i + 1)))::BIGINT"
_PACKED = f", q AS (SELECT *, {_IX} AS ix, {_IY} AS iy FROM points), m AS (SELECT *, {_SPREAD.format(v='ix')} + {_SPREAD31.format(v='iy')} AS code FROM q)"


@query(with_views("points") + _PACKED + " SELECT fid, code FROM m")
def morton_pack(spark, d):
    """63-bit Morton codes."""
    return views.points(spark, d).select("fid", morton.pack(F.col("lng"), F.col("lat")).alias("code"))


@query(with_views("points") + " SELECT fid, round(lng, 7) AS x, round(lat, 7) AS y FROM points")
def morton_unpack(spark, d):
    """Codes turned back to degrees."""
    x, y = morton.unpack(F.col("code"))
    return views.points(spark, d).select("fid", morton.pack(F.col("lng"), F.col("lat")).alias("code")).select("fid", x.alias("x"), y.alias("y"))


@query(
    with_views("points") + f", q AS (SELECT *, (({_IX} + 4) >> 3) << 3 AS ix, (({_IY} + 4) >> 3) << 3 AS iy FROM points)"
    f" SELECT fid, {_SPREAD.format(v='ix')} + {_SPREAD31.format(v='iy')} AS l2, (fid % 64)::INT AS weight FROM q"
)
def morton_l2(spark, d):
    """Codes with room for a weight."""
    code = morton.pack(F.col("lng"), F.col("lat"))
    w = morton.weight(F.lit(False), (F.col("fid") % 64).cast("int"))
    return views.points(spark, d).select("fid", code.alias("code")).select("fid", morton.to_l2(F.col("code")).alias("l2"), w.alias("weight"))


@query(with_views("cells", "cell_vertices") + " SELECT x, y, count(DISTINCT fid) AS n, min(fid) AS first FROM cell_vertices GROUP BY x, y")
def point_merge(spark, d):
    """Features that share a point."""
    rows = views.cells(spark, d).select("fid", model.multipoint(F.slice(measures.vertices(F.col("geom")), 1, 4)).alias("geom"))
    x, y = morton.unpack(F.col("code"))
    merged = topology.merge_points(rows)
    return merged.select(x.alias("x"), y.alias("y"), F.size("fids").cast("long").alias("n"), F.get("fids", F.lit(0)).alias("first"))


@query(with_views("cell_segments") + " SELECT DISTINCT a.fid, b.fid AS neighbour FROM cell_segments a JOIN cell_segments b USING (seg) WHERE a.fid <> b.fid")
def neighbors_pairs(spark, d):
    """Cells that share a border, both ways."""
    return topology.neighbours(views.cells(spark, d))


@query(with_views("cell_segments") + " SELECT DISTINCT a.fid, b.fid AS neighbour FROM cell_segments a JOIN cell_segments b USING (seg) WHERE a.fid <> b.fid AND a.fid = 12")
def neighbors_of(spark, d):
    """Neighbours of one cell."""
    return topology.neighbours(views.cells(spark, d), 12)


def _segment_xy(df: DataFrame, a: str, b: str) -> DataFrame:
    p, q = topology.node_xy(F.col(a)), topology.node_xy(F.col(b))
    return df.select(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("tx"), q["y"].alias("ty"))


_TWICE = " SELECT min(least(ax, tx)) AS ax, min(least(ay, ty)) AS ay, max(greatest(ax, tx)) AS tx, max(greatest(ay, ty)) AS ty FROM cell_segments {where} GROUP BY seg HAVING count(*) = {n}"


@query(with_views("cell_segments") + _TWICE.format(where="", n=2))
def mesh_edges(spark, d):
    """Borders between two cells."""
    return _segment_xy(topology.mesh(views.cells(spark, d)), "lo", "hi")


@query(with_views("cell_segments") + _TWICE.format(where="WHERE n_regionkey IN (1, 2)", n=2))
def mesh_filtered(spark, d):
    """Borders between two cells of some regions."""
    return _segment_xy(topology.mesh(views.cells(spark, d).filter("n_regionkey IN (1, 2)")), "lo", "hi")


@query(with_views("cell_segments") + " SELECT max(ax) AS ax, max(ay) AS ay, max(tx) AS tx, max(ty) AS ty FROM cell_segments WHERE n_regionkey = 1 GROUP BY seg HAVING count(*) = 1")
def merge_boundary_edges(spark, d):
    """Outer borders of a region, directed."""
    return _segment_xy(topology.boundary(views.cells(spark, d).filter("n_regionkey = 1")), "a", "b")


@query(with_views("cell_segments") + " SELECT ax AS x, ay AS y, count(*) AS n FROM cell_segments GROUP BY 1, 2")
def vertex_degree(spark, d):
    """Occurrences of each vertex."""
    p = topology.node_xy(F.col("node"))
    return topology.degrees(views.cells(spark, d)).select(p["x"].alias("x"), p["y"].alias("y"), "n")


@query(with_views("cell_segments") + ", c AS (SELECT ax AS x, ay AS y, count(DISTINCT fid) AS n FROM cell_segments GROUP BY 1, 2) SELECT x, y FROM c WHERE n > 1")
def arc_nodes(spark, d):
    """Where arcs begin: wherever more than one cell meets on this grid."""
    p = topology.node_xy(F.col("node"))
    return topology.arc_nodes(views.cells(spark, d)).select(p["x"].alias("x"), p["y"].alias("y"))


@query(with_views("cell_segments") + """, s AS (SELECT seg, count(*) AS n FROM cell_segments GROUP BY seg), corner AS (SELECT 4 AS n)
 SELECT n AS owners, count(*) - CASE WHEN n = 1 THEN 4 ELSE 0 END AS arcs, (count(*) + count(*) - CASE WHEN n = 1 THEN 4 ELSE 0 END)::BIGINT AS vertices FROM s GROUP BY n""")
def arcs_table(spark, d):
    """Arcs by owners: every border once, the grid's corners inside an arc of two segments."""
    a, _ = topology.arcs(views.cells(spark, d))
    return a.groupBy(F.col("n_owners").alias("owners")).agg(F.count("*").alias("arcs"), F.sum(F.size("ns")).alias("vertices"))


@query(with_views("cell_segments") + ", c AS (SELECT DISTINCT fid FROM cell_segments) SELECT fid, 5 AS vertices, true AS closed FROM c")
def ring_from_arcs(spark, d):
    """Rings put together from their arcs again."""
    a, refs = topology.arcs(views.cells(spark, d))
    line = F.when(F.col("reversed"), F.reverse("ns")).otherwise(F.col("ns"))
    parts = refs.join(a, "arc").select("fid", "place", line.alias("ns"))
    whole = parts.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("place", "ns"))).alias("p"))
    ring = F.flatten(F.transform("p", lambda x, i: F.when(i == 0, x["ns"]).otherwise(F.slice(x["ns"], 2, F.size(x["ns"])))))
    return whole.select("fid", F.size(ring).alias("vertices"), (F.get(ring, F.lit(0)) == F.element_at(ring, -1)).alias("closed"))


@query(
    with_views("cells") + ", r AS (SELECT floor(abs(6378137.0::DOUBLE * 6378137.0 / 2 * (radians(x1 - x0) * (sin(radians(y1)) + sin(radians(y1))) + radians(x0 - x1) * (sin(radians(y0)) + sin(radians(y0))))) + 0.5) AS a FROM cells)"
    " SELECT 1::BIGINT AS polygons, round(sum(a) / 1e7)::BIGINT AS area FROM r"
)
def merge_rings(spark, d):
    """All cells merged: one polygon with their area."""
    merged = topology.merge(views.cells(spark, d))
    return merged.select(measures.counts(F.col("geom"))["polygons"].alias("polygons"), F.round(measures.area(F.col("geom")) / 1e7).cast("long").alias("area"))


@query()
def simplify_rank(spark, d):
    """Ranks of the vertices of track arcs, and what a threshold leaves."""
    a, _ = topology.arcs(views.tracks(spark, d), topology.LINEAR)
    ranks = topology.ranked(a)
    left = topology.simplified(ranks, 55).select("arc", F.size("ns").alias("kept"))
    return ranks.select("arc", F.size("ns").alias("vertices"), F.array_max("ranks").alias("top")).join(left, "arc")


@query(
    with_views("points") + """, p AS (SELECT fid, event_id, x, y FROM (SELECT event_id AS fid, event_id, event_id * 7919 % 360000 AS x, event_id * 104729 % 170000 AS y FROM events)),
 ends AS (SELECT a.fid, b.x - a.x AS dx FROM p a JOIN p b ON 3 * a.x - 4 * a.y = 3 * b.x - 4 * b.y AND abs(b.x - a.x) BETWEEN 1 AND 399)
 SELECT p.fid, (2 + count(DISTINCT CASE WHEN dx > 0 THEN dx ELSE dx + 400 END))::INT AS vertices FROM p LEFT JOIN ends USING (fid) GROUP BY p.fid"""
)
def purify_lines(spark, d):
    """Lines with a vertex at every crossing (T02, T03, J05, O05): a short line from each event, as all whole tracks cross all."""
    short = views.points(spark, d).select(
        "fid", model.linestring(F.array(model.vertex(F.col("lng"), F.col("lat")), model.vertex(F.col("lng") + 0.4, F.col("lat") + 0.3))).alias("geom")
    )
    return topology.noded(short).select("fid", F.size("ns").alias("vertices"))


@query()
def arcs_topojson(spark, d):
    """Arc and geometry texts of a TopoJSON document."""
    arc_rows, geometries, _ = topology.topojson(views.cell_frame(spark, d).df)
    return arc_rows.select(F.concat(F.lit("arc "), "arc").alias("part"), "text").union(geometries.select(F.concat(F.lit("feature "), "fid"), "text"))


@query(with_views("cells") + " SELECT fid, true AS outer_clockwise, 0.0::DOUBLE - 2 * (x1 - x0) * (y0 - y1) AS sum FROM cells")
def orient_rings(spark, d):
    """Reversed cells oriented clockwise again."""
    polys = F.transform(F.col("geom.members")[0]["polys"], lambda p: F.transform(p, F.reverse))
    rows = views.cells(spark, d).select("fid", coords.orient(polys).alias("p"))
    ring = F.col("p")[0][0]
    return rows.select("fid", coords.clockwise(ring).alias("outer_clockwise"), coords.ring_sum(ring).alias("sum"))


@query(
    with_views("track_points") + """, w AS (SELECT fid, seq, (x + 180) - floor((x + 180) / 360) * 360 - 180 AS x FROM track_points),
 s AS (SELECT fid, x, lead(x) OVER (PARTITION BY fid ORDER BY seq) AS nx FROM w)
 SELECT fid, (1 + count(*) FILTER (x * nx < 0 AND abs(x - nx) > 180))::INT AS parts FROM s GROUP BY fid"""
)
def antimeridian_lines(spark, d):
    """Tracks split where they cross the antimeridian."""
    split = normalise.normalised(views.tracks(spark, d))
    return split.select("fid", F.size(F.col("geom.members")[0]["polys"][0]).alias("parts"))


@query()
def antimeridian_polygons(spark, d):
    """Polygons across the antimeridian cut in pieces."""
    c = views.cells(spark, d)
    moved = F.transform(measures.vertices(F.col("geom")), lambda v: model.vertex(v["x"] + 30, v["y"]))
    cut = normalise.normalised(c.select("fid", model.polygon(F.array(moved)).alias("geom")))
    return cut.select("fid", model.type_name(F.col("geom")).alias("type"), measures.area(F.col("geom")).alias("area"))


@query(
    with_views("suppliers") + """, p AS (SELECT fid, radians(lat) AS p1, radians(lng) AS l1, radians(20.0::DOUBLE) AS p2, radians(10.0::DOUBLE) AS l2 FROM suppliers),
 d AS (SELECT *, 2 * asin(sqrt(least(pow(sin((p1 - p2) / 2), 2) + cos(p1) * cos(p2) * pow(sin((l1 - l2) / 2), 2), 1.0))) AS d FROM p),
 f AS (SELECT *, unnest(range(1, 4)) AS i FROM d),
 c AS (SELECT *, sin((1 - i / 4.0::DOUBLE) * d) / sin(d) AS a, sin(i / 4.0::DOUBLE * d) / sin(d) AS b FROM f),
 x AS (SELECT fid, i, a * cos(p1) * cos(l1) + b * cos(p2) * cos(l2) AS x, a * cos(p1) * sin(l1) + b * cos(p2) * sin(l2) AS y, a * sin(p1) + b * sin(p2) AS z FROM c)
 SELECT fid, i - 1 AS seq, round(degrees(atan2(y, x)), 6) AS x, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS y FROM x"""
)
def great_circle_arc(spark, d):
    """Three points between each supplier and (10, 20)."""
    arc = geodesy.great_circle_arc(F.col("lng"), F.col("lat"), F.lit(10.0), F.lit(20.0), F.lit(4))
    rows = views.suppliers(spark, d).select("fid", F.posexplode(arc).alias("seq", "v"))
    return rows.select("fid", "seq", r6(F.col("v.x")).alias("x"), r6(F.col("v.y")).alias("y"))


@query(
    with_views("points") + " SELECT fid, round(cos(radians(lat)) * sin(radians(lng - 10)) * 100 + 50, 6) AS ox, round(radians(lng - 10) * 100 + 50, 6) AS ex,"
    " round(-(ln(tan(pi() / 4 + radians(lat) / 2)) - ln(tan(pi() / 4 + radians(20.0::DOUBLE) / 2))) * 100 + 50, 6) AS my FROM points"
)
def projections(spark, d):
    """Plane coordinates in three projections."""
    at = lambda kind: geodesy.project(kind, F.col("lng"), F.col("lat"), 100.0, 10.0, 20.0, 50.0, 50.0)
    return views.points(spark, d).select(
        "fid", r6(at("orthographic")["x"]).alias("ox"), r6(at("equirectangular")["x"]).alias("ex"), r6(at("mercator")["y"]).alias("my")
    )


@query(with_views("points") + " SELECT count(*) AS n, true AS bounded FROM points")
def box_lower_bound(spark, d):
    """No point is nearer than the bound of its cell's box."""
    p = spatial_join.contain_join(views.points(spark, d).filter("lat < 85"), views.cells(spark, d))
    bound = geodesy.box_bound(F.col("bbox"), F.lit(10.0), F.lit(20.0))
    h = geodesy.haversine(F.lit(10.0), F.lit(20.0), F.col("lng"), F.col("lat"))
    return p.agg(F.count("*").alias("n"), F.bool_and(bound <= h + 1e-12).alias("bounded"))


_HEX = "lower(printf('%02x', (p_partkey * 7919 % 256)::INT) || printf('%02x', (p_partkey * 31 % 256)::INT) || printf('%02x', (p_partkey % 256)::INT))"


@query("SELECT p_partkey AS id, (p_partkey * 7919 % 256)::INT AS r, (p_partkey * 31 % 256)::INT AS g, (p_partkey % 256)::INT AS b, 'rgb(' || (p_partkey * 7919 % 256) || ',' || (p_partkey * 31 % 256) || ',' || (p_partkey % 256) || ')' AS text FROM part")
def color_parse(spark, d):
    """Colours read and written."""
    k = F.col("p_partkey")
    two = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    text = F.concat(F.lit("#"), two(k * 7919 % 256), two(k * 31 % 256), two(k % 256))
    rows = views.read(spark, d, "part").select(k.alias("id"), values.colour(text).alias("c"))
    return rows.select("id", "c.r", "c.g", "c.b", values.colour_text(F.col("c")).alias("text"))


@query("SELECT p_partkey AS id, 'ff' || printf('%02x', (p_partkey % 256)::INT) || printf('%02x', (p_partkey * 31 % 256)::INT) || printf('%02x', (p_partkey * 7919 % 256)::INT) AS kml FROM part")
def kml_color(spark, d):
    """KML colours."""
    k = F.col("p_partkey")
    c = F.struct((k * 7919 % 256).alias("r"), (k * 31 % 256).alias("g"), (k % 256).alias("b"), F.lit(255).cast("long").alias("a"))
    return views.read(spark, d, "part").select(k.alias("id"), values.kml_colour(c).alias("kml"))


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice <= 0 THEN 0 ELSE greatest(0, least(63, floor(1.5 * log2(o_totalprice * 1000) - 8.2365)))::INT END AS rank FROM orders")
def rank_from_area(spark, d):
    """Importance of an area (F32)."""
    return views.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), values.rank(F.col("o_totalprice") * 1000).alias("rank"))


@query("SELECT event_id AS fid, floor(floor(epoch_us(ts) / 1000) / 1000.0::DOUBLE + 0.5)::BIGINT AS seconds, strftime(ts, '%Y%m%d') AS dbf, date_trunc('day', ts)::DATE AS day FROM events")
def date_seconds(spark, d):
    """Times to whole seconds, dates as DBF text and back."""
    text = values.dbf_date_text(F.col("ts"))
    return views.points(spark, d).select(
        "fid", F.unix_seconds(values.whole_seconds(F.col("ts"))).alias("seconds"), text.alias("dbf"), values.dbf_date(text).alias("day")
    )


@query("SELECT c_custkey AS id, regexp_replace(c_name, '[^A-Za-z0-9_.-]', '_', 'g') AS name, trim(printf('%,d', c_custkey * 1234567)) AS n FROM customer")
def text_forms(spark, d):
    """XML names and thousands separators."""
    return views.read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), values.xml_name(F.col("c_name")).alias("name"), values.thousands(F.col("c_custkey") * 1234567).alias("n")
    )


@query(with_views("track_points") + " SELECT fid, seq, x, y FROM track_points")
def coordinate_text(spark, d):
    """Coordinates written as text and read again."""
    text = values.kml_coordinates(measures.vertices(F.col("geom")))
    rows = views.tracks(spark, d).select("fid", F.posexplode(values.parse_coordinates(text)).alias("seq", "v"))
    return rows.select("fid", "seq", "v.x", "v.y")


@query("SELECT 'n_name' AS name, 'C' AS type, max(octet_length(n_name::BLOB))::INT AS length, 0 AS decimals FROM nation UNION ALL SELECT 'n_regionkey', 'N', max(length(n_regionkey::VARCHAR))::INT, 0 FROM nation")
def dbf_schema(spark, d):
    """Field types and widths of a DBF by one aggregate."""
    return profile.dbf_fields(views.cell_frame(spark, d).df)


_BACK = with_views("cells", "cell_vertices") + " SELECT fid, n_name, seq, x, y FROM cells JOIN cell_vertices USING (fid)"


def _vertices(ff: FeatureFrame, shift: int = 0) -> DataFrame:
    """Vertices of a frame that was written and read, rings from their lower left corner."""
    rows = model.exploded(ff.df.select((F.col("fid") + shift).alias("fid"), F.col("props.n_name").alias("n_name"), "geom"), "fid", "n_name")
    return rows.select("fid", "n_name", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


def _through(spark, data: bytes, ending: str) -> str:
    path = f"{shared_path(spark, 'file')}.{ending}"
    catalog.write_file(spark, data, path)
    return path


@query(_BACK)
def geojson_roundtrip(spark, d):
    """Cells through a GeoJSON document."""
    return _vertices(catalog.read(spark, _through(spark, geojson.collection_text(views.cell_frame(spark, d)).encode(), "geojson")))


@query(_BACK)
def geojson_lines_roundtrip(spark, d):
    """Cells through gzipped newline-delimited GeoJSON."""
    path = f"{shared_path(spark, 'lines')}.geojsonl"
    geojson.write_lines(views.cell_frame(spark, d), path, gz=True)
    return _vertices(geojson.read_lines(spark, path))


@query(_BACK)
def container_roundtrip(spark, d):
    """Cells through the binary container."""
    return _vertices(catalog.read(spark, _through(spark, container.to_bytes(views.cell_frame(spark, d)), "pbf")))


@query(_BACK)
def shapefile_roundtrip(spark, d):
    """Cells through a zipped shapefile."""
    return _vertices(catalog.read(spark, _through(spark, shapefile.to_bytes(views.cell_frame(spark, d)), "zip")))


@query(_BACK)
def kml_roundtrip(spark, d):
    """Cells through KMZ."""
    return _vertices(catalog.read(spark, _through(spark, kml.to_bytes(views.cell_frame(spark, d)), "kmz")))


@query(_BACK)
def gml_roundtrip(spark, d):
    """Cells through GML."""
    return _vertices(catalog.read(spark, _through(spark, gml.to_bytes(views.cell_frame(spark, d)), "gml")))


@query(with_views("cells") + " SELECT fid, n_name, 4::BIGINT AS corners, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM cells")
def topojson_roundtrip(spark, d):
    """Cells through TopoJSON: same rings, each turned to start at a node."""
    ff = catalog.read(spark, _through(spark, topojson.to_bytes(views.cell_frame(spark, d)), "topojson"))
    b = measures.bbox(F.col("geom"))
    rows = ff.df.select(F.col("fid"), F.col("props.n_name").alias("n_name"), (F.size(measures.vertices(F.col("geom"))) - 1).cast("long").alias("corners"), b.alias("b"))
    return rows.select("fid", "n_name", "corners", "b.*")


@query(_BACK)
def gzip_roundtrip(spark, d):
    """Cells through a gzipped container, made again from a gzipped GeoJSON document."""
    ff = catalog.read(spark, _through(spark, geojson.collection_text(views.cell_frame(spark, d)).encode(), "geojson.gz"))
    return _vertices(catalog.read(spark, _through(spark, container.to_bytes(ff), "pbf.gz")))


@query(_BACK)
def bytes_roundtrip(spark, d):
    """Cells through bytes whose format goes by their content: GML, then a zipped shapefile, then a container."""
    ff = views.cell_frame(spark, d)
    for write in (gml.to_bytes, shapefile.to_bytes, container.to_bytes):
        ff = catalog.read(spark, write(ff))
    return _vertices(ff)


@query(_BACK)
def table_roundtrip(spark, d):
    """Cells through a saved table with metadata."""
    name = "geoloom_cells"
    catalog.delete(spark, name)
    catalog.save(views.cell_frame(spark, d), name)
    return _vertices(catalog.load(spark, name))


@query("SELECT 'renamed' AS name, 'CC0' AS license, count(*) AS n FROM nation")
def container_update(spark, d):
    """Metadata of container bytes replaced, body passed on."""
    data = container.update(container.to_bytes(views.cell_frame(spark, d)), name="renamed", license="CC0")
    ff = container.read(spark, _through(spark, data, "pbf"))
    return ff.df.agg(F.count("*").alias("n")).select(F.lit(ff.meta.name).alias("name"), F.lit(ff.meta.license).alias("license"), "n")


@query(_CONTAIN)
def stream_contain(spark, d):
    """Points of a stream joined with polygons, counted when it has run out (J01 on Structured Streaming)."""
    import uuid

    source = f"{shared_path(spark, 'stream')}"
    views.points(spark, d).write.parquet(source)
    rows = streams.contained(streams.points(spark, source, views.points(spark, d).schema, 100), views.cells(spark, d)).select("fid", "n_name")
    out = shared_path(spark, "streamed")
    run = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "state"))
    run.trigger(availableNow=True).queryName(f"contain_{uuid.uuid4().hex}").start().awaitTermination()
    return spark.read.schema("fid long, n_name string").parquet(out).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM nation")
def frame_length(spark, d):
    """How many features a frame holds."""
    return spark.createDataFrame([(profile.length(views.cell_frame(spark, d)),)], "n long")


@query(with_views("cells") + " SELECT fid, x1 + fid * 5 <= 180 AS valid FROM cells")
def extent_validity(spark, d):
    """Boxes moved east, valid while they end before the antimeridian."""
    box = F.struct(*(((F.col(f"b.{c}") + F.col("fid") * 5) if c[0] == "x" else F.col(f"b.{c}")).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    boxed = views.cells(spark, d).select("fid", measures.bbox(F.col("geom")).alias("b"))
    return boxed.select("fid", measures.is_bbox(box).alias("valid"))


@query(with_views("points") + " SELECT event_type, count(*) AS n FROM points WHERE NOT (lng BETWEEN -20 AND 60.5 AND lat BETWEEN -10 AND 45.25) GROUP BY event_type")
def points_outside_box(spark, d):
    """Points outside a box, by type."""
    box = F.struct(*(F.lit(v).alias(k) for k, v in (("xmin", -20.0), ("ymin", -10.0), ("xmax", 60.5), ("ymax", 45.25))))
    far = views.points(spark, d).filter(~predicates.in_box(box, F.col("lng"), F.col("lat")))
    return far.groupBy("event_type").agg(F.count("*").alias("n"))


@query(with_views("cells") + " SELECT fid, n_name, n_regionkey FROM cells")
def properties_table(spark, d):
    """One column a property (P10)."""
    return relational.table(views.cell_frame(spark, d))


@query("SELECT 0::BIGINT AS fid, 'a' AS k UNION ALL SELECT 1, 'b' UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) + 1, n_name FROM nation")
def concat_instances(spark, d):
    """Frames of one feature and then of many, fids following on."""
    one = lambda k: FeatureFrame(spark.range(1).select(F.col("id").alias("fid"), model.point(F.lit(1.0), F.lit(2.0)).alias("geom"), F.struct(F.lit(k).alias("k")).alias("props")))
    cells = views.cell_frame(spark, d)
    many = cells.with_df(cells.df.withColumn("props", F.struct(F.col("props.n_name").alias("k"))))
    return relational.table(relational.concat(one("a"), one("b"), many))


@query(
    with_views("suppliers") + """ SELECT fid, round(pow(sin(radians(lat - 20) / 2), 2) + cos(radians(lat)) * cos(radians(20.0::DOUBLE)) * pow(sin(radians(lng - 10) / 2), 2), 6) AS h,
 round(12742.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(lat - 20) / 2), 2) + cos(radians(lat)) * cos(radians(20.0::DOUBLE)) * pow(sin(radians(lng - 10) / 2), 2)))), 3) AS km FROM suppliers"""
)
def haversine_parts(spark, d):
    """Haversine measure and kilometres from each supplier to (10, 20)."""
    h = geodesy.haversine(F.col("lng"), F.col("lat"), F.lit(10.0), F.lit(20.0))
    return views.suppliers(spark, d).select("fid", F.round(h, 6).alias("h"), F.round(geodesy.kilometres(h), 3).alias("km"))


@query(
    """SELECT event_id AS fid, CASE event_id % 8 WHEN 0 THEN 'NULL' WHEN 1 THEN 'BOOL' WHEN 2 THEN 'INTEGER' WHEN 3 THEN 'FLOAT' WHEN 4 THEN 'STRING'
 WHEN 5 THEN 'COLOR' WHEN 6 THEN CASE WHEN event_id % 400 <= 180 THEN 'BBOX' ELSE 'JSON' END ELSE 'JSON' END AS type FROM events"""
)
def value_types(spark, d):
    """Types of property values of every kind."""
    fid = F.col("fid")
    texts = F.array(
        F.lit("null"), F.lit("true"), fid.cast("string"), F.concat(fid.cast("string"), F.lit(".5")), F.concat(F.lit('"v'), fid.cast("string"), F.lit('"')),
        F.lit('"#ff8800"'), F.concat(F.lit("[0,0,"), (fid % 400).cast("string"), F.lit(",1]")), F.concat(F.lit('{"a":'), fid.cast("string"), F.lit("}")),
    )
    kind = values.variant_type(F.parse_json(F.element_at(texts, (fid % 8 + 1).cast("int"))))
    return views.points(spark, d).select("fid", kind.alias("type"))


@query("SELECT n_nationkey::BIGINT AS fid, '{\"name\":\"' || n_name || '\",\"at\":[' || n_nationkey || ',' || n_regionkey || ']}' AS text FROM nation")
def json_texts(spark, d):
    """JSON text of structs."""
    value = F.struct(F.col("n_name").alias("name"), F.array(F.col("fid"), F.col("n_regionkey").cast("long")).alias("at"))
    return views.cells(spark, d).select("fid", values.json_text(value).alias("text"))


@query(with_views("points") + " SELECT fid, floor(lng * 10 + 0.5) / 10 AS x, floor(lat * 10 + 0.5) / 10 AS y FROM points")
def requantised(spark, d):
    """Coordinates at a precision of one digit."""
    v = F.col("geom.members")[0]["polys"][0][0][0]
    return relational.requantise(views.point_frame(spark, d), 1).df.select("fid", v["x"].alias("x"), v["y"].alias("y"))


@query(with_views("cells") + " SELECT fid, upper(n_name) || ' ' || fid AS label FROM cells WHERE n_regionkey <> 2 AND x0 < 100")
def python_callbacks(spark, d):
    """Filter and property map by Python functions of properties, type, box and number."""
    kept = relational.filter_features(views.cell_frame(spark, d), lambda p, t, b, i: p["n_regionkey"] != 2 and t == "Polygon" and b["xmin"] < 100)
    named = relational.map_properties(kept.with_df(kept.df.withColumn("props", F.struct("props.n_name", "fid"))), lambda p: (f"{p['n_name'].upper()} {p['fid']}",), "label string")
    return relational.table(named)


@query(with_views("cells") + ", k AS (SELECT DISTINCT CASE WHEN n_regionkey < 3 THEN (n_regionkey * 50)::VARCHAR END AS k FROM cells) SELECT row_number() OVER (ORDER BY k) - 1 AS place, 'cells@' || k AS name FROM k WHERE k IS NOT NULL")
def class_order(spark, d):
    """Classes by a Python function, in the order of their texts."""
    parts = relational.classified(views.cell_frame(spark, d), lambda p, t, b, i: p["n_regionkey"] * 50 if p["n_regionkey"] < 3 else None)
    return spark.createDataFrame([(i, f.meta.name) for i, f in enumerate(parts.values())], "place long, name string")
