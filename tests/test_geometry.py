import json
import math

import pytest
from pyspark.sql import functions as F

from geoloom import model
from geoloom.functions import coords, geodesy, measures, morton, predicates, values
from geoloom.model import FeatureFrame, Meta
from geoloom.operators import normalise, profile, relational, spatial_join, topology
from geoloom.sources import container, geojson, gml, kml, shapefile, topojson

SQUARE = [[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]]
HOLE = [[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5], [0.5, 0.5]]
SHAPES = [
    {"type": "Point", "coordinates": [1.5, -2.25]},
    {"type": "MultiPoint", "coordinates": [[0, 0], [1, 1], [2, 0]]},
    {"type": "LineString", "coordinates": [[0, 0], [10, 5.5]]},
    {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 5]]]},
    {"type": "Polygon", "coordinates": [SQUARE, HOLE]},
    {"type": "MultiPolygon", "coordinates": [[SQUARE], [[[x + 10, y] for x, y in SQUARE], [[x + 10, y] for x, y in HOLE]]]},
    {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [SQUARE]}]},
]
PROPS = [{"a": 1, "b": "x"}, {"a": 2.5}, {"b": "y", "c": True}, {"n": {"u": 1, "v": "w"}}, {"d": "2024-02-03"}, {"k": "#f80"}, {"l": [1, 2]}]


@pytest.fixture(scope="module")
def frame(spark):
    feats = [{"type": "Feature", "geometry": g, "properties": p} for g, p in zip(SHAPES, PROPS)]
    return geojson.from_object(spark, {"type": "FeatureCollection", "name": "all", "features": feats})


def shapes(ff):
    return [json.loads(r[0])["geometry"] for r in geojson.feature_text(ff.df).orderBy("fid").select("text").collect()]


def numbers(shape):
    return json.loads(json.dumps(shape), parse_int=float)


def test_geojson_round_trip(frame):
    assert frame.meta.name == "all"
    assert [numbers(s) for s in shapes(frame)] == [numbers(s) for s in SHAPES]
    text = json.loads(geojson.collection_text(frame))
    assert text["name"] == "all" and text["features"][0]["properties"]["b"] == "x"


def test_measures(frame):
    c = frame.df.select("fid", measures.counts(F.col("geom")).alias("c"), measures.area(F.col("geom")).alias("a"), measures.centroid(F.col("geom")).alias("m"), measures.bbox(F.col("geom")).alias("b"))
    r = {x["fid"]: x for x in c.collect()}
    assert tuple(r[5]["c"]) == (0, 0, 2, 15) and tuple(r[6]["c"]) == (1, 0, 1, 6)
    one = (math.radians(1) * 6378137.0) ** 2
    assert r[4]["a"] == pytest.approx(3 * one, rel=2e-3) and r[2]["a"] == 0
    assert r[6]["a"] == pytest.approx(4 * one, rel=2e-3)
    assert tuple(r[0]["m"]) == (1.5, -2.25) and tuple(r[4]["b"]) == (0, 0, 2, 2)
    assert tuple(profile.totals(frame.df).first()) == (5, 3, 4, 42)


def test_contains_with_holes_and_grid(spark, frame):
    pts = spark.createDataFrame([(0, 0.1, 0.1), (1, 1.0, 1.0), (2, 10.2, 0.2), (3, 50.0, 50.0), (4, 11.0, 1.0)], "fid long, lng double, lat double")
    for way in (True, False):
        got = {(r["fid"], r["poly_fid"]) for r in spatial_join.contain_join(pts, frame.df.select("fid", "geom"), broadcast=way).collect()}
        assert got == {(0, 4), (0, 5), (0, 6), (1, 5), (1, 6), (2, 5)}
        assert {r[0] for r in spatial_join.contain_join(pts, frame.df.select("fid", "geom"), "left_anti", broadcast=way).select("fid").collect()} == {3, 4}
    assert [r[0] for r in spatial_join.containing(frame.df, 0.1, 0.1).collect()] == [4, 5, 6]
    assert spatial_join.containing(frame.df, 90, 80, first=True).first()[0] == -1


def test_quantise_rounds_halves_up(spark):
    r = spark.range(1).select(coords.quantise(F.lit(-2.5), 0).alias("a"), coords.quantise(F.lit(2.5), 0).alias("b"), coords.wrap_lng(F.lit(540.0)).alias("c"), coords.wrap_lng(F.lit(-190.0)).alias("d")).first()
    assert tuple(r) == (-2, 3, 180.0, 170.0)


def test_morton_round_trip(spark):
    x, y = morton.unpack(F.col("m"))
    rows = spark.createDataFrame([(180.0, 90.0), (-180.0, -90.0), (139.7671248, 35.6812362)], "x double, y double")
    out = rows.select("x", "y", morton.pack(F.col("x"), F.col("y")).alias("m")).select("x", "y", x.alias("u"), y.alias("v")).collect()
    assert all(abs(r["x"] - r["u"]) < 5.1e-8 and abs(r["y"] - r["v"]) < 5.1e-8 for r in out)


def test_container_bytes(spark, frame, tmp_path):
    data = container.to_bytes(frame)
    meta, keys, _, feats = container.decode(data)
    feats = list(feats)
    assert meta.name == "all" and {"a", "b", "c", "n", "n.u", "n.v"} <= set(keys) and len(feats) == 7
    assert feats[0][1] == {"a": 1, "b": "x"} and feats[3][1] == {"n": {"u": 1, "v": "w"}} and feats[5][1] == {"k": "rgb(240,128,0)"}
    (tmp_path / "x.pbf").write_bytes(data)
    back = container.read(spark, str(tmp_path / "x.pbf"))
    assert [numbers(s) for s in shapes(back)] == [numbers(s) for s in SHAPES]
    other = container.update(data, name="new", description="d")
    assert container.decode(other)[0] == Meta("new", "d", "", 6) and list(container.decode(other)[3]) == feats


@pytest.mark.parametrize("v", [True, 5, -7, 2.5, "text", "", {"a": [1, None]}, [0, 0, 1, 1.5], [1, 2]])
def test_container_values(v):
    assert container.decode_value(container.encode_value(v)) == v


def test_shapefile_layers(frame):
    data = shapefile.to_bytes(frame)
    back = list(shapefile.parse(data, "x.zip"))
    kinds = sorted(g["gtype"] for g, _ in back)
    assert kinds == sorted([0, 0, 1, 2, 3, 4, 4, 5])
    holed = [g for g, p in back if g["gtype"] == model.POLYGON and len(g["members"][0]["polys"][0]) == 2]
    assert len(holed) == 1


def test_dbf_types():
    rows = [{"n": 1, "f": 2.5, "s": "é", "d": "2024-02-03", "b": True, "m": 1}, {"n": -20, "f": 10.25, "s": None, "b": False, "m": "x"}]
    data = shapefile._dbf(rows, "utf-8")
    back = list(shapefile.records(data, "utf-8"))
    assert back[0] == {"n": 1, "f": 2.5, "s": "é", "d": "2024-02-03", "b": True, "m": "1"}
    assert back[1] == {"n": -20, "f": 10.25, "b": False, "m": "x"}


@pytest.mark.parametrize("fmt", [kml, gml])
def test_xml_formats_keep_shapes(frame, fmt):
    data = fmt.to_bytes(frame) if fmt is gml else fmt.to_bytes(frame, zipped=False)
    back = [g for g, _ in fmt.parse(data, "x")]
    assert [g["gtype"] for g in back] == list(range(7))
    assert len(back[4]["members"][0]["polys"][0]) == 2 and back[2]["members"][0]["polys"][0][0][1] == {"x": 10.0, "y": 5.5}


def test_xml_escapes_and_refuses_entities(spark):
    ff = geojson.from_object(spark, {"type": "Feature", "geometry": SHAPES[0], "properties": {"name": "<a & b>", "x:y": "1 < 2"}})
    assert list(kml.parse(kml.to_bytes(ff, zipped=False), "x"))[0][1] == {"name": "<a & b>", "x:y": "1 < 2"}
    with pytest.raises(ValueError):
        list(kml.parse(b'<!DOCTYPE x [<!ENTITY a "b">]><kml/>', "x"))


def test_gml_references():
    doc = b"""<c xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:ks="urn:k">
    <gml:Point gml:id="p1"><gml:pos>35.5 139.5</gml:pos></gml:Point>
    <gml:featureMember><ks:City><ks:name>T</ks:name><ks:loc xlink:href="#p1"/></ks:City></gml:featureMember>
    <gml:featureMember><ks:City><ks:name>lost</ks:name><ks:loc xlink:href="#p9"/></ks:City></gml:featureMember></c>"""
    assert [(g["members"][0]["polys"][0][0][0], p) for g, p in gml.features(doc)] == [({"x": 139.5, "y": 35.5}, {"ks_name": "T"})]


def grid(spark, n):
    rows = [(j * n + i, i, j) for i in range(n) for j in range(n)]
    c = F.col
    return spark.createDataFrame(rows, "fid long, i int, j int").select("fid", model.rectangle(c("i"), c("j"), c("i") + 1, c("j") + 1).alias("geom"))


def test_topology_of_squares(spark):
    g = grid(spark, 3)
    pairs = {(r[0], r[1]) for r in topology.neighbours(g).collect()}
    assert len(pairs) == 24 and all((b, a) in pairs and a != b for a, b in pairs)
    assert topology.mesh(g).count() == 12
    ring = topology.merge(g.filter("fid <> 4")).first()["geom"]
    assert len(ring["members"][0]["polys"]) == 1 and len(ring["members"][0]["polys"][0]) == 2
    total = topology.merge(g.filter("fid <> 4")).select(measures.area(F.col("geom"))).first()[0]
    assert total == pytest.approx(g.filter("fid <> 4").agg(F.sum(measures.area(F.col("geom")))).first()[0], abs=10)
    apart = topology.merge(g.filter("fid IN (0, 2)")).first()["geom"]
    assert len(apart["members"][0]["polys"]) == 2
    touching = topology.merge(g.filter("fid IN (0, 4)")).first()["geom"]
    assert len(touching["members"][0]["polys"]) == 2


def test_topojson_round_trip(spark):
    g = grid(spark, 2).withColumn("props", F.struct(F.col("fid").alias("k")))
    topo = json.loads(topology.topojson_text(g, "g"))
    assert len(topo["arcs"]) == 8 and topo["type"] == "Topology"
    for geom, props in topojson.features(topo):
        ring = geom["members"][0]["polys"][0][0]
        assert len(ring) == 5 and ring[0] == ring[-1]
        assert {(v["x"], v["y"]) for v in ring} == {(props["k"] % 2 + a, props["k"] // 2 + b) for a in (0, 1) for b in (0, 1)}


@pytest.mark.parametrize(
    ("p", "q", "r", "s", "want"),
    [
        ((0, 0), (1000, 1000), (0, 1000), (1000, 0), [(500, 500)]),
        ((0, 0), (1000, 0), (500, 0), (500, 900), [(500, 0)]),
        ((0, 0), (1000, 0), (400, 0), (1600, 0), [(400, 0), (1000, 0)]),
        ((0, 0), (1000, 0), (500, 5), (500, 900), [(500, 5)]),
        ((0, 0), (1000, 0), (500, 20), (500, 900), []),
        ((0, 0), (10, 0), (20, 5), (30, 5), []),
        ((0, 0), (2014, 2018), (0, 2018), (2014, 0), [(1010, 1010)]),
        ((0, 0), (1000, 0), (100, -5), (900, 40), [(100, -5), (190, 0)]),
    ],
)
def test_meetings(p, q, r, s, want):
    assert topology.meetings(p, q, r, s) == want


def test_noding_cuts_both_lines(spark):
    lines = spark.createDataFrame([(0, 0.0, 0.0, 0.01, 0.01), (1, 0.0, 0.01, 0.01, 0.0), (2, 1.0, 1.0, 1.1, 1.0)], "fid long, a double, b double, c double, d double")
    c = F.col
    rows = lines.select("fid", model.linestring(F.array(model.vertex(c("a"), c("b")), model.vertex(c("c"), c("d")))).alias("geom"))
    got = {r["fid"]: len(r["ns"]) for r in topology.noded(rows).collect()}
    assert got == {0: 3, 1: 3, 2: 2}


def test_noding_against_brute_force(spark):
    import random

    r = random.Random(11)
    lines = [tuple(r.randrange(-500_000, 500_000) / 1e6 for _ in range(4)) for _ in range(40)]
    side = lambda p, q, x: (q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0]) > 0
    cross = lambda s, t: side(s[:2], s[2:], t[:2]) != side(s[:2], s[2:], t[2:]) and side(t[:2], t[2:], s[:2]) != side(t[:2], t[2:], s[2:])
    want = {i: 2 + sum(cross(s, t) for j, t in enumerate(lines) if j != i) for i, s in enumerate(lines)}
    c = F.col
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "fid long, a double, b double, c double, d double")
    rows = rows.select("fid", model.linestring(F.array(model.vertex(c("a"), c("b")), model.vertex(c("c"), c("d")))).alias("geom"))
    assert {r["fid"]: len(r["ns"]) for r in topology.noded(rows).collect()} == want and sum(want.values()) > 300


def two_point_lines(spark, lines):
    c = F.col
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(lines)], "fid long, a double, b double, c double, d double")
    return rows.select("fid", model.linestring(F.array(model.vertex(c("a"), c("b")), model.vertex(c("c"), c("d")))).alias("geom"))


def shapes_of(df):
    segs = topology.segments(df, "fid", kinds=topology.LINEAR)
    return segs.select(F.col("fid").alias("sid"), "a", "b", F.col("fid").alias("line"), F.col("seq").alias("s0"), F.col("seq").alias("s1"))


def test_long_segments_take_few_cells(spark):
    lines = [(i % 300 - 150, i % 160 - 80, i % 300 - 150 + 0.4, i % 160 - 80 + 0.3) for i in range(1000)] + [(-180, -85, 180, 85), (-180, 0, 180, 0)]
    shapes = shapes_of(two_point_lines(spark, lines))
    levels = sorted(r[0] for r in shapes.select(topology.level(F.col("a"), F.col("b"))).distinct().collect())
    assert levels == [2, 5] and topology.placed(shapes, levels).count() < 5 * len(lines)


def test_copies_of_a_line_meet_once(spark):
    copies, met = 300, []
    df = two_point_lines(spark, [(0, 0, 1, 1)] * copies + [(0, 1, 1, 0)] * copies + [(0, 0.25, 0.5, 0.25)])
    whole, found = topology.candidates, lambda *a: met.append(whole(*a)) or met[0]
    topology.candidates = found
    try:
        got = {r["fid"]: len(r["ns"]) for r in topology.noded(df).collect()}
    finally:
        topology.candidates = whole
    assert got == {i: 4 if i < copies else 3 for i in range(2 * copies + 1)}
    assert met[0].count() == 2


def test_noding_across_grids_against_every_pair(spark):
    """Segments of all lengths, parallel ones among them: no pair that meets is lost, whichever grids it lies on."""
    import random

    r = random.Random(3)
    spans = [10.0**-r.randrange(7) * r.choice([1, 1, 40]) for _ in range(150)]
    lines = [(x, y, x + r.uniform(-w, w), y + r.choice([0, 1]) * r.uniform(-w, w)) for w in spans for x, y in [(r.choice([0, w]) * r.uniform(-1, 1), r.choice([0, w]) * r.uniform(-1, 1))]]
    shapes = shapes_of(two_point_lines(spark, lines))
    rows = sorted(shapes.collect())
    levels = sorted(x[0] for x in shapes.select(topology.level(F.col("a"), F.col("b"))).distinct().collect())
    found = {(x["a_sid"], x["b_sid"]) for x in topology.candidates(shapes, levels).collect()}
    ends = lambda x: (divmod(x["a"], topology.SIDE), divmod(x["b"], topology.SIDE))
    want = {(p["sid"], q["sid"]) for p in rows for q in rows if p["sid"] < q["sid"] and topology.meetings(*ends(p), *ends(q))}
    assert len(levels) > 3 and len(want) > 300 and want <= found and len(found) < 2 * len(want)


def test_effective_areas_never_fall():
    a = topology.effective_areas([(0, 0), (1, 0.1), (2, 1), (3, -1), (4, 0)], metres=False)
    assert a[0] == a[-1] == math.inf and all(x > 0 for x in a[1:-1]) and min(a[1:-1]) == pytest.approx(min(a))
    assert topology.rank_of(0) == 0 and topology.rank_of(math.inf) == 63 and topology.rank_of(2.0**40) == 51


def test_line_split_at_antimeridian():
    parts = normalise.split_line([(170, 0), (-170, 0)])
    assert [[(round(x, 6), round(y, 6)) for x, y in p] for p in parts] == [[(170, 0), (180, 0)], [(-180, 0), (-170, 0)]]


def test_lines_are_cut_without_python(spark):
    """Lines, points and collections across the antimeridian: as the Arrow function cut them, and no row of them goes to it."""
    import random

    r = random.Random(4)
    far = lambda: (r.choice([-180.0, 180.0, 0.0, 190.0, -540.0, r.uniform(-200, 200), r.uniform(-180, 180)]), r.choice([0.0, r.uniform(-85, 85)]))
    line = lambda: [far() for _ in range(r.randrange(9))]
    member = lambda kind: (kind, [[line() for _ in range(r.randrange(4) if kind == model.MULTILINE else 1)]])
    geoms = [(k, [member(k)]) for k in [model.LINE, model.MULTILINE, model.MULTIPOINT] * 60]
    geoms += [(model.COLLECTION, [member(r.choice([model.LINE, model.MULTILINE, model.MULTIPOINT])) for _ in range(r.randrange(4))]) for _ in range(40)]
    geoms += [(model.LINE, [(model.LINE, [[[(170.0, 10.0), (-170.0, 20.0)] * 40]])])]
    df = spark.createDataFrame(list(enumerate(geoms)), f"fid long, geom {model.GEOMETRY}")
    rows = df.withColumn("s", F.coalesce(normalise.needs_split(F.col("geom")), F.lit(False))).collect()
    want = {x["fid"]: normalise._fix(x["geom"].asDict(True), x["s"], 6) for x in rows}
    assert sum(x["s"] for x in rows) > 100
    fix = normalise._fix
    normalise._fix = None  # the Arrow function would fail
    try:
        got = {x["fid"]: x["geom"].asDict(True) for x in normalise.normalised(df).collect()}
    finally:
        normalise._fix = fix
    assert got == want


def test_rings_are_handed_on_in_small_pieces(spark):
    ring = [(x, y) for x, y in ((0, 0), (0, 9), (5, 12), (9, 9), (9, 0), (0, 0))]
    df = spark.createDataFrame([(i, (model.POLYGON, [(model.POLYGON, [[[(float(x + i), float(y)) for x, y in ring]]])])) for i in range(50)], f"fid long, geom {model.GEOMETRY}")
    want = {x["fid"]: x["geom"] for x in normalise.normalised(df.coalesce(1)).collect()}
    held, normalise.HELD = normalise.HELD, 15
    try:
        assert {x["fid"]: x["geom"] for x in normalise.normalised(df.coalesce(1)).collect()} == want and len(want) == 50
    finally:
        normalise.HELD = held


def test_ring_split_and_pole():
    pieces = normalise.split_ring([(170, -10), (170, 10), (-170, 10), (-170, -10), (170, -10)])
    assert len(pieces) == 2 and all(p[0] == p[-1] and normalise.ring_sum(p) > 0 for p in pieces)
    assert {math.copysign(1, p[1][0]) for p in pieces} == {1.0, -1.0}
    cap = normalise.split_ring([(0, 60), (90, 60), (180 - 1e-9, 60), (-90, 60), (0, 60)][::-1])
    assert len(cap) == 1 and max(y for _, y in cap[0]) == 90.0
    four = [(170, -20), (170, 20), (-170, 20), (-170, 10), (175, 10), (175, -10), (-170, -10), (-170, -20), (170, -20)]
    assert len(normalise.split_ring(four)) == 3


def test_polygon_with_hole_over_antimeridian(spark):
    ff = geojson.from_object(spark, {"type": "Polygon", "coordinates": [[[170, -10], [170, 10], [190, 10], [190, -10], [170, -10]], [[172, -1], [174, -1], [174, 1], [172, 1], [172, -1]]]})
    out = normalise.normalised(ff.df.select("fid", "geom"))
    g = out.first()["geom"]
    assert g["gtype"] == model.MULTIPOLYGON and sorted(len(p) for p in g["members"][0]["polys"]) == [1, 2]
    again = normalise.normalised(out)
    assert again.select(measures.area(F.col("geom"))).first() == out.select(measures.area(F.col("geom"))).first()


def test_clean_ring():
    spike = [(0, 0), (0, 10), (5, 10), (9, 10), (5, 10), (10, 10), (10, 0), (0, 0)]
    assert (9, 10) not in normalise.clean_ring(spike)[:3] or normalise.clean_ring(spike)[0] == normalise.clean_ring(spike)[-1]
    square = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
    assert normalise.clean_ring(square) == square


def test_normalise_turns_and_dedupes(spark):
    ff = geojson.from_object(spark, [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [SQUARE[::-1], HOLE[::-1]]}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [0.0000001, 0], [1, 1]]}, "properties": {}},
    ])
    a, b = normalise.normalised(ff.df.select("fid", "geom")).orderBy("fid").collect()
    outer, hole = a["geom"]["members"][0]["polys"][0]
    ring = lambda r: [(v["x"], v["y"]) for v in r]
    assert normalise.ring_sum(ring(outer)) > 0 > normalise.ring_sum(ring(hole))
    assert len(b["geom"]["members"][0]["polys"][0][0]) == 2


def test_colours(spark):
    rows = spark.createDataFrame([("#f80",), ("#ff8800",), ("#ffff",), ("rgb(1,2,3)",), ("rgba(1,2,3,0.5)",), ("red",)], "t string")
    got = [None if r[0] is None else tuple(r[0]) for r in rows.select(values.colour(F.col("t"))).collect()]
    assert got == [(240, 128, 0, 255), (255, 136, 0, 255), (0, 0, 0, 255), (1, 2, 3, 255), (1, 2, 3, 127), None]
    assert kml.aabbggrr("#ff8800") == "ff0088ff"


def test_relational_operators(frame, spark):
    assert relational.renamed(frame, "@x").meta.name == "all@x" and relational.renamed(frame, "z").meta.name == "z"
    assert relational.filter_features(frame, lambda p, t, b, i: t == "Point").df.count() == 1
    both = relational.concat(frame, frame)
    assert both.df.count() == 14 and both.df.agg(F.max("fid")).first()[0] == 13 and both.meta.name == "all"
    assert relational.concatenate([frame, frame.header(precision=5)]) is None and relational.concatenate([]) is None
    assert relational.dissolve(frame, "nope") is frame
    report = profile.lint(frame)
    assert "Polygon: 1" in report and "a: " in report
    coarse = relational.requantise(frame, 0).df.filter("fid = 0").first()["geom"]["members"][0]["polys"][0][0][0]
    assert (coarse["x"], coarse["y"]) == (2.0, -2.0)


def test_great_circle_and_bounds(spark):
    r = spark.range(1).select(geodesy.great_circle_arc(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0), F.lit(3)).alias("a"), geodesy.kilometres(geodesy.haversine(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0))).alias("km")).first()
    assert [round(p["x"], 6) for p in r["a"]] == [30.0, 60.0] and r["km"] == pytest.approx(6371 * math.pi / 2)


def test_predicates_on_borders(spark):
    ring = F.array(*(model.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in SQUARE))
    ask = [(0.0, 0.0), (2.0, 1.0), (1.0, 2.0), (1.0, 0.0), (0.0, 1.0)]
    got = spark.range(1).select(*(predicates.ray_cast(ring, F.lit(x), F.lit(y)).alias(f"c{i}") for i, (x, y) in enumerate(ask))).first()
    assert list(got) == [True, False, False, True, True]


def test_frame_is_immutable(frame):
    other = frame.header(name="b")
    assert frame.meta.name == "all" and other.meta.name == "b" and other.df is frame.df and isinstance(other, FeatureFrame)


def test_member_of_an_archive(spark, frame, tmp_path):
    import zipfile

    from geoloom.sources import catalog

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.geojson", geojson.collection_text(frame))
        z.writestr("other.txt", "x")
    ff = catalog.read(spark, f"{tmp_path}/a.zip#in/one.geojson")
    assert ff.meta.name == "one" and [numbers(s) for s in shapes(ff)] == [numbers(s) for s in SHAPES]
    with pytest.raises(ValueError):
        catalog.read(spark, f"{tmp_path}/a.zip#other.txt")


def test_grid_join_keeps_the_points_columns(spark):
    from geoloom.operators import spatial_join

    points = spark.createDataFrame([(1, 0.5, 0.5, 7, 8, 9, 10)], "fid long, lng double, lat double, level int, cell int, cx int, cy int")
    cells = spark.createDataFrame([(0,)], "fid long").select("fid", model.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("geom"))
    for broadcast in (True, False):
        row = spatial_join.contain_join(points, cells, broadcast=broadcast).first()
        assert (row["level"], row["cell"], row["cx"], row["cy"], row["poly_fid"]) == (7, 8, 9, 10, 0)


def test_long_segments_meet_in_the_cells_they_pass(spark):
    import random

    r = random.Random(12)
    lines = [(r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(-9, 9)) for _ in range(6)]
    side = lambda p, q, x: (q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0]) > 0
    cross = lambda s, t: side(s[:2], s[2:], t[:2]) != side(s[:2], s[2:], t[2:]) and side(t[:2], t[2:], s[:2]) != side(t[:2], t[2:], s[2:])
    want = {i: 2 + sum(cross(s, t) for j, t in enumerate(lines) if j != i) for i, s in enumerate(lines)}
    c = F.col
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "fid long, a double, b double, c double, d double")
    rows = rows.select("fid", model.linestring(F.array(model.vertex(c("a"), c("b")), model.vertex(c("c"), c("d")))).alias("geom"))
    assert {r["fid"]: len(r["ns"]) for r in topology.noded(rows).collect()} == want


def test_merged_rings_keep_their_holes_and_islands(spark):
    """A 5 x 5 block of unit cells without its middle ring, and an island in the middle: slanted cuts, a hole, an island."""
    c = F.col
    cells = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in range(5) for y in range(5) if (x, y) == (2, 2) or not (1 <= x <= 3 and 1 <= y <= 3))]
    v = lambda x, y: model.vertex(F.col(x).cast("double"), F.col(y).cast("double"))
    frame = spark.createDataFrame([(2 * i + k, x, y, k) for i, x, y in cells for k in (0, 1)], "fid long, x int, y int, k int").withColumns({"x1": c("x") + 1, "y1": c("y") + 1})
    low, high = F.array(v("x", "y"), v("x", "y1"), v("x1", "y1"), v("x", "y")), F.array(v("x", "y"), v("x1", "y1"), v("x1", "y"), v("x", "y"))
    rows = frame.select("fid", model.polygon(F.array(F.when(c("k") == 0, low).otherwise(high))).alias("geom"))
    polys = topology.merge(rows).first()["geom"]["members"][0]["polys"]
    assert sorted(len(p) for p in polys) == [1, 2]
    area = lambda ring: abs(sum((b["x"] - a["x"]) * (b["y"] + a["y"]) for a, b in zip(ring, ring[1:]))) / 2
    assert sorted(round(area(r)) for p in polys for r in p) == [1, 9, 25]
