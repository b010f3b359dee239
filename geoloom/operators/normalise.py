"""Normalisation of geometries before they are stored.

Order: split at the antimeridian and orient, wrap longitudes, quantise, drop repeats, clean polygon rings. What
built-in functions can say is said with them, lines across the antimeridian too; the sequential steps of rings run in
one Arrow function, and only over rows that hold polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import coords, measures
from ..functions.coords import let

#: Fixed value: vertices that the Arrow function holds as Python objects before it hands rows on, beside one geometry.
HELD = 20_000

Ring = list[tuple[float, float]]


def crossing_latitude(x0: float, y0: float, x1: float, y1: float) -> float:
    """Latitude at which the great circle through two points meets the antimeridian.

    The circle's plane has the normal n = a x b. A point of the antimeridian is (-cos lat, 0, sin lat); it lies in the
    plane where its product with n is 0, that is tan lat = n_x / n_z. A plane through the poles meets it at the pole that
    n_x names; one that holds the antimeridian itself (or equal or opposite points) meets it everywhere: the first latitude.
    """
    (ax, ay, az), (bx, by, bz) = (
        (math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y)))
        for x, y in ((x0, y0), (x1, y1))
    )
    n_x, n_z = ay * bz - az * by, ax * by - ay * bx
    if math.hypot(n_x, n_z) < 1e-15:
        return y0
    return math.degrees(math.atan2(n_x, n_z)) if n_z > 0 else math.degrees(math.atan2(-n_x, -n_z))


def _turn(x: float) -> float:
    return (x + 180) % 360 - 180


def _crosses(a: tuple[float, float], b: tuple[float, float]) -> bool:
    return a[0] * b[0] < 0 and abs(a[0] - b[0]) > 180


def split_line(points: Ring) -> list[Ring]:
    """Parts of a line between its crossings; each part ends and the next begins on its side's meridian."""
    points = [(_turn(x), y) for x, y in points]
    parts, now = [], points[:1]
    for a, b in zip(points, points[1:]):
        if _crosses(a, b):
            lat, side = crossing_latitude(*a, *b), math.copysign(180.0, a[0])
            parts.append([*now, (side, lat)])
            now = [(-side, lat)]
        now.append(b)
    return [*parts, now] if now else parts


def ring_sum(ring: Ring) -> float:
    return sum((x2 - x1) * (y2 + y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:]))


def split_ring(ring: Ring) -> list[Ring]:
    """Closed clockwise pieces of a closed ring.

    Chains between crossings are joined along the meridian to the neighbour in latitude order. A ring around a pole
    has an odd number of crossings; the one next to the pole is joined over it.
    """
    ring = [(_turn(x), y) for x, y in ring]
    # the orientation is that of the unwrapped ring: edges over the antimeridian go the short way
    wide, shift = [ring[0]], 0.0
    for a, b in zip(ring, ring[1:]):
        shift += 360 if a[0] - b[0] > 180 else -360 if b[0] - a[0] > 180 else 0
        wide.append((b[0] + shift, b[1]))
    if ring_sum(wide) < 0:
        ring = ring[::-1]
    at = [i for i in range(len(ring) - 1) if _crosses(ring[i], ring[i + 1])]
    if not at:
        return [ring]
    lats = [crossing_latitude(*ring[i], *ring[i + 1]) for i in at]
    north = sum(y for _, y in ring) / len(ring) > 0
    order = sorted(range(len(at)), key=lambda c: lats[c] if north else -lats[c])
    mate = {}
    for a, b in zip(order[::2], order[1::2]):
        mate[a], mate[b] = b, a
    lone = order[-1] if len(order) % 2 else None
    body, n = ring[:-1], len(ring) - 1

    def chain(c: int) -> tuple[Ring, int]:
        """From behind crossing c to the next crossing, with the points on the meridian at both ends."""
        start, nxt = (at[c] + 1) % n, (c + 1) % len(at)
        walk, i = [], start
        while True:
            walk.append(body[i])
            if i == at[nxt]:
                break
            i = (i + 1) % n
        first, last = math.copysign(180.0, walk[0][0]), math.copysign(180.0, walk[-1][0])
        return [(first, lats[c]), *walk, (last, lats[nxt])], nxt

    pieces, todo = [], set(range(len(at)))
    while todo:
        first = c = min(todo)
        piece: Ring = []
        while c in todo:
            todo.discard(c)
            part, end = chain(c)
            piece += part
            if end == lone:
                side, pole = part[-1][0], 90.0 if north else -90.0
                piece += [(side, pole), (-side, pole)]
                c = lone
            else:
                # the partner's chain that begins on the side where this one ends
                c = mate[end]
            if c == first:
                break
        pieces.append([*piece, piece[0]])
    return pieces


def inside(ring: Ring, x: float, y: float) -> bool:
    found = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            found = not found
    return found


def split_polygon(rings: list[Ring]) -> list[list[Ring]]:
    """Polygons of an outer ring's pieces, each with the pieces of holes that lie in it.

    Pieces of a hole that no outer piece holds are left out.
    """
    outer = [[piece] for piece in split_ring(rings[0])]
    for hole in rings[1:]:
        for piece in split_ring(hole):
            n = max(1, len(piece) - 1)
            x, y = sum(p[0] for p in piece[:-1]) / n, sum(p[1] for p in piece[:-1]) / n
            for poly in outer:
                if any(inside(poly[0], *p) for p in ((x, y), piece[len(piece) // 2])):
                    poly.append(piece[::-1] if ring_sum(piece) >= 0 else piece)
                    break
    return [[p[0] if ring_sum(p[0]) >= 0 else p[0][::-1], *p[1:]] for p in outer]


def clean_ring(ring: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A closed ring without spikes and small bow-ties.

    Drops a vertex where the line turns straight back, and the vertices between an edge and the second or third edge
    after it where they cross; closed again at the end.
    """
    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)

    def back(a, b, c) -> bool:
        ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
        return abs(ux * vy - uy * vx) < 1e-9 and ux * vx + uy * vy <= 0

    def side(a, b, c) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def meet(a, b, c, d) -> bool:
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    changed = True
    while changed and len(pts) > 3:
        changed, n = False, len(pts)
        for i in range(n):
            if back(pts[i - 1], pts[i], pts[(i + 1) % n]):
                del pts[i]
                changed = True
                break
            for j in (2, 3):
                if n > j + 2 and meet(pts[i], pts[(i + 1) % n], pts[(i + j) % n], pts[(i + j + 1) % n]):
                    drop = {(i + k) % n for k in range(1, j + 1)}
                    pts = [p for k, p in enumerate(pts) if k not in drop]
                    changed = True
                    break
            if changed:
                break
    return [*pts, pts[0]] if pts else []


def _split_member(gtype: int, polys: list) -> tuple[int, list]:
    """A member cut at the antimeridian; what falls into parts becomes the multi type."""
    if gtype in (model.LINE, model.MULTILINE):
        parts = [p for line in polys[0] for p in split_line(line)]
        return (model.LINE if len(parts) == 1 and gtype == model.LINE else model.MULTILINE), [parts]
    parts = [q for rings in polys for q in split_polygon(rings)]
    return (model.POLYGON if len(parts) == 1 and gtype == model.POLYGON else model.MULTIPOLYGON), parts


def _fix(geom: dict, split: bool, precision: int) -> dict:
    unit, members = 10**precision, []
    for m in geom["members"]:
        kind = m["gtype"]
        polys = [[[(v["x"], v["y"]) for v in line] for line in rings] for rings in m["polys"]]
        if split and kind not in (model.POINT, model.MULTIPOINT):
            kind, polys = _split_member(kind, polys)
        done = []
        for rings in polys:
            lines = []
            for line in rings:
                whole = [(math.floor(_within(x) * unit + 0.5), math.floor(y * unit + 0.5)) for x, y in line]
                once = [p for i, p in enumerate(whole) if i == 0 or p != whole[i - 1]]
                if kind in (model.POLYGON, model.MULTIPOLYGON) and len(once) > 3:
                    once = clean_ring(once)
                lines.append([{"x": x / unit, "y": y / unit} for x, y in once])
            done.append(lines)
        members.append({"gtype": kind, "polys": done})
    return {"gtype": members[0]["gtype"] if geom["gtype"] != model.COLLECTION and members else geom["gtype"], "members": members}


def _within(x: float) -> float:
    while x > 180:
        x -= 360
    while x < -180:
        x += 360
    return x


def needs_split(geom: Column) -> Column:
    """Out of [-180, 180] or at least 180 degrees wide."""
    box = measures.bbox(geom, 12)
    return (box["xmin"] < -180) | (box["xmax"] > 180) | (box["xmax"] - box["xmin"] >= 180)


def _crossing(a: Column, b: Column) -> Column:
    """crossing_latitude and the first vertex's side as a column: the vertex where the line leaves."""
    at = lambda v: F.struct(
        (F.cos(F.radians(v["y"])) * F.cos(F.radians(v["x"]))).alias("x"), (F.cos(F.radians(v["y"])) * F.sin(F.radians(v["x"]))).alias("y"),
        F.sin(F.radians(v["y"])).alias("z"),
    )
    normal = let(
        F.struct(at(a).alias("a"), at(b).alias("b")),
        lambda p: F.struct(
            (p["a"]["y"] * p["b"]["z"] - p["a"]["z"] * p["b"]["y"]).alias("x"), (p["a"]["x"] * p["b"]["y"] - p["a"]["y"] * p["b"]["x"]).alias("z")
        ),
    )
    lat = let(
        normal,
        lambda n: F.when(F.hypot(n["x"], n["z"]) < 1e-15, a["y"]).when(n["z"] > 0, F.degrees(F.atan2(n["x"], n["z"])))
        .otherwise(F.degrees(F.atan2(-n["x"], -n["z"]))),
    )
    return model.vertex(F.when(a["x"] < 0, -180.0).otherwise(180.0), lat)


def _line_parts(line: Column) -> Column:
    """split_line by built-in functions; a line without vertices has no parts."""

    def turned(v: Column) -> Column:
        rest = (v["x"] + 180.0) % F.lit(360.0)  # with the sign of the dividend
        return model.vertex(F.when(rest < 0, rest + 360.0).otherwise(rest) - 180.0, v["y"])

    def cuts(ps: Column) -> Column:
        def cut(b: Column, i: Column) -> Column:
            a = F.get(ps, i - 1)
            hit = (i > 0) & (a["x"] * b["x"] < 0) & (F.abs(a["x"] - b["x"]) > 180)
            return F.when(hit, F.struct(i.alias("i"), _crossing(a, b).alias("v")))

        return F.filter(F.transform(ps, cut), lambda c: c.isNotNull())

    def parts(ps: Column, at: Column) -> Column:
        none = F.array().cast(f"array<{model.VERTEX}>")

        def part(k: Column) -> Column:
            came, goes = F.get(at, k - 1), F.get(at, k)
            begin, end = F.coalesce(came["i"], F.lit(0)), F.coalesce(goes["i"], F.size(ps))
            head = F.when(came.isNotNull(), F.array(model.vertex(-came["v"]["x"], came["v"]["y"]))).otherwise(none)
            tail = F.when(goes.isNotNull(), F.array(goes["v"])).otherwise(none)
            return F.concat(head, F.slice(ps, begin + 1, end - begin), tail)

        return F.transform(F.sequence(F.lit(0), F.size(at)), part)

    whole = let(F.transform(line, turned), lambda ps: let(cuts(ps), lambda at: parts(ps, at)))
    return F.when(F.size(line) > 0, whole).otherwise(F.array().cast(f"array<array<{model.VERTEX}>>"))


def _lines_cut(geom: Column) -> Column:
    """A geometry without rings, its lines cut at the antimeridian; what falls into parts becomes the multi type."""

    def cut(m: Column) -> Column:
        def renamed(parts: Column) -> Column:
            kind = F.when((F.size(parts) == 1) & (m["gtype"] == model.LINE), model.LINE).otherwise(model.MULTILINE)
            return F.struct(kind.cast("tinyint").alias("gtype"), F.array(parts).alias("polys"))

        linear = m["gtype"].isin(model.LINE, model.MULTILINE)
        return F.when(linear, let(F.flatten(F.transform(F.get(m["polys"], F.lit(0)), _line_parts)), renamed)).otherwise(m)

    def whole(members: Column) -> Column:
        first = F.get(members, F.lit(0))["gtype"]
        kind = F.when(geom["gtype"] == model.COLLECTION, geom["gtype"]).otherwise(F.coalesce(first, geom["gtype"]))
        return F.struct(kind.alias("gtype"), members.alias("members"))

    return let(F.transform(geom["members"], cut), whole).cast(model.GEOMETRY)


def _per_line(polys: Column, body) -> Column:
    return F.transform(polys, lambda p: F.transform(p, body))


def _plain(geom: Column, precision: int) -> Column:
    """The normal form of geometries without rings, cut where they have to be, by built-in functions alone."""
    at = lambda v: F.struct(
        coords.rounded(coords.wrap_lng(v["x"]), precision).alias("x"), coords.rounded(v["y"], precision).alias("y")
    )
    members = F.transform(
        geom["members"],
        lambda m: F.struct(m["gtype"].alias("gtype"), _per_line(m["polys"], lambda line: coords.dedupe(F.transform(line, at))).alias("polys")),
    )
    return F.struct(geom["gtype"].alias("gtype"), members.alias("members")).cast(model.GEOMETRY)


def normalised(df: DataFrame, precision: int = model.DEFAULT_PRECISION) -> DataFrame:
    """df with geom in normal form; rows without a geometry stay as they are (D23: members of collections each)."""
    split = F.coalesce(needs_split(F.col("geom")), F.lit(False))
    ringed = F.exists("geom.members", lambda m: m["gtype"].isin(model.POLYGON, model.MULTIPOLYGON))

    oriented = F.struct(
        F.col("geom.gtype").alias("gtype"),
        F.transform(
            "geom.members",
            lambda m: F.struct(
                m["gtype"].alias("gtype"),
                F.when(m["gtype"].isin(model.POLYGON, model.MULTIPOLYGON), coords.orient(m["polys"])).otherwise(m["polys"]).alias("polys"),
            ),
        ).alias("members"),
    ).cast(model.GEOMETRY)
    ringed = F.coalesce(ringed, F.lit(False))
    hard = df.filter(ringed).withColumn("_split", split).withColumn("geom", F.when(F.col("_split"), F.col("geom")).otherwise(oriented))
    names = df.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, flag = (batch.column(batch.schema.get_field_index(n)) for n in ("geom", "_split"))
            begin, held, fixed = 0, 0, []
            # a geometry is a Python object only while it is worked on, and its result until HELD vertices are together
            for i in range(len(batch)):
                fixed.append(_fix(at[i].as_py(), flag[i].as_py(), precision))
                held += sum(len(line) for m in fixed[-1]["members"] for rings in m["polys"] for line in rings)
                if held >= HELD or i == len(batch) - 1:
                    rows = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([pa.array(fixed, at.type) if n == "geom" else rows.column(n) for n in names], names)
                    begin, held, fixed = i + 1, 0, []

    geom = F.col("geom")
    easy = df.filter(~ringed).withColumn("geom", F.when(geom.isNotNull(), _plain(F.when(split, _lines_cut(geom)).otherwise(geom), precision)))
    return hard.mapInArrow(run, df.schema).unionByName(easy)
