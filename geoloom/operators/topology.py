"""Topology: segments, neighbours, mesh, merge, arcs, ranks, noding, TopoJSON.

Neighbours, mesh and merge work on segments, so they need no arcs; both sides of a border must have the same
vertices (node first where they don't). Nodes are coordinates in units of 1e-7 degree, packed in one long.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import coords, morton
from ..functions.coords import let
from ..session import materialise
from .graph import components, numbered
from .spatial_join import contain_join, with_bbox

SIDE = 2147483648
#: Cell of the finest noding grid in units, how much coarser each next grid is, number of grids.
CELL, GROWTH, LEVELS = 1 << 16, 8, 6
#: Squared snap distance, a little more than the distance, unit that intersections are rounded to.
SNAP2, PAD, STEP = 125, 12, 10
AREAL, LINEAR, PUNCTUAL = (model.POLYGON, model.MULTIPOLYGON), (model.LINE, model.MULTILINE), (model.POINT, model.MULTIPOINT)


def node(x: Column, y: Column) -> Column:
    """A vertex as one long."""
    ix, iy = morton.to_ints(x, y)
    return ix * SIDE + iy


def node_xy(n: Column) -> Column:
    return model.vertex(F.round(F.floor(n / SIDE) / morton.UNITS - 180.0, 7), F.round(F.pmod(n, F.lit(SIDE)) / morton.UNITS - 90.0, 7))


def rings(df: DataFrame, *keep: str, kinds: tuple[int, ...] = AREAL) -> DataFrame:
    """keep + (member, poly, ring, line): rings or lines of the wanted types, oriented polygons."""
    m = df.select(*keep, F.posexplode("geom.members").alias("member", "m")).filter(F.col("m.gtype").isin(*kinds))
    polys = coords.orient(F.col("m.polys")) if kinds == AREAL else F.col("m.polys")
    p = m.select(*keep, "member", F.posexplode(polys).alias("poly", "p"))
    return p.select(*keep, "member", "poly", F.posexplode("p").alias("ring", "line"))


def node_lines(df: DataFrame, *keep: str, kinds: tuple[int, ...] = AREAL) -> DataFrame:
    """keep + (member, poly, ring, ns): the rings or lines of two vertices or more, as nodes."""
    lines = rings(df, *keep, kinds=kinds).withColumn("ns", F.transform("line", lambda v: node(v["x"], v["y"])))
    return lines.filter(F.size("ns") > 1).drop("line")


def node_segments(lines: DataFrame, *keep: str) -> DataFrame:
    """keep + (seq, a, b): directed segments between different nodes of lines of nodes."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("ns") - 1), lambda i: F.struct(F.get("ns", i - 1).alias("a"), F.get("ns", i).alias("b")))
    return lines.select(*keep, F.posexplode(pairs).alias("seq", "s")).select(*keep, "seq", "s.a", "s.b").filter("a <> b")


def segments(df: DataFrame, *keep: str, kinds: tuple[int, ...] = AREAL) -> DataFrame:
    """keep + (member, poly, ring, seq, a, b, lo, hi): directed segments between different nodes."""
    rows = node_segments(node_lines(df, *keep, kinds=kinds), *keep, "member", "poly", "ring")
    return rows.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})


def neighbours(df: DataFrame, fid: int | None = None) -> DataFrame:
    """fid, neighbour: features that share a segment, both ways, never with themselves."""
    s = segments(df, "fid").select("fid", "lo", "hi").distinct()
    own = s if fid is None else s.filter(F.col("fid") == fid)
    other = s.select(F.col("fid").alias("neighbour"), "lo", "hi")
    return own.join(other, ["lo", "hi"]).filter("fid <> neighbour").select("fid", "neighbour").distinct()


def owners(df: DataFrame, *group: str) -> DataFrame:
    """group + (lo, hi, n, fids): owners of each segment."""
    return segments(df, "fid", *group).groupBy(*group, "lo", "hi").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("fid")).alias("fids"))


def mesh(df: DataFrame) -> DataFrame:
    """lo, hi of the segments owned exactly twice."""
    return segments(df, "fid").groupBy("lo", "hi").agg(F.count("*").alias("n")).filter("n = 2").select("lo", "hi")


def boundary(df: DataFrame, *group: str) -> DataFrame:
    """group + (a, b): directed segments owned once."""
    return (
        segments(df, "fid", *group).groupBy(*group, "lo", "hi")
        .agg(F.count("*").alias("n"), F.min(F.struct("a", "b")).alias("s")).filter("n = 1").select(*group, "s.a", "s.b")
    )


def lines_of(edges: DataFrame) -> DataFrame:
    """Undirected edges (lo, hi) as two-point lines: geom, for a mesh as geometry."""
    line = F.array(node_xy(F.col("lo")), node_xy(F.col("hi")))
    return edges.select(model.linestring(line).alias("geom"))


def stitch(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Closed rings of directed edges: at a node with a choice the walk keeps to the right-hand side."""
    out: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
    xy = lambda n: (n // SIDE, n % SIDE)
    found = []
    for first in sorted(out):
        while out.get(first):
            ring, here, came = [first], first, None
            while True:
                choice = out.get(here)
                if not choice:
                    break
                pick = 0
                if came is not None and len(choice) > 1:
                    (x0, y0), (x1, y1) = xy(came), xy(here)
                    back = math.atan2(y0 - y1, x0 - x1)
                    turn = lambda n: (math.atan2(xy(n)[1] - y1, xy(n)[0] - x1) - back) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
                    pick = min(range(len(choice)), key=lambda i: turn(choice[i]))  # noqa: B023
                came, here = here, choice.pop(pick)
                ring.append(here)
                if here == first:
                    found.append(ring)
                    break
            else:
                continue
            if ring[-1] != first:
                break
    return found


def boundary_rings(df: DataFrame, *group: str) -> DataFrame:
    """group + (line, outer): closed rings around merged polygons; each connected piece is walked by itself."""
    edges = materialise(boundary(df, *group))
    keyed = edges.withColumn("g", F.hash(*group) if group else F.lit(0))
    # pieces of different groups may touch, so a node counts once in each group
    tag = lambda c: F.xxhash64("g", c)
    comp = components(keyed.select(tag("a").alias("a"), tag("b").alias("b")))
    piece = keyed.join(comp, tag("a") == F.col("node")).select(*group, "component", "a", "b")
    kinds = ", ".join(f"{g} {edges.schema[g].dataType.simpleString()}" for g in group)

    def walk(key, batch):
        import pandas as pd

        found = stitch(list(zip(batch["a"].tolist(), batch["b"].tolist())))
        return pd.DataFrame({**{g: [key[i]] * len(found) for i, g in enumerate(group)}, "ns": found})

    schema = f"{kinds}{', ' if kinds else ''}ns array<long>"
    walked = piece.groupBy(*group, "component").applyInPandas(walk, schema)
    line = F.transform("ns", lambda n: node_xy(n))
    return walked.select(*group, line.alias("line")).withColumn("outer", coords.ring_sum(F.col("line")) >= 0)


def merge(df: DataFrame, *group: str) -> DataFrame:
    """group + geom: polygons of a group without their shared segments, holes within their smallest outer ring."""
    lines = numbered(boundary_rings(df, *group), "rid", *group, "line")
    tops = lines.filter("outer").select(*group, F.col("rid").alias("oid"), F.col("line").alias("shell"))
    holes = lines.filter("NOT outer").select(*group, "rid", "line")
    # a hole lies in the shells that hold its first vertex (met on boxes and cells) or that it touches
    first = F.get("line", F.lit(0))
    shells = tops.select(F.col("oid").alias("fid"), model.polygon(F.array("shell")).alias("geom"))
    within = contain_join(holes.select("rid", first["x"].alias("lng"), first["y"].alias("lat")), shells).select("rid", F.col("poly_fid").alias("oid"))
    corner = lambda df, k, ring: df.select(k, F.explode(F.array_distinct(ring)).alias("v"))
    touching = corner(holes, "rid", "line").join(corner(tops, "oid", "shell"), "v").select("rid", "oid").distinct()
    near = within.withColumn("inside", F.lit(True)).union(touching.withColumn("inside", F.lit(False)))
    near = near.groupBy("rid", "oid").agg(F.bool_or("inside").alias("inside"))
    sized = tops.select(*(F.col(g).alias(f"t_{g}") for g in group), "oid", F.abs(coords.ring_sum(F.col("shell"))).alias("size"))
    same = reduce(lambda x, g: x & F.col(f"t_{g}").eqNullSafe(F.col(g)), group, F.lit(True))
    met = near.join(sized, "oid").join(holes.drop("line"), "rid").filter(same)
    best = met.groupBy("rid").agg(F.min_by("oid", F.struct((~F.col("inside")).alias("o"), "size", "oid")).alias("oid"))
    nested = best.join(holes, "rid").groupBy("oid").agg(F.array_sort(F.collect_list("line")).alias("holes"))
    polys = tops.join(nested, "oid", "left").select(
        *group, "oid", F.concat(F.array("shell"), F.coalesce("holes", F.array().cast(f"array<array<{model.VERTEX}>>"))).alias("p")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("oid", "p"))), lambda x: x["p"])
    return polys.groupBy(*group).agg(ordered.alias("ps")).select(*group, model.multipolygon(F.col("ps")).alias("geom"))


def merge_points(df: DataFrame) -> DataFrame:
    """code, fids: features at each point code, in code order."""
    v = model.exploded(df, "fid").filter(F.col("mtype").isin(*PUNCTUAL))
    return v.select("fid", morton.pack(F.col("x"), F.col("y")).alias("code")).groupBy("code").agg(F.array_sort(F.collect_list("fid")).alias("fids")).orderBy("code")


def degrees(df: DataFrame) -> DataFrame:
    """node, n: occurrences of each vertex over all rings, closing ones not counted."""
    return segments(df, "fid").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))


def arc_nodes(df: DataFrame, kinds: tuple[int, ...] = AREAL) -> DataFrame:
    """node: where arcs begin or end: not two neighbours, or two segments of different owners."""
    s = segments(df, "fid", kinds=kinds)
    own = s.groupBy("lo", "hi").agg(F.array_sort(F.collect_set("fid")).alias("fids"))
    both = own.select(F.col("lo").alias("node"), F.col("hi").alias("other"), "fids").union(own.select("hi", "lo", "fids"))
    by = both.groupBy("node").agg(F.count("*").alias("n"), F.count_distinct("fids").alias("kinds"))
    return by.filter("n <> 2 OR kinds > 1").select("node")


def arcs(df: DataFrame, kinds: tuple[int, ...] = AREAL) -> tuple[DataFrame, DataFrame]:
    """(arc, ns, n_owners) and (fid, member, poly, ring, place, arc, reversed): each border line once.

    Arcs are keyed by their whole vertex sequence in the direction that sorts first; rings without nodes start at
    their smallest Morton code.
    """
    lines = rings(df, "fid", kinds=kinds).withColumn("ns", F.transform("line", lambda v: node(v["x"], v["y"]))).drop("line")
    lines = lines.withColumn("ns", let(F.col("ns"), lambda a: F.filter(a, lambda v, i: (i == 0) | (v != F.get(a, i - 1)))))
    lines = lines.filter(F.size("ns") > 1)
    key = ["fid", "member", "poly", "ring"]
    at = lines.select(*key, F.posexplode("ns").alias("i", "node")).join(arc_nodes(df, kinds).withColumn("cut", F.lit(True)), "node", "left")
    code = morton.pack_ints(F.floor(F.col("node") / SIDE), F.pmod(F.col("node"), F.lit(SIDE)))
    marked = at.withColumn("code", code).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("i", "node", F.coalesce("cut", F.lit(False)).alias("cut"), "code"))).alias("v")
    )
    n = F.size("v")
    closed = F.get("v", F.lit(0))["node"] == F.get("v", n - 1)["node"]
    cuts = F.transform(F.filter("v", lambda x: x["cut"]), lambda x: x["i"])
    least = F.array_min(F.transform("v", lambda x: F.struct(x["code"].alias("c"), x["i"].alias("i"))))["i"]
    first = F.when(~closed, F.lit(0)).when(F.size(cuts) > 0, F.get(cuts, F.lit(0))).otherwise(least)
    # a closed ring is turned so that it starts and ends at its first cut
    turned = F.when(
        closed & (F.col("first") > 0),
        F.concat(F.slice("v", F.col("first") + 1, n), F.slice("v", 2, F.greatest(F.col("first"), F.lit(0)))),
    ).otherwise(F.col("v"))
    turned_lines = marked.withColumn("first", first).select(*key, turned.alias("v"))
    stops = let(
        F.filter(F.transform("v", lambda x, i: F.when(x["cut"] | (i == 0) | (i == F.size("v") - 1), i)), lambda i: i.isNotNull()),
        lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.struct(F.get(s, k - 1).alias("from"), F.get(s, k).alias("to"))),
    )
    pieces = turned_lines.select(*key, "v", F.posexplode(stops).alias("place", "s")).select(
        *key, "place", F.transform(F.slice("v", F.col("s.from") + 1, F.col("s.to") - F.col("s.from") + 1), lambda x: x["node"]).alias("ns")
    )
    back = F.reverse("ns")
    pieces = materialise(pieces.withColumns({"reversed": back < F.col("ns"), "ns": F.least(F.col("ns"), back)}))
    whole = numbered(pieces.groupBy("ns").agg(F.count_distinct("fid").alias("n_owners")), "arc", "ns")
    refs = pieces.join(whole.select("ns", "arc"), "ns").select(*key, "place", "arc", "reversed")
    return whole.select("arc", "ns", "n_owners"), refs


def effective_areas(points: list[tuple[float, float]], metres: bool = True) -> list[float]:
    """Visvalingam's effective area of each interior vertex, never below one removed earlier; ends are infinite."""
    n = len(points)
    ys = [y for _, y in points]
    scale = math.cos(math.radians((min(ys) + max(ys)) / 2)) if ys else 1.0
    unit = (math.radians(1) * 6378137.0) ** 2 if metres else 1.0

    def area(a: int, b: int, c: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = points[a], points[b], points[c]
        return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2 * scale * unit

    result, prev, after = [math.inf] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    now = {i: area(i - 1, i, i + 1) for i in range(1, n - 1)}
    heap = [(s, i) for i, s in now.items()]
    heapq.heapify(heap)
    floor = 0.0
    while heap:
        s, i = heapq.heappop(heap)
        if now.get(i) != s:
            continue
        floor = max(floor, s)
        result[i] = floor
        del now[i]
        a, b = prev[i], after[i]
        after[a], prev[b] = b, a
        for j in (a, b):
            if j in now:
                now[j] = area(prev[j], j, after[j])
                heapq.heappush(heap, (now[j], j))
    return result


def rank_of(area: float) -> int:
    """Rank 0..63 of an effective area (F32)."""
    return 0 if area <= 0 else 63 if math.isinf(area) else max(0, min(63, math.floor(1.5 * math.log2(area) - 8.2365)))


def ranked(arcs_df: DataFrame, metres: bool = True) -> DataFrame:
    """arc, ns, ranks: importance of each arc vertex, 63 at the ends."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ranks = []
            for ns in batch.column("ns").to_pylist():
                pts = [((n // SIDE) / morton.UNITS - 180, (n % SIDE) / morton.UNITS - 90) for n in ns]
                ranks.append([rank_of(a) for a in effective_areas(pts, metres)])
            yield pa.RecordBatch.from_arrays([batch.column("arc"), batch.column("ns"), pa.array(ranks, pa.list_(pa.int32()))], ["arc", "ns", "ranks"])

    return arcs_df.select("arc", "ns").mapInArrow(run, "arc long, ns array<long>, ranks array<int>")


def simplified(ranked_df: DataFrame, threshold: int) -> DataFrame:
    """arc, ns: vertices of at least the threshold's rank, ends always."""
    last = F.size("ns") - 1
    kept = F.filter(F.arrays_zip("ns", "ranks"), lambda v, i: (i == 0) | (i == last) | (v["ranks"] >= threshold))
    return ranked_df.select("arc", F.transform(kept, lambda v: v["ns"]).alias("ns"))


Node = tuple[int, int]


def _wedge(a: Node, b: Node, c: Node) -> int:
    """Twice the signed area of the triangle abc: on which side of ab lies c."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _along(a: Node, b: Node, share: Fraction) -> Node:
    """The node that share of the way from a to b leads to, each step cut toward zero."""
    return a[0] + math.trunc(share * (b[0] - a[0])), a[1] + math.trunc(share * (b[1] - a[1]))


def _foot(a: Node, b: Node, c: Node) -> Fraction | None:
    """Where c's perpendicular meets ab strictly between its ends, as a share of ab; None beyond the snap distance."""
    full = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    share = Fraction((c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1]), full) if full else Fraction(0)
    # squared distances are compared in whole units
    return share if 0 < share < 1 and _wedge(a, b, c) ** 2 // full <= SNAP2 else None


def meetings(p: Node, q: Node, r: Node, s: Node) -> list[Node]:
    """Where the segments pq and rs meet, in exact integers.

    Crossings (ends included), ends strictly inside a collinear overlap, and feet of ends within the snap distance of
    the other segment, also beside a crossing. A meeting within the snap distance of an end is that end, else it goes to
    the nearest multiple of ten units, halves up.
    """
    ends = (p, q, r, s)

    def settled(x: int, y: int) -> Node:
        close = (e for e in ends if (x - e[0]) ** 2 + (y - e[1]) ** 2 <= SNAP2)
        return next(close, ((x + STEP // 2) // STEP * STEP, (y + STEP // 2) // STEP * STEP))

    found: list[Node] = []
    side_p, side_q = _wedge(r, s, p), _wedge(r, s, q)
    side_r, side_s = _wedge(p, q, r), _wedge(p, q, s)
    if side_p != side_q:  # not parallel
        if min(side_p, side_q) <= 0 <= max(side_p, side_q) and min(side_r, side_s) <= 0 <= max(side_r, side_s):
            found.append(settled(*_along(p, q, Fraction(side_p, side_p - side_q))))
    elif not side_r and not side_s and p != q:  # on one line, in the order of their ends
        found += [e for e in ends if any(min(o) < e < max(o) for o in ((p, q), (r, s)))]
    for e, (a, b) in ((r, (p, q)), (s, (p, q)), (p, (r, s)), (q, (r, s))):
        if (share := _foot(a, b, e)) is not None:
            found.append(settled(*_along(a, b, share)))
    return sorted(set(found))


def _xy(n: Column) -> tuple[Column, Column]:
    """A node's coordinates in units, as exact integers."""
    return F.shiftright(n, 31), n.bitwiseAND(F.lit(SIDE - 1))


def level(a: Column, b: Column) -> Column:
    """A segment's grid: cells of CELL * GROWTH ** level units, four of which are as long as it is wide or high at least."""
    (ax, ay), (bx, by) = _xy(a), _xy(b)
    size, found = F.greatest(F.abs(ax - bx), F.abs(ay - by)), F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        found = F.when(size <= 4 * CELL * GROWTH**k, F.lit(k)).otherwise(found)
    return found


def placed(shapes: DataFrame, levels: list[int]) -> DataFrame:
    """shapes without a, b + (mx, my, vx, vy, level, at, cell): a row for each cell that a shape passes, on its own grid and on
    each coarser one of levels. (mx, my) is a + b, (vx, vy) is b - a, exact in doubles.

    A shape passes nine cells of its own grid at most, so rows grow with the shapes and not with their lengths.
    """
    own = shapes.withColumn("level", level(F.col("a"), F.col("b")))
    grids = F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("level"))
    (ax, ay), (bx, by) = _xy(F.col("a")), _xy(F.col("b"))
    box = own.withColumn("at", F.explode(grids)).withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by})
    side = F.lit(float(CELL)) * F.pow(F.lit(float(GROWTH)), F.col("at"))
    cell = lambda v: F.floor(v / F.col("side")).cast("long")
    box = box.withColumns({
        "side": side, "x0": F.least("ax", "bx") - PAD, "x1": F.greatest("ax", "bx") + PAD, "y0": F.least("ay", "by") - PAD, "y1": F.greatest("ay", "by") + PAD,
    })
    # of each column of cells the rows that the segment passes there, not its whole box
    columns = box.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))))
    run, edge = (F.col("bx") - F.col("ax")).cast("double"), F.col("cx") * F.col("side")
    on = lambda x: F.col("ay") + (F.greatest(F.least(x, F.greatest("ax", "bx")), F.least("ax", "bx")) - F.col("ax")) * (F.col("by") - F.col("ay")) / run
    ends = (on(edge - PAD - 1), on(edge + F.col("side") + PAD + 1))
    steep = F.abs(run) <= 2 * PAD
    low = F.when(steep, F.col("y0")).otherwise(F.greatest(F.least(*ends) - PAD - 1, F.col("y0")))
    high = F.when(steep, F.col("y1")).otherwise(F.least(F.greatest(*ends) + PAD + 1, F.col("y1")))
    spread = columns.withColumn("cy", F.explode(F.sequence(cell(low), cell(high))))
    sums = [(F.col(f"{e}{n}") * k + F.col(f"b{n}")).cast("double").alias(f"{w}{n}") for w, e, k in (("m", "a", 1), ("v", "a", -1)) for n in "xy"]
    # cells whose numbers fall together only bring more candidates
    return spread.select(*(n for n in shapes.columns if n not in "ab"), *sums, "level", "at", ((F.col("cx") * (1 << 24) + F.col("cy")) * LEVELS + F.col("at")).alias("cell"))


def candidates(shapes: DataFrame, levels: list[int], own: str | None = None) -> DataFrame:
    """(own, sid, a, b, line, s0, s1) -> pairs that may meet, the smaller sid first, each pair once.

    Met by cells, on the coarser grid of the two, then by boxes, then by the sides they lie on. With own, only pairs that
    have it in common. Every cell takes part, however full; adaptive execution splits hot cells.
    """
    every = placed(shapes, levels)
    homes = every if len(levels) == 1 else every.filter("at = level")
    l, r = homes.alias("l"), every.alias("r")  # noqa: E741
    c = lambda t, n: F.col(f"{t}.{n}")
    turn = c("l", "sid") < c("r", "sid")
    on = (c("l", "cell") == c("r", "cell")) if own is None else (c("l", "cell") == c("r", "cell")) & (c("l", own) == c("r", own))
    on = on & (turn if len(levels) == 1 else (c("r", "level") < c("l", "level")) | ((c("r", "level") == c("l", "level")) & turn))
    # two segments are apart if they are so along an axis or across either of them; short expressions, as only methods of up
    # to 8,000 bytes are compiled to machine code
    dx, dy = c("l", "mx") - c("r", "mx"), c("l", "my") - c("r", "my")
    wide = {t: F.abs(c(t, "vx")) + F.abs(c(t, "vy")) for t in "lr"}
    on = on & (F.abs(dx) <= F.abs(c("l", "vx")) + F.abs(c("r", "vx")) + 4 * PAD) & (F.abs(dy) <= F.abs(c("l", "vy")) + F.abs(c("r", "vy")) + 4 * PAD)
    turned = F.abs(c("l", "vx") * c("r", "vy") - c("l", "vy") * c("r", "vx"))
    for t in "lr":
        on = on & (F.abs(c(t, "vx") * dy - c(t, "vy") * dx) <= turned + 2 * PAD * wide[t])
    # a line's neighbouring segments are no pair, where these are all that have the shape
    near = (c("l", "line") == c("r", "line")) & (c("l", "s1") - c("r", "s0") <= 1) & (c("r", "s1") - c("l", "s0") <= 1)
    once = (c("l", "s0") == c("l", "s1")) & (c("r", "s0") == c("r", "s1"))
    on = on & ~F.coalesce(near & once, F.lit(False))
    end = lambda t, k: ((c(t, "mx") + k * c(t, "vx")) / 2).cast("long") * SIDE + ((c(t, "my") + k * c(t, "vy")) / 2).cast("long")
    of = lambda t: {"sid": c(t, "sid"), "a": end(t, -1), "b": end(t, 1), "line": c(t, "line"), "s0": c(t, "s0"), "s1": c(t, "s1")}
    sides = [F.when(turn, v).otherwise(w).alias(f"{k}_{n}") for k, t, u in (("a", "l", "r"), ("b", "r", "l")) for (n, v), w in zip(of(t).items(), of(u).values())]
    return l.join(r, on).select(*([c("l", own).alias(own)] if own else []), *sides).distinct()


def noded(df: DataFrame, kinds: tuple[int, ...] = LINEAR, scope: str | None = None) -> DataFrame:
    """fid, member, poly, ring, ns: lines with a vertex at every meeting, without repeats and A-B-A spikes.

    scope: `dataset` nodes all lines together (the default for lines), `feature` each feature by itself (for polygons).
    Segments with the same ends are one shape, whose meetings are found once and given to each of them.
    """
    own = "fid" if (scope or ("dataset" if kinds == LINEAR else "feature")) == "feature" else None
    key, shape = ["fid", "member", "poly", "ring"], [*([own] if own else []), "a", "b"]
    lines = materialise(node_lines(df, "fid", kinds=kinds).filter(F.exists("ns", lambda v: v != F.get("ns", F.lit(0)))))
    segs = node_segments(lines, *key).withColumns({"line": F.xxhash64(*key), "sid": F.xxhash64(*key, "seq")})
    levels = sorted(r[0] for r in segs.select(level(F.col("a"), F.col("b"))).distinct().collect())
    # the only line that has the shape, or null, and the places it has it at
    alone = F.when(F.min("line") == F.max("line"), F.min("line"))
    shapes = segs.groupBy(*shape).agg(F.min("sid").alias("sid"), alone.alias("line"), F.min("seq").alias("s0"), F.max("seq").alias("s1"))
    pairs = candidates(shapes, levels or [0], own)
    places = [*([f"fid {lines.schema['fid'].dataType.simpleString()}"] if own else []), "a long", "b long", "node long", "line long", "s0 int", "s1 int"]

    def solve(batches):
        import pyarrow as pa

        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != own}
            at, rows = [], []
            for i in range(len(batch)):
                ends = [divmod(c[f"{t}_{e}"][i], SIDE) for t in "ab" for e in "ab"]
                for x, y in meetings(*ends):
                    for t, o in ("ab", "ba"):
                        at.append(i)
                        rows.append((c[f"{t}_a"][i], c[f"{t}_b"][i], x * SIDE + y, c[f"{o}_line"][i], c[f"{o}_s0"][i], c[f"{o}_s1"][i]))
            kinds_of = (*[pa.int64()] * 4, *[pa.int32()] * 2)
            found = [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * 6, kinds_of)]
            head = [batch.column(own).take(pa.array(at, pa.int64()))] if own else []
            yield pa.RecordBatch.from_arrays([*head, *found], [p.split(" ")[0] for p in places])

    met = materialise(pairs.mapInArrow(solve, ", ".join(places)).distinct().withColumnsRenamed({"line": "o_line", "s0": "o_s0", "s1": "o_s1"}))
    beside = (F.col("o_line") == F.col("line")) & (F.col("o_s0") >= F.col("seq") - 1) & (F.col("o_s1") <= F.col("seq") + 1)
    (x, y), (ax, ay) = _xy(F.col("node")), _xy(F.col("a"))
    entry = F.struct("seq", (F.pow(x - ax, 2) + F.pow(y - ay, 2)).alias("d"), "node")
    inner = met.join(segs, shape).filter(~F.coalesce(beside, F.lit(False))).groupBy(*key).agg(F.collect_set(entry).alias("m"))
    inner = materialise(inner)
    own_nodes = F.transform("ns", lambda v, i: F.struct(i.alias("seq"), F.lit(-1.0).alias("d"), v.alias("node")))
    whole = F.when(F.col("m").isNull(), F.col("ns")).otherwise(F.transform(F.array_sort(F.concat(own_nodes, "m")), lambda v: v["node"]))
    rows = lines.join(inner, key, "left").select(*key, whole.alias("line"))
    # a vertex goes if it equals the one kept before, and the one before goes with it if it is the tip of a spike
    empty = F.array().cast("array<bigint>")
    clean = F.aggregate(
        "line", empty,
        lambda a, v: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) == v), a)
        .when((F.size(a) > 1) & (F.try_element_at(a, F.lit(-2)) == v), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(v))),
    )
    return rows.select(*key, clean.alias("ns"))


def topojson(df: DataFrame, name: str = "data", precision: int = model.DEFAULT_PRECISION, props: str | None = "props") -> tuple[DataFrame, DataFrame, dict]:
    """Arc rows (arc, text), geometry rows (fid, text) and the header of a TopoJSON document.

    Arcs of polygons come first, those of lines follow; points are quantised as arcs are.
    """
    e = 10**precision
    (pa, pr), (la, lr) = arcs(df, AREAL), arcs(df, LINEAR)
    shift = pa.count()
    whole = pa.select("arc", "ns").union(la.select(F.col("arc") + shift, "ns"))
    q = lambda v: F.struct(coords.quantise(v["x"], precision).alias("x"), coords.quantise(v["y"], precision).alias("y"))
    pts = F.transform("ns", lambda n: q(node_xy(n)))
    steps = let(pts, lambda p: F.transform(p, lambda v, i: F.array(
        v["x"] - F.when(i == 0, F.lit(0)).otherwise(F.get(p, i - 1)["x"]), v["y"] - F.when(i == 0, F.lit(0)).otherwise(F.get(p, i - 1)["y"]))))
    arc_rows = whole.select("arc", F.to_json(steps).alias("text"))
    signed = lambda base: F.when(F.col("reversed"), -(F.col("arc") + base) - 1).otherwise(F.col("arc") + base)

    def lists(refs: DataFrame, base: int, depth: int) -> DataFrame:
        level = refs.withColumn("v", F.to_json(F.array(signed(base))))
        level = refs.select("fid", "member", "poly", "ring", F.col("place").alias("i"), signed(base).cast("string").alias("v"))
        for group in (["fid", "member", "poly", "ring"], ["fid", "member", "poly"], ["fid"])[:3]:
            order = F.array_sort(F.collect_list(F.struct("i", "v")))
            text = F.concat(F.lit("["), F.array_join(F.transform(order, lambda x: x["v"]), ","), F.lit("]"))
            grouped = level.groupBy(*group).agg(text.alias("v"))
            if group == ["fid", "member", "poly", "ring"]:
                level = grouped.withColumn("i", F.struct("ring").alias("i")["ring"])
            elif group == ["fid", "member", "poly"]:
                level = grouped.withColumn("i", F.col("member") * 1_000_000 + F.col("poly"))
            else:
                level = grouped
        return level.select("fid", F.col("v"))

    areal = lists(pr, 0, 3).withColumnRenamed("v", "polys")
    flat_lines = lr.withColumns({"ring": F.col("member") * 1_000_000 + F.col("ring"), "poly": F.lit(0), "member": F.lit(0)})
    linear = lists(flat_lines, shift, 2).select("fid", F.expr("substring(v, 2, length(v) - 2)").alias("lines"))
    points = (
        model.exploded(df, "fid").filter(F.col("mtype").isin(*PUNCTUAL)).groupBy("fid")
        .agg(F.array_sort(F.collect_list(F.struct("member", "seq", F.array(coords.quantise(F.col("x"), precision), coords.quantise(F.col("y"), precision)).alias("q")))).alias("p"))
        .select("fid", F.to_json(F.transform("p", lambda v: v["q"])).alias("points"))
    )
    rows = df.select("fid", *([F.to_json(props).alias("props")] if props else [F.lit("{}").alias("props")]))
    rows = rows.join(areal, "fid", "left").join(linear, "fid", "left").join(points, "fid", "left")
    part = lambda c, kind, field: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{{"type":"{kind}","{field}":'), F.col(c), F.lit("}")))
    inner = F.concat_ws(",", part("points", "MultiPoint", "coordinates"), part("lines", "MultiLineString", "arcs"), part("polys", "MultiPolygon", "arcs"))
    text = F.concat(F.lit('{"type":"GeometryCollection","id":'), F.col("fid").cast("string"), F.lit(',"properties":'), F.col("props"), F.lit(',"geometries":['), inner, F.lit("]}"))
    header = {"type": "Topology", "transform": {"scale": [1 / e, 1 / e], "translate": [0, 0]}, "name": name}
    return arc_rows, rows.select("fid", text.alias("text")), header


def topojson_text(df: DataFrame, name: str = "data", **options) -> str:
    """The document as one text, for sinks of one file."""
    from .profile import extent

    arc_rows, geometries, header = topojson(df, name, **options)
    box = extent(df).first()
    head = json.dumps(header | {"bbox": [*box]})[:-1]
    arcs_text = ",".join(r[0] for r in arc_rows.orderBy("arc").select("text").toLocalIterator())
    geoms = ",".join(r[0] for r in geometries.orderBy("fid").select("text").toLocalIterator())
    return f'{head},"objects":{{{json.dumps(name)}:{{"type":"GeometryCollection","geometries":[{geoms}]}}}},"arcs":[{arcs_text}]}}'


def by_locality(df: DataFrame) -> DataFrame:
    """Rows ranged and sorted by the Morton code of their box's corner, so files prune by statistics."""
    code = morton.pack(F.col("bbox.xmin"), F.col("bbox.ymin"))
    return with_bbox(df).withColumn("morton", code).repartitionByRange("morton").sortWithinPartitions("morton")
