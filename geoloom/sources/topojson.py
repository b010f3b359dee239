"""TopoJSON in and out."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .. import model
from ..model import FeatureFrame, Meta
from . import files


def features(topo: dict) -> Iterable[tuple[dict, dict]]:
    """Features of a topology: arcs decoded, `~i` reversed, joint vertices once; collections open one level."""
    t = topo.get("transform") or {}
    (kx, ky), (tx, ty) = t.get("scale", (1, 1)), t.get("translate", (0, 0))
    arcs = []
    for arc in topo.get("arcs", []):
        x = y = 0
        line = []
        for p in arc:
            x, y = (x + p[0], y + p[1]) if t else (p[0], p[1])
            line.append((x * kx + tx, y * ky + ty))
        arcs.append(line)
    place = lambda p: (p[0] * kx + tx, p[1] * ky + ty)

    def line(refs: list[int]) -> list[tuple[float, float]]:
        out: list = []
        for i in refs:
            part = arcs[i] if i >= 0 else arcs[~i][::-1]
            out += part[1:] if out else part
        return out

    def shape(g: dict) -> dict | None:
        kind, a, c = g.get("type"), g.get("arcs"), g.get("coordinates")
        if kind == "Point":
            return files.geom(model.POINT, [[[place(c)]]])
        if kind == "MultiPoint":
            return files.geom(model.MULTIPOINT, [[[place(p) for p in c]]])
        if kind == "LineString":
            return files.geom(model.LINE, [[line(a)]])
        if kind == "MultiLineString":
            return files.geom(model.MULTILINE, [[line(x) for x in a]])
        if kind == "Polygon":
            return files.geom(model.POLYGON, [[line(x) for x in a]])
        if kind == "MultiPolygon":
            return files.geom(model.MULTIPOLYGON, [[line(x) for x in rings] for rings in a])
        if kind == "GeometryCollection":
            inner = [s for x in g["geometries"] if (s := shape(x))]
            return inner[0] if len(inner) == 1 else files.collection(inner) if inner else None
        return None

    for obj in topo.get("objects", {}).values():
        for g in obj["geometries"] if obj.get("type") == "GeometryCollection" else [obj]:
            if s := shape(g):
                yield s, ({"id": g["id"]} if "id" in g else {}) | (g.get("properties") or {})


def read(spark: SparkSession, path: str, noprop: bool = False) -> FeatureFrame:
    rows = files.parsed(spark, path, lambda data, _: features(json.loads(data)))
    return FeatureFrame(files.frame(rows, noprop), Meta(path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]))


def to_bytes(ff: FeatureFrame) -> bytes:
    """The frame as one TopoJSON document."""
    from ..operators.topology import topojson_text

    return topojson_text(ff.df, ff.meta.name or "data", precision=ff.meta.precision).encode()
