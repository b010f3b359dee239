"""GML in and out."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import count
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession

from .. import model
from ..model import FeatureFrame, Meta
from . import files
from .kml import local, number, tree

GML = "http://www.opengis.net/gml/3.2"
XLINK = "http://www.w3.org/1999/xlink"
_KINDS = ("Point", "LineString", "Curve", "Polygon", "Surface", "MultiPoint", "MultiCurve", "MultiLineString", "MultiSurface", "MultiPolygon", "MultiGeometry")


def _positions(node) -> list[tuple[float, float]]:
    """Latitude comes first in the text."""
    nums: list[float] = []
    for x in node.iter():
        if local(x.tag) in ("pos", "posList") and x.text:
            nums += map(float, x.text.split())
    return list(zip(nums[1::2], nums[::2]))


def geometry(node) -> dict | None:
    """Geometry of a GML element (D21: multi types too)."""
    kind = local(node.tag)
    if kind == "Point":
        pts = _positions(node)
        return files.geom(model.POINT, [[pts[:1]]]) if pts else None
    if kind in ("LineString", "Curve"):
        return files.geom(model.LINE, [[_positions(node)]])
    if kind in ("Polygon", "Surface"):
        rings = [_positions(x) for x in node.iter() if local(x.tag) in ("LinearRing", "Ring")]
        return files.geom(model.POLYGON, [rings]) if rings else None
    parts = [g for member in node for x in member if (g := geometry(x))]
    kinds = {g["gtype"] for g in parts}
    lines = [[(v["x"], v["y"]) for v in line] for g in parts for m in g["members"] for rings in m["polys"] for line in rings]
    if kinds == {model.POINT}:
        return files.geom(model.MULTIPOINT, [[[p for line in lines for p in line]]])
    if kinds == {model.LINE}:
        return files.geom(model.MULTILINE, [lines])
    if kinds == {model.POLYGON}:
        return files.geom(model.MULTIPOLYGON, [[[(v["x"], v["y"]) for v in line] for line in rings] for g in parts for m in g["members"] for rings in m["polys"]])
    return files.collection(parts) if parts else None


def _name(tag: str, prefixes: dict[str, str]) -> str:
    space, _, name = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
    return f"{prefixes[space]}_{name}" if prefixes.get(space) else name


def features(data: bytes) -> Iterable[tuple[dict, dict]]:
    """Features of a document, geometry inline or through its gml:id; unresolved ones are dropped."""
    root = tree(data)
    prefixes = {u.decode(): p.decode() for p, u in re.findall(rb'xmlns:(\w+)="([^"]*)"', data[:65536])}
    by_id: dict[str, dict] = {}
    for x in root.iter():
        if local(x.tag) in _KINDS and (key := x.get(f"{{{GML}}}id") or x.get("id")) and (g := geometry(x)):
            by_id[key] = g
    for member in (x for x in root.iter() if local(x.tag) in ("featureMember", "member", "featureMembers")):
        for feature in member:
            if local(feature.tag) in _KINDS:
                continue
            geom, props = None, {}
            for p in feature:
                href = p.get(f"{{{XLINK}}}href")
                inline = next((x for x in p if local(x.tag) in _KINDS), None)
                if href:
                    geom = geom or by_id.get(href.lstrip("#"))
                elif inline is not None:
                    geom = geom or geometry(inline)
                elif p.text and p.text.strip() and not len(p):
                    props[_name(p.tag, prefixes)] = p.text.strip()
            if geom:
                yield geom, props


def parse(data: bytes, name: str) -> Iterable[tuple[dict, dict]]:
    """A document, or those in an archive."""
    if not files.is_zip(data):
        yield from features(data)
        return
    for member, inner in sorted(files.members(data).items()):
        if member.lower().endswith((".gml", ".xml")):
            yield from features(inner)


def read(spark: SparkSession, path: str, noprop: bool = False) -> FeatureFrame:
    rows = files.parsed(spark, path, parse)
    return FeatureFrame(files.frame(rows, noprop), Meta(path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]))


def _positions_text(line: list[dict]) -> str:
    return " ".join(f"{number(v['y'])} {number(v['x'])}" for v in line)


def _part(kind: int, rings: list) -> list[str]:
    if kind in (model.POINT, model.MULTIPOINT):
        return [f"<gml:Point><gml:pos>{_positions_text([v])}</gml:pos></gml:Point>" for line in rings for v in line]
    if kind in (model.LINE, model.MULTILINE):
        return [f"<gml:LineString><gml:posList>{_positions_text(line)}</gml:posList></gml:LineString>" for line in rings]
    ring = lambda tag, r: f"<gml:{tag}><gml:LinearRing><gml:posList>{_positions_text(r)}</gml:posList></gml:LinearRing></gml:{tag}>"
    return ["<gml:Polygon>" + "".join(ring("interior" if i else "exterior", r) for i, r in enumerate(rings)) + "</gml:Polygon>"]


def geometry_text(geom: dict) -> str:
    parts = [(m["gtype"], p) for m in geom["members"] for rings in m["polys"] for p in _part(m["gtype"], rings)]
    if geom["gtype"] in (model.POINT, model.LINE, model.POLYGON):
        return "".join(p for _, p in parts)
    outer, inner = {
        model.MULTIPOINT: ("MultiPoint", "pointMember"), model.MULTILINE: ("MultiCurve", "curveMember"),
        model.MULTIPOLYGON: ("MultiSurface", "surfaceMember"),
    }.get(geom["gtype"], ("MultiGeometry", "geometryMember"))
    return f"<gml:{outer}>" + "".join(f"<gml:{inner}>{p}</gml:{inner}>" for _, p in parts) + f"</gml:{outer}>"


def _identified(text: str, base: str) -> str:
    """text with a gml:id on each geometry, numbered in the order of the text."""
    numbers = count()
    return re.sub(r"<gml:(Point|LineString|Polygon|Multi(?:Point|Curve|Surface|Geometry))>", lambda m: f'<gml:{m[1]} gml:id="{base}.{next(numbers)}">', text)


def _member(i: int, geom: dict | None, props: dict) -> str:
    fields = "".join(
        f"<{k}>{escape(str(v).lower() if isinstance(v, bool) else str(v))}</{k}>"
        for k, v in ((re.sub(r"^(?=[^A-Za-z_])", "_", re.sub(r"[^\w.-]", "_", k)), v) for k, v in props.items() if not isinstance(v, dict | list))
    )
    shape = f"<geometry>{_identified(geometry_text(geom), f'g{i}')}</geometry>" if geom else ""
    return f"<gml:featureMember><Feature gml:id=\"f{i}\">{fields}{shape}</Feature></gml:featureMember>"


def to_bytes(ff: FeatureFrame) -> bytes:
    """The frame as one GML 3.2 document, features and geometries with ids; scalar properties only."""
    body = "\n".join(_member(i, g, p) for i, (g, p) in enumerate(files.collected(ff.df)))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<gml:FeatureCollection xmlns:gml="{GML}" xmlns:xlink="{XLINK}">\n{body}\n</gml:FeatureCollection>'.encode()
