"""KML and KMZ in and out."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession

from .. import model
from ..model import FeatureFrame, Meta
from . import files
from .container import colour_bytes


def tree(data: bytes) -> ElementTree.Element:
    """The document's root; documents that declare entities are refused."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", data[:4096], re.I):
        raise ValueError("document type declarations aren't read")
    return ElementTree.fromstring(data)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _first(node, name: str):
    return next((x for x in node.iter() if local(x.tag) == name), None)


def _line(node) -> list[tuple[float, float]]:
    text = (c.text or "") if (c := _first(node, "coordinates")) is not None else ""
    return [(float(p[0]), float(p[1])) for p in (g.split(",") for g in text.split()) if len(p) > 1]


def geometry(node) -> dict | None:
    """A KML geometry; several in a MultiGeometry become a multi type or a collection."""
    kind = local(node.tag)
    if kind == "Point":
        pts = _line(node)
        return files.geom(model.POINT, [[pts[:1]]]) if pts else None
    if kind in ("LineString", "LinearRing"):
        return files.geom(model.LINE, [[_line(node)]])
    if kind == "Polygon":
        rings = [_line(x) for x in node.iter() if local(x.tag) == "LinearRing"]
        return files.geom(model.POLYGON, [rings]) if rings else None
    if kind == "MultiGeometry":
        parts = [g for x in node if (g := geometry(x))]
        kinds = {g["gtype"] for g in parts}
        if len(kinds) != 1:
            return files.collection(parts) if parts else None
        one, polys = kinds.pop(), [g["members"][0]["polys"] for g in parts]
        flat = [[(v["x"], v["y"]) for v in line] for p in polys for rings in p for line in rings]
        if one == model.POINT:
            return files.geom(model.MULTIPOINT, [[[p for line in flat for p in line]]])
        if one == model.LINE:
            return files.geom(model.MULTILINE, [flat])
        if one == model.POLYGON:
            return files.geom(model.MULTIPOLYGON, [[[[v["x"], v["y"]] for v in line] for line in p[0]] for p in polys])
        return files.collection(parts)
    return None


def placemarks(data: bytes) -> Iterable[tuple[dict, dict]]:
    """Features of a KML document: name, description, SimpleData and Data values, icon address."""
    for mark in (x for x in tree(data).iter() if local(x.tag) == "Placemark"):
        props, geom = {}, None
        for child in mark:
            kind = local(child.tag)
            if kind in ("name", "description") and child.text:
                props[kind] = child.text.strip()
            geom = geom or geometry(child)
        for x in mark.iter():
            if local(x.tag) == "SimpleData" and x.text is not None:
                props[x.get("name", "")] = x.text
            elif local(x.tag) == "Data" and (v := _first(x, "value")) is not None and v.text is not None:
                props[x.get("name", "")] = v.text
            elif local(x.tag) == "href" and x.text:
                props["icon"] = x.text.strip()
        if geom:
            yield geom, props


def parse(data: bytes, name: str) -> Iterable[tuple[dict, dict]]:
    """Features of a KML document or of all in a KMZ archive."""
    if not files.is_zip(data):
        yield from placemarks(data)
        return
    for member, inner in sorted(files.members(data).items()):
        if member.lower().endswith(".kml"):
            yield from placemarks(inner)


def read(spark: SparkSession, path: str, noprop: bool = False) -> FeatureFrame:
    rows = files.parsed(spark, path, parse)
    return FeatureFrame(files.frame(rows, noprop), Meta(path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]))


def number(v: float) -> str:
    """Shortest text of a coordinate; whole numbers without a fraction."""
    return str(int(v)) if v == int(v) else repr(v)


def _coords(line: list[dict]) -> str:
    return "<coordinates>" + " ".join(f"{number(v['x'])},{number(v['y'])},0" for v in line) + "</coordinates>"


def _ring(tag: str, line: list[dict]) -> str:
    return f"<{tag}><LinearRing>{_coords(line)}</LinearRing></{tag}>"


def _parts(member: dict) -> list[str]:
    kind, polys = member["gtype"], member["polys"]
    if kind in (model.POINT, model.MULTIPOINT):
        return [f"<Point>{_coords([v])}</Point>" for rings in polys for line in rings for v in line]
    if kind in (model.LINE, model.MULTILINE):
        return [f"<LineString>{_coords(line)}</LineString>" for rings in polys for line in rings]
    return [
        "<Polygon>" + "".join(_ring("innerBoundaryIs" if i else "outerBoundaryIs", r) for i, r in enumerate(rings)) + "</Polygon>"
        for rings in polys
    ]


def geometry_text(geom: dict) -> str:
    parts = [p for m in geom["members"] for p in _parts(m)]
    several = geom["gtype"] not in (model.POINT, model.LINE, model.POLYGON)
    return f"<MultiGeometry>{''.join(parts)}</MultiGeometry>" if several else "".join(parts)


def aabbggrr(text: str, opacity: float | None = None) -> str:
    """KML colour of a colour text."""
    r, g, b, a = colour_bytes(text)
    return "".join(f"{x:02x}" for x in (a if opacity is None else int(opacity * 255), b, g, r))


def _placemark(geom: dict | None, props: dict, colour: str | None) -> str:
    style = ""
    if colour and isinstance(c := props.get(colour), str) and re.fullmatch(r"rgba?\(.*\)|#[0-9a-f]{3,6}", c):
        k = aabbggrr(c)
        style = f"<Style><LineStyle><color>{k}</color></LineStyle><PolyStyle><color>{k}</color></PolyStyle></Style>"
    text = lambda v: escape(json.dumps(v) if isinstance(v, dict | list | bool) else str(v))
    own = "".join(f"<{k}>{text(props[k])}</{k}>" for k in ("name", "description") if k in props)
    data = "".join(f"<Data name={quoteattr(k)}><value>{text(v)}</value></Data>" for k, v in props.items() if k not in ("name", "description"))
    extended = f"<ExtendedData>{data}</ExtendedData>" if data else ""
    return f"<Placemark>{own}{style}{extended}{geometry_text(geom) if geom else ''}</Placemark>"


def document(features: Iterable[tuple[dict | None, dict]], name: str, colour: str | None = None) -> str:
    marks = "\n".join(_placemark(g, p, colour) for g, p in features)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(name)}</name>\n{marks}\n</Document></kml>'


def to_bytes(ff: FeatureFrame, zipped: bool = True, colour: str | None = None, resources: dict[str, bytes] | None = None) -> bytes:
    """The frame as KMZ, or as KML; colour names the property that holds each feature's colour."""
    kml = document(files.collected(ff.df), ff.meta.name, colour).encode()
    if not zipped:
        return kml
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", kml)
        for path, data in (resources or {}).items():
            z.writestr(path, data)
    return out.getvalue()
