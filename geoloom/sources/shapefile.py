"""Zipped shapefiles in and out."""

from __future__ import annotations

import datetime
import io
import json
import struct
import zipfile
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .. import model
from ..model import FeatureFrame, Meta
from ..operators.normalise import inside, ring_sum
from . import files

#: Shape codes read as point, multipoint, line and polygon; codes written for them.
READS = {1: "point", 11: "point", 8: "multipoint", 18: "multipoint", 3: "line", 13: "line", 5: "polygon", 15: "polygon"}
WRITES = {"point": 1, "multipoint": 8, "polyline": 3, "polygon": 5}
#: Fixed value: the projection file of WGS 84.
WGS84 = (
    'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],'
    'PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
)
SJIS_PAGE = 0x13


def nest(rings: list) -> list:
    """Polygons of clockwise outer rings, each hole in the first outer ring that holds its first vertex."""
    outer = [[r] for r in rings if ring_sum(r) >= 0]
    for hole in (r for r in rings if ring_sum(r) < 0):
        for poly in outer:
            if inside(poly[0], *hole[0]):
                poly.append(hole)
                break
    return outer


def shapes(shp: bytes) -> Iterable[dict | None]:
    """Geometries of an SHP file in record order; null shapes keep their place."""
    at = 100
    while at + 8 <= len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        rec = shp[at + 8 : at + 8 + size]
        at += 8 + size
        kind = READS.get(struct.unpack("<i", rec[:4])[0])
        if kind == "point":
            yield files.geom(model.POINT, [[[struct.unpack("<2d", rec[4:20])]]])
        elif kind == "multipoint":
            n = struct.unpack("<i", rec[36:40])[0]
            c = struct.unpack(f"<{2 * n}d", rec[40 : 40 + 16 * n])
            yield files.geom(model.MULTIPOINT, [[list(zip(c[::2], c[1::2]))]])
        elif kind:
            parts, n = struct.unpack("<2i", rec[36:44])
            starts = [*struct.unpack(f"<{parts}i", rec[44 : 44 + 4 * parts]), n]
            c = struct.unpack(f"<{2 * n}d", rec[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            pts = list(zip(c[::2], c[1::2]))
            lines = [pts[a:b] for a, b in zip(starts, starts[1:])]
            if kind == "line":
                yield files.geom(model.LINE if len(lines) == 1 else model.MULTILINE, [lines])
            else:
                polys = nest(lines)
                yield files.geom(model.POLYGON if len(polys) == 1 else model.MULTIPOLYGON, polys) if polys else None
        else:
            yield None


def _dbf_value(kind: str, raw: bytes, encoding: str):
    text = raw.decode(encoding, errors="replace").strip().strip("\0")
    if kind in "NFB":
        try:
            return (int(text) if text.lstrip("+-").isdigit() else float(text)) if text else None
        except ValueError:
            return None
    if kind == "L":
        return text[:1].lower() in ("y", "t") if text and text != "?" else None
    if kind == "D":
        return f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 and text.isdigit() else None
    return text or None


def records(dbf: bytes, encoding: str | None = None) -> Iterable[dict | None]:
    """Rows of a DBF file; None for a deleted one (S08). The code page byte decides where no encoding is given."""
    n, head, size = struct.unpack("<IHH", dbf[4:12])
    encoding = encoding or ("cp932" if dbf[29] == SJIS_PAGE else "utf-8")
    fields, at = [], 32
    while dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode(encoding, errors="replace")
        fields.append((name, chr(dbf[at + 11]), dbf[at + 16]))
        at += 32
    for i in range(n):
        row = dbf[head + i * size : head + (i + 1) * size]
        if row[:1] == b"*":
            yield None
            continue
        found, p = {}, 1
        for name, kind, width in fields:
            found[name] = _dbf_value(kind, row[p : p + width], encoding)
            p += width
        yield {k: v for k, v in found.items() if v is not None}


def parse(data: bytes, name: str, encoding: str | None = None) -> Iterable[tuple[dict, dict]]:
    """Features of all SHP files of the archive that have a DBF beside them."""
    inner = files.members(data)
    lower = {k.lower(): v for k, v in inner.items()}
    for base in sorted(k[:-4] for k in lower if k.endswith(".shp")):
        if f"{base}.dbf" not in lower:
            continue
        page = lower.get(f"{base}.cpg", b"").decode("ascii", "ignore").strip().lower()
        own = {"sjis": "cp932", "shift_jis": "cp932", "932": "cp932"}.get(page, page) or encoding
        for geom, props in zip(shapes(lower[f"{base}.shp"]), records(lower[f"{base}.dbf"], own)):
            if geom is not None and props is not None:
                yield geom, props


def read(spark: SparkSession, path: str, encoding: str | None = None, noprop: bool = False) -> FeatureFrame:
    """Zipped shapefiles at path."""
    rows = files.parsed(spark, path, lambda data, name: parse(data, name, encoding))
    return FeatureFrame(files.frame(rows, noprop), Meta(path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]))


def _pairs(line: list[dict]) -> list[tuple[float, float]]:
    return [(v["x"], v["y"]) for v in line]


def _record(layer: str, polys: list) -> tuple[bytes, tuple]:
    lines = [_pairs(line) for rings in polys for line in rings]
    pts = [p for line in lines for p in line]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    box = (min(xs), min(ys), max(xs), max(ys))
    coords = struct.pack(f"<{2 * len(pts)}d", *(c for p in pts for c in p))
    code = struct.pack("<i", WRITES[layer])
    if layer == "point":
        return code + coords, box
    if layer == "multipoint":
        return code + struct.pack("<4di", *box, len(pts)) + coords, box
    starts = [sum(map(len, lines[:i])) for i in range(len(lines))]
    return code + struct.pack(f"<4d2i{len(lines)}i", *box, len(lines), len(pts), *starts) + coords, box


def _layer(kind: int) -> str:
    return ("point", "multipoint", "polyline", "polyline", "polygon", "polygon")[kind]


def _shp(layer: str, geoms: list[list]) -> tuple[bytes, bytes]:
    """SHP and SHX bytes."""
    body, index, at, boxes = [], [], 50, []
    for i, polys in enumerate(geoms, 1):
        rec, box = _record(layer, polys)
        boxes.append(box)
        body.append(struct.pack(">2i", i, len(rec) // 2) + rec)
        index.append(struct.pack(">2i", at, len(rec) // 2))
        at += 4 + len(rec) // 2
    whole = [f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max))] if boxes else [0.0] * 4

    def head(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", 1000, WRITES[layer], *whole, 0, 0, 0, 0)

    return head(at) + b"".join(body), head(50 + 4 * len(index)) + b"".join(index)


def _text(v) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False) if isinstance(v, dict | list) else str(v)


def _is_date(v) -> bool:
    if not isinstance(v, str) or len(v) != 10:
        return False
    try:
        datetime.date.fromisoformat(v)
    except ValueError:
        return False
    return True


def dbf_fields(rows: list[dict], encoding: str = "utf-8") -> list[tuple[str, bytes, str, int, int]]:
    """(property, stored name, type, length, decimals) in name order.

    Numbers are N of the widest parts, dates D, booleans L, all else and mixtures C of at most 254 bytes. Stored names
    have at most 10 bytes and a final zero; a clash gets a number.
    """
    found, used = [], set()
    for key in sorted({k for r in rows for k in r}):
        vals = [r[key] for r in rows if r.get(key) is not None]
        name = key.encode(encoding, "replace")[:10].decode(encoding, "ignore").encode(encoding)
        n = 1
        while name in used:
            tail = f"_{n}".encode()
            name, n = name[: 10 - len(tail)] + tail, n + 1
        used.add(name)
        if vals and all(isinstance(v, bool) for v in vals):
            found.append((key, name, "L", 1, 0))
        elif vals and all(isinstance(v, int | float) and not isinstance(v, bool) for v in vals):
            texts = [repr(v) if "e" not in repr(v) else f"{v:.15f}".rstrip("0") for v in vals]
            part = max((len(t.partition(".")[2]) if not t.endswith(".0") else 0 for t in texts), default=0)
            whole = max(len(t.partition(".")[0]) for t in texts)
            found.append((key, name, "N", min(254, whole + (1 + part if part else 0)), part))
        elif vals and all(map(_is_date, vals)):
            found.append((key, name, "D", 8, 0))
        else:
            size = max((len(_text(v).encode(encoding, "replace")) for v in vals), default=1)
            found.append((key, name, "C", max(1, min(254, size)), 0))
    return found


def _dbf(rows: list[dict], encoding: str) -> bytes:
    fields = dbf_fields(rows, encoding)
    size = 1 + sum(f[3] for f in fields)
    page = SJIS_PAGE if encoding == "cp932" else 0
    out = [struct.pack("<4BIHH17xB2x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), size, page)]
    out += [struct.pack("<11sc4xBB14x", name, kind.encode(), width, part) for _, name, kind, width, part in fields]
    out.append(b"\r")
    for r in rows:
        cells = [b" "]
        for key, _, kind, width, part in fields:
            v = r.get(key)
            if v is None:
                cell = b" " * width
            elif kind == "N":
                cell = (f"{v:.{part}f}" if part else f"{int(v)}").rjust(width).encode()[:width]
            elif kind == "L":
                cell = b"T" if v else b"F"
            elif kind == "D":
                cell = v.replace("-", "").encode()
            else:
                raw = _text(v).encode(encoding, "replace")[:width]
                cell = raw.decode(encoding, "ignore").encode(encoding).ljust(width)
            cells.append(cell)
        out.append(b"".join(cells))
    return b"".join(out) + b"\x1a"


def archive(features: Iterable[tuple[dict | None, dict]], name: str, encoding: str = "utf-8") -> bytes:
    """A zip of up to four layers, suffixed when there is more than one; collections fall into their members."""
    layers: dict[str, tuple[list, list]] = {}
    for geom, props in features:
        for m in (geom or {"members": []})["members"]:
            shapes_, rows = layers.setdefault(_layer(m["gtype"]), ([], []))
            shapes_.append(m["polys"])
            rows.append(props)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for layer, (geoms, rows) in sorted(layers.items()):
            base = name if len(layers) == 1 else f"{name}_{layer}"
            shp, shx = _shp(layer, geoms)
            for ext, data in (("shp", shp), ("shx", shx), ("dbf", _dbf(rows, encoding)), ("prj", WGS84.encode()), ("cpg", encoding.encode())):
                z.writestr(f"{base}.{ext}", data)
    return out.getvalue()


def to_bytes(ff: FeatureFrame, encoding: str = "utf-8") -> bytes:
    """The frame as one zipped shapefile; the format is one file, so its rows pass through one writer."""
    return archive(files.collected(ff.df), ff.meta.name or "data", encoding)
