"""The binary container: a Protocol Buffers message with delta-coded coordinates.

Written from its format description: header fields, then one body message with the features. Pools are raw-deflate
compressed. Null properties are not written; functions are never evaluated, their source stays text.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .. import model
from ..model import FeatureFrame, Meta
from . import files

#: Field numbers of the format.
NAME, KEYS, PRECISION, BUFS, FARRAY, FEATURE, GEOMETRY, GTYPE, LENGTH, COORDS, VALUE, INDEX, GARRAY, DESCRIPTION, LICENSE = range(1, 16)
#: Type codes of property values.
NULL, BOOL, INTEGER, FLOAT, STRING, DATE, COLOR, FUNC, JSON, BBOX, BLOB, IMAGE = range(12)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return n >> 1 if not n & 1 else -(n >> 1) - 1


def _field(number: int, wire: int, data: bytes) -> bytes:
    return varint(number << 3 | wire) + data


def message(number: int, data: bytes) -> bytes:
    return _field(number, 2, varint(len(data)) + data)


def number_field(number: int, n: int) -> bytes:
    return _field(number, 0, varint(n))


def packed(number: int, values: Iterable[int]) -> bytes:
    return message(number, b"".join(map(varint, values)))


class Reader:
    """Fields of a message: (number, value), a value being an int, 8 bytes or the bytes of a nested field."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at = memoryview(data), 0

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    def fields(self):
        while self.at < len(self.data):
            tag = self.varint()
            wire = tag & 7
            if wire == 0:
                yield tag >> 3, self.varint()
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                yield tag >> 3, self.data[self.at : self.at + size]
                self.at += size
            elif wire == 2:
                size = self.varint()
                yield tag >> 3, self.data[self.at : self.at + size]
                self.at += size
            else:
                raise ValueError(f"wire type {wire} has no place in this format")

    def numbers(self) -> list[int]:
        found = []
        while self.at < len(self.data):
            found.append(self.varint())
        return found


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data, -15)


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def _coords(lines: list[list[dict]], unit: int, closed: bool) -> tuple[list[int], list[int]]:
    """(vertex counts, zig-zag deltas that start anew in each line); rings lose their closing vertex."""
    sizes, out = [], []
    for line in lines:
        pts = [(math.floor(v["x"] * unit + 0.5), math.floor(v["y"] * unit + 0.5)) for v in line]
        if closed and len(pts) > 1 and pts[0] == pts[-1]:
            pts = pts[:-1]
        sizes.append(len(pts))
        x0 = y0 = 0
        for x, y in pts:
            out += [zigzag(x - x0), zigzag(y - y0)]
            x0, y0 = x, y
    return sizes, out


def encode_geometry(geom: dict, unit: int) -> bytes:
    if geom["gtype"] == model.COLLECTION:
        inner = b"".join(message(GEOMETRY, encode_geometry({"gtype": m["gtype"], "members": [m]}, unit)) for m in geom["members"])
        return number_field(GTYPE, model.COLLECTION) + message(GARRAY, inner)
    kind, polys = geom["gtype"], geom["members"][0]["polys"]
    sizes, deltas = _coords([line for rings in polys for line in rings], unit, kind in (model.POLYGON, model.MULTIPOLYGON))
    out = number_field(GTYPE, kind)
    if kind in (model.MULTILINE, model.POLYGON):
        out += packed(LENGTH, sizes)
    elif kind == model.MULTIPOLYGON:
        lengths, i = [len(polys)], 0
        for rings in polys:
            lengths += [len(rings), *sizes[i : i + len(rings)]]
            i += len(rings)
        out += packed(LENGTH, lengths)
    return out + packed(COORDS, deltas)


def decode_geometry(data, unit: int) -> dict:
    kind, lengths, deltas, inner = 0, [], [], []
    for number, value in Reader(data).fields():
        if number == GTYPE:
            kind = value
        elif number == LENGTH:
            lengths = Reader(value).numbers()
        elif number == COORDS:
            deltas = [unzigzag(n) for n in Reader(value).numbers()]
        elif number == GARRAY:
            inner = [decode_geometry(v, unit) for n, v in Reader(value).fields() if n == GEOMETRY]
    if kind == model.COLLECTION:
        return files.collection(inner)
    ring = kind in (model.POLYGON, model.MULTIPOLYGON)
    if kind == model.MULTIPOLYGON:
        shape, i = [], 1
        for _ in range(lengths[0] if lengths else 0):
            shape.append(lengths[i + 1 : i + 1 + lengths[i]])
            i += 1 + lengths[i]
    else:
        shape = [lengths or [len(deltas) // 2]]
    at, polys = 0, []
    for sizes in shape:
        rings = []
        for size in sizes:
            x = y = 0
            line = []
            for _ in range(size):
                x, y, at = x + deltas[at], y + deltas[at + 1], at + 2
                line.append((x / unit, y / unit))
            rings.append([*line, line[0]] if ring and line else line)
        polys.append(rings)
    return files.geom(kind, polys)


def _is_box(v) -> bool:
    return (
        isinstance(v, list) and len(v) == 4 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v)
        and v[0] <= v[2] and v[1] <= v[3] and -180 <= v[0] and v[2] <= 180 and -90 <= v[1] and v[3] <= 90
    )


def value_type(v) -> int:
    """Type code of a property value."""
    if v is None:
        return NULL
    if isinstance(v, bool):
        return BOOL
    if isinstance(v, int) or isinstance(v, float) and v.is_integer():
        return INTEGER
    if isinstance(v, float):
        return FLOAT
    if isinstance(v, str):
        return COLOR if re.fullmatch(r"rgba?\(.*\)|#[0-9a-f]{3,6}", v) else STRING
    return BBOX if _is_box(v) else JSON


def colour_bytes(text: str) -> bytes:
    """r, g, b, a of a colour text."""
    if text[0] == "#":
        h = text[1:]
        rgb = [int(c, 16) * 16 for c in h] if len(h) == 3 else list(bytes.fromhex(h)) if len(h) == 6 else [0, 0, 0]
        return bytes([*rgb, 255])
    n = [float(x) for x in re.findall(r"[0-9.]+", text)]
    return bytes([*(int(x) & 255 for x in n[:3]), int(n[3] * 255) & 255 if len(n) > 3 else 255])


def colour_text(c: bytes) -> str:
    return f"rgb({c[0]},{c[1]},{c[2]})" if c[3] == 255 else f"rgba({c[0]},{c[1]},{c[2]},{c[3] / 255:.2f})"


def encode_value(v) -> bytes:
    kind = value_type(v)
    if kind == BOOL:
        return number_field(BOOL, int(v))
    if kind == INTEGER:
        return number_field(INTEGER, zigzag(int(v)))
    if kind == FLOAT:
        return _field(FLOAT, 1, struct.pack("<d", v))
    if kind == STRING:
        return message(STRING, v.encode())
    if kind == COLOR:
        return message(COLOR, colour_bytes(v))
    if kind == BBOX:
        return message(BBOX, struct.pack("<4d", *v))
    return message(JSON, json.dumps(v, separators=(",", ":")).encode())


def decode_value(data):
    for kind, v in Reader(data).fields():
        if kind == BOOL:
            return bool(v)
        if kind in (INTEGER, DATE):
            return unzigzag(v)
        if kind == FLOAT:
            return struct.unpack("<d", v)[0]
        if kind == COLOR:
            return colour_text(bytes(v))
        if kind == JSON:
            return json.loads(bytes(v))
        if kind == BBOX:
            return list(struct.unpack("<4d", v)) if len(v) == 32 else list(struct.unpack("<4f", v))
        if kind in (STRING, FUNC, BLOB, IMAGE):
            return bytes(v).decode()
    return None


def flat(props: dict) -> dict:
    """One level of objects as `key.sub`; nulls left out."""
    out = {}
    for k, v in props.items():
        if isinstance(v, dict) and v and not any(isinstance(x, dict) for x in v.values()):
            out |= {f"{k}.{s}": x for s, x in v.items() if x is not None}
        elif v is not None:
            out[k] = v
    return out


def nested(props: dict) -> dict:
    """The inverse of flat, at the first dot."""
    out: dict = {}
    for k, v in props.items():
        key, dot, sub = k.partition(".")
        if dot:
            out.setdefault(key, {})[sub] = v
        else:
            out[k] = v
    return out


def header(meta: Meta, keys: list[str], pool: Iterable[bytes] = ()) -> bytes:
    out = b"".join(
        message(n, s.encode()) for n, s in ((NAME, meta.name), (DESCRIPTION, meta.description), (LICENSE, meta.license)) if s
    )
    if meta.precision != model.DEFAULT_PRECISION:
        out += number_field(PRECISION, meta.precision)
    return out + b"".join(message(KEYS, k.encode()) for k in keys) + b"".join(message(BUFS, deflate(b)) for b in pool)


def encode(meta: Meta, features: Iterable[tuple[dict, dict]], keys: list[str], pool: Iterable[bytes] = ()) -> bytes:
    """Container bytes of (geometry, properties) in order; keys is the sorted dictionary of flat names."""
    at, unit, body = {k: i for i, k in enumerate(keys)}, 10**meta.precision, []
    for geom, props in features:
        rows = [(at[k], v) for k, v in flat(props).items()]
        one = message(GEOMETRY, encode_geometry(geom, unit)) + b"".join(message(VALUE, encode_value(v)) for _, v in rows)
        body.append(message(FEATURE, one + packed(INDEX, [i for i, _ in rows])))
    return header(meta, keys, pool) + message(FARRAY, b"".join(body))


def decode(data: bytes) -> tuple[Meta, list[str], list[bytes], Iterable[tuple[dict, dict]]]:
    """(metadata, keys, pool, features) of container bytes; features are decoded as they are asked for."""
    found, keys, pool, body = {}, [], [], memoryview(b"")
    names = {NAME: "name", DESCRIPTION: "description", LICENSE: "license"}
    for number, value in Reader(data).fields():
        if number in names:
            found[names[number]] = bytes(value).decode()
        elif number == PRECISION:
            found["precision"] = value
        elif number == KEYS:
            keys.append(bytes(value).decode())
        elif number == BUFS:
            pool.append(inflate(bytes(value)))
        elif number == FARRAY:
            body = value
    meta = Meta(**found)

    def features():
        unit = 10**meta.precision
        for number, value in Reader(body).fields():
            if number != FEATURE:
                continue
            geom, values, index = None, [], []
            for n, v in Reader(value).fields():
                if n == GEOMETRY:
                    geom = decode_geometry(v, unit)
                elif n == VALUE:
                    values.append(decode_value(v))
                elif n == INDEX:
                    index = Reader(v).numbers()
            yield geom, nested({keys[i]: v for i, v in zip(index, values)})

    return meta, keys, pool, features()


def update(data: bytes, **changes) -> bytes:
    """The container with other metadata; its body is passed on as it is."""
    meta, keys, pool, _ = decode(data)
    body = b"".join(message(FARRAY, bytes(v)) for n, v in Reader(data).fields() if n == FARRAY)
    from dataclasses import replace

    return header(replace(meta, **changes), keys, pool) + body


def read(spark: SparkSession, path: str, noprop: bool = False) -> FeatureFrame:
    """Containers at path, gzipped or not; metadata is that of the first."""
    rows = files.parsed(spark, path, lambda data, _: decode(data)[3])
    first = spark.read.format("binaryFile").load(path).select("content").first()
    meta = decode(files.plain(bytes(first[0])))[0] if first else Meta()
    return FeatureFrame(files.frame(rows, noprop), meta)


def to_bytes(ff: FeatureFrame, pool: Iterable[bytes] = ()) -> bytes:
    """The frame as one container: a pass for the keys, one for the body."""
    names: list[str] = []
    if "props" in ff.df.columns:
        from ..operators.relational import keys as key_rows
        from pyspark.sql import functions as F

        names = [r[0] for r in key_rows(ff.df.select(F.to_json("props").alias("j")), "j").collect()]  # the schema's names
    return encode(ff.meta, files.collected(ff.df), sorted(names), pool)
