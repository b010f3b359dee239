"""GeoJSON in and out (S02-S04, K02): documents, newline-delimited features, and large files split by features."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import model
from ..model import FeatureFrame, Meta
from . import files
from .files import typed

P1 = "array<double>"
_DEPTH = {0: P1, 1: f"array<{P1}>", 2: f"array<{P1}>", 3: f"array<array<{P1}>>", 4: f"array<array<{P1}>>", 5: f"array<array<array<{P1}>>>"}


def _v(c: Column) -> Column:
    return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))


def _line(c: Column) -> Column:
    return F.transform(c, _v)


def _lines(c: Column) -> Column:
    return F.transform(c, _line)


def _member(text: Column) -> Column:
    """A member struct of the JSON text of one geometry that is no collection."""
    kind, raw = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
    c = {i: F.from_json(raw, t) for i, t in _DEPTH.items()}
    polys = {
        0: F.array(F.array(F.array(_v(c[0])))), 1: F.array(F.array(_line(c[1]))), 2: F.array(F.array(_line(c[2]))),
        3: F.array(_lines(c[3])), 4: F.array(_lines(c[4])), 5: F.transform(c[5], _lines),
    }
    found = F.lit(None).cast(model.PARTS)
    code = F.lit(None).cast("tinyint")
    for i, name in enumerate(model.TYPES[:6]):
        found = F.when(kind == name, polys[i].cast(model.PARTS)).otherwise(found)
        code = F.when(kind == name, F.lit(i).cast("tinyint")).otherwise(code)
    return F.struct(code.alias("gtype"), found.alias("polys"))


def parse_geometry(text: Column) -> Column:
    """The canonical geometry of GeoJSON text; null where it is none (one level of collections)."""
    whole = F.get_json_object(text, "$.type") == "GeometryCollection"
    parts = F.from_json(F.get_json_object(text, "$.geometries"), "array<string>")
    members = F.when(whole, F.transform(parts, _member)).otherwise(F.array(_member(text)))
    gtype = F.when(whole, F.lit(model.COLLECTION).cast("tinyint")).otherwise(F.get(members, F.lit(0))["gtype"])
    return F.when(gtype.isNotNull(), F.struct(gtype.alias("gtype"), members.alias("members")).cast(model.GEOMETRY))


def _pair(v: Column) -> Column:
    return F.array(v["x"], v["y"])


def _member_text(m: Column) -> Column:
    polys = m["polys"]
    first = F.get(polys, F.lit(0))
    line = lambda r: F.transform(r, _pair)
    text = F.to_json(F.transform(polys, lambda p: F.transform(p, line)))
    for kinds, c in (
        ((model.POINT,), _pair(F.get(F.get(first, F.lit(0)), F.lit(0)))),
        ((model.MULTIPOINT, model.LINE), line(F.get(first, F.lit(0)))),
        ((model.MULTILINE, model.POLYGON), F.transform(first, line)),
    ):
        text = F.when(m["gtype"].isin(*kinds), F.to_json(c)).otherwise(text)
    name = F.element_at(F.array(*map(F.lit, model.TYPES)), m["gtype"].cast("int") + 1)
    return F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), text, F.lit("}"))


def geometry_text(geom: Column) -> Column:
    """GeoJSON text of a geometry."""
    members = F.transform(geom["members"], _member_text)
    whole = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(members, ","), F.lit("]}"))
    return F.when(geom["gtype"] == model.COLLECTION, whole).otherwise(F.get(members, F.lit(0)))


def feature_text(df: DataFrame) -> DataFrame:
    """fid, text: one GeoJSON feature a row; null properties are left out."""
    props = F.to_json("props") if "props" in df.columns and df.schema["props"].dataType != StructType([]) else F.lit("{}")
    geom = F.coalesce(geometry_text(F.col("geom")), F.lit("null"))
    text = F.concat(F.lit('{"type":"Feature","geometry":'), geom, F.lit(',"properties":'), props, F.lit("}"))
    return df.select("fid", text.alias("text"))


def _typed(features: DataFrame, noprop: bool) -> DataFrame:
    """(fid, feature text) -> fid, geom, props with inferred types."""
    geom = parse_geometry(F.get_json_object("text", "$.geometry")).alias("geom")
    raw = F.coalesce(F.get_json_object("text", "$.properties"), F.lit("{}"))
    if noprop:
        return features.select("fid", geom)
    return typed(features.select("fid", geom, raw.alias("props")))


def features_of(docs: DataFrame, text: str = "value") -> DataFrame:
    """(doc number n, text) of whole documents -> (fid, text) of features: collections, arrays, a feature, bare geometries.

    Members of a bare GeometryCollection are features (D24); of arrays only features stay.
    """
    d = F.trim(F.col(text))
    kind = F.get_json_object(d, "$.type")
    listed = F.when(d.startswith("["), F.from_json(d, "array<string>")).when(
        kind == "FeatureCollection", F.from_json(F.get_json_object(d, "$.features"), "array<string>")
    )
    bare = lambda g: F.concat(F.lit('{"type":"Feature","geometry":'), g, F.lit(',"properties":{}}'))
    several = F.transform(F.from_json(F.get_json_object(d, "$.geometries"), "array<string>"), bare)
    items = (
        F.when(listed.isNotNull(), listed).when(kind == "Feature", F.array(d)).when(kind == "GeometryCollection", several)
        .when(kind.isin(*model.TYPES), F.array(bare(d)))
    )
    rows = docs.select("n", F.posexplode(items).alias("i", "text"))
    return rows.filter(F.get_json_object("text", "$.type") == "Feature").select("n", "i", "text")


def shape(g: dict | None) -> dict | None:
    """A geometry object as a dictionary of the canonical form; null where it is none."""
    kind, c = (g or {}).get("type"), (g or {}).get("coordinates")
    if kind == "GeometryCollection":
        inner = [s for x in g.get("geometries", []) if (s := shape(x))]
        return files.collection(inner) if inner else None
    if kind not in model.TYPES or c is None:
        return None
    wrapped = {0: lambda: [[[c]]], 1: lambda: [[c]], 2: lambda: [[c]], 3: lambda: [c], 4: lambda: [c], 5: lambda: c}
    code = model.TYPES.index(kind)
    return files.geom(code, [[[p[:2] for p in line] for line in rings] for rings in wrapped[code]()])


def parse(data: bytes, name: str):
    """Features of a document in bytes, for members of archives."""
    d = json.loads(data)
    items = d if isinstance(d, list) else d.get("features", []) if d.get("type") == "FeatureCollection" else [d]
    for f in items:
        f = f if f.get("type") == "Feature" else {"geometry": f, "properties": {}}
        if s := shape(f.get("geometry")):
            yield s, f.get("properties") or {}


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    from ..operators.graph import numbered

    return numbered(rows, "fid", *order).select("fid", "text")


def read(spark: SparkSession, path: str, name: str = "", precision: int = model.DEFAULT_PRECISION, noprop: bool = False) -> FeatureFrame:
    """GeoJSON files at path; each is a whole document (S02, S03). gzip goes by extension."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("n"), "value")
    rows = _numbered(features_of(docs), "n", "i")
    return FeatureFrame(_typed(rows, noprop), Meta(name or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0], precision=precision))


def read_lines(spark: SparkSession, path: str, name: str = "", precision: int = model.DEFAULT_PRECISION, noprop: bool = False) -> FeatureFrame:
    """Newline-delimited features, or a collection with one feature a line: splits like any text.

    Lines that hold no feature (the collection's own brackets) are skipped; a feature that can't be parsed keeps its
    text in the column _corrupt of read_lines_with_corrupt.
    """
    good, _ = read_lines_with_corrupt(spark, path)
    return FeatureFrame(_typed(_numbered(good, "file", "at", "nth"), noprop), Meta(name, precision=precision))


def read_lines_with_corrupt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, lines that look like features and can't be parsed)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("nth"), F.regexp_replace(F.trim("value"), r"^,|,$", "").alias("text"),
    ).filter(F.col("text").startswith("{"))
    lines = lines.filter(~F.col("text").rlike(r'^\{"type":\s*"FeatureCollection".*\[$'))
    whole = F.try_parse_json("text").isNotNull() & (F.get_json_object("text", "$.type") == "Feature")
    return lines.filter(whole), lines.filter(~F.coalesce(whole, F.lit(False))).select(F.col("text").alias("_corrupt"))


def from_object(spark: SparkSession, value: dict | list, name: str = "", precision: int = model.DEFAULT_PRECISION) -> FeatureFrame:
    """A GeoJSON object held by the driver."""
    docs = spark.createDataFrame([("0", json.dumps(value))], "n string, value string")
    own = value.get("name", "") if isinstance(value, dict) else ""
    return FeatureFrame(_typed(_numbered(features_of(docs), "n", "i"), False), Meta(own or name, precision=precision))


def write_lines(ff: FeatureFrame, path: str, gz: bool = False) -> None:
    """One feature a line, in order, in many files."""
    rows = feature_text(ff.df).repartitionByRange("fid").sortWithinPartitions("fid").select("text")
    rows.write.option("compression", "gzip" if gz else "none").text(path)


def collection_text(ff: FeatureFrame) -> str:
    """One FeatureCollection with the frame's name; rows stream through the driver one partition at a time."""
    rows = (r[0] for r in feature_text(ff.df).orderBy("fid").select("text").toLocalIterator())
    return f'{{"type":"FeatureCollection","name":{json.dumps(ff.meta.name)},"features":[' + ",\n".join(rows) + "]}"
