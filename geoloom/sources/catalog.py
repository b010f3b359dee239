"""Named data sets as tables (S15, S16, K09), and one reader for all formats."""

from __future__ import annotations

import gzip
import json
import re
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import measures
from ..model import FeatureFrame, Meta
from ..session import shared_path
from . import container, files, geojson, gml, kml, shapefile, topojson

PROPERTY = "geoloom.meta"
#: Files fetched in this process: (application, address) -> path in the shared folder.
_FETCHED: dict[tuple[str, str], str] = {}


def read(spark: SparkSession, source, **options) -> FeatureFrame:
    """A frame of a path, an address, a table's name, bytes, a GeoJSON object or a frame.

    The format goes by the name's ending; that of bytes by their content, gzipped or not.
    """
    if isinstance(source, FeatureFrame):
        return source
    if isinstance(source, bytes | bytearray | memoryview):
        data = files.plain(bytes(source))
        path = f"{shared_path(spark, 'bytes')}.{ending_of(data)}"
        write_file(spark, data, path)
        return read(spark, path, **options)
    if isinstance(source, dict | list):
        return geojson.from_object(spark, source, **options)
    if re.match(r"https?://", source):
        address, *member = source.split("#", 1)
        return read(spark, "#".join([fetched(spark, address), *member]), **options)
    if "#" in source:
        return _member(spark, *source.split("#", 1), **options)
    name = source.lower().removesuffix(".gz").removesuffix(".gzip").rstrip("/")
    for endings, reader in (
        ((".geojsonl", ".ndjson"), geojson.read_lines), ((".topojson",), topojson.read), ((".geojson", ".json"), geojson.read),
        ((".kml", ".kmz"), kml.read), ((".gml", ".xml"), gml.read), ((".zip",), shapefile.read), ((".pbf",), container.read),
    ):
        if name.endswith(endings):
            return reader(spark, source, **options)
    return load(spark, source)


def ending_of(data: bytes) -> str:
    """The name ending of the format that data is in."""
    if files.is_zip(data):
        names = [n.lower() for n in files.members(data)]
        inner = {"zip": (".shp",), "kmz": (".kml",), "gml": (".gml", ".xml")}
        kind = next((k for k, endings in inner.items() if any(n.endswith(endings) for n in names)), None)
        if kind is None:
            raise ValueError("no reader for this archive")
        return kind
    head = data[:4096].removeprefix(b"\xef\xbb\xbf").lstrip()
    if head[:1] == b"<":
        return "kml" if re.search(rb"<(\w+:)?kml\b", head) else "gml"
    if head[:1] in (b"{", b"["):
        document = json.loads(data)
        return "topojson" if isinstance(document, dict) and document.get("type") == "Topology" else "geojson"
    return "pbf"


def fetched(spark: SparkSession, address: str, again: bool = False) -> str:
    """Path in the shared folder of what is at an http address, fetched once an application unless again."""
    key = (spark.sparkContext.applicationId, address)
    if again or key not in _FETCHED:
        with urlopen(address) as answer:
            data = answer.read()
        name = re.sub(r"[^\w.-]", "_", re.sub(r"[?#].*", "", address).rstrip("/").rsplit("/", 1)[-1])
        path = f"{shared_path(spark, 'fetched')}/{name}"
        write_file(spark, data, path, packed=True)
        _FETCHED[key] = path
    return _FETCHED[key]


def _member(spark: SparkSession, path: str, member: str, noprop: bool = False) -> FeatureFrame:
    """One file of the archives at path, as `archive.zip#member`."""
    parsers = {
        (".topojson",): lambda data, _: topojson.features(json.loads(data)), (".geojson", ".json"): geojson.parse,
        (".kml", ".kmz"): kml.parse, (".gml", ".xml"): gml.parse, (".pbf",): lambda data, _: container.decode(data)[3],
        (".zip",): shapefile.parse,
    }
    parse = next((p for endings, p in parsers.items() if member.lower().endswith(endings)), None)
    if parse is None:
        raise ValueError(f"no reader for {member}")
    rows = files.parsed(spark, path, parse, member)
    return FeatureFrame(files.frame(rows, noprop), Meta(member.rsplit("/", 1)[-1].split(".")[0]))


def save(ff: FeatureFrame, table: str) -> None:
    """The frame as a table with its box as the pruning column and metadata as a table property."""
    df = ff.df.withColumn("bbox", measures.bbox(F.col("geom"), ff.meta.precision))
    df.write.mode("overwrite").saveAsTable(table)
    text = json.dumps(ff.meta.__dict__).replace("\\", "\\\\").replace("'", "\\'")
    df.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PROPERTY}' = '{text}')")


def load(spark: SparkSession, table: str) -> FeatureFrame:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == PROPERTY).collect()
    meta = Meta(**json.loads(rows[0]["value"])) if rows else Meta(table)
    return FeatureFrame(spark.table(table), meta)


def names(spark: SparkSession) -> list[str]:
    """Tables that are there."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def refresh(spark: SparkSession) -> None:
    for name in names(spark):
        spark.catalog.refreshTable(name)


def delete(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def write_file(spark: SparkSession, data: bytes, path: str, packed: bool = False) -> None:
    """Bytes of a one-file format at a path of any file system Spark knows; gzipped if it ends in .gz, unless packed."""
    if path.lower().endswith((".gz", ".gzip")) and not packed:
        data = gzip.compress(data, mtime=0)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for i in range(0, len(data), 1 << 20):
            part = bytearray(data[i : i + (1 << 20)])
            out.write(part, 0, len(part))
    finally:
        out.close()
