"""Features from files that only a parser understands: Spark reads the bytes, executors parse, one task a file."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model

#: Members of archives may unpack to so many bytes.
MAX_MEMBER = 1 << 31


def geom(gtype: int, polys: list) -> dict:
    """A geometry as a dictionary from parts of (x, y) pairs."""
    parts = [[[{"x": float(x), "y": float(y)} for x, y in line] for line in rings] for rings in polys]
    return {"gtype": gtype, "members": [{"gtype": gtype, "polys": parts}]}


def collection(members: list[dict]) -> dict:
    return {"gtype": model.COLLECTION, "members": [m for g in members for m in g["members"]]}


def plain(data: bytes) -> bytes:
    """data, gunzipped if it begins as gzip does."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(wbits=31).decompress(data, MAX_MEMBER)
    return data


def members(data: bytes) -> dict[str, bytes]:
    """Files of a zip archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if sum(i.file_size for i in infos) > MAX_MEMBER:
            raise ValueError("the archive unpacks to more than the limit")
        return {i.filename: z.read(i) for i in infos}


def is_zip(data: bytes) -> bool:
    return data[:4] == b"PK\x03\x04"


def parsed(spark: SparkSession, path: str, parse: Callable[[bytes, str], Iterable[tuple[dict | None, dict]]], member: str | None = None) -> DataFrame:
    """file, i, geom, props (JSON text) of the features that parse(data, path) yields for each file.

    member: only this file of each archive (S14).
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(model.GEOMETRY))
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = plain(data)
                if member is not None:
                    name, data = f"{name}#{member}", members(data)[member]
                rows = list(parse(data, name))
                for at in range(0, max(len(rows), 1), 4096):
                    part = rows[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()),
                            pa.array([g for g, _ in part], kind), pa.array([json.dumps(p, default=str) for _, p in part], pa.string()),
                        ],
                        ["file", "i", "geom", "props"],
                    )

    return files.mapInArrow(run, f"file string, i long, geom {model.GEOMETRY}, props string")


def json_schema(rows: DataFrame, json_col: str) -> str:
    """DDL of the struct that a column of JSON objects holds: integers and fractions make DOUBLE, other mixtures STRING."""
    found = rows.select(F.parse_json(json_col).alias("v")).agg(F.schema_of_variant_agg("v")).first()[0] or ""
    import re

    ddl = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", found).replace("OBJECT<", "STRUCT<")
    return re.sub(r"\b(VARIANT|VOID)\b", "STRING", ddl)


def typed(rows: DataFrame, json_col: str = "props") -> DataFrame:
    """rows with the JSON column as a struct of inferred types, fields in name order."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    ddl = json_schema(rows, json_col)
    kind = _parse_datatype_string(ddl) if ddl.startswith("STRUCT<") and ddl != "STRUCT<>" else StructType().add("_none", "string")
    kind = StructType(sorted(kind.fields, key=lambda f: f.name))
    return rows.withColumn(json_col, F.from_json(json_col, kind))


def frame(rows: DataFrame, noprop: bool = False) -> DataFrame:
    """fid, geom, props from parsed(): numbered by file and place."""
    from ..operators.graph import numbered

    out = numbered(rows, "fid", "file", "i")
    return out.select("fid", "geom") if noprop else typed(out).select("fid", "geom", "props")


def collected(df: DataFrame, precision: int = 12) -> Iterable[tuple[dict | None, dict]]:
    """(geometry, properties without nulls) in fid order, streamed to the driver for writers of one file."""
    cols = ["geom", F.to_json("props").alias("props")] if "props" in df.columns else ["geom", F.lit("{}").alias("props")]
    for row in df.orderBy("fid").select(*cols).toLocalIterator():
        yield (row[0].asDict(recursive=True) if row[0] else None), json.loads(row[1])
