"""Profiles of a feature frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import measures, values
from ..model import FeatureFrame


def length(ff: FeatureFrame) -> int:
    """Number of features."""
    return ff.df.count()


def totals(df: DataFrame) -> DataFrame:
    """points, lines, polygons, coords of all features."""
    c = df.select(measures.counts(F.col("geom")).alias("c"))
    return c.agg(*(F.coalesce(F.sum(f"c.{k}"), F.lit(0)).alias(k) for k in ("points", "lines", "polygons", "coords")))


def extent(df: DataFrame, precision: int = model.DEFAULT_PRECISION) -> DataFrame:
    """xmin, ymin, xmax, ymax over the features whose own box is valid."""
    box = df.select(measures.bbox(F.col("geom"), precision).alias("b")).filter(measures.is_bbox(F.col("b")))
    return box.agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def type_counts(df: DataFrame) -> DataFrame:
    """type, n (A04)."""
    return df.groupBy(model.type_name(F.col("geom")).alias("type")).agg(F.count("*").alias("n"))


def key_types(df: DataFrame, json: str) -> DataFrame:
    """key, type, n of a column of JSON objects, most frequent type first; null values are not counted."""
    rows = df.select(F.explode(F.from_json(json, "map<string,variant>")).alias("key", "v"))
    typed = rows.select("key", values.variant_type(F.col("v")).alias("type")).filter("type <> 'NULL'")
    return typed.groupBy("key", "type").agg(F.count("*").alias("n"))


def merged_types(histogram: DataFrame) -> DataFrame:
    """key, type: FLOAT where just FLOAT and INTEGER occur and FLOAT more often, else all types joined by a bar."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("type")))), lambda x: x["type"]
    )
    by = histogram.groupBy("key").agg(ordered.alias("types"))
    merged = (F.size("types") == 2) & (F.get("types", F.lit(0)) == "FLOAT") & (F.get("types", F.lit(1)) == "INTEGER")
    return by.select("key", F.when(merged, F.lit("FLOAT")).otherwise(F.array_join("types", "|")).alias("type"))


def lint(ff: FeatureFrame) -> str:
    """A report of the frame; only aggregates reach the driver."""
    n = length(ff)
    c, b = totals(ff.df).first(), extent(ff.df, ff.meta.precision).first()
    lines = [f"name: {ff.meta.name}", f"precision: {ff.meta.precision}", f"features: {n:,}"]
    lines += [f"  {r['type']}: {r['n']:,}" for r in type_counts(ff.df).orderBy("type").collect()]
    lines += [f"points: {c[0]:,}, lines: {c[1]:,}, polygons: {c[2]:,}, coords: {c[3]:,}", f"bbox: {[*b]}"]
    if "props" in ff.df.columns and ff.df.schema["props"].dataType.fields:
        rows = ff.df.select(F.to_json("props").alias("j"))
        lines += [f"  {r['key']}: {r['type']}" for r in merged_types(key_types(rows, "j")).orderBy("key").collect()]
    return "\n".join(lines)


def dbf_fields(df: DataFrame) -> DataFrame:
    """name, type, length, decimals of the DBF fields for the struct column props: one aggregate."""
    from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, TimestampType

    spark, sizes = df.sparkSession, []
    fields = sorted(df.schema["props"].dataType.fields, key=lambda f: f.name)
    for f in fields:
        c = F.col(f"props.`{f.name}`")
        if isinstance(f.dataType, DoubleType | FloatType | IntegerType | LongType | ShortType):
            text = F.regexp_replace(F.format_number(c, 10), ",", "") if isinstance(f.dataType, DoubleType | FloatType) else c.cast("string")
            text = F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
            whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
            sizes.append(F.struct(F.max(F.length(whole)).alias("a"), F.max(F.length(part)).alias("b")))
        else:
            sizes.append(F.struct(F.max(F.octet_length(c.cast("string"))).alias("a"), F.lit(0).alias("b")))
    if not fields:
        return spark.createDataFrame([], "name string, type string, length int, decimals int")
    row, rows = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sizes))).first(), []
    for f, (a, b) in zip(fields, row):
        name = f.name.encode()[:11].decode(errors="ignore")
        if isinstance(f.dataType, BooleanType):
            rows.append((name, "L", 1, 0))
        elif isinstance(f.dataType, DateType | TimestampType):
            rows.append((name, "D", 8, 0))
        elif isinstance(f.dataType, DoubleType | FloatType | IntegerType | LongType | ShortType):
            rows.append((name, "N", min(254, (a or 1) + (1 + b if b else 0)), b or 0))
        else:
            rows.append((name, "C", max(1, min(254, a or 1)), 0))
    return spark.createDataFrame(rows, "name string, type string, length int, decimals int")
