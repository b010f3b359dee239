"""Relational operators on feature frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from .. import model
from ..functions import coords
from ..model import FeatureFrame, Meta
from .graph import numbered

#: Documents with more keys than this are written by key instead of split into frames.
MAX_PARTS = 1000


def _predicate(ff: FeatureFrame, test: Column | Callable) -> Column:
    """A Column as it is; a Python function of (props, type, bbox, fid) through one Arrow UDF."""
    if isinstance(test, Column):
        return test
    from ..functions.measures import bbox

    call = F.udf(lambda p, t, b, i: bool(test(p, t, b, i)), BooleanType(), useArrow=True)
    return call(F.col("props"), model.type_name(F.col("geom")), bbox(F.col("geom"), ff.meta.precision), F.col("fid"))


def filter_features(ff: FeatureFrame, test: Column | Callable) -> FeatureFrame:
    """Features that pass; the result has no name."""
    return ff.with_df(ff.df.filter(_predicate(ff, test)), name="")


def map_properties(ff: FeatureFrame, props: dict[str, Column] | Callable, schema: str | None = None) -> FeatureFrame:
    """Properties replaced, geometry untouched (P02, X02): columns by name, or a function of props with a schema."""
    if callable(props):
        new = F.udf(props, schema, useArrow=True)(F.col("props"))
    else:
        new = F.struct(*(c.alias(k) for k, c in sorted(props.items())))
    return ff.with_df(ff.df.withColumn("props", new), name="")


def renamed(ff: FeatureFrame, name: str) -> FeatureFrame:
    """Another name; one that begins with `@` is put behind the present one."""
    return ff.header(name=ff.meta.name + name if name.startswith("@") else name)


def clone(ff: FeatureFrame, name: str | None = None, filter=None, map=None) -> FeatureFrame:
    """Filter, then map, in one plan, under a name."""
    out = filter_features(ff, filter) if filter is not None else ff
    out = map_properties(out, map) if map is not None else out
    return renamed(out.header(name=ff.meta.name), name) if name is not None else out


def without_properties(ff: FeatureFrame) -> FeatureFrame:
    """Geometry alone: sources then never read the properties."""
    return ff.with_df(ff.df.select("fid", "geom"))


def feature(ff: FeatureFrame, fid: int) -> DataFrame:
    """The feature of an ordinal."""
    return ff.df.filter(F.col("fid") == fid)


def geometry_of(ff: FeatureFrame, fid: int, member: int | None = None) -> DataFrame:
    """A feature's geometry, or one member of a collection."""
    geom = F.col("geom") if member is None else F.get(F.col("geom.members"), F.lit(member))
    return feature(ff, fid).select(geom.alias("geom"))


def properties_of(ff: FeatureFrame, fid: int) -> DataFrame:
    return feature(ff, fid).select("props.*")


def types(ff: FeatureFrame) -> DataFrame:
    """fid, type name."""
    return ff.df.select("fid", model.type_name(F.col("geom")).alias("type"))


def table(ff: FeatureFrame) -> DataFrame:
    """fid and one column a property (P10)."""
    return ff.df.select("fid", "props.*")


def each(ff: FeatureFrame, act: Callable) -> None:
    """Runs act(fid, type, props) on the executors for its effects."""
    ff.df.select("fid", model.type_name(F.col("geom")).alias("type"), "props").foreach(lambda r: act(r[0], r[1], r[2]))


def flattened(df: DataFrame, props: str = "props") -> DataFrame:
    """props with one level of nested structs as `key.sub` fields; the inverse is unflattened."""
    fields = []
    for f in df.schema[props].dataType.fields:
        if isinstance(f.dataType, StructType):
            fields += [F.col(f"{props}.`{f.name}`.`{s.name}`").alias(f"{f.name}.{s.name}") for s in f.dataType.fields]
        else:
            fields.append(F.col(f"{props}.`{f.name}`").alias(f.name))
    return df.withColumn(props, F.struct(*fields))


def unflattened(df: DataFrame, props: str = "props") -> DataFrame:
    """Fields with a dot become structs, split at the first dot."""
    groups: dict[str, list[tuple[str, Column]]] = {}
    for f in df.schema[props].dataType.fields:
        key, dot, sub = f.name.partition(".")
        groups.setdefault(key, []).append((sub if dot else "", F.col(f"{props}.`{f.name}`")))
    fields = []
    for key, parts in groups.items():
        nested = [c.alias(s) for s, c in parts if s]
        fields.append(F.struct(*nested).alias(key) if nested else parts[0][1].alias(key))
    return df.withColumn(props, F.struct(*fields))


def keys(df: DataFrame, json: str) -> DataFrame:
    """key: the sorted distinct property names of a column of JSON objects, with those of one nested level."""
    first = df.select(F.explode(F.from_json(json, "map<string,variant>")).alias("key", "v"))
    nested = first.filter(F.schema_of_variant("v").startswith("OBJECT")).select("key", F.explode(F.json_object_keys(F.to_json("v"))).alias("sub"))
    return first.select("key").union(nested.select(F.concat_ws(".", "key", "sub"))).distinct().orderBy("key")


def classify(df: DataFrame, key: Column) -> DataFrame:
    """Rows with their class `key` as text, so 1 and "1" meet; rows without one are dropped."""
    return df.withColumn("class", key.cast("string")).filter(F.col("class").isNotNull())


def classified(ff: FeatureFrame, key: Column | Callable) -> dict[str, FeatureFrame]:
    """A frame for each class, in key order, named `<name>@<key>` (A05, O04). Classes are few: at most MAX_PARTS."""
    if not isinstance(key, Column):
        from ..functions.measures import bbox

        call = F.udf(lambda p, t, b, i: None if (k := key(p, t, b, i)) is None else str(k), "string", useArrow=True)
        key = call(F.col("props"), model.type_name(F.col("geom")), bbox(F.col("geom"), ff.meta.precision), F.col("fid"))
    marked = classify(ff.df, key)
    found = [r[0] for r in marked.select("class").distinct().orderBy("class").limit(MAX_PARTS + 1).collect()]
    if len(found) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} classes: write classify(...) partitioned by class instead")
    return {k: ff.with_df(marked.filter(F.col("class") == k).drop("class"), name=f"{ff.meta.name}@{k}") for k in found}


def dissolve(ff: FeatureFrame, key: str, mode: str = "collect") -> FeatureFrame:
    """One feature for each value of a property.

    `collect` gathers the group's polygons into one (multi)polygon, borders kept; `union` removes shared borders.
    Properties stay where all members agree on one value. Groups without polygons go; an unknown key gives the input.
    """
    fields = ff.df.schema["props"].dataType
    if key.split(".")[0] not in fields.names:
        return ff
    marked = ff.df.withColumn("key", F.col(f"props.{key}").cast("string")).filter(F.col("key").isNotNull())
    same = []
    for f in fields.fields:
        c = F.col(f"props.`{f.name}`")
        text = F.to_json(F.struct(c))
        agree = (F.count_distinct(text) == 1) & (F.count(c) == F.count("*"))
        same.append(F.when(agree, F.any_value(c)).alias(f.name))
    polygons = F.filter(F.col("geom.members"), lambda m: m["gtype"].isin(model.POLYGON, model.MULTIPOLYGON))
    if mode == "union":
        from . import topology

        merged = topology.merge(marked.select("fid", "geom", "key"), "key").select("key", "geom")
        shared = marked.groupBy("key").agg(F.struct(*same).alias("props"))
        joined = merged.join(shared, "key")
    else:
        parts = F.flatten(F.array_sort(F.collect_list(F.struct("fid", F.flatten(F.transform(polygons, lambda m: m["polys"])).alias("p"))))["p"])
        grouped = marked.groupBy("key").agg(parts.alias("polys"), F.struct(*same).alias("props")).filter(F.size("polys") > 0)
        kind = F.when(F.size("polys") == 1, F.lit(model.POLYGON)).otherwise(F.lit(model.MULTIPOLYGON)).cast("tinyint")
        member = F.struct(kind.alias("gtype"), F.col("polys"))
        geom = F.struct(kind.alias("gtype"), F.array(member).alias("members")).cast(model.GEOMETRY)
        joined = grouped.select("key", geom.alias("geom"), "props")
    return ff.with_df(numbered(joined, "fid", "key").select("fid", "geom", "props"))


def concatenate(frames: list[FeatureFrame], name: str | None = None) -> FeatureFrame | None:
    """Bag union in list order, fids following on, properties by name.

    None for an empty list or for frames of different precision; one frame is itself.
    """
    frames = [f for f in frames if isinstance(f, FeatureFrame)]
    if not frames or len({f.meta.precision for f in frames}) > 1:
        return None
    if len(frames) == 1:
        return frames[0]
    wide: dict[str, str] = {}
    for f in frames:
        for x in f.df.schema["props"].dataType.fields:
            kind = x.dataType.simpleString()
            if (had := wide.setdefault(x.name, kind)) != kind:
                wide[x.name] = "double" if {had, kind} <= {"bigint", "int", "double", "float"} else "string"
    parts, start = [], 0
    for i, f in enumerate(frames):
        have = set(f.df.schema["props"].dataType.names)
        props = F.struct(*((F.col(f"props.`{k}`") if k in have else F.lit(None)).cast(t).alias(k) for k, t in sorted(wide.items())))
        parts.append(f.df.select((F.col("fid") + start).alias("fid"), "geom", props.alias("props")))
        if i < len(frames) - 1:
            last = f.df.agg(F.max("fid")).first()[0]
            start += 0 if last is None else last + 1
    union = reduce(DataFrame.unionByName, parts)
    return FeatureFrame(union, Meta(name or "", precision=frames[0].meta.precision))


def concat(ff: FeatureFrame, *others: FeatureFrame) -> FeatureFrame | None:
    """ff and others under ff's name."""
    return concatenate([ff, *others], ff.meta.name)


def requantise(ff: FeatureFrame, precision: int) -> FeatureFrame:
    """Coordinates rounded to another precision."""
    rounded = F.transform(
        F.col("geom.members"),
        lambda m: F.struct(
            m["gtype"].alias("gtype"),
            F.transform(
                m["polys"],
                lambda p: F.transform(
                    p,
                    lambda r: F.transform(
                        r, lambda v: F.struct(coords.rounded(v["x"], precision).alias("x"), coords.rounded(v["y"], precision).alias("y"))
                    ),
                ),
            ).alias("polys"),
        ),
    )
    geom = F.struct(F.col("geom.gtype").alias("gtype"), rounded.alias("members")).cast(model.GEOMETRY)
    return ff.with_df(ff.df.withColumn("geom", geom), precision=precision)


def binary_pool(df: DataFrame, data: str) -> DataFrame:
    """buf_id, hash, data: each distinct value once, numbered by hash (A10)."""
    once = df.select(F.sha2(data, 256).alias("hash"), F.col(data).alias("data")).dropDuplicates(["hash"])
    return numbered(once, "buf_id", "hash")


def with_buffers(df: DataFrame, pool: DataFrame, buf_id: str = "buf_id") -> DataFrame:
    """df with the data its ids refer to."""
    return df.join(pool.select(F.col("buf_id").alias(buf_id), "data"), buf_id, "left")
