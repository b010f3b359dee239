"""The data model: canonical geometry struct, feature frames and their metadata.

Every geometry has one shape, whatever its type: members (one unless it is a collection), each with parts by
polygon, ring or line, and vertex. Rings are closed here and open only in the container format.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Geometry type names; the numeric code is the position.
TYPES = (
    "Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection",
)
POINT, MULTIPOINT, LINE, MULTILINE, POLYGON, MULTIPOLYGON, COLLECTION = range(7)
DEFAULT_PRECISION = 6

VERTEX = "struct<x:double,y:double>"
PARTS = f"array<array<array<{VERTEX}>>>"
GEOMETRY = f"struct<gtype:tinyint,members:array<struct<gtype:tinyint,polys:{PARTS}>>>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


@dataclass(frozen=True)
class Meta:
    """Name, description, licence and coordinate precision of a data set, kept apart from its rows."""

    name: str = ""
    description: str = ""
    license: str = ""
    precision: int = DEFAULT_PRECISION


@dataclass(frozen=True)
class FeatureFrame:
    """Features (fid BIGINT, geom, props STRUCT or VARIANT) with metadata and the pool of binary values."""

    df: DataFrame
    meta: Meta = field(default_factory=Meta)
    pool: DataFrame | None = None

    def header(self, **changes) -> FeatureFrame:
        """Metadata replaced; no row is touched."""
        return replace(self, meta=replace(self.meta, **changes))

    def name(self, value: str | None = None):
        """Name, or a frame with another one."""
        return self.meta.name if value is None else self.header(name=value)

    def description(self, value: str | None = None):
        return self.meta.description if value is None else self.header(description=value)

    def license(self, value: str | None = None):
        return self.meta.license if value is None else self.header(license=value)

    def with_df(self, df: DataFrame, **changes) -> FeatureFrame:
        return replace(self, df=df, meta=replace(self.meta, **changes))


def vertex(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(gtype: int, polys: Column) -> Column:
    """A geometry of one member from its parts (polygon / ring or line / vertex)."""
    member = F.struct(F.lit(gtype).cast("tinyint").alias("gtype"), polys.alias("polys"))
    return F.struct(F.lit(gtype).cast("tinyint").alias("gtype"), F.array(member).alias("members")).cast(GEOMETRY)


def point(x: Column, y: Column) -> Column:
    return geometry(POINT, F.array(F.array(F.array(vertex(x, y)))))


def multipoint(vertices: Column) -> Column:
    return geometry(MULTIPOINT, F.array(F.array(vertices)))


def linestring(vertices: Column) -> Column:
    return geometry(LINE, F.array(F.array(vertices)))


def multilinestring(lines: Column) -> Column:
    return geometry(MULTILINE, F.array(lines))


def polygon(rings: Column) -> Column:
    return geometry(POLYGON, F.array(rings))


def multipolygon(polys: Column) -> Column:
    return geometry(MULTIPOLYGON, polys)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed clockwise rectangle."""
    corners = ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))
    return polygon(F.array(F.array(*(vertex(x, y) for x, y in corners))))


def type_name(geom: Column) -> Column:
    """Name of the geometry's type."""
    return F.element_at(F.array(*map(F.lit, TYPES)), geom["gtype"].cast("int") + 1)


def exploded(df: DataFrame, *keep: str, geom: str = "geom") -> DataFrame:
    """keep + (member, mtype, poly, ring, seq, x, y): one row for each vertex."""
    m = df.select(*keep, F.posexplode(f"{geom}.members").alias("member", "m"))
    p = m.select(*keep, "member", F.col("m.gtype").alias("mtype"), F.posexplode("m.polys").alias("poly", "p"))
    r = p.select(*keep, "member", "mtype", "poly", F.posexplode("p").alias("ring", "r"))
    v = r.select(*keep, "member", "mtype", "poly", "ring", F.posexplode("r").alias("seq", "v"))
    return v.select(*keep, "member", "mtype", "poly", "ring", "seq", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
