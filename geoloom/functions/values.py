"""Property values: types, colours, dates, text forms, ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a colour text.
COLOUR = r"^(rgba?\(.*\)|#[0-9a-f]{3,6})$"


def variant_type(v: Column) -> Column:
    """Type name of a variant value: NULL, BOOL, INTEGER, FLOAT, STRING, COLOR, BBOX or JSON."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    parts = F.try_variant_get(v, "$", "array<double>")
    at = lambda i: F.get(parts, F.lit(i))
    box = (F.size(parts) == 4) & (at(0) <= at(2)) & (at(1) <= at(3)) & at(0).between(-180, 180) & at(2).between(-180, 180)
    box &= at(1).between(-90, 90) & at(3).between(-90, 90)
    return (
        F.when(v.isNull() | (kind == "VOID"), "NULL")
        .when(kind == "BOOLEAN", "BOOL")
        .when(kind == "STRING", F.when(F.try_variant_get(v, "$", "string").rlike(COLOUR), "COLOR").otherwise("STRING"))
        .when(kind.startswith("ARRAY"), F.when(F.coalesce(box, F.lit(False)), "BBOX").otherwise("JSON"))
        .when(kind.startswith("OBJECT"), "JSON")
        .when(F.floor(number) == number, "INTEGER")
        .otherwise("FLOAT")
    )


def colour(text: Column) -> Column:
    """r, g, b, a (0..255) of `#rgb`, `#rrggbb`, `rgb()` or `rgba()`; a digit x of the short form is x * 16.

    Hex of 4 or 5 digits is black. Null where the text is no colour.
    """
    hex_ = F.regexp_extract(text, r"^#([0-9a-f]{3,6})$", 1)
    pair = lambda i: F.conv(F.substring(hex_, 2 * i + 1, 2), 16, 10).cast("int")
    digit = lambda i: F.conv(F.substring(hex_, i + 1, 1), 16, 10).cast("int") * 16
    numbers = F.transform(
        F.regexp_extract_all(F.regexp_extract(text, r"^rgba?\((.*)\)$", 1), F.lit(r"[0-9.]+"), 0), lambda x: x.try_cast("double")
    )
    of_rgb = lambda i: F.floor(F.get(numbers, F.lit(i))).cast("int")
    alpha = F.coalesce(F.floor(F.get(numbers, F.lit(3)) * 255).cast("int"), F.lit(255))

    def channel(i: int) -> Column:
        return (
            F.when(F.length(hex_) == 6, pair(i)).when(F.length(hex_) == 3, digit(i)).when(F.length(hex_) > 0, F.lit(0)).otherwise(of_rgb(i))
        )

    found = F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), F.when(F.length(hex_) > 0, 255).otherwise(alpha).alias("a"))
    return F.when(text.rlike(COLOUR), found)


def colour_text(c: Column) -> Column:
    """`rgb(r,g,b)`, or `rgba(r,g,b,a.aa)` if not opaque."""
    solid = F.format_string("rgb(%d,%d,%d)", c["r"], c["g"], c["b"])
    clear = F.format_string("rgba(%d,%d,%d,%.2f)", c["r"], c["g"], c["b"], c["a"] / 255.0)
    return F.when(c["a"] == 255, solid).otherwise(clear)


def kml_colour(c: Column, opacity: Column | None = None) -> Column:
    """`aabbggrr` in lower-case hex."""
    a = c["a"] if opacity is None else F.floor(opacity * 255).cast("int")
    return F.lower(F.concat(*(F.lpad(F.hex(v), 2, "0") for v in (a, c["b"], c["g"], c["r"]))))


def whole_seconds(ts: Column) -> Column:
    """Timestamp at the nearest whole second, halves up."""
    return F.timestamp_seconds(F.floor(F.unix_millis(ts) / 1000.0 + 0.5))


def dbf_date(text: Column) -> Column:
    """Date of YYYYMMDD; null where it is none."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def dbf_date_text(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def json_text(value: Column) -> Column:
    """JSON text of a struct, map, array or variant."""
    return F.to_json(value)


def xml_name(text: Column) -> Column:
    """A name fit for an XML element: colons and what names can't hold become `_`."""
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")
    return F.regexp_replace(plain, r"^(?=[^\p{L}_])", "_")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def kml_coordinates(vertices: Column) -> Column:
    """`x,y,0` separated by blanks."""
    return F.array_join(F.transform(vertices, lambda v: F.concat_ws(",", v["x"].cast("string"), v["y"].cast("string"), F.lit("0"))), " ")


def gml_coordinates(vertices: Column) -> Column:
    """`lat lon` pairs separated by blanks."""
    return F.array_join(F.transform(vertices, lambda v: F.concat_ws(" ", v["y"].cast("string"), v["x"].cast("string"))), " ")


def parse_coordinates(text: Column) -> Column:
    """Vertices of `x,y[,z]` groups separated by white space; the height is dropped."""
    groups = F.filter(F.split(F.trim(text), r"\s+"), lambda g: g.contains(","))
    return F.transform(
        groups, lambda g: F.struct(F.split(g, ",")[0].cast("double").alias("x"), F.split(g, ",")[1].cast("double").alias("y"))
    )


def rank(area: Column) -> Column:
    """Importance 0..63 of an area in square metres (F32)."""
    raw = F.floor(1.5 * F.log2(F.when(area > 0, area)) - 8.2365)
    return F.coalesce(F.least(F.lit(63), F.greatest(F.lit(0), raw)), F.lit(0)).cast("int")
