"""Font rules as relations: widths, encodings with differences, maps to Unicode, code splitting, colour-space kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: names of colour spaces; RGB and G stand for device spaces, Indexed is not taken
SPACES = "DeviceGray DeviceRGB DeviceCMYK Pattern Separation ICCBased CalGray CalRGB Lab RGB G Indexed".split()


def exploded_widths(fonts: DataFrame) -> DataFrame:
    """font, code, width of fonts (font, first_char, widths)."""
    return fonts.select("font", "first_char", F.posexplode("widths").alias("at", "width")).select("font", (F.col("first_char") + F.col("at")).cast("long").alias("code"), "width")


def differences(elements: DataFrame) -> DataFrame:
    """font, code, glyph of elements (font, at, code or glyph): a code sets the place, a name takes it and goes on;
    of names for one code the last stays. Codes over 255 are left out."""
    w = Window.partitionBy("font").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    groups = elements.withColumn("group", F.count("code").over(upto))
    inside = Window.partitionBy("font", "group").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumn("place", F.coalesce(F.first("code", ignorenulls=True).over(inside), F.lit(0)) + F.count("glyph").over(inside) - 1)
    return placed.where("glyph is not null and place < 256").groupBy("font", F.col("place").cast("long").alias("code")).agg(F.max_by("glyph", "at").alias("glyph"))


def _sign(cp: Column) -> Column:
    """The sign of a code point, above U+FFFF too."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def decoded(code: Column, to_unicode: Column, encoding: Column) -> Column:
    """A code's text: by its map, then by an array of 256 code points; unassigned codes have none."""
    cp = F.get(encoding, code)
    return F.coalesce(to_unicode[code], F.when(cp > 0, _sign(cp)).otherwise(""))


def unicode_map(ranges: DataFrame) -> DataFrame:
    """font, code, text of ranges (font, at, low, high, target): later ranges win."""
    codes = ranges.select("font", "at", "target", F.posexplode(F.sequence("low", "high")).alias("i", "code"))
    last = codes.groupBy("font", "code").agg(F.max_by(F.col("target") + F.col("i"), "at").alias("cp"))
    return last.select("font", "code", _sign(F.col("cp")).alias("text"))


def split_codes(b: Column) -> Column:
    """Two-byte codes of a byte string; an odd last byte has no code."""
    return F.transform(F.regexp_extract_all(F.hex(b), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))


def is_bold(description: Column) -> Column:
    return F.contains(F.lower(description), F.lit("bold"))


def colorspace(name: Column) -> Column:
    return F.when(name == "RGB", "DeviceRGB").when(name == "G", "DeviceGray").when(name.isin(SPACES[:9]), name).otherwise("unsupported")
