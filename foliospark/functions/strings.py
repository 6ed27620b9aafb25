"""String rules of document extraction, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import tables

#: White space and the alphanumeric class by Unicode.
SPACE, ALNUM = r"(?U)\s+", r"^[\p{L}\p{Nd}\p{Nl}\p{No}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.regexp_replace(trim(c), SPACE, " ")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SPACE), lambda w: w != ""))


def starts_alphanumeric(c: Column) -> Column:
    return c.rlike(ALNUM)


def parses_u32(c: Column) -> Column:
    digits = F.regexp_replace(c, r"^\+?0*", "")
    return c.rlike(r"^\+?[0-9]+$") & (F.length(digits) <= 10) & (F.lpad(digits, 10, "0") <= "4294967295")


def is_roman(c: Column) -> Column:
    return c.rlike("^[IVX]+$")


def insert_nbsp(c: Column) -> Column:
    """A space that follows no other sign, or precedes none, becomes &nbsp;."""
    return F.regexp_replace(c, "(?<![^ ]) | (?![^ ])", "&nbsp;")


def number(c: Column) -> Column:
    """A double as its shortest text that reads back as the same, without an exponent; whole numbers without a fraction."""
    text = c.cast("double").cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa, power = F.split_part(F.ltrim(text, F.lit("-")), F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    n = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.when(n <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.left(digits, power + 1), F.lit("."), F.substr(digits, power + 2)))
    plain = F.regexp_replace(text, r"\.0$", "")
    return F.when(~text.contains("E"), plain).otherwise(F.concat(sign, F.when(power < 0, small).otherwise(large)))


def decode(codes: Column, encoding: str) -> Column:
    """Text of bytes by a named one-byte encoding: Latin-1 with its departures replaced."""
    table = tables.encoding(encoding)
    changed = [b for b in range(256) if table[b] and table[b] != b]
    text = F.translate(F.decode(codes, "ISO-8859-1"), "".join(map(chr, changed)), "".join(chr(table[b]) for b in changed))
    # what is unassigned decodes to U+0000, which translate() would drop
    missing = [b for b in range(1, 256) if not table[b]]
    return F.regexp_replace(text, "[" + "".join(f"\\x{b:02x}" for b in missing) + "]", "\0") if missing else text


def pdf_string(b: Column) -> Column:
    """A PDF text string: UTF-16BE after its mark, or else PDFDocEncoding."""
    marked = (F.octet_length(b) > 2) & (F.substring(b, 1, 2) == F.unhex(F.lit("FEFF")))
    return F.when(marked, F.decode(F.substring(b, 3, 1 << 30), "UTF-16BE")).otherwise(decode(b, "PDFDocEncoding"))


def glyph_to_unicode(name: Column, path: str | None = None) -> Column:
    names = tables.glyph_names(path)
    return F.create_map(*(x for n, c in names.items() for x in (F.lit(n), F.lit(c))))[name]


def register(spark: SparkSession) -> None:
    """SQL functions of these rules."""
    for name, body in {
        "insert_nbsp(s STRING) RETURNS STRING": "regexp_replace(s, '(?<![^ ]) | (?![^ ])', '&nbsp;')",
        "unicode_trim(s STRING) RETURNS STRING": r"regexp_replace(s, '(?U)^\\s+|\\s+$', '')",
        "is_roman(s STRING) RETURNS BOOLEAN": "s rlike '^[IVX]+$'",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")
