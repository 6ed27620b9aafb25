"""Queries over characters of documents and static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import metrics as M
from foliospark.functions import strings as S
from foliospark.functions import tables as T
from foliospark.operators import fonts as P


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _parts(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet")


def _chars(s: SparkSession, d: str) -> DataFrame:
    """Distinct signs of all documents, how often each stands."""
    one = F.explode(F.filter(F.split("text", ""), lambda c: c != ""))
    return _docs(s, d).select(one.alias("c")).groupBy("c").agg(F.count("*").alias("n")).withColumn("cp", F.expr("conv(hex(encode(c, 'UTF-32')), 16, 10)").cast("int"))


def _decoded(s: SparkSession, d: str, name: str) -> DataFrame:
    """Bytes 0 to 255 through an encoding, by the characters' Latin-1 codes in the documents' texts."""
    return _docs(s, d).select("doc_id", F.sha2(S.decode(F.encode("text", "ISO-8859-1"), name), 256).alias("sha256"), F.length("text").alias("n"))


def _glyphs(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame(sorted(T.glyph_names().items()), "glyph string, cp int")
    # a fixed table: some hundreds of rows
    return _chars(s, d).join(F.broadcast(names), "cp", "left").groupBy("c", "cp", "n").agg(F.min("glyph").alias("glyph")).select("cp", "n", "glyph", F.coalesce(S.glyph_to_unicode(F.col("glyph")), F.lit(-1)).alias("back"))


def _widths(s: SparkSession, d: str) -> DataFrame:
    """By font: the widths of all signs, how many signs there are and how many have none."""
    names = ("Helvetica", "Helvetica-Bold", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Courier")
    rows = [(f, c, float(w)) for f in names for c, w in sorted(M.core_widths(f).items())]
    table = s.createDataFrame(rows, "font string, cp int, width double")
    # fixed tables: some two thousand rows, and the fonts' names
    chars = _chars(s, d).withColumn("font", F.explode(F.array(*map(F.lit, names))))
    met = chars.join(F.broadcast(table), ["font", "cp"], "left")
    return met.groupBy("font").agg(F.sum(F.col("n") * F.coalesce("width", F.lit(0.0))).cast("long").alias("advance"), F.sum("n").alias("n"), F.sum(F.when(F.col("width").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))


def _width_rows(s: SparkSession, d: str) -> DataFrame:
    fonts = _parts(s, d).select(F.col("p_partkey").alias("font"), (F.col("p_size") % 32 + 32).alias("first_char"), F.sequence(F.lit(1), F.col("p_size")).alias("widths"))
    return P.exploded_widths(fonts).select("font", "code", F.col("width").cast("long").alias("width"))


def _differences(s: SparkSession, d: str) -> DataFrame:
    """A font a supplier: its parts' sizes are codes, its parts' names glyphs."""
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    elements = lines.select(F.col("l_suppkey").alias("font"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("at"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity").cast("int") + 64).alias("code"), F.when(F.col("l_linenumber") % 3 != 1, F.col("l_partkey") % 26).alias("letter"))
    return P.differences(elements.withColumn("glyph", F.chr((F.col("letter") + 97).cast("int"))))


def _coalesced(s: SparkSession, d: str) -> DataFrame:
    """Signs by a ToUnicode map of lower-case vowels, then WinAnsi."""
    given = F.create_map(*(x for c in "aeiou" for x in (F.lit(ord(c)), F.lit(c.upper()))))
    win = F.array(*map(F.lit, T.encoding("WinAnsiEncoding")))
    chars = _chars(s, d).where("cp < 256")
    return chars.select("cp", "n", P.decoded(F.col("cp"), given, win).alias("out"))


def _bold(s: SparkSession, d: str) -> DataFrame:
    styles = F.array(*map(F.lit, ("Regular", "BOLD", "SemiBoldItalic", "Light")))
    return _parts(s, d).select("p_partkey", P.is_bold(F.concat(F.col("p_name"), F.lit("-"), F.get(styles, (F.col("p_partkey") % 4).cast("int")))).alias("bold"))


def _cids(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).select("doc_id", P.split_codes(F.encode("text", "UTF-16BE")).alias("codes"))
    return docs.select("doc_id", F.size("codes").alias("n"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("total"))


def _map(s: SparkSession, d: str) -> DataFrame:
    """Code ranges (low, high, first target) of parts, spread to single codes; later ones win."""
    ranges = _parts(s, d).select((F.col("p_partkey") % 50).alias("font"), F.col("p_partkey").alias("at"), (F.col("p_size") * 3).alias("low"), (F.col("p_size") * 3 + F.col("p_partkey") % 7).alias("high"), (F.col("p_size") + 65).alias("target"))
    return P.unicode_map(ranges).select("font", F.col("code").cast("long").alias("code"), "text")


QUERIES = {
    "pdfdoc_decode": lambda s, d: _docs(s, d).select("doc_id", F.sha2(S.pdf_string(F.encode("text", "ISO-8859-1")), 256).alias("sha256")),
    "utf16_decode": lambda s, d: _docs(s, d).select("doc_id", F.sha2(S.pdf_string(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))), 256).alias("sha256")),
    "encoding_decode": lambda s, d: _decoded(s, d, "WinAnsiEncoding"),
    "glyph_lookup": _glyphs,
    "core_width": _widths,
    "widths_explode": _width_rows,
    "differences_overlay": _differences,
    "decode_coalesce": _coalesced,
    "tounicode_map": _map,
    "cid_split": _cids,
    "bold_flag": _bold,
    "insert_nbsp": lambda s, d: _docs(s, d).select("doc_id", F.sha2(S.insert_nbsp(F.regexp_replace("text", "[aeiou]", " ")), 256).alias("sha256")),
    "colorspace_kind": lambda s, d: _parts(s, d).select("p_partkey", P.colorspace(F.get(F.array(*map(F.lit, P.SPACES)), (F.col("p_partkey") % len(P.SPACES)).cast("int"))).alias("kind")),
}


# fixed values that results are checked by, stated apart from the engine's tables: code:point of the codes that don't
# stand for themselves; names of signs by code point, the first by alphabet
_EXPECTED = {
    "PDFDocEncoding": "24:728 25:711 26:710 27:729 28:733 29:731 30:730 31:732 127:0 128:8226 129:8224 130:8225 131:8230 132:8212 133:8211 134:402 135:8260 136:8249 137:8250 138:8722 139:8240 140:8222 141:8220 142:8221 143:8216 144:8217 145:8218 146:8482 147:64257 148:64258 149:321 150:338 151:352 152:376 153:381 154:305 155:322 156:339 157:353 158:382 159:0 160:8364 173:0",
    "WinAnsiEncoding": " ".join(f"{c}:0" for c in range(1, 32)) + " 127:8226 128:8364 129:8226 130:8218 131:402 132:8222 133:8230 134:8224 135:8225 136:710 137:8240 138:352 139:8249 140:338 141:8226 142:381 143:8226 144:8226 145:8216 146:8217 147:8220 148:8221 149:8226 150:8211 151:8212 152:732 153:8482 154:353 155:8250 156:339 157:8226 158:382 159:376 160:32 173:45",
}
_NAMED = """32:space 33:exclam 34:quotedbl 35:numbersign 36:dollar 37:percent 38:ampersand 39:quotesingle 40:parenleft 41:parenright 42:asterisk 43:plus 44:comma 45:hyphen 46:period 47:slash 48:zero 49:one 50:two 51:three 52:four
53:five 54:six 55:seven 56:eight 57:nine 58:colon 59:semicolon 60:less 61:equal 62:greater 63:question 64:at 91:bracketleft 92:backslash 93:bracketright 94:asciicircum 95:underscore 96:grave 123:braceleft 124:bar 125:braceright 126:asciitilde
192:Agrave 193:Aacute 194:Acircumflex 195:Atilde 196:Adieresis 197:Aring 198:AE 199:Ccedilla 200:Egrave 201:Eacute 202:Ecircumflex 203:Edieresis 204:Igrave 205:Iacute 206:Icircumflex 207:Idieresis 209:Ntilde 210:Ograve 211:Oacute 212:Ocircumflex 213:Otilde 214:Odieresis 216:Oslash
217:Ugrave 218:Uacute 219:Ucircumflex 220:Udieresis 221:Yacute 223:germandbls 224:agrave 225:aacute 226:acircumflex 227:atilde 228:adieresis 229:aring 230:ae 231:ccedilla 232:egrave 233:eacute 234:ecircumflex 235:edieresis 236:igrave 237:iacute 238:icircumflex 239:idieresis 241:ntilde 242:ograve
243:oacute 244:ocircumflex 245:otilde 246:odieresis 248:oslash 249:ugrave 250:uacute 251:ucircumflex 252:udieresis 253:yacute 255:ydieresis 161:exclamdown 191:questiondown"""
# fixed values: widths of the codes 32 to 126 but for the two quotes, then of germandbls, ae, AE, oslash, Oslash
_WIDE = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584 611",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584 611",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541 500",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520 556",
    "Times-Italic": "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541 500",
    "Times-BoldItalic": "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570 500",
    "Courier": " ".join(["600"] * 96),
}


def _translated(name: str) -> str:
    pairs = [x.split(":") for x in _EXPECTED[name].split()]
    pairs.sort(key=lambda x: x[1] == "0")
    return f"translate(text, {' || '.join(f'chr({a})' for a, _ in pairs)}, {' || '.join(f'chr({b})' for _, b in pairs)})"


_CHARS = "(SELECT c, ord(c) AS cp, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c)"
_NAMES = "(VALUES " + ", ".join("('{1}', {0})".format(*x.split(":")) for x in _NAMED.split()) + ") g(glyph, code)"
_WIDTHS = "(VALUES " + ", ".join(f"('{f}', [{', '.join(w.split())}])" for f, w in _WIDE.items()) + ") f(font, widths)"
# a letter with an accent is as wide as the bare one, but for some of i's in Helvetica
_WIDTH = "CASE WHEN cp BETWEEN 32 AND 126 THEN widths[cp - 31] WHEN c = 'ß' THEN widths[96] WHEN font = 'Helvetica' AND c IN ('í', 'ì', 'î', 'ï') THEN 278 WHEN cp BETWEEN 192 AND 255 AND ord(strip_accents(c)) BETWEEN 65 AND 122 THEN widths[ord(strip_accents(c)) - 31] END"
_SPACES = "CASE p_partkey % {n} {cases} END"

ORACLES = {
    "pdfdoc_decode": f"SELECT doc_id, sha256({_translated('PDFDocEncoding')}) AS sha256 FROM documents",
    "utf16_decode": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "encoding_decode": f"SELECT doc_id, sha256({_translated('WinAnsiEncoding')}) AS sha256, length(text)::INT AS n FROM documents",
    "glyph_lookup": f"SELECT cp, n, min(CASE WHEN cp BETWEEN 65 AND 90 OR cp BETWEEN 97 AND 122 THEN c ELSE glyph END) AS glyph, CASE WHEN min(CASE WHEN cp BETWEEN 65 AND 90 OR cp BETWEEN 97 AND 122 THEN c ELSE glyph END) IS NOT NULL THEN cp ELSE -1 END AS back FROM {_CHARS} LEFT JOIN {_NAMES} ON cp = code GROUP BY cp, n",
    "core_width": f"SELECT font, sum(n * coalesce(width, 0))::BIGINT AS advance, sum(n)::BIGINT AS n, sum(CASE WHEN width IS NULL THEN n ELSE 0 END)::BIGINT AS n_missing FROM (SELECT font, n, {_WIDTH} AS width FROM {_CHARS}, {_WIDTHS}) GROUP BY font",
    "widths_explode": "SELECT p_partkey AS font, p_size % 32 + 32 + i - 1 AS code, i AS width FROM (SELECT *, unnest(range(1, p_size + 1)) AS i FROM part)",
    "differences_overlay": """WITH e AS (SELECT l_suppkey AS font, row_number() OVER w AS k, CASE WHEN l_linenumber % 3 = 1 THEN l_quantity::INT + 64 END AS code, CASE WHEN l_linenumber % 3 <> 1 THEN chr((l_partkey % 26 + 97)::INT) END AS glyph FROM lineitem
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate)),
      r AS (SELECT *, count(code) OVER (PARTITION BY font ORDER BY k) AS g FROM e),
      p AS (SELECT font, k, glyph, max(code) OVER (PARTITION BY font, g) AS start, count(glyph) OVER (PARTITION BY font, g ORDER BY k) - 1 AS off FROM r)
      SELECT font, (coalesce(start, 0) + off)::BIGINT AS code, arg_max(glyph, k) AS glyph FROM p WHERE glyph IS NOT NULL AND coalesce(start, 0) + off < 256 GROUP BY ALL""",
    "decode_coalesce": f"SELECT cp, n, CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN upper(c) WHEN cp = 160 THEN ' ' WHEN cp = 173 THEN '-' WHEN cp < 32 THEN '' ELSE c END AS out FROM {_CHARS}",
    "tounicode_map": "SELECT font, code, chr(arg_max(t, p_partkey)::INT) AS text FROM (SELECT p_partkey % 50 AS font, p_partkey, p_size * 3 + i AS code, p_size + 65 + i AS t FROM (SELECT *, unnest(range(0, p_partkey % 7 + 1)) AS i FROM part)) GROUP BY ALL",
    "cid_split": "SELECT doc_id, len(cs)::INT AS n, coalesce(list_sum([ord(c) FOR c IN cs]), 0)::BIGINT AS total FROM (SELECT doc_id, string_split(text, '') AS cs FROM documents)",
    "bold_flag": "SELECT p_partkey, contains(lower(p_name), 'bold') OR p_partkey % 4 IN (1, 2) AS bold FROM part",
    "insert_nbsp": """WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '[aeiou]', ' ', 'g'), '') AS cs FROM documents)
      SELECT doc_id, sha256(array_to_string([CASE WHEN cs[i] = ' ' AND (i = 1 OR cs[i - 1] = ' ' OR i = len(cs) OR cs[i + 1] = ' ') THEN '&nbsp;' ELSE cs[i] END FOR i IN range(1, len(cs) + 1)], '')) AS sha256 FROM t""",
    "colorspace_kind": "SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'DeviceGray' WHEN 1 THEN 'DeviceRGB' WHEN 2 THEN 'DeviceCMYK' WHEN 3 THEN 'Pattern' WHEN 4 THEN 'Separation' WHEN 5 THEN 'ICCBased' WHEN 6 THEN 'CalGray' WHEN 7 THEN 'CalRGB' WHEN 8 THEN 'Lab' WHEN 9 THEN 'DeviceRGB' WHEN 10 THEN 'DeviceGray' ELSE 'unsupported' END AS kind FROM part",
}
