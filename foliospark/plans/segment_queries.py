"""Queries over segments that arithmetic derives from documents: a line is a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import segments as G


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    d, i = F.col("doc_id"), F.col("i")
    sizes = F.array(*(F.lit(float(s)) for s in (12, 12, 12, 12, 10, 14, 18, 24)))
    size = F.get(sizes, ((d * 7 + i * 13) % 8).cast("int"))
    return docs.select(
        "doc_id",
        (F.floor(i / 40) + 1).cast("int").alias("page_num"),
        i.alias("seg_no"),
        "content",
        F.concat(F.lit("F"), ((d + i) % 3).cast("string")).alias("font_name"),
        (size + 0.25).alias("font_size"),
        size.alias("transformed_font_size"),
        ((d + i) % 5 == 0).alias("is_bold"),
    )


SEGMENTS = """
raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
seg AS (SELECT doc_id, i // 40 + 1 AS page_num, i AS seg_no, ls[i + 1] AS content, 'F' || ((doc_id + i) % 3) AS font_name,
  [12, 12, 12, 12, 10, 14, 18, 24][(doc_id * 7 + i * 13) % 8 + 1]::DOUBLE AS tsize, (doc_id + i) % 5 = 0 AS is_bold
  FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM raw)),
hist AS (SELECT doc_id, font_name, tsize, sum(strlen(content))::BIGINT AS chars FROM seg GROUP BY ALL),
body AS (SELECT doc_id, arg_min(font_name, (-chars, tsize, font_name)) AS body_font, arg_min(tsize, (-chars, tsize, font_name)) AS body_size, list_reverse_sort(list_distinct(list(tsize))) AS sizes FROM hist GROUP BY doc_id),
larger AS (SELECT doc_id, body_font, body_size, [s FOR s IN sizes IF s > body_size * 1.1] AS sizes FROM body),
stats AS (SELECT doc_id, body_font, body_size, CASE WHEN len(sizes) <= 6 THEN sizes ELSE [sizes[i * (len(sizes) // 6) + 1] FOR i IN range(0, 6)] END AS thresholds FROM larger),
heads AS (SELECT seg.*, body_font, body_size, thresholds, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS short,
  len([w FOR w IN regexp_split_to_array(content, '\\s+') IF w <> '']) AS words FROM seg JOIN stats USING (doc_id)),
able AS (SELECT *, words < 10 AND regexp_matches(short, '^[\\p{L}\\p{Nd}\\p{Nl}\\p{No}]')
  AND (strlen(short) >= 4 OR (regexp_matches(short, '^\\+?[0-9]+$') AND TRY_CAST(short AS HUGEINT) <= 4294967295) OR regexp_matches(short, '^[IVX]+$')) AS can FROM heads),
levels AS (SELECT *, CASE
  WHEN font_name = body_font AND abs(tsize - body_size) < 0.1 THEN CASE WHEN is_bold AND can THEN 'H7' ELSE 'Body' END
  WHEN tsize < body_size THEN 'SubBody'
  WHEN abs(tsize - body_size) < 0.1 THEN CASE WHEN is_bold AND can THEN 'H7' ELSE 'Body' END
  WHEN can AND len(thresholds) > 0 THEN 'H' || least(6, list_position([abs(t - tsize) FOR t IN thresholds], list_min([abs(t - tsize) FOR t IN thresholds])))
  ELSE 'Body' END AS level FROM able)
""".replace("\\\\", "\\")


def _sql(select: str) -> str:
    return f"WITH {SEGMENTS} {select}"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.doc_stats(segments(spark, sf_dir))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    return G.classify(rows, G.doc_stats(rows))


CHUNKS = """
, ordered AS (SELECT doc_id, list({'l': level, 'c': content, 's': short, 'p': page_num} ORDER BY page_num, seg_no) AS xs FROM levels GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(
  [{'h': ['', '', '', '', '', '', ''], 't': '', 'p': 0, 'o': []::STRUCT(headings VARCHAR[], paragraph VARCHAR, page INT)[], 'l': '', 'c': '', 's': '', 'q': 0}] ||
  [{'h': ['', '', '', '', '', '', ''], 't': '', 'p': 0, 'o': []::STRUCT(headings VARCHAR[], paragraph VARCHAR, page INT)[], 'l': x.l, 'c': x.c, 's': x.s, 'q': x.p::INT} FOR x IN xs],
  LAMBDA a, x: {
    'h': CASE WHEN x.l[1] <> 'H' THEN a.h
      WHEN strlen(regexp_replace(a.t, '^\\s+|\\s+$', '', 'g')) > 35 THEN [CASE WHEN i = x.l[2]::INT THEN x.s WHEN i > x.l[2]::INT AND i < 7 THEN '' ELSE a.h[i] END FOR i IN range(1, 8)]
      ELSE [CASE WHEN i = x.l[2]::INT THEN a.h[i] || ' ' || x.s ELSE a.h[i] END FOR i IN range(1, 8)] END,
    't': CASE WHEN x.l[1] = 'H' THEN CASE WHEN strlen(regexp_replace(a.t, '^\\s+|\\s+$', '', 'g')) > 35 THEN '' ELSE a.t END WHEN a.t = '' THEN x.c ELSE a.t || ' ' || x.c END,
    'p': CASE WHEN x.l[1] = 'H' THEN a.p ELSE x.q END,
    'o': CASE WHEN x.l[1] = 'H' AND strlen(regexp_replace(a.t, '^\\s+|\\s+$', '', 'g')) > 35
      THEN list_append(a.o, {'headings': [h FOR h IN a.h IF h <> ''], 'paragraph': regexp_replace(regexp_replace(a.t, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 'page': x.q}) ELSE a.o END,
    'l': '', 'c': '', 's': '', 'q': 0}) AS f FROM ordered),
done AS (SELECT doc_id, CASE WHEN f.t <> '' THEN list_append(f.o, {'headings': [h FOR h IN f.h IF h <> ''], 'paragraph': regexp_replace(f.t, '^\\s+|\\s+$', '', 'g'), 'page': f.p}) ELSE f.o END AS o FROM folded)
SELECT doc_id, n::INT AS chunk_no, o[n].headings AS headings, o[n].paragraph AS paragraph, o[n].page AS page FROM (SELECT *, unnest(range(1, len(o) + 1)) AS n FROM done)
""".replace("\\\\", "\\")

QUERIES = {
    "font_size_hist": lambda s, d: G.size_histogram(segments(s, d), "font_size"),
    "tsize_hist": lambda s, d: G.size_histogram(segments(s, d), "transformed_font_size"),
    "body_font": lambda s, d: _stats(s, d).select("doc_id", "body_font", "body_transformed_size"),
    "heading_thresholds": lambda s, d: _stats(s, d).select("doc_id", F.concat_ws(",", F.transform("thresholds", lambda t: t.cast("int").cast("string"))).alias("thresholds")),
    "size_mode": lambda s, d: G.rounded_mode(segments(s, d), "doc_id", "font_size"),
    "level": lambda s, d: _levels(s, d).select("doc_id", "seg_no", "level"),
    "chunks": lambda s, d: G.assemble(_levels(s, d)).select("doc_id", "chunk_no", F.concat_ws(" > ", "headings").alias("headings"), "paragraph", "page"),
}

ORACLES = {
    "font_size_hist": _sql("SELECT doc_id, font_name, tsize + 0.25 AS font_size, chars FROM hist"),
    "tsize_hist": _sql("SELECT doc_id, font_name, tsize AS transformed_font_size, chars FROM hist"),
    "body_font": _sql("SELECT doc_id, body_font, body_size AS body_transformed_size FROM stats"),
    "heading_thresholds": _sql("SELECT doc_id, array_to_string([t::INT::VARCHAR FOR t IN thresholds], ',') AS thresholds FROM stats"),
    "size_mode": _sql("SELECT doc_id, arg_min(v, (-n, v)) AS mode FROM (SELECT doc_id, round((tsize + 0.25) * 100) / 100 AS v, count(*) AS n FROM seg GROUP BY ALL) GROUP BY doc_id"),
    "level": _sql("SELECT doc_id, seg_no::INT AS seg_no, level FROM levels"),
    "chunks": _sql(CHUNKS.replace("o[n].headings AS headings", "array_to_string(o[n].headings, ' > ') AS headings")),
}
