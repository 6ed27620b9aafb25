"""Queries of the renderers, over glyphs and paths that arithmetic derives from order lines and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import strings as S
from foliospark.operators import render as R
from foliospark.plans.text_queries import BY, KEYS, ORDER, ops


def _glyphs(s: SparkSession, d: str) -> DataFrame:
    """A glyph a line: of width 0.5 x 8, so that a line numbered one more than the one before goes on with its run."""
    one = lambda v: F.lit(float(v))
    return ops(s, d).select(*KEYS, (F.col("l_linenumber") * 4.0).alias("x"), one(700).alias("y"), one(1).alias("a"), one(0).alias("b"), one(0).alias("c"), one(1).alias("d"), one(0.5).alias("w0"), one(0).alias("spacing"), one(8).alias("size"), F.concat("l_returnflag", F.when(F.col("l_quantity") > 25, " ").otherwise("")).alias("text"))


def _html_glyph(s: SparkSession, d: str) -> DataFrame:
    runs = R.html_runs(_glyphs(s, d), BY, ORDER)
    ordered = F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in ORDER), F.col("x").alias("gx"), F.col("text").alias("t"))))
    grouped = runs.groupBy("l_orderkey", "run").agg(ordered.alias("gs"))
    text = F.array_join(F.transform("gs", lambda g: g["t"]), "")
    return grouped.select("l_orderkey", F.col("run").cast("long").alias("run"), R.html_div(F.col("gs")[0]["gx"], F.lit(92.0), F.lit(8.0), text).alias("html"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", (F.col("p_size") * 12.0).alias("w"), (F.col("p_size") * 16.5).alias("h"), "p_name")


def _svg_path(s: SparkSession, d: str) -> DataFrame:
    x, y = F.col("w"), F.col("h")
    args = lambda *v: F.array(*([*v] + [F.lit(0.0)] * (6 - len(v))))
    step = lambda op, *v: F.struct(F.lit(op).alias("op"), args(*v).alias("args"))
    path = F.array(step("M", x, y), step("L", x + 1, y), step("C", x, y, x + 2, y, x + 3, y), step("R", x, y, F.lit(10.0), F.lit(20.5)), step("Z"))
    return _boxes(s, d).select("p_partkey", R.svg_path(path, [F.lit(float(v)) for v in (1, 0, 0, 1, 0, 5)]).alias("svg"))


QUERIES = {
    "html_page": lambda s, d: _boxes(s, d).select("p_partkey", R.html_page(F.col("p_partkey"), F.col("w"), F.col("h"), S.insert_nbsp(F.col("p_name"))).alias("html")),
    "html_glyph": _html_glyph,
    "svg_page": lambda s, d: _boxes(s, d).select("p_partkey", R.svg_page(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"), F.lit("")).alias("svg")),
    "svg_path": _svg_path,
}


def _n(x: str) -> str:
    """A number as text; values here have one decimal at most."""
    return f"regexp_replace(({x})::DOUBLE::VARCHAR, '\\.0$', '')"


_BOX = "(SELECT p_partkey, p_name, p_size * 12.0::DOUBLE AS w, p_size * 16.5::DOUBLE AS h FROM part)"
_RUNS = """WITH g AS (SELECT *, row_number() OVER w AS k, coalesce(lag(l_linenumber) OVER w + 1 = l_linenumber, false) AS same FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)),
r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM g),
t AS (SELECT l_orderkey, run, min(l_linenumber) AS x, string_split(string_agg(l_returnflag || CASE WHEN l_quantity > 25 THEN ' ' ELSE '' END, '' ORDER BY k), '') AS cs FROM r GROUP BY ALL)
"""

ORACLES = {
    "html_page": f"""SELECT p_partkey, '<meta charset=''utf-8'' /> <!-- page ' || p_partkey || ' --><div id=''page' || p_partkey || ''' style=''position: relative; height: ' || {_n("h")} || 'px; width: ' || {_n("w")} || 'px; border: 1px black solid''>' || p_name || '</div>' AS html FROM {_BOX}""",
    "html_glyph": _RUNS + """SELECT l_orderkey, run::BIGINT AS run, '<div style=''position: absolute; left: ' || x * 4 || 'px; top: 92px; font-size: 8px''>' ||
  array_to_string([CASE WHEN cs[i] = ' ' AND (i = 1 OR cs[i - 1] = ' ' OR i = len(cs) OR cs[i + 1] = ' ') THEN '&nbsp;' ELSE cs[i] END FOR i IN range(1, len(cs) + 1)], '') || '</div>' || chr(10) AS html FROM t""",
    "svg_page": f"""SELECT p_partkey, '<?xml version="1.0" encoding="UTF-8" ?>' || chr(10) || '<!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 1.1//EN" "http://www.w3.org/Graphics/SVG/1.1/DTD/svg11.dtd"><svg width="' || {_n("w")} || '" height="' || {_n("h")} ||
  '" xmlns="http://www.w3.org/2000/svg" version="1.1" viewBox=''0 0 ' || {_n("w")} || ' ' || {_n("h")} || '''>' || chr(10) || '<g transform=''matrix(1, 0, 0, -1, 0, ' || {_n("h")} || ')''>' || chr(10) || '</g>' || chr(10) || '</svg>' AS svg FROM {_BOX}""",
    "svg_path": f"""SELECT p_partkey, '<g transform=''matrix(1, 0, 0, 1, 0, 5)''><path d=''M' || x || ' ' || y || ' L' || x1 || ' ' || y || ' C' || x || ' ' || y || ' ' || x2 || ' ' || y || ' ' || x3 || ' ' || y ||
  ' M' || x || ' ' || y || ' L' || x10 || ' ' || y || ' L' || x10 || ' ' || y20 || ' L' || x || ' ' || y20 || ' Z Z'' /></g>' || chr(10) AS svg
  FROM (SELECT p_partkey, {_n("w")} AS x, {_n("h")} AS y, {_n("w + 1")} AS x1, {_n("w + 2")} AS x2, {_n("w + 3")} AS x3, {_n("w + 10")} AS x10, {_n("h + 20.5")} AS y20 FROM {_BOX})""",
}
