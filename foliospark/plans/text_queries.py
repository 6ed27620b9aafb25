"""Queries over content-stream operators that arithmetic derives from order lines: an order is a text object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import layout as L

BY = ["l_orderkey"]
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
KEYS = [*BY, *ORDER]
_W = "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_UP, _BEFORE = f"{_W} ROWS UNBOUNDED PRECEDING)", f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_SIZE = "(10.0 + l_linenumber % 3)::DOUBLE"


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*KEYS, "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _td(s: SparkSession, d: str) -> DataFrame:
    moves = ops(s, d).withColumn("tx", F.col("l_quantity")).withColumn("ty", -F.col("l_linenumber").cast("double"))
    return L.td_positions(moves, BY, ORDER).select(*KEYS[:4], "x", "y")


def _advance(s: SparkSession, d: str) -> DataFrame:
    glyphs = ops(s, d).select(*KEYS, (F.col("l_quantity") * 16).alias("w0"), F.lit(125.0).alias("size"), F.lit(0.25).alias("char_spacing"), F.lit(0.5).alias("word_spacing"), F.lit(1.0).alias("scale"), (F.col("l_returnflag") == "N").alias("is_space"))
    return L.string_advance(glyphs, BY, ORDER).select(*KEYS[:4], "advance", "x")


def _transformed(s: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    turned = F.col("l_returnflag") == "R"
    one = F.lit(1.0)
    size = L.transformed_size(F.when(turned, 0.0).otherwise(one), F.when(turned, one).otherwise(0.0), F.when(turned, -one).otherwise(0.0), F.when(turned, 0.0).otherwise(n), q)
    return ops(s, d).select(*KEYS[:4], F.coalesce(F.when(~F.isnan(size), size), F.lit(-1.0)).alias("tsize"))


def _strings(s: SparkSession, d: str) -> DataFrame:
    x = F.col("l_quantity") * 10
    return ops(s, d).select(*KEYS, x.alias("x"), (F.col("l_linenumber") * 7.0).alias("y"), (x + 40).alias("end"), (F.lit(10.0) + F.col("l_linenumber") % 3).cast("double").alias("size"))


def _gaps(s: SparkSession, d: str) -> DataFrame:
    return L.gap_tokens(_strings(s, d), BY, ORDER).select(*KEYS[:4], F.translate("gap", "\n ", "NS").alias("gap"))


def _islands(s: SparkSession, d: str) -> DataFrame:
    glyphs = ops(s, d).withColumn("size", F.when(F.col("l_returnflag") == "R", float("nan")).otherwise(F.lit(10.0) + F.floor(F.col("l_quantity") / 20)))
    return L.size_islands(glyphs, BY, ORDER).select(*KEYS[:4], F.col("island").cast("long").alias("island"))


def _visible(s: SparkSession, d: str) -> DataFrame:
    moves = ops(s, d).select(*KEYS, (F.col("l_quantity") * 14).alias("x"), (F.col("l_linenumber") * 120.0).alias("y"), F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.5).alias("gray"))
    return L.visible_text(moves, BY, ORDER).select(*KEYS[:4], "color", "visible")


def _depth(s: SparkSession, d: str) -> DataFrame:
    steps = ops(s, d).withColumn("step", F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0))
    return L.depth(steps, BY, ORDER).select(*KEYS[:4], F.col("depth").cast("long").alias("depth"))


def _inherited(s: SparkSession, d: str) -> DataFrame:
    parts = s.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey")
    nodes = parts.select(key.cast("long").alias("node"), F.when(key > 1, F.floor(key / 3)).alias("parent"), F.when(key % 5 == 1, F.col("p_size").cast("long")).alias("value"))
    return L.inherited(nodes).select("node", F.coalesce("value", F.lit(-1)).alias("value"))


QUERIES = {
    "td_positions": _td,
    "tj_advance": lambda s, d: ops(s, d).select(*KEYS[:4], L.adjustment(F.col("l_quantity") * 125, F.lit(8.0), F.lit(0.5)).alias("tx")),
    "string_advance": _advance,
    "transformed_size": _transformed,
    "gap_tokens": _gaps,
    "size_islands": _islands,
    "visible_text": _visible,
    "gs_depth": _depth,
    "inherited_attr": _inherited,
}

ORACLES = {
    "td_positions": f"SELECT {_K}, sum(l_quantity) {_UP} AS x, 792 + sum(l_linenumber) {_UP}::DOUBLE AS y FROM lineitem",
    "tj_advance": f"SELECT {_K}, -0.5 * l_quantity * 125 / 1000 * 8 AS tx FROM lineitem",
    "string_advance": f"SELECT *, 0 AS zero FROM (SELECT {_K}, t AS advance, coalesce(sum(t) {_BEFORE}, 0) AS x FROM (SELECT *, l_quantity * 16 / 1000 * 125 + 0.25 + CASE WHEN l_returnflag = 'N' THEN 0.5 ELSE 0 END AS t FROM lineitem))",
    "transformed_size": f"SELECT {_K}, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE round(l_quantity * sqrt(l_linenumber) * 100) / 100 END AS tsize FROM lineitem",
    "gap_tokens": f"""SELECT {_K}, CASE WHEN abs(y - ly) > 1.5 * s THEN 'N' ELSE '' END || CASE WHEN x < le AND abs(y - ly) > 0.5 * s THEN 'N' ELSE '' END || CASE WHEN x > le + 0.1 * s THEN 'S' ELSE '' END AS gap
      FROM (SELECT *, lag(x + 40, 1, 100000) {_W}) AS le, lag(y, 1, 0) {_W}) AS ly FROM (SELECT *, l_quantity * 10 AS x, l_linenumber * 7.0::DOUBLE AS y, {_SIZE} AS s FROM lineitem))""",
    "size_islands": f"""SELECT {_K}, sum(CASE WHEN s IS NOT NULL AND (p IS NULL OR p <> s) THEN 1 ELSE 0 END) {_UP}::BIGINT AS island
      FROM (SELECT *, last_value(s IGNORE NULLS) {_BEFORE} AS p FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN 10 + floor(l_quantity / 20) END AS s FROM lineitem))""",
    "visible_text": f"""SELECT {_K}, c AS color, l_quantity * 14 <= 612 AND l_linenumber * 120 <= 792 AND c <= 0.9 AS visible
      FROM (SELECT *, coalesce(last_value(g IGNORE NULLS) {_UP}, 0.0) AS c FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.5 END AS g FROM lineitem))""",
    "gs_depth": f"""SELECT {_K}, (s - least(0, min(s) {_UP}))::BIGINT AS depth FROM (SELECT *, sum(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) {_UP} AS s FROM lineitem)""",
    "inherited_attr": """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 3 END AS parent, CASE WHEN p_partkey % 5 = 1 THEN p_size::BIGINT END AS value FROM part),
      up AS (SELECT node, parent, value FROM n UNION ALL SELECT up.node, n.parent, n.value FROM up JOIN n ON up.parent = n.node WHERE up.value IS NULL)
      SELECT node, coalesce(max(value), -1) AS value FROM up GROUP BY node""",
}
ORACLES["string_advance"] = ORACLES["string_advance"].replace("SELECT *, 0 AS zero FROM (", "SELECT * FROM (")
