"""Queries over form fields that arithmetic derives from parts: a supplier-sized group of parts is a form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import forms as M


def fields(s: SparkSession, d: str) -> DataFrame:
    p, k = s.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")
    bits = [1, 2, 1 << 15, 1 << 16, 1 << 17, 1 << 20, 1 << 21]
    ff = F.lit(0)
    for i, b in enumerate(bits):
        ff = ff + F.when(F.shiftright("p_size", i).bitwiseAND(1) == 1, b).otherwise(0)
    words = F.split("p_type", " ")
    return p.select(
        F.floor(k / 20).cast("long").alias("doc_id"),
        k.cast("long").alias("n"),
        F.get(F.array(*map(F.lit, ("Btn", "Ch", "Tx", "Sig"))), (k % 4).cast("int")).alias("ft"),
        F.when(k % 7 != 0, ff).alias("ff"),
        F.when(k % 11 != 0, F.col("p_name")).alias("name"),
        F.when(k % 5 == 0, F.array(F.lit("Yes"))).when(k % 5 == 1, F.array().cast("array<string>")).otherwise(F.slice(words, 1, 2)).alias("values"),
        words.alias("options"),
    )


def _bfs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    nodes = s.read.parquet(f"{d}/part.parquet").select(k.cast("long").alias("node"), F.when(k > 3, F.floor(k / 4)).alias("parent"), (k % 4).alias("at"))
    return M.breadth_first(nodes).select("node", F.col("depth").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


_BITS = " + ".join(f"CASE WHEN (p_size >> {i}) & 1 = 1 THEN {b} ELSE 0 END" for i, b in enumerate([1, 2, 1 << 15, 1 << 16, 1 << 17, 1 << 20, 1 << 21]))
_FIELDS = f"""
f AS (SELECT p_partkey // 20 AS doc_id, p_partkey AS n, ['Btn', 'Ch', 'Tx', 'Sig'][p_partkey % 4 + 1] AS ft, CASE WHEN p_partkey % 7 <> 0 THEN {_BITS} ELSE 0 END AS ff,
  CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN ['Yes'] WHEN p_partkey % 5 = 1 THEN [] ELSE string_split(p_type, ' ')[1:2] END AS vals, string_split(p_type, ' ') AS options FROM part),
t AS (SELECT *, CASE ft WHEN 'Btn' THEN CASE WHEN ff & 98304 <> 0 THEN 'Radio' ELSE 'CheckBox' END WHEN 'Ch' THEN CASE WHEN ff & 131072 <> 0 THEN 'ComboBox' ELSE 'ListBox' END WHEN 'Tx' THEN 'Text' ELSE 'Unknown' END AS type, coalesce(vals[1], '') AS one FROM f),
s AS (SELECT *, CASE type WHEN 'Radio' THEN 'Radio: Selected: ' || one || ', Options: [' || array_to_string(options, ', ') || ']'
  WHEN 'CheckBox' THEN 'CheckBox: Checked: ' || CASE WHEN one = 'Yes' THEN 'true' ELSE 'false' END
  WHEN 'ListBox' THEN 'ListBox: Selected: [' || array_to_string(vals, ', ') || '], Options: [' || array_to_string(options, ', ') || '], Multiselect: ' || CASE WHEN ff & 2097152 <> 0 THEN 'true' ELSE 'false' END
  WHEN 'ComboBox' THEN 'ComboBox: Selected: [' || array_to_string(vals, ', ') || '], Options: [' || array_to_string(options, ', ') || '], Editable: ' || CASE WHEN ff & 1048576 <> 0 THEN 'true' ELSE 'false' END
  WHEN 'Text' THEN one ELSE 'Unknown' END AS state FROM t)
"""

QUERIES = {
    "form_bfs": _bfs,
    "form_type": lambda s, d: M.states(fields(s, d)).select("doc_id", "n", "type"),
    "form_flags": lambda s, d: M.states(fields(s, d)).select("doc_id", "n", "readonly", "required", "multiselect", "editable"),
    "form_state": lambda s, d: M.states(fields(s, d)).select("doc_id", "n", M.described(M.states(fields(s, d))).alias("state"), "is_checked", F.array_join("selected", "|").alias("selected")),
    "form_text": lambda s, d: M.form_text(M.states(fields(s, d))),
}

ORACLES = {
    "form_bfs": """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 3 THEN p_partkey // 4 END AS parent, p_partkey % 4 AS pos FROM part),
      w AS (SELECT node, 0::BIGINT AS depth, pos::VARCHAR AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.node, depth + 1, path || '.' || pos FROM n JOIN w ON n.parent = w.node)
      SELECT * FROM w""",
    "form_type": f"WITH {_FIELDS} SELECT doc_id, n, type FROM t",
    "form_flags": f"""WITH {_FIELDS} SELECT doc_id, n, CASE WHEN type <> 'Unknown' THEN ff & 1 <> 0 END AS readonly, CASE WHEN type <> 'Unknown' THEN ff & 2 <> 0 END AS required,
      CASE WHEN type = 'ListBox' THEN ff & 2097152 <> 0 END AS multiselect, CASE WHEN type = 'ComboBox' THEN ff & 1048576 <> 0 END AS editable FROM t""",
    "form_state": f"WITH {_FIELDS} SELECT doc_id, n, state, CASE WHEN type = 'CheckBox' THEN one = 'Yes' END AS is_checked, CASE WHEN type = 'Radio' THEN one WHEN type IN ('ListBox', 'ComboBox') THEN array_to_string(vals, '|') END AS selected FROM s",
    "form_text": f"WITH {_FIELDS} SELECT doc_id, string_agg(coalesce(name, '') || ': ' || state || ' ' || chr(10), '' ORDER BY n) AS paragraph FROM s GROUP BY doc_id",
}
