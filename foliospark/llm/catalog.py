"""Queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe, decontaminate, licenses, lines, mixing, neardup, neighbours, pii, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_neardup": neardup.op3_neardup,
        "op4_bpe": bpe.op4_bpe,
        "op5_neighbours": neighbours.op5_neighbours,
        "op6_lines": lines.op6_lines,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_warc": warc.op8_warc,
        "op9_licenses": licenses.op9_licenses,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE_SQL, "op6_lines": lines.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL, "op10_pii": pii.ORACLE_SQL}
