"""Queries over PDF files that a writer makes of documents: a line a string, 50 lines a page, Helvetica."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import strings as S
from foliospark.sources import pdf
from foliospark.sources.runtime import plan_bytes, ship

#: Texts of a task, in bytes of files.
TASK_BYTES = 8 << 20


def files(s: SparkSession, d: str) -> DataFrame:
    ship(s)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from foliospark.pdf.writer import from_text

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([from_text(t or "", title=f"document {i}") for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.binary())], names=["path", "content"])

    # interpreting costs far more than moving texts, so they are dealt evenly whatever the table's files are
    texts = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    texts = texts.repartition(max(s.sparkContext.defaultParallelism, plan_bytes(texts) // TASK_BYTES))
    return texts.mapInArrow(write, "path long, content binary")


def _parsed(s: SparkSession, d: str, what: str) -> DataFrame:
    return pdf.good(pdf.parse(files(s, d), what)).withColumn("doc_id", F.col("doc_id").cast("long"))


def _joined(rows: DataFrame, text: str, order: str) -> DataFrame:
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return rows.groupBy("doc_id").agg(F.sha2(S.collapse(whole), 256).alias("sha256"))


def _plain(s: SparkSession, d: str) -> DataFrame:
    out = pdf.extract_text(files(s, d)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return _joined(out, "text", "page_num")


def _segments(s: SparkSession, d: str) -> DataFrame:
    rows = _parsed(s, d, "segments")
    return rows.select("doc_id", "page_num", F.sha2(S.collapse(F.col("content")), 256).alias("sha256"), "transformed_font_size", "x", "cutat")


QUERIES = {
    "src_roundtrip": lambda s, d: _joined(_parsed(s, d, "segments"), "content", "page_num"),
    "page_count": lambda s, d: _parsed(s, d, "pages").groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("urx").alias("width")),
    "doc_info": lambda s, d: _parsed(s, d, "info").select("doc_id", "version", F.col("info")["Title"].alias("title"), F.col("page_count").cast("long").alias("pages")),
    "segments_roundtrip": _segments,
    "plain_text": _plain,
    "op_histogram": lambda s, d: _parsed(s, d, "ops").groupBy("op").agg(F.sum("n").alias("n")),
}

_TEXT = "sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sha256"
_PAGES = "(len(string_split(text, chr(10))) + 49) // 50"

ORACLES = {
    "src_roundtrip": f"SELECT doc_id, {_TEXT} FROM documents",
    "page_count": f"SELECT doc_id, {_PAGES} AS pages, 612.0::DOUBLE AS width FROM documents",
    "doc_info": f"SELECT doc_id, '1.4' AS version, 'document ' || doc_id AS title, {_PAGES} AS pages FROM documents",
    "segments_roundtrip": """SELECT doc_id, (p + 1)::INT AS page_num, sha256(trim(regexp_replace(array_to_string(ls[p * 50 + 1:p * 50 + 50], ' '), '\\s+', ' ', 'g'))) AS sha256, 12.0::DOUBLE AS transformed_font_size, 72.0::DOUBLE AS x, 'final' AS cutat
      FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) + 49) // 50)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
    "plain_text": f"SELECT doc_id, {_TEXT} FROM documents",
    "op_histogram": f"""WITH n AS (SELECT sum(len(string_split(text, chr(10))))::BIGINT AS l, sum({_PAGES})::BIGINT AS p FROM documents)
      SELECT op, CASE WHEN op IN ('Tj', 'Td') THEN l ELSE p END AS n FROM n, (VALUES ('BT'), ('ET'), ('Tf'), ('Td'), ('Tj')) v(op)""",
}
