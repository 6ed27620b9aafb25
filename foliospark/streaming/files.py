"""A folder of PDF files as a stream: each file is parsed once, as it arrives. The kernel keeps no state, so the stream
is append-only and restarts from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.sources import pdf

FILE = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str, what: str = "segments", files_a_trigger: int = 64, **options) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_a_trigger).load(path)
    return pdf.parse(files, what, **options)
