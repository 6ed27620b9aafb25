"""A training corpus in five stages; each is written as Parquet before the next reads it.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, decontaminate, lines, neardup, toxicity
from foliospark.sources.runtime import drop_scratch, remove, scratch_path

TOXIC = 0.5
#: What the operators leave in the shared folder; a stage deletes that of the stages before it, whose output is written.
TAGS = ("pipe-lines", "pipe-neardup")
#: Text of the last stage's blocks: small ones, as the executors' heaps have grown in the stages before.
BLOCK_BYTES = 8 << 20


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _clear(spark: SparkSession) -> None:
    for tag in TAGS:
        drop_scratch(spark, tag)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of score TOXIC and more, a tie at it too, go. The model learns from the labels that op7 learns from.
    Null and empty texts have the score of the model's bias; rows are scored one by one, however long; an empty table stays
    empty; other columns are let be."""
    _clear(spark)
    model = toxicity.fit_tables(spark, docs.select("doc_id", "text"), sf_dir)
    into = free_name(docs, "toxic")
    return toxicity.score(docs, model, into=into).where(F.col(into) < TOXIC).drop(into)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines of lines.LEAST characters and more go from texts: shorter ones recur by chance in
    texts that copy nothing. Documents go of which that leaves only white space, as they were nothing but repeats.
    Of equal lines the first stays, by doc_id and place; null texts stay, null ids come last; repeated rows lose the
    same lines; an empty table stays empty; other columns are let be."""
    _clear(spark)
    out = lines.dedup(docs, floor=lines.LEAST, tag="pipe-lines")
    if "n_chars" in docs.columns:
        kept = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("removed_lines") > 0, kept).otherwise(F.col("n_chars")))
    return out.where((F.size("removed_lines") == 0) | (F.length(F.regexp_replace("text", r"\s+", "")) > 0)).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike at 0.8 or more, directly or by others, the smallest id stays.
    Documents without words and rows without an id stay; rows of one id stay or go together; an empty table stays empty;
    other columns are let be."""
    _clear(spark)
    return neardup.dedup(docs, tag="pipe-neardup").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more, a tie at it too, stands in benchmark passages go. Documents without
    words stay; rows are judged one by one, however long; an empty table, of documents or of items, leaves all as is."""
    _clear(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' and decoded texts' digests by doc_id, a row each; a null text counts as an empty one."""
    _clear(spark)
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), bpe.default_tokenizer(), block_bytes=BLOCK_BYTES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A learnt model takes part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}", "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    _clear(spark)
    return docs
