"""From text segments to heading-aware chunks: statistics, levels, assembly. All native.

Segments: doc_id, page_num, seg_no, content, font_name, font_size, transformed_font_size, is_bold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import strings as S

#: A chunk's paragraph is longer than this many bytes; sizes this near count as equal; headings are this much larger.
PARAGRAPH, NEAR, LARGER, MOST_LEVELS = 35, 0.1, 1.1, 6


def size_histogram(segments: DataFrame, size: str) -> DataFrame:
    """Bytes of text by document, font and size."""
    return segments.groupBy("doc_id", "font_name", size).agg(F.sum(F.octet_length("content")).cast("long").alias("chars"))


def rounded_mode(values: DataFrame, by: str, value: str) -> DataFrame:
    """The commonest value to two decimals, the smallest of equals."""
    counted = values.groupBy(by, (F.round(F.col(value) * 100) / 100).alias("v")).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("mode"))


def doc_stats(segments: DataFrame) -> DataFrame:
    """doc_id, body_font, body_transformed_size, thresholds. The body is what most bytes are set in; of equals the
    smaller size, then the first font. Thresholds are the larger sizes, largest first, thinned to MOST_LEVELS."""
    by_doc = size_histogram(segments, "transformed_font_size").groupBy("doc_id")
    body = by_doc.agg(
        F.min_by(F.struct(F.col("font_name").alias("font"), F.col("transformed_font_size").alias("size")), F.struct(-F.col("chars"), "transformed_font_size", "font_name")).alias("body"),
        F.sort_array(F.collect_set("transformed_font_size"), asc=False).alias("sizes"),
    )
    sizes = F.filter("sizes", lambda s: s > F.col("body.size") * LARGER)
    step = F.floor(F.size(sizes) / MOST_LEVELS).cast("int")
    thinned = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(MOST_LEVELS - 1)), lambda i: F.get(sizes, i * step)))
    thresholds = F.when(F.size(sizes) <= MOST_LEVELS, sizes).otherwise(thinned)
    return body.select("doc_id", F.col("body.font").alias("body_font"), F.col("body.size").alias("body_transformed_size"), thresholds.alias("thresholds"))


def can_head(content: Column) -> Column:
    short = S.trim(content)
    return (S.word_count(content) < 10) & S.starts_alphanumeric(short) & ((F.octet_length(short) >= 4) | S.parses_u32(short) | S.is_roman(short))


def level(content: Column, font: Column, size: Column, bold: Column, body_font: Column, body_size: Column, thresholds: Column) -> Column:
    """H1 to H7, Body or SubBody. The order of the cases matters where sizes differ by less than NEAR."""
    near = F.abs(size - body_size) < NEAR
    plain = F.when(bold & can_head(content), "H7").otherwise("Body")
    distance = F.transform(thresholds, lambda t: F.abs(t - size))
    nearest = F.array_position(distance, F.array_min(distance))
    ranked = F.when(F.size(thresholds) == 0, "Body").otherwise(F.concat(F.lit("H"), F.least(nearest, F.lit(6)).cast("string")))
    return F.when((font == body_font) & near, plain).when(size < body_size, "SubBody").when(near, plain).when(can_head(content), ranked).otherwise("Body")


def classify(segments: DataFrame, stats: DataFrame) -> DataFrame:
    """segments with their levels. Statistics are a row a document, so the join is by doc_id, as both sides are."""
    joined = segments.join(stats, "doc_id")
    return joined.withColumn("level", level(*(F.col(c) for c in ("content", "font_name", "transformed_font_size", "is_bold", "body_font", "body_transformed_size", "thresholds"))))


def assemble(levels: DataFrame) -> DataFrame:
    """doc_id, chunk_no, headings, paragraph, page: a fold over each document's segments in order.

    A heading closes a paragraph of more than PARAGRAPH bytes, which gets the heading's page, and takes its place in
    the headings, clearing those below it but for the seventh; after a shorter paragraph it is appended to its place.
    What is left at the end has the page of its last text.
    """
    rows = levels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "seg_no", "level", "content"))).alias("rows"))
    chunk = "struct<headings:array<string>,paragraph:string,page:int>"
    zero = F.struct(F.array_repeat(F.lit(""), 7).alias("slots"), F.lit("").alias("text"), F.lit(0).alias("page"), F.expr(f"cast(array() as array<{chunk}>)").alias("out"))
    filled = lambda slots: F.filter(slots, lambda s: s != "")

    def emit(acc: Column, paragraph: Column, page: Column) -> Column:
        made = F.struct(filled(acc["slots"]).alias("headings"), paragraph.alias("paragraph"), page.cast("int").alias("page"))
        return F.concat(acc["out"], F.array(made))

    def step(acc: Column, r: Column) -> Column:
        content = S.trim(r["content"])
        at = F.substring(r["level"], 2, 1).try_cast("int")
        full = F.octet_length(S.trim(acc["text"])) > PARAGRAPH
        taken = F.transform(acc["slots"], lambda s, i: F.when(i + 1 == at, content).when((i + 1 > at) & (i < 6), "").otherwise(s))
        added = F.transform(acc["slots"], lambda s, i: F.when(i + 1 == at, F.concat(s, F.lit(" "), content)).otherwise(s))
        head = r["level"].startswith("H")
        return F.struct(
            F.when(~head, acc["slots"]).when(full, taken).otherwise(added).alias("slots"),
            F.when(head & full, "").when(head, acc["text"]).when(acc["text"] == "", r["content"]).otherwise(F.concat(acc["text"], F.lit(" "), r["content"])).alias("text"),
            F.when(head, acc["page"]).otherwise(r["page_num"]).cast("int").alias("page"),
            F.when(head & full, emit(acc, S.collapse(acc["text"]), r["page_num"])).otherwise(acc["out"]).alias("out"),
        )

    last = lambda acc: F.when(acc["text"] != "", emit(acc, S.trim(acc["text"]), acc["page"])).otherwise(acc["out"])
    folded = rows.select("doc_id", F.aggregate("rows", zero, step, last).alias("chunks"))
    return folded.select("doc_id", F.posexplode("chunks").alias("n", "c")).select("doc_id", (F.col("n") + 1).cast("int").alias("chunk_no"), "c.headings", "c.paragraph", "c.page")


def with_forms(chunks: DataFrame, forms: DataFrame) -> DataFrame:
    """Chunks after the documents' form texts (doc_id, paragraph), which come first, without headings, as page 0."""
    first = forms.select("doc_id", F.lit(0).alias("chunk_no"), F.expr("cast(array() as array<string>)").alias("headings"), "paragraph", F.lit(0).alias("page"))
    return chunks.unionByName(first)
