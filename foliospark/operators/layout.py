"""Text placement as windows over content-stream operators: each rule of the page interpreter that needs no free state.

Frames carry the columns named in a function; `by` partitions (a text object or a page), `order` orders within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.runtime import table


def _running(by: list[str], order: list) -> tuple:
    w = Window.partitionBy(*by).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w


def td_positions(ops: DataFrame, by: list[str], order: list, height: float = 792.0) -> DataFrame:
    """x, y after each move (tx, ty) of a text object, y from the page's top."""
    upto, _, _ = _running(by, order)
    return ops.withColumn("x", F.sum("tx").over(upto)).withColumn("y", F.lit(height) - F.sum("ty").over(upto))


def string_advance(glyphs: DataFrame, by: list[str], order: list) -> DataFrame:
    """x of each glyph (w0 in thousandths, size, char_spacing, word_spacing, scale, is_space): the sum of the advances
    before it, scale x (w0 x size + spacing)."""
    _, before, _ = _running(by, order)
    spacing = F.col("char_spacing") + F.when(F.col("is_space"), F.col("word_spacing")).otherwise(0.0)
    tx = F.col("scale") * (F.col("w0") / 1000 * F.col("size") + spacing)
    return glyphs.withColumn("advance", tx).withColumn("x", F.coalesce(F.sum(tx).over(before), F.lit(0.0)))


def adjustment(n: Column, size: Column, scale: Column) -> Column:
    """What a number in a shown array moves the text by."""
    return scale * (0 - n / 1000) * size


def transformed_size(a: Column, b: Column, c: Column, d: Column, size: Column) -> Column:
    """The side of the square as large as the transformed size; NaN for turned text; to two decimals."""
    area = (a + c) * (b + d)
    return F.when(area < 0, float("nan")).otherwise(F.round(F.abs(size) * F.sqrt(F.greatest(area, F.lit(0.0))) * 100) / 100)


def gap(x: Column, y: Column, last_end: Column, last_y: Column, size: Column, sideways: str = "\n") -> Column:
    """What comes before a string's first glyph. sideways: for text further left on another line."""
    known = ~F.isnan(size)
    dy = F.abs(y - last_y)
    return F.concat(
        F.when(known & (dy > 1.5 * size), "\n").otherwise(""),
        F.when(known & ~F.isnan(last_end) & (x < last_end) & (dy > 0.5 * size), sideways).otherwise(""),
        F.when(known & ~F.isnan(last_end) & (x > last_end + 0.1 * size), " ").otherwise(""),
    )


def gap_tokens(strings: DataFrame, by: list[str], order: list, sideways: str = "\n") -> DataFrame:
    """strings (x, y, end, size) with the gap before each; a page starts far right at its top."""
    _, _, w = _running(by, order)
    return strings.withColumn("gap", gap(F.col("x"), F.col("y"), F.lag("end", 1, 100000.0).over(w), F.lag("y", 1, 0.0).over(w), F.col("size"), sideways))


def size_islands(glyphs: DataFrame, by: list[str], order: list) -> DataFrame:
    """glyphs with the number of the run of equal sizes that each is in; NaN sizes belong to the run before."""
    upto, before, _ = _running(by, order)
    size = F.when(~F.isnan("size"), F.col("size"))
    last = F.last(size, ignorenulls=True).over(before)
    starts = F.when(size.isNotNull() & (last.isNull() | (size != last)), 1).otherwise(0)
    return glyphs.withColumn("starts", starts).withColumn("island", F.sum("starts").over(upto)).drop("starts")


def visible(x: Column, y: Column, r: Column, g: Column, b: Column, box: tuple[float, float, float, float] = (0, 0, 612, 792)) -> Column:
    """Inside the media box, edges included, and not close to white."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3]) & ~((r > 0.9) & (g > 0.9) & (b > 0.9))


def visible_text(ops: DataFrame, by: list[str], order: list) -> DataFrame:
    """ops (x, y, gray: set by a colour operator or null) with the colour in force and whether text shows."""
    upto, _, _ = _running(by, order)
    color = F.coalesce(F.last("gray", ignorenulls=True).over(upto), F.lit(0.0))
    return ops.withColumn("color", color).withColumn("visible", visible(F.col("x"), F.col("y"), F.col("color"), F.col("color"), F.col("color")))


def depth(ops: DataFrame, by: list[str], order: list) -> DataFrame:
    """ops (step: 1 to push, -1 to pop) with the stack's depth after each; popping an empty stack changes nothing.

    The depth is the running sum less its least value so far, where that is below zero."""
    upto, _, _ = _running(by, order)
    total = F.sum("step").over(upto)
    summed = ops.withColumn("__sum", total)
    return summed.withColumn("depth", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(upto))).drop("__sum")


def inherited(nodes: DataFrame) -> DataFrame:
    """node, value of nodes (node, parent, value): the nearest value up the parents, by pointer doubling: as many
    rounds as the logarithm of the depth. A cycle without a value leaves null: no chain needs more rounds than the
    logarithm of the number of nodes."""
    state = table(nodes.select("node", "parent", "value"), "inherited")
    for _ in range(state.count().bit_length()):
        if state.where("value is null and parent is not null").isEmpty():
            break
        up = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"), F.col("value").alias("above"))
        joined = state.join(up, "parent", "left")
        state = table(joined.select("node", F.when(F.coalesce("value", "above").isNull(), F.col("grand")).alias("parent"), F.coalesce("value", "above").alias("value")), "inherited")
    return state.select("node", "value")
