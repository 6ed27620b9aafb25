"""HTML, SVG and plain text of positioned glyphs and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import strings as S
from foliospark.operators import layout


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def html_page(page: Column, width: Column, height: Column, body: Column) -> Column:
    number = S.number
    return _text("<meta charset='utf-8' /> <!-- page ", page.cast("string"), " --><div id='page", page.cast("string"), "' style='position: relative; height: ", number(height), "px; width: ", number(width), "px; border: 1px black solid'>", body, "</div>")


def html_runs(glyphs: DataFrame, by: list[str], order: list, near: float = 1e-6) -> DataFrame:
    """glyphs (x, y, a, b, c, d, w0 as a part of the size, spacing, size, text) with the run that each is in: a glyph
    goes on with a run if it stands where the one before ended, in the same matrix, within `near`."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.lag(F.col("w0") * F.col("size") + F.col("spacing")).over(w)
    before = {c: F.lag(c).over(w) for c in "abcd"}
    same = F.lit(True)
    for c in "abcd":
        same = same & (F.abs(F.col(c) - before[c]) <= near)
    follows = same & (F.abs(F.col("x") - (F.lag("x").over(w) + step * before["a"])) <= near) & (F.abs(F.col("y") - (F.lag("y").over(w) + step * before["b"])) <= near)
    return glyphs.withColumn("__new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def html_div(x: Column, y: Column, size: Column, text: Column) -> Column:
    return _text("<div style='position: absolute; left: ", S.number(x), "px; top: ", S.number(y), "px; font-size: ", S.number(size), "px'>", S.insert_nbsp(text), "</div>\n")


def svg_page(llx: Column, lly: Column, urx: Column, ury: Column, body: Column, art: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """A page of the media box's size, or of the art box's where there is one."""
    x, y, width, height = llx, lly, urx - llx, ury - lly
    if art:
        x, width, height = art[0], art[2] - art[0], art[3] - art[1]
        y = ury - art[1] - height
    n = S.number
    return _text(
        '<?xml version="1.0" encoding="UTF-8" ?>\n<!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 1.1//EN" "http://www.w3.org/Graphics/SVG/1.1/DTD/svg11.dtd"><svg width="', n(width), '" height="', n(height),
        "\" xmlns=\"http://www.w3.org/2000/svg\" version=\"1.1\" viewBox='", n(x), " ", n(y), " ", n(width), " ", n(height), "'>\n<g transform='matrix(1, 0, 0, -1, 0, ", n(ury), ")'>\n", body, "</g>\n</svg>",
    )


def svg_path(ops: Column, matrix: list[Column]) -> Column:
    """A filled path of ops: an array of structs (op, args)."""
    n = S.number

    def one(o: Column) -> Column:
        a = [n(o["args"][i]) for i in range(6)]
        x, y, w, h = (o["args"][i] for i in range(4))
        return (
            F.when(o["op"].isin("M", "L"), _text(o["op"], a[0], " ", a[1]))
            .when(o["op"] == "C", _text("C", a[0], " ", a[1], " ", a[2], " ", a[3], " ", a[4], " ", a[5]))
            .when(o["op"] == "R", _text("M", n(x), " ", n(y), " L", n(x + w), " ", n(y), " L", n(x + w), " ", n(y + h), " L", n(x), " ", n(y + h), " Z"))
            .otherwise("Z")
        )

    parts: list[Column | str] = []
    for i, m in enumerate(matrix):
        parts += ([", "] if i else []) + [n(m)]
    return _text("<g transform='matrix(", *parts, ")'><path d='", F.array_join(F.transform(ops, one), " "), "' /></g>\n")


def plain_text(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_num, text of glyphs (op_no, glyph_no, text, x, y, w0, size): a string's first glyph may be parted
    from what came before by line feeds and spaces. y is from the page's top."""
    w = Window.partitionBy("doc_id", "page_num").orderBy("op_no", "glyph_no")
    token = layout.gap(F.col("x"), F.col("y"), F.lag(F.col("x") + F.col("w0") * F.col("size"), 1, 100000.0).over(w), F.lag("y", 1, 0.0).over(w), F.col("size"), " ")
    marked = glyphs.withColumn("out", F.concat(F.when(F.col("glyph_no") == 0, token).otherwise(""), "text"))
    ordered = F.array_sort(F.collect_list(F.struct("op_no", "glyph_no", "out")))
    return marked.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(ordered, lambda x: x["out"]), "").alias("text"))
