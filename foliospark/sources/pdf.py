"""PDF files as tables. A kernel over Arrow batches interprets pages; what is wrong with a file becomes a row of errors.

`what` picks the columns: segments, text, glyphs, paths, pages, fonts, info, ops or fields. Files are (path, content) rows: of
spark.read.format("binaryFile"), of a stream of it, or of any frame with a binary column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import tables
from foliospark.operators import forms, render
from foliospark.operators import segments as G
from foliospark.sources.runtime import ship, table

#: Files of an Arrow batch: rows carry whole files.
FILES_A_BATCH = 16

_COMMON = "doc_id string, status string, error_class string, error string"
SCHEMAS = {
    "segments": f"{_COMMON}, page_num int, seg_no int, content string, font_name string, font_size double, transformed_font_size double, x double, y double, is_bold boolean, cutat string",
    "text": f"{_COMMON}, page_num int, text string",
    "glyphs": f"{_COMMON}, page_num int, op_no int, glyph_no int, text string, w0 double, spacing double, size double, a double, b double, c double, d double, e double, f double, x double, y double, visible boolean",
    "paths": f"{_COMMON}, page_num int, op_no int, painted string, space string, tint array<double>, width double, a double, b double, c double, d double, e double, f double, ops array<struct<op:string;args:array<double>>>",
    "pages": f"{_COMMON}, page_num int, llx double, lly double, urx double, ury double, art_llx double, art_lly double, art_urx double, art_ury double",
    "fonts": f"{_COMMON}, page_num int, resource string, type string, subtype string, base_font string, name string, encoding string, descriptor string, widths array<double>",
    "info": f"{_COMMON}, version string, info map<string,string>, page_count int",
    "ops": f"{_COMMON}, page_num int, op string, n long",
    "fields": f"{_COMMON}, n int, ft string, ff int, name string, values array<string>, options array<string>",
}


def _text(raw) -> str | None:
    from foliospark.functions import tables

    if not isinstance(raw, bytes):
        return str(raw) if raw is not None else None
    if len(raw) > 2 and raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    table = tables.encoding("PDFDocEncoding")
    return "".join(chr(table[b]) for b in raw)


def _fields(doc) -> Iterator[tuple]:
    """Nodes of the form that have a type themselves, by levels."""
    catalog = doc.dict(doc.trailer.get("Root"))
    if "AcroForm" not in catalog:
        return
    queue, seen, n = list(doc.get(doc.dict(catalog["AcroForm"]).get("Fields")) or []), set(), 0
    while queue:
        ref = queue.pop(0)
        if ref in seen:
            continue
        seen.add(ref)
        f = doc.dict(ref)
        if "FT" in f:
            value, options = doc.get(f.get("V")), doc.get(f.get("Opt")) or []
            values = [_text(doc.get(v)) for v in value if isinstance(doc.get(v), bytes)] if isinstance(value, list) else [] if value is None else [_text(value)]
            choices = [_text(x) if isinstance(x, bytes) else _text(doc.get(x[1])) for o in options if isinstance(x := doc.get(o), bytes) or isinstance(x, list) and len(x) > 1]
            ff = doc.get(f.get("Ff"))
            yield n, str(doc.get(f["FT"])), ff if isinstance(ff, int) else 0, _text(doc.get(f.get("T"))), values, choices
            n += 1
        queue += doc.get(f.get("Kids")) or []


def _fonts(doc, resources) -> Iterator[tuple]:
    """What a page's fonts say of themselves."""
    named = lambda x: str(x) if x is not None and not isinstance(x, dict) else None
    for resource, ref in sorted(doc.dict(doc.dict(resources).get("Font") or {}).items()):
        f = doc.dict(ref)
        get = lambda key: doc.get(f.get(key))  # noqa: B023, E731
        encoding, widths, descriptor = get("Encoding"), get("Widths"), get("FontDescriptor")
        encoding = doc.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        numbers = [float(v) for w in widths if isinstance(v := doc.get(w), (int, float))] if isinstance(widths, list) else None
        name = doc.get(descriptor.get("FontName")) if isinstance(descriptor, dict) else None
        yield str(resource), named(get("Type")), named(get("Subtype")), named(get("BaseFont")), named(get("Name")), named(encoding), named(name), numbers


def _rows(data: bytes, what: str, password: bytes, wanted: tuple[int, int] | None, mode: str, names: dict[str, int] | None = None) -> Iterator[tuple]:
    for _, row in _views(data, (what,), password, wanted, mode, names):
        yield row


def _views(data: bytes, whats: tuple[str, ...], password: bytes, wanted: tuple[int, int] | None, mode: str, names: dict[str, int] | None = None) -> Iterator[tuple[str, tuple]]:
    """Rows of one view or several, each with its view's name. A file is read once, a page interpreted once."""
    from foliospark.pdf.interpreter import Interpreter, Page
    from foliospark.pdf.objects import Document, PdfError

    doc = Document(data, password)
    if "fields" in whats:
        yield from (("fields", r) for r in _fields(doc))
    if whats == ("fields",):
        return
    pages = doc.pages()
    if "info" in whats:
        info = doc.get(doc.trailer.get("Info")) if "Info" in doc.trailer else None
        version = data[data.find(b"%PDF-") + 5 :][:3].decode("latin-1")
        yield "info", (version, [(k, _text(doc.get(v))) for k, v in (info or {}).items() if isinstance(doc.get(v), bytes)], len(pages))
    drawn = set(whats) & {"segments", "ops", "paths", "glyphs", "text"}
    if not drawn and not set(whats) & {"pages", "fonts"}:
        return
    fonts: dict = {}
    for num, page in enumerate(pages, 1):
        if wanted and not wanted[0] <= num <= wanted[1]:
            continue
        box = doc.get(page.get("MediaBox"))
        if not isinstance(box, list) or len(box) < 4:
            raise PdfError("MediaBox", f"page {num} has no media box")
        out = Page(tuple(float(doc.get(v)) for v in box[:4]), num)
        if "pages" in whats:
            art = doc.get(page.get("ArtBox"))
            corners = [float(doc.get(v)) for v in art[:4]] if isinstance(art, list) and len(art) >= 4 else [None] * 4
            yield "pages", (num, *out.box, *corners)
        resources = doc.get(page.get("Resources"))
        resources = resources if isinstance(resources, dict) else {}
        if "fonts" in whats:
            yield from (("fonts", (num, *r)) for r in _fonts(doc, resources))
        if not drawn:
            continue
        Interpreter(doc, out, mode, bool(drawn & {"glyphs", "paths"}), fonts, names, "text" in drawn).run(doc.content(page), resources)
        if "segments" in drawn:
            for n, s in enumerate(out.segments):
                yield "segments", (num, n, *(s[k] for k in ("content", "font_name", "font_size", "transformed_font_size", "x", "y", "is_bold", "cutat")))
        if "text" in drawn:
            yield "text", (num, "".join(out.plain))
        if "ops" in drawn:
            yield from (("ops", (num, op, n)) for op, n in sorted(out.counts.items()) if op)
        if "paths" in drawn:
            yield from (("paths", (num, *p[:-1], [{"op": op, "args": v} for op, v in p[-1]])) for p in out.paths)
        if "glyphs" in drawn:
            yield from (("glyphs", (num, *g)) for g in out.glyphs)


def kernel(what: str, password: str | None = None, pages: tuple[int, int] | None = None, mode: str = "PERMISSIVE", compat: str = "compat", names: dict[str, int] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches (doc_id, content)."""
    width = SCHEMAS[what].count(",") + 1 - 4 - (what == "info")
    secret = (password or "").encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(what)
        for b in batches:
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    rows = [(doc_id, "ok", None, None, *r) for r in _rows(content.as_py() or b"", what, secret, pages, compat, names)]
                except Exception as e:  # noqa: BLE001  a file may be broken in any way; what broke is reported
                    if mode == "FAILFAST":
                        raise
                    if mode == "PERMISSIVE":
                        rows = [(doc_id, "error", getattr(e, "kind", type(e).__name__), str(e), *[None] * width)]
                    else:
                        rows = []
                for at in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 50_000], strict=True), schema, strict=True)], schema=schema)

    return run


def _arrow(what: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<struct<op:string;args:array<double>>>": pa.list_(pa.struct([("op", pa.string()), ("args", pa.list_(pa.float64()))])), "map<string;string>": pa.map_(pa.string(), pa.string())}
    fields = [f.split(" ") for f in SCHEMAS[what].replace("map<string,string>", "map<string;string>").split(", ")]
    return pa.schema([(n, kinds[k]) for n, k in fields])


def _glyph_list(spark: SparkSession, path: str | None) -> dict[str, int] | None:
    """The built-in glyph names and those of a file of `name;hex` lines, wherever Spark reads it: some thousands."""
    if path is None:
        return None
    out = dict(tables.glyph_names())
    for r in spark.read.text(path).where("value not like '#%' and value like '%;%'").collect():
        name, _, code = r["value"].strip().partition(";")
        out.setdefault(name, int(code.split()[-1], 16))
    return out


def parse(files: DataFrame, what: str = "segments", *, doc_id: str = "path", content: str = "content", password: str | None = None, pages: tuple[int, int] | None = None, mode: str = "PERMISSIVE", compat: str = "compat", glyph_list: str | None = None) -> DataFrame:
    """Files to rows of SCHEMAS[what]. pages: first and last page to take, found before anything is interpreted. mode:
    PERMISSIVE makes a broken file a row of status error, DROPMALFORMED leaves it out, FAILFAST fails. glyph_list: path
    of a file of further glyph names, `name;hex` lines."""
    ship(files.sparkSession)
    names = _glyph_list(files.sparkSession, glyph_list)
    return files.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content")).mapInArrow(kernel(what, password, pages, mode, compat, names), SCHEMAS[what].replace(";", ","))


def parse_views(files: DataFrame, whats: tuple[str, ...], **options) -> dict[str, DataFrame]:
    """Several views by one reading of each file: rows without errors, written once, as each view's rows come out of the
    same interpreted pages."""
    options = dict(options)
    doc_id, content = options.pop("doc_id", "path"), options.pop("content", "content")
    ship(files.sparkSession)
    names = _glyph_list(files.sparkSession, options.pop("glyph_list", None))
    secret, pages, compat, mode = (options.get("password") or "").encode(), options.get("pages"), options.get("compat", "compat"), options.get("mode", "PERMISSIVE")
    plain = {w: [f for f in _arrow(w)][4:] for w in whats}
    kinds = {w: pa.struct(plain[w]) for w in whats}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    found = list(_views(data.as_py() or b"", whats, secret, pages, compat, names))
                except Exception:  # noqa: BLE001  a broken file has no rows here; errors() tells
                    if mode == "FAILFAST":
                        raise
                    continue
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    columns = [pa.array([dict(zip((f.name for f in plain[w]), r, strict=True)) if w == v else None for v, r in part], kinds[w]) for w in whats]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), *columns], names=["doc_id", *whats])

    fields = {w: SCHEMAS[w].removeprefix(_COMMON + ", ").replace(";", ",") for w in whats}
    typed = {w: "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2: ", fields[w]) + ">" for w in whats}
    rows = files.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, "doc_id string, " + ", ".join(f"{w} {typed[w]}" for w in whats))
    rows = table(rows, "views")
    return {w: rows.where(F.col(w).isNotNull()).select("doc_id", f"{w}.*") for w in whats}


def read_pdf(spark: SparkSession, path: str, what: str = "segments", **options) -> DataFrame:
    """Files under a path. Arrow batches are kept short for the session, as rows carry whole files."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FILES_A_BATCH)
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path), what, **options)


def good(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'ok'").drop("status", "error_class", "error")


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'error'").select("doc_id", "error_class", "error").distinct()


def chunks(files: DataFrame, **options) -> DataFrame:
    """Heading-aware chunks of files, after the form's text where there is a form. Files are read once; what they hold is
    written, as statistics and levels both read it and interpreting pages is what costs."""
    views = parse_views(files, ("segments", "fields"), **options)
    found = views["segments"]
    out = G.assemble(G.classify(found, G.doc_stats(found)))
    return G.with_forms(out, forms.form_text(forms.states(views["fields"])))


def extract_text(files: DataFrame, **options) -> DataFrame:
    """doc_id, page_num, text: by the plain-text rules, a row a page. They look at a string's first and last glyph only,
    so the kernel applies them string by string; render.plain_text does so to frames of glyphs."""
    return good(parse(files, "text", **options))


def _bodies(rows: DataFrame, order: list[str]) -> DataFrame:
    """doc_id, page_num, body: fragments of a page in order."""
    whole = F.array_sort(F.collect_list(F.struct(*order, "fragment")))
    return rows.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(whole, lambda x: x["fragment"]), "").alias("body"))


def svg(files: DataFrame, **options) -> DataFrame:
    """doc_id, page_num, svg: filled paths of each page."""
    views = parse_views(files, ("paths", "pages"), **options)
    fills = views["paths"].where("painted = 'fill'")
    padded = F.transform("ops", lambda o: F.struct(o["op"].alias("op"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.coalesce(F.get(o["args"], i), F.lit(0.0))).alias("args")))
    bodies = _bodies(fills.select("doc_id", "page_num", "op_no", render.svg_path(padded, [F.col(c) for c in "abcdef"]).alias("fragment")), ["op_no"])
    box = [F.col(c) for c in ("llx", "lly", "urx", "ury")]
    body, art = F.coalesce("body", F.lit("")), tuple(F.col(f"art_{c}") for c in ("llx", "lly", "urx", "ury"))
    page = F.when(art[0].isNull(), render.svg_page(*box, body)).otherwise(render.svg_page(*box, body, art))
    return views["pages"].join(bodies, ["doc_id", "page_num"], "left").select("doc_id", "page_num", page.alias("svg"))


def html(files: DataFrame, **options) -> DataFrame:
    """doc_id, page_num, html: runs of glyphs as placed divisions, after a red one for each glyph."""
    views = parse_views(files, ("glyphs", "pages"), **options)
    g = views["glyphs"].withColumn("top", F.col("y"))
    area: Column = (F.col("a") + F.col("c")) * (F.col("b") + F.col("d"))
    shown = F.sqrt(F.greatest(area, F.lit(0.0))) * F.abs("size")
    # runs follow the matrix, whose y grows upwards
    runs = render.html_runs(g.withColumn("x", F.col("e")).withColumn("y", F.col("f")), ["doc_id", "page_num"], ["op_no", "glyph_no"])
    single = runs.select("doc_id", "page_num", "run", F.lit(0).alias("kind"), "op_no", "glyph_no", F.regexp_replace(render.html_div(F.col("x"), F.col("top"), shown, F.lit("")), "absolute; left", "absolute; color: red; left").alias("div"), "text")
    single = single.select("doc_id", "page_num", "run", "kind", "op_no", "glyph_no", F.concat(F.regexp_replace("div", "</div>\n$", ""), "text", F.lit("</div>")).alias("fragment"))
    first = F.array_sort(F.collect_list(F.struct("op_no", "glyph_no", "text", "x", "top", shown.alias("shown"))))
    joined = runs.groupBy("doc_id", "page_num", "run").agg(first.alias("gs"))
    text = F.array_join(F.transform("gs", lambda x: x["text"]), "")
    flushed = joined.where(F.length(text) > 0).select("doc_id", "page_num", "run", F.lit(1).alias("kind"), F.lit(0).alias("op_no"), F.lit(0).alias("glyph_no"), render.html_div(F.col("gs")[0]["x"], F.col("gs")[0]["top"], F.col("gs")[0]["shown"], text).alias("fragment"))
    # a run is written when the next one's first glyph comes, before that glyph
    numbered = single.withColumn("run", F.col("run") * 2).unionByName(flushed.withColumn("run", F.col("run") * 2 + 1))
    bodies = _bodies(numbered, ["run", "kind", "op_no", "glyph_no"])
    pages = views["pages"]
    return pages.join(bodies, ["doc_id", "page_num"], "left").select("doc_id", "page_num", render.html_page(F.col("page_num"), F.col("urx") - F.col("llx"), F.col("ury") - F.col("lly"), F.coalesce("body", F.lit(""))).alias("html"))
