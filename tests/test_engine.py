"""Operators over frames, against small cases and brute force."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from foliospark.functions import strings as S
from foliospark.operators import fonts as P
from foliospark.operators import forms, layout, render
from foliospark.operators import segments as G
from foliospark.pdf import writer
from foliospark.sources import pdf
from foliospark.streaming.files import read_stream

SEGMENT = "doc_id string, page_num int, seg_no int, content string, font_name string, font_size double, transformed_font_size double, is_bold boolean"


def test_string_rules(spark):
    texts = [" a  b ", "", "IV", "iv", "4294967295", "4294967296", "+7", " 7", "éa", "-a", " x　"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", S.trim(F.col("s")), S.word_count(F.col("s")), S.is_roman(F.col("s")), S.parses_u32(F.col("s")), S.starts_alphanumeric(F.col("s"))).collect()
    for s, trimmed, words, roman, u32, alnum in rows:
        assert trimmed == s.strip()
        assert words == len(s.split())
        assert roman == (s != "" and set(s) <= set("IVX"))
        assert u32 == (s in ("4294967295", "+7"))
        assert alnum == (s[:1].isalnum())


def test_nbsp_against_the_rule(spark):
    texts = ["".join(p) for n in range(6) for p in itertools.product("a ", repeat=n)]
    for s, got in spark.createDataFrame([(t,) for t in texts], "s string").select("s", S.insert_nbsp(F.col("s"))).collect():
        want = "".join("&nbsp;" if c == " " and (i == 0 or s[i - 1] == " " or i == len(s) - 1 or s[i + 1] == " ") else c for i, c in enumerate(s))
        assert got == want


def test_numbers(spark):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in (1.0, 0.5, 1e7, 0.0001, -3.25)], "x double").select(S.number(F.col("x"))).collect()]
    assert got == ["1", "0.5", "10000000", "0.0001", "-3.25"]


def fold(rows):
    """Chunk assembly as a plain loop."""
    slots, text, page, out = [""] * 8, "", 0, []
    for level, content, p in rows:
        if level[0] == "H":
            n = int(level[1])
            if len(text.strip().encode()) > 35:
                out.append(([h for h in slots if h], " ".join(text.split()), p))
                text = ""
                slots[n] = content.strip()
                for i in range(n + 1, 7):
                    slots[i] = ""
            else:
                slots[n] += " " + content.strip()
        else:
            text = f"{text} {content}" if text else content
            page = p
    if text:
        out.append(([h for h in slots if h], text.strip(), page))
    return out


def test_numbers_of_any_size(spark):
    values = (1 / 3, 1e-11, 0.1 + 0.2, -1.5e-7, 123456789.125, 1e22, -2.5e15, 0.0, 1e300)
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(S.number(F.col("x"))).collect()]
    assert got == ["0.3333333333333333", "0.00000000001", "0.30000000000000004", "-0.00000015", "123456789.125", "1" + "0" * 22, "-2500000000000000", "0", "1" + "0" * 300]


def test_signs_above_the_basic_plane(spark):
    ranges = spark.createDataFrame([(1, 0, 5, 6, 0x1F600)], "font int, at int, low int, high int, target int")
    assert sorted(r["text"] for r in P.unicode_map(ranges).collect()) == ["\U0001f600", "\U0001f601"]


def test_glyph_list_of_a_file_and_several_views(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# names\nnosuch;0416\n")
    from foliospark.pdf import writer

    data = writer.document([b"BT /F1 10 Tf 72 720 Td (A) Tj ET"], fonts={"F1": b"<< /Type /Font /Subtype /Type1 /BaseFont /Own /FirstChar 65 /LastChar 65 /Widths [500] /Encoding << /Differences [65 /nosuch] >> >>"})
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"broken"))], "path string, content binary")
    views = pdf.parse_views(files, ("segments", "pages"), glyph_list=str(tmp_path / "names.txt"))
    assert [(r["doc_id"], r["content"]) for r in views["segments"].collect()] == [("a", "Ж")]
    assert [(r["doc_id"], r["urx"], r["art_llx"]) for r in views["pages"].collect()] == [("a", 612.0, None)]


def test_chunks_against_a_loop(spark):
    rng, docs, data = random.Random(1), {}, []
    for d in range(30):
        docs[str(d)] = rows = [(rng.choice(["H1", "H2", "H3", "H6", "H7", "Body", "Body", "SubBody"]), rng.choice([" long enough text for a paragraph, nearly", "short", "", " "]), 1 + i // 5) for i in range(rng.randrange(0, 25))]
        data += [(str(d), p, i, level, content) for i, (level, content, p) in enumerate(rows)]
    got: dict = {}
    for r in G.assemble(spark.createDataFrame(data, "doc_id string, page_num int, seg_no int, level string, content string")).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append((r["headings"], r["paragraph"], r["page"]))
    assert got == {d: fold(rows) for d, rows in docs.items() if fold(rows)}


def test_statistics_and_levels(spark):
    rows = [("d", 1, 0, "Title of it", "F1", 24.0, 24.0, False), ("d", 1, 1, "x" * 50, "F1", 12.0, 12.0, False), ("d", 1, 2, "bold head", "F1", 12.0, 12.0, True), ("d", 1, 3, "tiny", "F1", 8.0, 8.0, False), ("d", 1, 4, "Part two", "F2", 18.0, 18.0, False), ("e", 1, 0, "slightly larger", "F1", 12.5, 12.5, False), ("e", 1, 1, "y" * 60, "F1", 12.0, 12.0, False)]
    seg = spark.createDataFrame(rows, SEGMENT)
    stats = G.doc_stats(seg)
    assert {r["doc_id"]: (r["body_font"], r["body_transformed_size"], r["thresholds"]) for r in stats.collect()} == {"d": ("F1", 12.0, [24.0, 18.0]), "e": ("F1", 12.0, [])}
    levels = [r["level"] for r in G.classify(seg, stats).orderBy("doc_id", "seg_no").collect()]
    assert levels == ["H1", "Body", "H7", "SubBody", "H2", "Body", "Body"]


def test_depth_ignores_pops_of_an_empty_stack(spark):
    steps = [-1, 1, 1, -1, -1, -1, 1]
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate(steps)], "k int, i int, step int")
    assert [r["depth"] for r in layout.depth(rows, ["k"], ["i"]).orderBy("i").collect()] == [0, 1, 2, 1, 0, 0, 1]


def test_inherited_values_up_a_long_chain(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 7 if i == 0 else None) for i in range(25)], "node long, parent long, value long")
    assert {r["value"] for r in layout.inherited(nodes).collect()} == {7}


def test_deep_trees_are_walked_to_the_end(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 7 if i == 0 else None, 0) for i in range(70)], "node long, parent long, value long, at int")
    assert {r["value"] for r in layout.inherited(nodes).collect()} == {7}
    assert sorted((r["node"], r["depth"]) for r in forms.breadth_first(nodes.where("node < 20")).collect()) == [(i, i) for i in range(20)]


def test_cycle_without_a_value_ends(spark):
    nodes = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 1, None)], "node long, parent long, value long")
    assert [r["value"] for r in layout.inherited(nodes).collect()] == [None] * 3


def test_form_states(spark):
    rows = [("d", 0, "Btn", 65536, "b", ["On"], ["x"]), ("d", 1, "Btn", 1, None, ["Yes"], []), ("d", 2, "Ch", 2097152, "l", ["a", "b"], ["a", "b"]), ("d", 3, "Tx", 2, "t", [], []), ("d", 4, "Sig", None, "s", [], [])]
    fields = spark.createDataFrame(rows, "doc_id string, n int, ft string, ff int, name string, values array<string>, options array<string>")
    states = forms.states(fields)
    assert [r["type"] for r in states.orderBy("n").collect()] == ["Radio", "CheckBox", "ListBox", "Text", "Unknown"]
    text = forms.form_text(states).collect()[0]["paragraph"]
    assert text == "b: Radio: Selected: On, Options: [x] \n: CheckBox: Checked: true \nl: ListBox: Selected: [a, b], Options: [a, b], Multiselect: true \nt:  \ns: Unknown \n"


def test_an_empty_html_page(spark):
    row = spark.range(1).select(render.html_page(F.lit(1), F.lit(612.0), F.lit(792.0), F.lit("")).alias("h")).collect()[0]["h"]
    assert row == "<meta charset='utf-8' /> <!-- page 1 --><div id='page1' style='position: relative; height: 792px; width: 612px; border: 1px black solid'></div>"


def test_files_and_errors(spark, tmp_path):
    body = "A body line of text that is long enough to be a paragraph\nand goes on"
    (tmp_path / "good.pdf").write_bytes(writer.from_text(body))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "note.txt").write_bytes(b"no")
    rows = pdf.read_pdf(spark, str(tmp_path))
    assert pdf.errors(rows).count() == 1 and pdf.good(rows).count() == 1
    assert pdf.read_pdf(spark, str(tmp_path), mode="DROPMALFORMED").where("status = 'error'").count() == 0
    files = spark.createDataFrame([("p", writer.from_text(body))], "path string, content binary")
    assert pdf.extract_text(files).collect()[0]["text"].split() == body.split()
    assert [(r["paragraph"].split(), r["page"]) for r in pdf.chunks(files).collect()] == [(body.split(), 1)]


def test_form_text_comes_first(spark):
    extra = [b"<< /Fields [4 0 R] >>", b"<< /FT /Tx /T (name) /V (Bob) >>"]
    data = writer.document([b"BT /F1 12 Tf 72 720 Td (Hello) Tj 0 -14 Td (World) Tj ET"], extra=extra, catalog=b"/AcroForm 3 0 R")
    out = pdf.chunks(spark.createDataFrame([("p", data)], "path string, content binary")).orderBy("chunk_no").collect()
    assert [(r["chunk_no"], r["paragraph"], r["page"]) for r in out] == [(0, "name: Bob \n", 0), (1, "Hello\nWorld", 1)]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(writer.from_text(f"text {i}"))
    q = read_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("stream_of_files").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    time.sleep(0.1)
    assert sorted(r["content"] for r in spark.table("stream_of_files").collect()) == ["text 0", "text 1", "text 2"]


def test_queries_have_oracles():
    import __spark_entry__ as e

    from foliospark.plans import catalog

    assert set(catalog.oracle_sql()) == set(catalog.queries()) <= set(e.queries())


def test_rendered_pages(spark):
    data = writer.document([b"0 0 10 20 re f BT /F1 12 Tf 72 720 Td (a b) Tj 0 -14 Td (c) Tj ET", b""], fonts={"F1": b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"})
    files = spark.createDataFrame([("p", data)], "path string, content binary")
    one, two = pdf.svg(files).orderBy("page_num").collect()
    assert "<path d='M0 0 L10 0 L10 20 L0 20 Z' />" in one["svg"] and "viewBox='0 0 612 792'" in two["svg"] and two["svg"].endswith("</g>\n</svg>")
    one, two = pdf.html(files).orderBy("page_num").collect()
    red = "<div style='position: absolute; color: red; left: {}px; top: {}px; font-size: 12px'>{}</div>"
    run = "<div style='position: absolute; left: 72px; top: {}px; font-size: 12px'>{}</div>\n"
    body = red.format("72", 72, "a") + red.format("79.2", 72, " ") + red.format("86.4", 72, "b") + run.format(72, "a b") + red.format("72", 86, "c") + run.format(86, "c")
    assert body in one["html"] and two["html"].endswith("'></div>")


def test_plain_text_is_a_row_a_page_by_the_rules_over_glyphs(spark):
    form = writer.stream(b"BT /F1 9 Tf 10 300 Td (inner one) Tj 0 -30 Td (two) Tj ET", b"/Type /XObject /Subtype /Form")
    contents = [
        b"BT /F1 12 Tf 72 720 Td (Hello, world) Tj 2 Tc 3 Tw 0 -14 Td (a b c) Tj 90 Tz 4 Ts 200 0 Td (far) Tj 9 0 Td (near) Tj ET",
        b"2 0 0 3 5 7 cm BT /F1 12 Tf 1 0.2 0.3 1 72 120 Tm (sheared) Tj 60 0 Td (x) Tj ET /X1 Do BT /F1 8 Tf (after) Tj ET",
        b"1 g BT /F1 12 Tf 72 720 Td (white) Tj 0 1 -1 0 100 100 Tm (turned) Tj () Tj (twice) Tj ET",
        b"BT ET",
    ]
    files = spark.createDataFrame([("a", writer.document(contents, extra=[form], resources=b"/XObject << /X1 3 0 R >>")), ("b", writer.from_text("")), ("c", b"junk")], "path string, content binary")
    got = {(r["doc_id"], r["page_num"]): r["text"] for r in pdf.extract_text(files).collect()}
    assert len(got) == 5 and got["a", 4] == got["b", 1] == ""
    assert [r["doc_id"] for r in pdf.errors(pdf.parse(files, "text")).collect()] == ["c"]
    area = (F.col("a") + F.col("c")) * (F.col("b") + F.col("d"))
    size = F.when(area < 0, float("nan")).otherwise(F.abs("size") * F.sqrt(F.greatest(area, F.lit(0.0))))
    glyphs = render.plain_text(pdf.good(pdf.parse(files, "glyphs")).withColumn("size", size)).collect()
    assert {(r["doc_id"], r["page_num"]): r["text"] for r in glyphs} == {k: v for k, v in got.items() if v}


def test_plain_text_keeps_the_strings_of_an_array_in_order(spark):
    files = spark.createDataFrame([("a", writer.document([b"BT /F1 12 Tf 72 720 Td [(abc) -20 (def) -900 (ghi)] TJ ET"]))], "path string, content binary")
    assert pdf.extract_text(files).collect()[0]["text"] == "\n abcdef ghi"
