"""A writer of plain PDF files: for tests, examples and round trips."""

from __future__ import annotations

import zlib


def literal(text: str, encoding: str = "cp1252") -> bytes:
    raw = text.encode(encoding, "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def assemble(objects: list[bytes], trailer: bytes = b"/Root 1 0 R") -> bytes:
    """A file of numbered objects from 1 on, with a table of their places."""
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d " % (len(objects) + 1) + trailer + b" >>\nstartxref\n%d\n%%%%EOF\n" % start)


def stream(data: bytes, head: bytes = b"", compress: bool = False) -> bytes:
    if compress:
        data, head = zlib.compress(data, 1), head + b" /Filter /FlateDecode"
    return b"<< /Length %d " % len(data) + head + b" >>\nstream\n" + data + b"\nendstream"


def document(contents: list[bytes], fonts: dict[str, bytes] | None = None, compress: bool = False, extra: list[bytes] | None = None, resources: bytes = b"", catalog: bytes = b"", box: bytes = b"[0 0 612 792]", trailer: bytes = b"") -> bytes:
    """Pages of contents. fonts: resource names and font dictionaries; Helvetica as F1 if none are given. extra:
    further objects, numbered from 3 on; fonts and pages follow."""
    extra = extra or []
    fonts = fonts if fonts is not None else {"F1": b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    objects = [b"", b"", *extra]
    names = []
    for name, body in fonts.items():
        objects.append(body)
        names.append(b"/%s %d 0 R" % (name.encode(), len(objects)))
    shared = b"<< /Font << " + b" ".join(names) + b" >> " + resources + b" >>"
    kids = []
    for c in contents:
        objects.append(stream(c, compress=compress))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R " + catalog + b" >>"
    objects[1] = b"<< /Type /Pages /Count %d /MediaBox " % len(kids) + box + b" /Resources " + shared + b" /Kids [" + b" ".join(kids) + b"] >>"
    return assemble(objects, b"/Root 1 0 R " + trailer)


def from_text(text: str, lines: int = 50, size: int = 12, compress: bool = True, title: str | None = None) -> bytes:
    """A text, a line a string, so many lines a page."""
    rows, pages = text.split("\n"), []
    for at in range(0, len(rows), lines):
        body = [b"BT /F1 %d Tf 72 720 Td" % size]
        for i, row in enumerate(rows[at : at + lines]):
            body.append((b"0 -%d Td " % (size + 2) if i else b"") + literal(row) + b" Tj")
        pages.append(b"\n".join([*body, b"ET"]))
    info = b"/Info 3 0 R" if title is not None else b""
    return document(pages, compress=compress, extra=[b"<< /Title " + literal(title) + b" >>"] if title is not None else None, trailer=info)
