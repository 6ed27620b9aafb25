"""The page interpreter: content-stream operators to text segments and glyphs.

mode: compat keeps the quirks that results depend on (see the notes at each), intent does what the specification says.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from foliospark.pdf import color as colors
from foliospark.pdf.fonts import Font, font_of
from foliospark.pdf.objects import Document, Name, PdfError, Stream, operations

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: tuple, n: tuple) -> tuple:
    """m, then n: row vectors."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def rounded(x: float) -> float:
    """To two decimals, halves away from zero."""
    return math.copysign(math.floor(abs(x) * 100 + 0.5) / 100, x) if math.isfinite(x) else x


def shown(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


@dataclass
class State:
    """What q saves and Q restores."""

    ctm: tuple = IDENTITY
    tm: tuple = IDENTITY
    line: tuple = IDENTITY
    font: Font | None = None
    size: float = math.nan
    spacing: float = 0.0
    words: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    fill: dict = field(default_factory=lambda: {"kind": "DeviceGray"})
    stroke: dict = field(default_factory=lambda: {"kind": "DeviceGray"})
    fill_color: tuple = (0.0,)
    stroke_color: tuple = (0.0,)
    width: float = 1.0
    mask: dict | None = None


@dataclass
class Page:
    """What a page gives: segments and, if asked for, glyphs and painted paths, or pieces of plain text with where the
    last one ended; operators are counted."""

    box: tuple[float, float, float, float]
    number: int
    segments: list[dict] = field(default_factory=list)
    glyphs: list[tuple] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    paths: list[tuple] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)
    plain_end: tuple[float, float] = (100000.0, 0.0)


def number(x) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise PdfError("Type", "a number is missing")
    return float(x)


class Interpreter:
    def __init__(self, doc: Document, page: Page, mode: str = "compat", glyphs: bool = False, fonts: dict | None = None, names: dict[str, int] | None = None, plain: bool = False):
        self.doc, self.page, self.mode, self.trace, self.fonts, self.names, self.plain = doc, page, mode, glyphs, {} if fonts is None else fonts, names, plain

    def font(self, resources: dict, name: str) -> Font:
        ref = self.doc.dict(resources.get("Font")).get(name)
        if ref is None:
            raise PdfError("Font", f"font {name} is missing")
        key = (ref, self.mode) if not isinstance(ref, dict) else id(ref)
        if key not in self.fonts:
            self.fonts[key] = font_of(self.doc, self.doc.dict(ref), self.mode, self.names)
        return self.fonts[key]

    def run(self, content: bytes, resources: dict, nested: int = 0, inside: frozenset = frozenset()) -> None:
        """A stream, from a fresh state; segments of nested forms come before the pending line."""
        page, (llx, lly, urx, ury) = self.page, self.page.box
        height = ury - lly
        s, saved = State(), []
        color = (0.0, 0.0, 0.0)  # not saved by q
        text, x, y = "", 0.0, 0.0
        last_end, last_y = 100000.0, 0.0
        # attributes of the pending line; they change on a cut alone, so a page's first segment has none
        bold, size, name, tsize = False, 0.0, "", 0.0

        def cut(why: str) -> None:
            page.segments.append({"content": text.strip(), "font_name": name, "font_size": size, "transformed_font_size": tsize, "x": x, "y": y, "is_bold": bold, "cutat": why})

        def show(op: str, string: bytes) -> None:
            """A string. Its glyphs share a size and follow each other, so gaps and cuts come before the first alone."""
            nonlocal text, x, y, last_end, last_y, tsize
            if s.font is None:
                raise PdfError("Font", "text without a font")
            codes = s.font.codes(string)
            if not codes:
                return
            m = s.tm
            px, py = m[4], height - m[5]
            area = (m[0] + m[2]) * (m[1] + m[3])
            t = rounded(abs(s.size) * math.sqrt(area)) if area >= 0 else math.nan
            seen = llx <= s.line[4] <= urx and lly <= s.line[5] <= ury and not all(c > 0.9 for c in color)
            if not math.isnan(t) and not math.isnan(tsize) and t != tsize:
                if text.strip():
                    if x > 0 and y > 0:
                        cut(op)
                    text = ""
                tsize = t
            if abs(py - last_y) > 1.5 * t:
                text += "\n"
            if px < last_end and abs(py - last_y) > 0.5 * t:
                text += "\n"
            if px > last_end + 0.1 * t:
                text += " "
            x, y = (rounded(px), rounded(py)) if op == "TJ" else (px, py)
            w0 = s.font.widths_of(codes) / 1000
            gap = s.spacing + s.font.spaces_in(codes) * s.words if s.words else s.spacing
            if self.trace:
                for n, (code, w, more) in enumerate(zip(codes, w0.tolist(), np.broadcast_to(gap, w0.shape).tolist(), strict=True)):
                    trm = times((s.scale, 0.0, 0.0, 1.0, 0.0, s.rise), times(s.tm, s.ctm))
                    page.glyphs.append((page.counts.get("", 0), n, s.font.signs((code,)), w, more, s.size, *trm, trm[4], height - trm[5], seen))
                    s.tm = times((1.0, 0.0, 0.0, 1.0, s.scale * (w * s.size + more), 0.0), s.tm)
            # where each glyph starts, and where the next string would, one sum after the other
            moved = s.scale * (w0 * s.size + gap)
            steps = np.empty((2, len(moved) + 1))
            steps[:, 0] = m[4:]
            steps[0, 1:] = moved * m[0] + 0.0 * m[2]
            steps[1, 1:] = moved * m[1] + 0.0 * m[3]
            (ex, nx), (ey, ny) = np.cumsum(steps, axis=1)[:, -2:].tolist()
            out = s.font.signs(codes)
            if seen:
                text += out
            last_end, last_y = ex + float(w0[-1]) * t, height - ey
            if self.plain:
                add_plain(out, m, (*m[:4], ex, ey), float(w0[-1]))
            s.tm = (*m[:4], nx, ny)

        def add_plain(out: str, first: tuple, last: tuple, w0: float) -> None:
            """A string's plain text, whether it shows or not. first, last: the matrices of these glyphs."""
            (a, b, c, d, px, py), (_, _, _, _, qx, qy) = (times((s.scale, 0.0, 0.0, 1.0, 0.0, s.rise), times(v, s.ctm)) for v in (first, last))
            area, (end, line) = (a + c) * (b + d), page.plain_end
            t, py = abs(s.size) * math.sqrt(area) if area >= 0 else math.nan, height - py
            if abs(py - line) > 1.5 * t:
                page.plain.append("\n")
            if px < end and abs(py - line) > 0.5 * t:
                page.plain.append(" ")
            if px > end + 0.1 * t:
                page.plain.append(" ")
            page.plain.append(out)
            page.plain_end = qx + w0 * t, height - qy

        path: list[tuple[str, list[float]]] = []

        def draw(op: str, args: list) -> None:
            """Path steps M, L, C, R and Z; v starts a curve where the path is, y ends one at its control point."""
            v = [number(a) for a in args]
            if op == "v":
                if not path or path[-1][0] in "RZ":
                    raise PdfError("Path", "a curve starts nowhere")
                v = [*path[-1][1][-2:], *v]
            elif op == "y":
                v = [*v, *v[-2:]]
            path.append(({"m": "M", "l": "L", "h": "Z", "re": "R"}.get(op, "C"), v))

        def paint(how: str) -> None:
            if self.trace and how and path:
                space, tint = (s.stroke, s.stroke_color) if how == "stroke" else (s.fill, s.fill_color)
                page.paths.append((page.counts.get("", 0), how, space["kind"], list(tint), s.width, *s.ctm, list(path)))
            path.clear()

        def move(tx: float, ty: float) -> None:
            s.line = s.tm = times((1.0, 0.0, 0.0, 1.0, tx, ty), s.line)

        for op, args in operations(content):
            page.counts[op] = page.counts.get(op, 0) + 1
            page.counts[""] = page.counts.get("", 0) + 1
            match op:
                case "BT":
                    s.tm = s.line = IDENTITY
                case "cm":
                    s.ctm = times(tuple(number(v) for v in args[:6]), s.ctm)
                case "rg" | "g":
                    values = tuple(number(v) for v in args)
                    color = values if op == "rg" else values * 3
                case "Tf":
                    s.font, s.size = self.font(resources, str(args[0])), number(args[1])
                    now = (s.font.bold, rounded(s.size), str(args[0]))
                    if now != (bold, size, name) and text.strip() and x > 0 and y > 0:
                        old, new = (bold, now[0]) if bold != now[0] else (size, now[1]) if size != now[1] else (name, now[2])
                        cut(f"Tf, old value: {shown(old)}, new value: {shown(new)}")
                        bold, size, name = now
                        text = ""
                case "TJ":
                    for v in args[0] if args and isinstance(args[0], list) else []:
                        if isinstance(v, bytes):
                            show(op, v)
                        elif isinstance(v, (int, float)):
                            s.tm = times((1.0, 0.0, 0.0, 1.0, s.scale * (0 - v / 1000) * s.size, 0.0), s.tm)
                case "Tj":
                    if not args or not isinstance(args[0], bytes):
                        raise PdfError("Type", "Tj needs a string")
                    show(op, args[0])
                case "'" | '"' if self.mode == "intent":
                    if op == '"':
                        s.words, s.spacing = number(args[0]), number(args[1])
                    move(0.0, -s.leading)
                    show("Tj", args[-1])
                case "Tc":
                    s.spacing = number(args[0])
                case "Tw":
                    s.words = number(args[0])
                case "Tz":
                    s.scale = number(args[0]) / 100
                case "TL":
                    s.leading = number(args[0])
                case "Ts":
                    s.rise = number(args[0])
                    text += " "
                case "Tm":
                    s.tm = s.line = tuple(number(v) for v in args[:6])
                case "Td" | "TD":
                    if op == "TD":
                        s.leading = -number(args[1])
                    move(number(args[0]), number(args[1]))
                case "T*":
                    move(0.0, -s.leading)
                case "q":
                    saved.append(replace(s))
                case "Q":
                    if saved:
                        s = saved.pop()
                case "CS" | "cs":
                    space = colors.colorspace(self.doc, str(args[0]), resources)
                    if op == "CS":
                        s.stroke = space
                    else:
                        s.fill = space
                case "SC" | "SCN":
                    s.stroke_color = () if s.stroke["kind"] == "Pattern" else tuple(number(v) for v in args)
                case "sc" | "scn":
                    s.fill_color = () if s.fill["kind"] == "Pattern" else tuple(number(v) for v in args)
                case "w":
                    s.width = number(args[0])
                case "gs":
                    given = self.doc.dict(self.doc.dict(resources.get("ExtGState", {})).get(str(args[0])))
                    if "SMask" in given:
                        mask = self.doc.get(given["SMask"])
                        if mask != "None" and not isinstance(mask, dict):
                            raise PdfError("ExtGState", "a soft mask of another type")
                        s.mask = mask if isinstance(mask, dict) else None
                case "m" | "l" | "c" | "v" | "y" | "h" | "re":
                    draw(op, args)
                case "S":
                    paint("stroke")
                case "F" | "f":
                    paint("fill")
                case "n":
                    paint("")
                case "Do" if args and isinstance(args[0], Name):
                    ref = self.doc.dict(resources.get("XObject", {})).get(str(args[0]))
                    form = self.doc.get(ref)
                    if isinstance(form, Stream) and self.doc.get(form.head.get("Subtype")) != "Image" and ref not in inside:
                        own = self.doc.get(form.head.get("Resources"))
                        self.run(self.doc.decoded(form), own if isinstance(own, dict) else resources, nested + 1, inside | {ref})
        if text and x > 0 and y > 0:
            cut("final")
