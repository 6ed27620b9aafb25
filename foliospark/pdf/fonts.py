"""Fonts: codes of a string, their widths and their text."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np

from foliospark.functions import metrics, tables
from foliospark.pdf.objects import Document, Lexer, Name, PdfError, Ref, Stream

#: Fonts of icons: names that stand for no sign are let be.
ICONS = "FontAwesome"


def cmap(data: bytes) -> dict:
    """chars: code to UTF-16BE text by bfchar and bfrange; spaces: (bytes, low, high) of codes; cids: (low, high, cid)."""
    out: dict = {"chars": {}, "spaces": [], "cids": []}
    for kind, body in re.findall(rb"begin(bfchar|bfrange|codespacerange|cidrange|cidchar)(.*?)end\1", data, re.S):
        lex, items = Lexer(body, refs=False), []
        while isinstance(x := lex.next(), (bytes, int, list, Name)):
            items.append(x)
        number = lambda b: int.from_bytes(b, "big")
        if kind == b"bfchar":
            for code, text in zip(items[::2], items[1::2], strict=False):
                out["chars"][number(code)] = _utf16(text)
        elif kind == b"bfrange":
            for low, high, text in zip(items[::3], items[1::3], items[2::3], strict=False):
                if number(high) - number(low) >= 1 << 24:
                    raise PdfError("CMap", "a range of more codes than there are signs")
                for k in range(number(high) - number(low) + 1):
                    if isinstance(text, list):
                        if k < len(text):
                            out["chars"][number(low) + k] = _utf16(text[k])
                    else:
                        last = (number(text) + k).to_bytes(max(len(text), 2), "big")
                        out["chars"][number(low) + k] = _utf16(last)
        elif kind == b"codespacerange":
            out["spaces"] += [(len(low), number(low), number(high)) for low, high in zip(items[::2], items[1::2], strict=False)]
        elif kind == b"cidrange":
            out["cids"] += [(number(low), number(high), cid) for low, high, cid in zip(items[::3], items[1::3], items[2::3], strict=False)]
        else:
            out["cids"] += [(number(code), number(code), cid) for code, cid in zip(items[::2], items[1::2], strict=False)]
    return out


def _utf16(text) -> str:
    if not isinstance(text, bytes) or len(text) % 2:
        raise PdfError("CMap", "a target isn't UTF-16")
    return text.decode("utf-16-be", "ignore")


#: Fonts that dictionaries describe without references, as those of many files do: so many at most.
_SHARED: dict[tuple, Font] = {}
MOST_SHARED = 64


def _frozen(x) -> tuple:
    if isinstance(x, dict):
        return dict, tuple((k, _frozen(v)) for k, v in x.items())
    if isinstance(x, list):
        return list, tuple(map(_frozen, x))
    if isinstance(x, (Ref, Stream)):
        raise KeyError(x)
    return type(x), x


def font_of(doc: Document, head: dict, mode: str, names: dict[str, int] | None) -> Font:
    """The font of a dictionary; the same for equal ones that stand for themselves."""
    try:
        key = (mode, _frozen(head))
    except KeyError:
        key = None
    if key is None or names is not None:
        return Font(doc, head, mode, names)
    if key not in _SHARED:
        font = Font(doc, head, mode)
        font.doc = None  # which would keep the file
        if len(_SHARED) >= MOST_SHARED:
            _SHARED.clear()
        _SHARED[key] = font
    return _SHARED[key]


class Font:
    """mode: compat keeps the quirks of range widths and CID numbering, intent follows the specification. names: glyph
    names and their code points, if not the built-in ones."""

    def __init__(self, doc: Document, head: dict, mode: str = "compat", names: dict[str, int] | None = None):
        self.doc, self.head, self.mode = doc, head, mode
        get = doc.get
        self.subtype, self.base = str(get(head.get("Subtype"))), str(get(head.get("BaseFont")) or "")
        self.bold = "bold" in repr({k: v for k, v in head.items()}).lower()
        self.names = tables.glyph_names() if names is None else names
        self.to_unicode = self._unicode_map()
        self.encoding: list[int] | None = None
        self.widths: dict[int, float] = {}
        self.missing = 0.0
        self._table: np.ndarray | None = None
        self._signs: tuple[str | list[str], bytes] | None = None
        if self.subtype == "Type0":
            self._composite()
        else:
            self._simple()

    def _unicode_map(self) -> dict[int, str] | None:
        x = self.doc.get(self.head.get("ToUnicode"))
        if x is None or x == "Identity-H":
            return None
        if not isinstance(x, Stream):
            raise PdfError("CMap", "unsupported map to Unicode")
        return cmap(self.doc.decoded(x))["chars"]

    def _named(self, name: str) -> list[int]:
        try:
            return list(tables.encoding(str(name)))
        except KeyError:
            raise PdfError("Encoding", f"unexpected encoding {name}") from None

    def _simple(self) -> None:
        get, head = self.doc.get, self.head
        enc = get(head.get("Encoding"))
        if isinstance(enc, Name):
            self.encoding = self._named(enc)
        elif isinstance(enc, dict):
            base = get(enc.get("BaseEncoding"))
            self.encoding = self._named(base) if base else list(tables.encoding("PDFDocEncoding"))
            self._differences(get(enc.get("Differences")) or [])
        elif enc is not None or self.subtype == "Type3":
            raise PdfError("Encoding", "an encoding of another type")
        elif self.subtype == "TrueType":
            self.encoding = self._named("WinAnsiEncoding")
        elif isinstance(file := get((get(head.get("FontDescriptor")) or {}).get("FontFile")), Stream):
            self.encoding = list(tables.encoding("PDFDocEncoding"))
            # the built-in encoding of a Type 1 program: lines of `dup code /name put`
            for code, name in re.findall(rb"dup\s+(\d+)\s*/(\S+)\s+put", self.doc.decoded(file)):
                if (cp := self.names.get(name.decode("latin-1"))) is not None and int(code) < 256:
                    self.encoding[int(code)] = cp
        first, widths = get(head.get("FirstChar")), get(head.get("Widths"))
        if isinstance(first, int) and isinstance(widths, list):
            last = get(head.get("LastChar"))
            if isinstance(last, int) and last - first + 1 != len(widths):
                raise PdfError("Widths", "the number of widths doesn't match")
            self.widths = {first + i: float(get(w)) for i, w in enumerate(widths)}
        elif self.base in metrics.CORE_FONTS:
            if self.encoding is None:
                # the font's own codes
                own = metrics.core_codes(self.base)
                self.encoding = [own[code][0] if code in own else 0 for code in range(256)]
                self.widths = {code: float(width) for code, (_, width) in own.items()}
            else:
                by = metrics.core_widths(self.base)
                self.widths = {code: float(by[cp]) for code, cp in enumerate(self.encoding) if cp in by}
        else:
            raise PdfError("Widths", "no widths")
        missing = get(head.get("MissingWidth"))
        self.missing = float(missing) if isinstance(missing, (int, float)) else 0.0

    def _differences(self, items: list) -> None:
        code = 0
        for x in items:
            x = x if self.subtype == "Type3" else self.doc.get(x)
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                cp = self.names.get(str(x))
                if code < 256 and cp is not None:
                    self.encoding[code] = cp
                if self.to_unicode is not None and self.subtype != "Type3":
                    if cp is not None:
                        self.to_unicode.setdefault(code, chr(cp))
                    elif ICONS in self.base:
                        self.to_unicode.setdefault(code, "")
                code += 1
            else:
                raise PdfError("Encoding", "differences hold another type")

    def _composite(self) -> None:
        get, head = self.doc.get, self.head
        enc = get(head.get("Encoding"))
        if isinstance(enc, Stream):
            m = cmap(self.doc.decoded(enc))
            self.spaces, self.cids = m["spaces"] or [(2, 0, 0xFFFF)], m["cids"]
        elif enc == "Identity-H":
            self.spaces, self.cids = [(2, 0, 0xFFFF)], [(0, 0xFFFF, 0)]
        else:
            raise PdfError("Encoding", f"unexpected encoding {enc}")
        inner = self.doc.dict(self.doc.get(head["DescendantFonts"])[0])
        default = get(inner.get("DW"))
        self.missing = float(default) if isinstance(default, int) else 1000.0
        w, i = get(inner.get("W")) or [], 0
        while i + 1 < len(w):
            first, second = get(w[i]), get(w[i + 1])
            if isinstance(second, list):
                self.widths.update((first + k, float(get(v))) for k, v in enumerate(second))
                i += 2
            else:
                if self.mode == "intent" and i + 2 < len(w):
                    self.widths.update(dict.fromkeys(range(first, second + 1), float(get(w[i + 2]))))
                i += 3

    def codes(self, text: bytes) -> bytes | list[tuple[int, int]]:
        """The codes of a string: its bytes, or (code, bytes) of a composite font, where codes that fit no range end it."""
        return text if self.subtype != "Type0" else list(self._composite_codes(text))

    def _composite_codes(self, text: bytes) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(text):
            for n in range(1, 5):
                code = int.from_bytes(text[at : at + n], "big")
                if at + n <= len(text) and any(size == n and low <= code <= high for size, low, high in self.spaces):
                    break
            else:
                return
            at += n
            for low, high, cid in self.cids:
                if low <= code <= high:
                    yield (code + cid if self.mode == "compat" else code - low + cid), n
                    break
            else:
                return

    def widths_of(self, codes: bytes | list[tuple[int, int]]) -> np.ndarray:
        if self.subtype == "Type0":
            return np.array([self.width(code) for code, _ in codes])
        if self.subtype == "Type3":
            return np.array([self.width(code) for code in codes])
        if self._table is None:
            self._table = np.array([self.width(code) for code in range(256)])
        return np.take(self._table, np.frombuffer(codes, np.uint8))

    def spaces_in(self, codes: bytes | list[tuple[int, int]]) -> np.ndarray:
        """Which codes word spacing follows: 32 as a single byte."""
        return np.array([c == (32, 1) for c in codes]) if self.subtype == "Type0" else np.frombuffer(codes, np.uint8) == 32

    def signs(self, codes) -> str:
        """The text of codes."""
        if self.subtype == "Type0":
            return "".join(self.text(code) for code, _ in codes)
        if self._signs is None:
            by = [self.text(code) for code in range(256)]
            # codes of one sign each are decoded at once, those without any dropped before; U+FFFE would be an error
            one = all(len(t) < 2 and t != "\ufffe" for t in by)
            self._signs = ("".join(t or "\0" for t in by) if one else by), bytes(c for c, t in enumerate(by) if not t)
        table, silent = self._signs
        if isinstance(table, list):
            return "".join(table[code] for code in codes)
        return codecs.charmap_decode(bytes(codes).translate(None, silent), "strict", table)[0]

    def width(self, code: int) -> float:
        if self.subtype == "Type3" and code not in self.widths:
            raise PdfError("Widths", f"no width of code {code}")
        return self.widths.get(code, self.missing)

    def text(self, code: int) -> str:
        if self.to_unicode is not None and code in self.to_unicode:
            return self.to_unicode[code]
        if self.subtype == "Type0":
            return ""
        table = self.encoding or tables.encoding("PDFDocEncoding")
        return chr(table[code]) if table[code] else ""
