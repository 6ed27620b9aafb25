"""Objects of a PDF file: parsing, cross references (tables, streams, and by search where these are broken)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from foliospark.pdf import crypt, filters


class PdfError(Exception):
    """kind: what an error row names."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


class Op(str):
    """A bare word: an operator of a content stream."""

    __slots__ = ()


@dataclass
class Stream:
    head: dict
    raw: bytes
    key: tuple[int, int] | None = None


#: What is skipped, and a word if one follows.
_NEXT = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*([^\x00\t\n\x0c\r ()<>\[\]{}/%]+)?")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_RUN = re.compile(rb"[^\\()]*")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
_END = object()


@lru_cache(4096)
def _word(w: bytes):
    if _NUMBER.match(w):
        return float(w) if b"." in w else int(w)
    return {b"true": True, b"false": False, b"null": None}.get(w, Op(w.decode("latin-1")))


class Lexer:
    """Objects from bytes at a place. refs: whether `1 0 R` is a reference, as it isn't in content streams."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def next(self):
        d = self.data
        found = _NEXT.match(d, self.at)
        self.at = found.end()
        if w := found[1]:
            if self.refs and (m := _REF.match(d, found.start(1))):
                self.at = m.end()
                return Ref(int(m[1]), int(m[2]))
            return _word(w)
        if self.at >= len(d):
            return _END
        c = d[self.at : self.at + 1]
        if c == b"/":
            m = _WORD.match(d, self.at + 1)
            raw = m.group() if m else b""
            self.at += 1 + len(raw)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self._literal()
        if d.startswith(b"<<", self.at):
            self.at += 2
            out = {}
            while (k := self.next()) is not _END and k != ">>":
                v = self.next()
                if v is _END or v == ">>":
                    break
                if isinstance(k, Name):
                    out[str(k)] = v
            return out
        if c == b"<":
            stop = d.find(b">", self.at)
            stop = len(d) if stop < 0 else stop
            text = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : stop])
            self.at = stop + 1
            return bytes.fromhex((text + b"0" * (len(text) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while (v := self.next()) is not _END and not (isinstance(v, Op) and v == "]"):
                out.append(v)
            return out
        if d.startswith(b">>", self.at):
            self.at += 2
            return Op(">>")
        self.at += 1
        return Op(c.decode())

    def _literal(self) -> bytes:
        d, at, deep, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            if run := _RUN.match(d, at).group():
                out += run
                at += len(run)
                continue
            c = d[at]
            if c == 92:
                at += 1
                e = d[at] if at < len(d) else 0
                if 48 <= e <= 55:
                    m = _OCTAL.match(d, at)
                    out.append(int(m.group(), 8) & 255)
                    at = m.end()
                    continue
                if e == 13 and d[at + 1 : at + 2] == b"\n":
                    at += 1
                elif e not in (10, 13):
                    out.append(_ESCAPES.get(e, e))
                at += 1
                continue
            deep += (c == 40) - (c == 41)
            if not deep:
                break
            out.append(c)
            at += 1
        self.at = at + 1
        return bytes(out)


def operations(content: bytes):
    """(operator, operands) of a content stream; inline images are skipped."""
    lex, held = Lexer(content, refs=False), []
    while (x := lex.next()) is not _END:
        if not isinstance(x, Op):
            held.append(x)
            continue
        if x == "BI":
            stop = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(content, lex.at)
            lex.at = stop.end() if stop else len(content)
        yield str(x), held
        held = []


@dataclass
class Document:
    data: bytes
    password: bytes = b""
    trailer: dict = field(default_factory=dict)
    places: dict[int, tuple] = field(default_factory=dict)
    cache: dict[int, object] = field(default_factory=dict)
    key: crypt.Handler | None = None

    def __post_init__(self) -> None:
        if b"%PDF-" not in self.data[:1024]:
            raise PdfError("Format", "no PDF header")
        try:
            self._tables(int(re.findall(rb"startxref\s+(\d+)", self.data)[-1]))
            self.dict(self.trailer.get("Root"))["Pages"]
        except Exception:  # noqa: BLE001  whatever is wrong with the tables, the objects are looked for
            self._search()
        if "Encrypt" in self.trailer:
            ids = self.get(self.trailer.get("ID")) or [b""]
            self.key = crypt.handler(self.dict(self.trailer["Encrypt"]), ids[0] if isinstance(ids[0], bytes) else b"", self.password, self.get)
            if self.key is None:
                raise PdfError("Password", "the password is wrong")
            self.cache.clear()

    def _tables(self, at: int) -> None:
        seen = set()
        while at not in seen:
            seen.add(at)
            lex = Lexer(self.data, at)
            head = lex.next()
            if head == "xref":
                while isinstance(first := lex.next(), int):
                    for n in range(first, first + lex.next()):
                        place, _, kind = lex.next(), lex.next(), lex.next()
                        if kind == "n":
                            self.places.setdefault(n, (1, place))
                        else:
                            self.places.setdefault(n, (0,))
                trailer = lex.next()
                if isinstance(extra := trailer.get("XRefStm"), int):
                    self._stream_table(extra)
            else:
                trailer = self._stream_table(at)
            self.trailer = trailer | self.trailer
            if not isinstance(trailer.get("Prev"), int):
                return
            at = trailer["Prev"]

    def _stream_table(self, at: int) -> dict:
        s = self._object_at(at)
        data, w = self.decoded(s), s.head["W"]
        index = s.head.get("Index") or [0, s.head["Size"]]
        row, k = sum(w), 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for n in range(first, first + count):
                r, fields, p = data[k : k + row], [], 0
                for size in w:
                    fields.append(int.from_bytes(r[p : p + size], "big") if size else None)
                    p += size
                kind = 1 if fields[0] is None else fields[0]
                self.places.setdefault(n, (kind, fields[1], fields[2] or 0))
                k += row
        return s.head

    def _search(self) -> None:
        self.places, self.cache = {}, {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b", self.data):
            self.places[int(m[1])] = (1, m.start())
        for m in re.finditer(rb"trailer", self.data):
            t = Lexer(self.data, m.end()).next()
            if isinstance(t, dict):
                self.trailer |= t
        for n in list(self.places):
            try:
                x = self.get(Ref(n, 0))
            except Exception:  # noqa: BLE001
                continue
            head = x.head if isinstance(x, Stream) else x
            if not isinstance(head, dict):
                continue
            if head.get("Type") == "ObjStm":
                for i, num in enumerate(self._numbers(x)):
                    self.places.setdefault(num, (2, n, i))
            if head.get("Type") == "XRef":
                self.trailer = {k: v for k, v in head.items() if k in ("Root", "Info", "Encrypt", "ID")} | self.trailer
            if head.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(n, 0))
        if "Root" not in self.trailer:
            raise PdfError("Format", "no catalog")

    def _numbers(self, s: Stream) -> list[int]:
        lex = Lexer(self.decoded(s))
        return [lex.next() for _ in range(2 * s.head["N"])][::2]

    def _object_at(self, at: int, key: tuple[int, int] | None = None):
        lex = Lexer(self.data, at)
        num, gen, word = lex.next(), lex.next(), lex.next()
        if word != "obj":
            raise PdfError("Format", f"no object at {at}")
        x = lex.next()
        if isinstance(x, dict):
            m = re.compile(rb"\s*stream(\r\n|\n|\r)?").match(self.data, lex.at)
            if m:
                length = self.get(x.get("Length")) if not isinstance(x.get("Length"), Ref) or self.places else None
                end = m.end() + length if isinstance(length, int) else -1
                if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                    found = re.compile(rb"\r?\n?endstream").search(self.data, m.end())
                    end = found.start() if found else len(self.data)
                return Stream(x, self.data[m.end() : end], (num, gen))
        if self.key and key:
            return self.key.strings(x, *key)
        return x

    def get(self, x):
        """What a reference leads to; a missing object is an error, a null place is None."""
        hops = 0
        while isinstance(x, Ref):
            hops += 1
            if hops > 32:
                raise PdfError("Format", "references run in a circle")
            if x.num not in self.cache:
                place = self.places.get(x.num)
                if place is None:
                    raise PdfError("Reference", f"object {x.num} is missing")
                if place[0] == 2:
                    s = self.get(Ref(place[1], 0))
                    lex = Lexer(data := self.decoded(s))
                    at = [lex.next() for _ in range(2 * s.head["N"])][1::2][place[2]]
                    self.cache[x.num] = Lexer(data, s.head["First"] + at).next()
                else:
                    self.cache[x.num] = self._object_at(place[1], (x.num, x.gen)) if place[0] == 1 else None
            x = self.cache[x.num]
        return x

    def dict(self, x) -> dict:
        x = self.get(x)
        if isinstance(x, Stream):
            return x.head
        if not isinstance(x, dict):
            raise PdfError("Type", "a dictionary is missing")
        return x

    def decoded(self, s: Stream) -> bytes:
        """A stream's bytes, filters undone; raw where that fails."""
        raw = s.raw
        if self.key and s.key and s.head.get("Type") != "XRef":
            raw = self.key.stream(raw, *s.key)
        return filters.decode(raw, self.get(s.head.get("Filter")), self.get(s.head.get("DecodeParms")), self.get)

    def pages(self) -> list[dict]:
        """Page dictionaries in order, each with what it inherits."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(x, given: dict) -> None:
            if isinstance(x, Ref):
                if x.num in seen:
                    return
                seen.add(x.num)
            node = self.dict(x)
            own = given | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            if "Kids" in node:
                for k in self.get(node["Kids"]) or []:
                    walk(k, own)
            else:
                out.append(own | node)

        walk(self.dict(self.trailer.get("Root")).get("Pages"), {})
        return out

    def content(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = c if isinstance(c, list) else [c] if c is not None else []
        return b"\n".join(self.decoded(s) for p in parts if isinstance(s := self.get(p), Stream))
