"""Character tables: encodings and glyph names. Metrics of standard fonts are in metrics.

What a rule gives is built by the rule: encodings from Python's codecs, names of letters from Unicode names. More glyph
names and metrics come as parameters: a file of `name;hex` lines, a dictionary of widths.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from foliospark.functions import metrics

# fixed values: where PDFDocEncoding departs from Latin-1, 0 for unassigned
PDFDOC = {
    0x00: 0, 0x18: 0x02D8, 0x19: 0x02C7, 0x1A: 0x02C6, 0x1B: 0x02D9, 0x1C: 0x02DD, 0x1D: 0x02DB, 0x1E: 0x02DA, 0x1F: 0x02DC, 0x7F: 0,
    0x80: 0x2022, 0x81: 0x2020, 0x82: 0x2021, 0x83: 0x2026, 0x84: 0x2014, 0x85: 0x2013, 0x86: 0x0192, 0x87: 0x2044,
    0x88: 0x2039, 0x89: 0x203A, 0x8A: 0x2212, 0x8B: 0x2030, 0x8C: 0x201E, 0x8D: 0x201C, 0x8E: 0x201D, 0x8F: 0x2018,
    0x90: 0x2019, 0x91: 0x201A, 0x92: 0x2122, 0x93: 0xFB01, 0x94: 0xFB02, 0x95: 0x0141, 0x96: 0x0152, 0x97: 0x0160,
    0x98: 0x0178, 0x99: 0x017D, 0x9A: 0x0131, 0x9B: 0x0142, 0x9C: 0x0153, 0x9D: 0x0161, 0x9E: 0x017E, 0x9F: 0, 0xA0: 0x20AC, 0xAD: 0,
}
# fixed values: where WinAnsi and MacRoman depart from Python's codecs
WIN_ANSI = {0x7F: 0x2022, 0x81: 0x2022, 0x8D: 0x2022, 0x8F: 0x2022, 0x90: 0x2022, 0x9D: 0x2022, 0xA0: 0x0020, 0xAD: 0x002D}
MAC_ROMAN = {0x7F: 0, 0xBD: 0x2126, 0xCA: 0x0020, 0xDB: 0x00A4}
# fixed values: names of ASCII signs in order, and of signs outside ASCII
ASCII_NAMES = "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at".split()
ASCII_NAMES_2, ASCII_NAMES_3 = "bracketleft backslash bracketright asciicircum underscore grave".split(), "braceleft bar braceright asciitilde".split()
LATIN_NAMES = dict(zip("exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot softhyphen registered macron degree plusminus twosuperior threesuperior acute mu paragraph periodcentered cedilla onesuperior ordmasculine guillemotright onequarter onehalf threequarters questiondown".split(), range(0xA1, 0xC0), strict=True))
OTHER_NAMES = {
    "AE": 0xC6, "ae": 0xE6, "Eth": 0xD0, "eth": 0xF0, "Thorn": 0xDE, "thorn": 0xFE, "germandbls": 0xDF, "multiply": 0xD7, "divide": 0xF7,
    "Aring": 0xC5, "aring": 0xE5, "Oslash": 0xD8, "oslash": 0xF8, "dotlessi": 0x131, "Lslash": 0x141, "lslash": 0x142, "OE": 0x152, "oe": 0x153,
    "florin": 0x192, "circumflex": 0x2C6, "caron": 0x2C7, "breve": 0x2D8, "dotaccent": 0x2D9, "ring": 0x2DA, "ogonek": 0x2DB, "tilde": 0x2DC, "hungarumlaut": 0x2DD,
    "endash": 0x2013, "emdash": 0x2014, "quoteleft": 0x2018, "quoteright": 0x2019, "quotesinglbase": 0x201A, "quotedblleft": 0x201C, "quotedblright": 0x201D, "quotedblbase": 0x201E,
    "dagger": 0x2020, "daggerdbl": 0x2021, "bullet": 0x2022, "ellipsis": 0x2026, "perthousand": 0x2030, "guilsinglleft": 0x2039, "guilsinglright": 0x203A,
    "fraction": 0x2044, "Euro": 0x20AC, "trademark": 0x2122, "Omega": 0x2126, "Delta": 0x2206, "minus": 0x2212, "infinity": 0x221E, "notequal": 0x2260, "lessequal": 0x2264, "greaterequal": 0x2265,
    "partialdiff": 0x2202, "summation": 0x2211, "product": 0x220F, "radical": 0x221A, "integral": 0x222B, "approxequal": 0x2248, "lozenge": 0x25CA, "fi": 0xFB01, "fl": 0xFB02, "mapsto": 0x21A6,
}
ACCENTS = {"ACUTE": "acute", "GRAVE": "grave", "CIRCUMFLEX": "circumflex", "DIAERESIS": "dieresis", "TILDE": "tilde", "CARON": "caron", "CEDILLA": "cedilla", "BREVE": "breve", "MACRON": "macron", "OGONEK": "ogonek", "DOT ABOVE": "dotaccent", "RING ABOVE": "ring", "DOUBLE ACUTE": "hungarumlaut"}
# fixed values: names of more signs
MORE_NAMES = {
    "Gcommaaccent": 0x122, "gcommaaccent": 0x123, "Kcommaaccent": 0x136, "kcommaaccent": 0x137, "Lcommaaccent": 0x13B, "lcommaaccent": 0x13C, "Ncommaaccent": 0x145, "ncommaaccent": 0x146,
    "Rcommaaccent": 0x156, "rcommaaccent": 0x157, "Scommaaccent": 0x218, "scommaaccent": 0x219, "Tcommaaccent": 0x162, "tcommaaccent": 0x163, "Dcroat": 0x110, "dcroat": 0x111, "Hbar": 0x126, "hbar": 0x127,
    "IJ": 0x132, "ij": 0x133, "kgreenlandic": 0x138, "Ldot": 0x13F, "ldot": 0x140, "napostrophe": 0x149, "Eng": 0x14A, "eng": 0x14B, "Tbar": 0x166, "tbar": 0x167, "longs": 0x17F, "Idot": 0x130, "dotlessj": 0xF6BE,
    "ff": 0xFB00, "ffi": 0xFB03, "ffl": 0xFB04, "f_f": 0xFB00, "f_i": 0xFB01, "f_l": 0xFB02, "f_f_i": 0xFB03, "f_f_l": 0xFB04, "nbspace": 0xA0, "nonbreakingspace": 0xA0, "sfthyphen": 0xAD, "middot": 0xB7, "mu1": 0xB5,
    "commaaccent": 0xF6C3, "Delta": 0x2206, "increment": 0x2206, "Omega": 0x2126, "Ohm": 0x2126, "Deltagreek": 0x394, "Omegagreek": 0x3A9, "mugreek": 0x3BC, "sigma1": 0x3C2, "sigmafinal": 0x3C2, "theta1": 0x3D1, "phi1": 0x3D5, "omega1": 0x3D6, "Upsilon1": 0x3D2,
    "figuredash": 0x2012, "afii00208": 0x2015, "onedotenleader": 0x2024, "twodotenleader": 0x2025, "minute": 0x2032, "second": 0x2033, "primereversed": 0x2035, "exclamdbl": 0x203C, "colonmonetary": 0x20A1, "franc": 0x20A3, "lira": 0x20A4, "peseta": 0x20A7, "won": 0x20A9, "newsheqelsign": 0x20AA, "dong": 0x20AB,
    "onethird": 0x2153, "twothirds": 0x2154, "oneeighth": 0x215B, "threeeighths": 0x215C, "fiveeighths": 0x215D, "seveneighths": 0x215E, "estimated": 0x212E, "Ifraktur": 0x2111, "Rfraktur": 0x211C, "weierstrass": 0x2118, "aleph": 0x2135, "prescription": 0x211E,
    "arrowleft": 0x2190, "arrowup": 0x2191, "arrowright": 0x2192, "arrowdown": 0x2193, "arrowboth": 0x2194, "arrowupdn": 0x2195, "arrowupdnbse": 0x21A8, "carriagereturn": 0x21B5, "arrowdblleft": 0x21D0, "arrowdblup": 0x21D1, "arrowdblright": 0x21D2, "arrowdbldown": 0x21D3, "arrowdblboth": 0x21D4,
    "universal": 0x2200, "existential": 0x2203, "emptyset": 0x2205, "gradient": 0x2207, "nabla": 0x2207, "element": 0x2208, "notelement": 0x2209, "suchthat": 0x220B, "asteriskmath": 0x2217, "bulletoperator": 0x2219, "proportional": 0x221D, "orthogonal": 0x221F, "angle": 0x2220,
    "logicaland": 0x2227, "logicalor": 0x2228, "intersection": 0x2229, "union": 0x222A, "therefore": 0x2234, "similar": 0x223C, "congruent": 0x2245, "equivalence": 0x2261, "propersubset": 0x2282, "propersuperset": 0x2283, "notsubset": 0x2284, "reflexsubset": 0x2286, "reflexsuperset": 0x2287,
    "circleplus": 0x2295, "circlemultiply": 0x2297, "perpendicular": 0x22A5, "dotmath": 0x22C5, "house": 0x2302, "revlogicalnot": 0x2310, "integraltp": 0x2320, "integralbt": 0x2321, "angleleft": 0x2329, "angleright": 0x232A,
    "upblock": 0x2580, "dnblock": 0x2584, "block": 0x2588, "lfblock": 0x258C, "rtblock": 0x2590, "ltshade": 0x2591, "shade": 0x2592, "dkshade": 0x2593, "filledbox": 0x25A0, "filledrect": 0x25AC, "triagup": 0x25B2, "triagrt": 0x25BA, "triagdn": 0x25BC, "triaglf": 0x25C4, "circle": 0x25CB,
    "invbullet": 0x25D8, "openbullet": 0x25E6, "smileface": 0x263A, "invsmileface": 0x263B, "sun": 0x263C, "female": 0x2640, "male": 0x2642, "spade": 0x2660, "club": 0x2663, "heart": 0x2665, "diamond": 0x2666, "musicalnote": 0x266A, "musicalnotedbl": 0x266B, "apple": 0xF8FF,
}
# fixed values: accents of two words and more, as in names of signs
FURTHER_ACCENTS = {"HOOK ABOVE": "hookabove", "DOT BELOW": "dotbelow", "LINE BELOW": "linebelow", "RING BELOW": "ringbelow", "TILDE BELOW": "tildebelow", "CIRCUMFLEX BELOW": "circumflexbelow", "DIAERESIS BELOW": "dieresisbelow", "DOUBLE GRAVE": "dblgrave", "INVERTED BREVE": "invertedbreve", "HORN": "horn", "HOOK": "hook"}
# fixed values: first and last Unicode value of a run, and the number of its first name afii
AFII = [(0x410, 0x415, 10017), (0x401, 0x401, 10023), (0x416, 0x42F, 10024), (0x490, 0x490, 10050), (0x402, 0x40C, 10051), (0x40E, 0x40E, 10062), (0x40F, 0x40F, 10145), (0x430, 0x435, 10065), (0x451, 0x451, 10071), (0x436, 0x44F, 10072), (0x491, 0x491, 10098), (0x452, 0x45C, 10099), (0x45E, 0x45E, 10110), (0x45F, 0x45F, 10193), (0x5D0, 0x5EA, 57664), (0x660, 0x669, 57392), (0x621, 0x63A, 57409), (0x640, 0x64A, 57440), (0x64B, 0x652, 57451), (0x60C, 0x60C, 57388), (0x2116, 0x2116, 61352)]
SMALL_SIGNS = {"exclam": 0xF721, "ampersand": 0xF726, "question": 0xF73F, "Grave": 0xF760, "exclamdown": 0xF7A1, "Dieresis": 0xF7A8, "Macron": 0xF7AF, "Acute": 0xF7B4, "Cedilla": 0xF7B8, "questiondown": 0xF7BF, "Ydieresis": 0xF7FF, "Breve": 0xF6F4, "Caron": 0xF6F5, "Circumflex": 0xF6F6, "Dotaccent": 0xF6F7, "Hungarumlaut": 0xF6F8, "Lslash": 0xF6F9, "OE": 0xF6FA, "Ogonek": 0xF6FB, "Ring": 0xF6FC, "Scaron": 0xF6FD, "Tilde": 0xF6FE, "Zcaron": 0xF6FF}
DIGITS = "zero one two three four five six seven eight nine".split()


def ascii_names() -> list[str]:
    """Names of the signs 32 to 126."""
    return [*ASCII_NAMES, *map(chr, range(0x41, 0x5B)), *ASCII_NAMES_2, *map(chr, range(0x61, 0x7B)), *ASCII_NAMES_3]


def _codec(name: str, changes: dict[int, int]) -> list[int]:
    out = []
    for b in range(256):
        c = bytes([b]).decode(name, "ignore")
        out.append(changes.get(b, ord(c) if c and b >= 32 else 0))
    return out


@lru_cache(maxsize=8)
def encoding(name: str) -> tuple[int, ...]:
    """256 code points, 0 for unassigned, of a named encoding. Names other than these raise KeyError."""
    if name == "PDFDocEncoding":
        return tuple(PDFDOC.get(b, b) for b in range(256))
    if name == "MacExpertEncoding":
        return tuple(metrics.mac_expert())
    return tuple({"WinAnsiEncoding": lambda: _codec("cp1252", WIN_ANSI), "MacRomanEncoding": lambda: _codec("mac_roman", MAC_ROMAN)}[name]())


def _accented(first: int, last: int) -> dict[str, int]:
    """Names of Latin letters with up to two accents, from Unicode's: Acircumflexacute."""
    marks, out = ACCENTS | FURTHER_ACCENTS, {}
    for c in range(first, last):
        name = unicodedata.name(chr(c), "")
        for case, letter in (("CAPITAL", str.upper), ("SMALL", str.lower)):
            head = f"LATIN {case} LETTER "
            if name.startswith(head) and " WITH " in name:
                base, _, tail = name[len(head) :].partition(" WITH ")
                parts = tail.split(" AND ")
                if len(base) == 1 and all(p in marks for p in parts):
                    out.setdefault(letter(base) + "".join(marks[p] for p in parts), c)
    return out


def _by_script() -> dict[str, int]:
    """Names of Greek, Cyrillic, Hebrew, Arabic and Japanese letters, by rule."""
    out = {}
    for c in range(0x386, 0x3CF):
        words = unicodedata.name(chr(c), "").split(" ")
        if words[:1] == ["GREEK"] and words[2:3] == ["LETTER"] and words[3] not in ("FINAL", "DIGAMMA"):
            name = words[3].capitalize() if words[1] == "CAPITAL" else words[3].lower()
            marks = {"WITH": "", "AND": "", "TONOS": "tonos", "DIALYTIKA": "dieresis"}
            out.setdefault(("L" if name[0] == "L" else "l") + "ambda" if name.lower() == "lamda" else name, c) if len(words) == 4 else out.setdefault(name + "".join(marks.get(w, w) for w in words[4:]), c)
    for low, high, n in AFII:
        out |= {f"afii{n + i}": c for i, c in enumerate(range(low, high + 1))}
    for c in [*range(0x410, 0x450)]:
        words = unicodedata.name(chr(c)).split(" ")
        name = {"SHORT I": "iishort", "HARD SIGN": "hardsign", "SOFT SIGN": "softsign", "I": "ii", "E": "ereversed", "YERU": "yeri"}.get(" ".join(words[3:]), words[3].lower())
        name = {"yu": "iu", "ya": "ia", "ie": "ie"}.get(name, name)
        out[(name.capitalize() if words[1] == "CAPITAL" else name) + "cyrillic"] = c
    for c in [*range(0x3041, 0x3095), *range(0x30A1, 0x30F7), *range(0xFF66, 0xFF9E)]:
        words = unicodedata.name(chr(c), "").split(" ")
        if "LETTER" in words:
            sound = words[-1].lower() + ("small" if "SMALL" in words else "")
            script = "hiragana" if "HIRAGANA" in words else "katakana"
            out[sound + script + ("halfwidth" if words[0] == "HALFWIDTH" else "")] = c
    return out


def _by_form(names: dict[str, int]) -> dict[str, int]:
    """Names of signs of another form: full width, in circles or brackets, small capitals, raised and lowered."""
    out = {f"{n}monospace": 0xFF01 + i for i, n in enumerate(ascii_names()[1:])}
    for i in range(26):
        upper, lower = chr(65 + i), chr(97 + i)
        out |= {f"{upper}circle": 0x24B6 + i, f"{lower}circle": 0x24D0 + i, f"{lower}paren": 0x249C + i, f"{upper}small": 0xF761 + i}
    # small capitals of Latin-1 letters: their small letters' values from F700 on
    out |= {f"{n}small": 0xF700 + c + 32 for n, c in names.items() if 0xC0 <= c <= 0xDE and c != 0xD7}
    out |= {f"{n}small": c for n, c in SMALL_SIGNS.items()}
    teens = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    for i, n in enumerate([*DIGITS[1:], *teens]):
        out |= {f"{n}circle": 0x2460 + i, f"{n}paren": 0x2474 + i, f"{n}period": 0x2488 + i}
    for i, n in enumerate(DIGITS):
        out |= {f"{n}oldstyle": 0xF730 + i, f"{n}inferior": 0x2080 + i}
        out.setdefault(f"{n}superior", {1: 0xB9, 2: 0xB2, 3: 0xB3}.get(i, 0x2070 + i))
    return out


@lru_cache(maxsize=4)
def glyph_names(path: str | None = None) -> dict[str, int]:
    """Glyph name to code point, by rules and fixed values; path: a file of further `name;hex` lines, of which the rules'
    names keep theirs."""
    out = dict(zip(ascii_names(), range(0x20, 0x7F), strict=True)) | LATIN_NAMES | OTHER_NAMES
    for more in (_accented(0xC0, 0x250), _accented(0x1E00, 0x1F00), MORE_NAMES, _by_script(), _by_form(out | _accented(0xC0, 0x100))):
        for name, c in more.items():
            out.setdefault(name, c)
    if path:
        with open(path, encoding="ascii") as f:
            for line in f:
                name, _, code = line.strip().partition(";")
                if name and not name.startswith("#"):
                    out.setdefault(name, int(code.split()[-1], 16))
    return out
