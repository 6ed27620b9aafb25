"""Metrics of the standard fonts: widths by code point, and the codes that a font has of its own."""

from __future__ import annotations

from functools import lru_cache

# fixed values: signs that the standard encoding has at 39 and 96, and from 161 on, by code
STANDARD_HIGH = {
    161: "exclamdown", 162: "cent", 163: "sterling", 164: "fraction", 165: "yen", 166: "florin", 167: "section", 168: "currency", 169: "quotesingle", 170: "quotedblleft", 171: "guillemotleft",
    172: "guilsinglleft", 173: "guilsinglright", 174: "fi", 175: "fl", 177: "endash", 178: "dagger", 179: "daggerdbl", 180: "periodcentered", 182: "paragraph", 183: "bullet", 184: "quotesinglbase",
    185: "quotedblbase", 186: "quotedblright", 187: "guillemotright", 188: "ellipsis", 189: "perthousand", 191: "questiondown", 193: "grave", 194: "acute", 195: "circumflex", 196: "tilde", 197: "macron",
    198: "breve", 199: "dotaccent", 200: "dieresis", 202: "ring", 203: "cedilla", 205: "hungarumlaut", 206: "ogonek", 207: "caron", 208: "emdash", 225: "AE", 227: "ordfeminine", 232: "Lslash", 233: "Oslash",
    234: "OE", 235: "ordmasculine", 241: "ae", 245: "dotlessi", 248: "lslash", 249: "oslash", 250: "oe", 251: "germandbls",
}
STANDARD_QUOTES = {39: "quoteright", 96: "quoteleft"}
# fixed values: signs without a code there, but for letters with accents
UNCODED = "divide commaaccent copyright lozenge Thorn threesuperior multiply partialdiff plusminus brokenbar registered summation greaterequal Eth Delta thorn twosuperior mu threequarters trademark onehalf lessequal onequarter degree radical minus logicalnot notequal eth onesuperior Euro".split()
# fixed values: widths in thousandths of the size: of the codes 32 to 126, of STANDARD_HIGH, of UNCODED
WIDTHS = {
    "Helvetica": (
        "278 278 355 556 556 889 667 222 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 222 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
        "333 556 556 167 556 556 556 556 191 333 556 333 333 500 500 556 556 556 278 537 350 222 333 333 556 1000 1000 611 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 1000 370 556 778 1000 365 889 278 222 611 944 611",
        "584 250 737 471 667 333 584 476 584 260 737 600 549 722 612 556 333 556 834 1000 834 549 834 400 453 584 584 549 556 333 556",
    ),
    "Helvetica-Bold": (
        "278 333 474 556 556 889 722 278 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 278 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
        "333 556 556 167 556 556 556 556 238 500 556 333 333 611 611 556 556 556 278 556 350 278 500 500 556 1000 1000 611 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 1000 370 611 778 1000 365 889 278 278 611 944 611",
        "584 250 737 494 667 333 584 494 584 280 737 600 549 722 612 611 333 611 834 1000 834 549 834 400 549 584 584 549 611 333 556",
    ),
    "Times-Roman": (
        "250 333 408 500 500 833 778 333 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
        "333 500 500 167 500 500 500 500 180 444 500 333 333 556 556 500 500 500 250 453 350 333 444 444 500 1000 1000 444 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 889 276 611 722 889 310 667 278 278 500 722 500",
        "564 250 760 471 556 300 564 476 564 200 760 600 549 722 612 500 300 500 750 980 750 549 750 400 453 564 564 549 500 300 500",
    ),
    "Times-Bold": (
        "250 333 555 500 500 1000 833 333 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
        "333 500 500 167 500 500 500 500 278 500 500 333 333 556 556 500 500 500 250 540 350 333 500 500 500 1000 1000 500 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 1000 300 667 778 1000 330 722 278 278 500 722 556",
        "570 250 747 494 611 300 570 494 570 220 747 600 549 722 612 556 300 556 750 1000 750 549 750 400 549 570 570 549 500 300 500",
    ),
    "Times-Italic": (
        "250 333 420 500 500 833 778 333 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541",
        "389 500 500 167 500 500 500 500 214 556 500 333 333 500 500 500 500 500 250 523 350 333 556 556 500 889 1000 500 333 333 333 333 333 333 333 333 333 333 333 333 333 889 889 276 556 722 944 310 667 278 278 500 667 500",
        "675 250 760 471 611 300 675 476 675 275 760 600 549 722 612 500 300 500 750 980 750 549 750 400 453 675 675 549 500 300 500",
    ),
    "Times-BoldItalic": (
        "250 389 555 500 500 833 778 333 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570",
        "389 500 500 167 500 500 500 500 278 500 500 333 333 556 556 500 500 500 250 500 350 333 500 500 500 1000 1000 500 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 944 266 611 722 944 300 722 278 278 500 722 500",
        "570 250 747 494 611 300 570 494 570 220 747 600 549 722 612 500 300 576 750 1000 750 549 750 400 549 606 606 549 500 300 500",
    ),
}
# fixed values: letters with accents that are not as wide as the bare ones
ODD = {
    "Helvetica": {"dcaron": 643, "tcaron": 317, "lcaron": 299} | dict.fromkeys(["iacute", "icircumflex", "idieresis", "igrave", "imacron"], 278),
    "Helvetica-Bold": {"dcaron": 743, "tcaron": 389, "lcaron": 400},
    "Times-Roman": {"dcaron": 588, "tcaron": 326, "lcaron": 344},
    "Times-Bold": {"dcaron": 672, "tcaron": 416, "lcaron": 394},
    "Times-Italic": {"dcaron": 544, "tcaron": 300, "lcaron": 300, "Lcaron": 611},
    "Times-BoldItalic": {"dcaron": 608, "tcaron": 366, "lcaron": 382},
}
# fixed values: letters with accents that the fonts have, by accent
ACCENTED = {
    "acute": "A C E I L N O R S U Y Z a c e i l n o r s u y z", "breve": "A G a g", "caron": "C D E L N R S T Z c d e l n r s t z", "cedilla": "C S c s", "circumflex": "A E I O U a e i o u",
    "commaaccent": "G K L N R S T g k l n r s t", "croat": "D d", "dieresis": "A E I O U Y a e i o u y", "dotaccent": "E I Z e z", "grave": "A E I O U a e i o u", "hungarumlaut": "O U o u",
    "macron": "A E I O U a e i o u", "ogonek": "A E I U a e i u", "ring": "A U a u", "tilde": "A N O a n o",
}
SAME = {"Helvetica-Oblique": "Helvetica", "Helvetica-BoldOblique": "Helvetica-Bold"}
CORE_FONTS = ["Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", *SAME, *WIDTHS, "Symbol", "ZapfDingbats"]

# fixed values: code points of Symbol's codes 32 to 126, 160 to 239 and 241 to 254, and their widths
SYMBOL_POINTS = (
    "0020 0021 2200 0023 2203 0025 0026 220B 0028 0029 2217 002B 002C 2212 002E 002F 0030 0031 0032 0033 0034 0035 0036 0037 0038 0039 "
    "003A 003B 003C 003D 003E 003F 2245 0391 0392 03A7 2206 0395 03A6 0393 0397 0399 03D1 039A 039B 039C 039D 039F 03A0 0398 03A1 03A3 "
    "03A4 03A5 03C2 2126 039E 03A8 0396 005B 2234 005D 22A5 005F F8E5 03B1 03B2 03C7 03B4 03B5 03C6 03B3 03B7 03B9 03D5 03BA 03BB 00B5 "
    "03BD 03BF 03C0 03B8 03C1 03C3 03C4 03C5 03D6 03C9 03BE 03C8 03B6 007B 007C 007D 223C 20AC 03D2 2032 2264 2044 221E 0192 2663 2666 "
    "2665 2660 2194 2190 2191 2192 2193 00B0 00B1 2033 2265 00D7 221D 2202 2022 00F7 2260 2261 2248 2026 F8E6 F8E7 21B5 2135 2111 211C "
    "2118 2297 2295 2205 2229 222A 2283 2287 2284 2282 2286 2208 2209 2220 2207 F6DA F6D9 F6DB 220F 221A 22C5 00AC 2227 2228 21D4 21D0 "
    "21D1 21D2 21D3 25CA 2329 F8E8 F8E9 F8EA 2211 F8EB F8EC F8ED F8EE F8EF F8F0 F8F1 F8F2 F8F3 F8F4 232A 222B 2320 F8F5 2321 F8F6 F8F7 "
    "F8F8 F8F9 F8FA F8FB F8FC F8FD F8FE"
)
SYMBOL_WIDTHS = (
    "250 333 713 500 549 833 778 439 333 333 500 549 250 549 250 278 500 500 500 500 500 500 500 500 500 500 "
    "278 278 549 549 549 444 549 722 667 722 612 611 763 603 722 333 631 722 686 889 722 722 768 741 556 592 "
    "611 690 439 768 645 795 611 333 863 333 658 500 500 631 549 549 494 439 521 411 603 329 603 549 549 576 "
    "521 549 549 521 549 603 439 576 713 686 493 686 494 480 200 480 549 750 620 247 549 167 713 500 753 753 "
    "753 753 1042 987 603 987 603 400 549 411 549 549 713 494 460 549 549 549 549 1000 603 1000 658 823 686 795 "
    "987 768 768 823 768 768 713 713 713 713 713 713 713 768 713 790 790 890 823 549 250 713 603 603 1042 987 "
    "603 987 603 494 329 790 790 786 713 384 384 384 384 384 384 494 494 494 494 329 274 686 686 686 384 384 "
    "384 384 384 384 494 494 494"
)
# fixed values: widths of ZapfDingbats' codes 32 to 126, 128 to 141, 161 to 239 and 241 to 254
ZAPF_WIDTHS = (
    "278 974 961 974 980 719 789 790 791 690 960 939 549 855 911 933 911 945 974 755 846 762 761 571 677 763 "
    "760 759 754 494 552 537 577 692 786 788 788 790 793 794 816 823 789 841 823 833 816 831 923 744 723 749 "
    "790 792 695 776 768 792 759 707 708 682 701 826 815 789 789 707 687 696 689 786 787 713 791 785 791 873 "
    "761 762 762 759 759 892 892 788 784 438 138 277 415 392 392 668 668 390 390 317 317 276 276 509 509 410 "
    "410 234 234 334 334 732 544 544 910 667 760 760 776 595 694 626 788 788 788 788 788 788 788 788 788 788 "
    "788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 "
    "788 788 788 788 894 838 1016 458 748 924 748 918 927 928 928 834 873 828 924 924 917 930 931 463 883 836 "
    "836 867 867 696 696 874 874 760 946 771 865 771 888 967 888 831 873 927 970 918"
)
# fixed values: signs of ZapfDingbats that stand elsewhere than the rest of their run
ZAPF_ELSEWHERE = {32: 0x20, 37: 0x260E, 42: 0x261B, 43: 0x261E, 72: 0x2605, 108: 0x25CF, 110: 0x25A0, 115: 0x25B2, 116: 0x25BC, 117: 0x25C6, 119: 0x25D7, 168: 0x2663, 169: 0x2666, 170: 0x2665, 171: 0x2660, 213: 0x2192, 214: 0x2194, 215: 0x2195}
# fixed values: code:point of MacExpertEncoding
MAC_EXPERT = (
    "20:0020 21:F721 22:F6F8 23:F7A2 24:F724 25:F6E4 26:F726 27:F7B4 28:207D 29:207E 2A:2025 2B:2024 2C:002C 2D:002D 2E:002E 2F:2044 30:F730 31:F731 "
    "32:F732 33:F733 34:F734 35:F735 36:F736 37:F737 38:F738 39:F739 3A:003A 3B:003B 3D:F6DE 3F:F73F 44:F7F0 47:00BC 48:00BD 49:00BE 4A:215B 4B:215C "
    "4C:215D 4D:215E 4E:2153 4F:2154 56:FB00 57:FB01 58:FB02 59:FB03 5A:FB04 5B:208D 5D:208E 5E:F6F6 5F:F6E5 60:F760 61:F761 62:F762 63:F763 64:F764 "
    "65:F765 66:F766 67:F767 68:F768 69:F769 6A:F76A 6B:F76B 6C:F76C 6D:F76D 6E:F76E 6F:F76F 70:F770 71:F771 72:F772 73:F773 74:F774 75:F775 76:F776 "
    "77:F777 78:F778 79:F779 7A:F77A 7B:20A1 7C:F6DC 7D:F6DD 7E:F6FE 81:F6E9 82:F6E0 87:F7E1 88:F7E0 89:F7E2 8A:F7E4 8B:F7E3 8C:F7E5 8D:F7E7 8E:F7E9 "
    "8F:F7E8 90:F7EA 91:F7EB 92:F7ED 93:F7EC 94:F7EE 95:F7EF 96:F7F1 97:F7F3 98:F7F2 99:F7F4 9A:F7F6 9B:F7F5 9C:F7FA 9D:F7F9 9E:F7FB 9F:F7FC A1:2078 "
    "A2:2084 A3:2083 A4:2086 A5:2088 A6:2087 A7:F6FD A9:F6DF AA:2082 AC:F7A8 AE:F6F5 AF:F6F0 B0:2085 B2:F6E1 B3:F6E7 B4:F7FD B6:F6E3 B9:F7FE BB:2089 "
    "BC:2080 BD:F6FF BE:F7E6 BF:F7F8 C0:F7BF C1:2081 C2:F6F9 C9:F7B8 CF:F6FA D0:2012 D1:F6E6 D6:F7A1 D8:F7FF DA:00B9 DB:00B2 DC:00B3 DD:2074 DE:2075 "
    "DF:2076 E0:2077 E1:2079 E2:2070 E4:F6EC E5:F6F1 E6:F6F3 E9:F6ED EA:F6F2 EB:F6EB F1:F6EE F2:F6FB F3:F6F4 F4:F7AF F5:F6EA F6:207F F7:F6EF F8:F6E2 "
    "F9:F6E8 FA:F6F7 FB:F6FC"
)


def _zapf_point(code: int) -> int:
    if code in ZAPF_ELSEWHERE:
        return ZAPF_ELSEWHERE[code]
    if 172 <= code <= 181:
        return 0x2460 + code - 172
    return code + (0x2701 - 33 if code < 128 else 0x2768 - 128 if code < 161 else 0x2761 - 161)


def standard_names() -> dict[int, str]:
    """The standard encoding: code to name."""
    from foliospark.functions import tables

    return dict(enumerate(tables.ascii_names(), 32)) | STANDARD_QUOTES | STANDARD_HIGH


@lru_cache(maxsize=16)
def core_codes(font: str) -> dict[int, tuple[int, int]]:
    """A standard font's own codes: code point and width of each."""
    from foliospark.functions import tables

    if font == "Symbol":
        codes = [*range(32, 127), *range(160, 240), *range(241, 255)]
        return {c: (int(p, 16), int(w)) for c, p, w in zip(codes, SYMBOL_POINTS.split(), SYMBOL_WIDTHS.split(), strict=True)}
    if font == "ZapfDingbats":
        codes = [*range(32, 127), *range(128, 142), *range(161, 240), *range(241, 255)]
        return {c: (_zapf_point(c), int(w)) for c, w in zip(codes, ZAPF_WIDTHS.split(), strict=True)}
    names, points = standard_names(), tables.glyph_names()
    if font.startswith("Courier"):
        return {c: (points[n], 600) for c, n in names.items()}
    low, high, _ = WIDTHS[SAME.get(font, font)]
    widths = dict(zip([*range(32, 127), *STANDARD_HIGH], map(int, f"{low} {high}".split()), strict=True))
    return {c: (points[n], widths[c]) for c, n in names.items()}


@lru_cache(maxsize=16)
def core_widths(font: str) -> dict[int, int]:
    """Code point to width of a standard font, whether it has a code for it or not; none for other fonts."""
    from foliospark.functions import tables

    if font not in CORE_FONTS:
        return {}
    out = dict(core_codes(font).values())
    if font in ("Symbol", "ZapfDingbats"):
        return out | ({0xF8FF: 790} if font == "Symbol" else {})
    points = tables.glyph_names()
    family, courier = SAME.get(font, font), font.startswith("Courier")
    bare = {n: w for _, (p, w) in core_codes(font).items() for n in [chr(p)]}
    for name, width in zip(UNCODED, [600] * len(UNCODED) if courier else map(int, WIDTHS[family][2].split()), strict=True):
        out[points[name]] = width
    for accent, letters in ACCENTED.items():
        for letter in letters.split():
            name = letter + accent
            out[points[name]] = bare[letter] if courier else ODD[family].get(name, bare[letter])
    return out


def mac_expert() -> list[int]:
    out = [0] * 256
    for item in MAC_EXPERT.split():
        code, point = item.split(":")
        out[int(code, 16)] = int(point, 16)
    return out
