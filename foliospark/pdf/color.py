"""Colour spaces and tint functions: parsed, not evaluated."""

from __future__ import annotations

from foliospark.pdf.objects import Document, Name, PdfError, Stream

DEVICE = {"DeviceGray": "DeviceGray", "DeviceRGB": "DeviceRGB", "DeviceCMYK": "DeviceCMYK", "Pattern": "Pattern", "RGB": "DeviceRGB", "G": "DeviceGray"}
#: Parameters of spaces by measured light, with the lengths of those that must be there.
MEASURED = {"CalGray": {"WhitePoint": 3}, "CalRGB": {"WhitePoint": 3}, "Lab": {"WhitePoint": 3}}


def _numbers(doc: Document, x) -> list[float] | None:
    x = doc.get(x)
    return [float(doc.get(v)) for v in x] if isinstance(x, list) else None


def function(doc: Document, x) -> dict:
    """Sampled (0) and exponential (2) functions; defaults filled in."""
    x = doc.get(x)
    head = x.head if isinstance(x, Stream) else x
    kind = doc.get(head.get("FunctionType"))
    if kind == 0:
        size = [int(v) for v in _numbers(doc, head["Size"])]
        ranges = _numbers(doc, head["Range"])
        return {
            "type": 0, "domain": _numbers(doc, head["Domain"]), "range": ranges, "size": size, "bits": doc.get(head["BitsPerSample"]),
            "encode": _numbers(doc, head.get("Encode")) or [v for n in size for v in (0.0, float(n - 1))], "decode": _numbers(doc, head.get("Decode")) or ranges, "samples": doc.decoded(x),
        }
    if kind == 2:
        return {"type": 2, "c0": _numbers(doc, head.get("C0")) or [0.0], "c1": _numbers(doc, head.get("C1")) or [1.0], "n": float(doc.get(head["N"]))}
    raise PdfError("Function", f"function type {kind} is not taken")


def colorspace(doc: Document, name: str, resources: dict) -> dict:
    """kind and parameters of a named colour space; what is not taken has the kind `unsupported`."""
    if name in DEVICE and name not in ("RGB", "G"):
        return {"kind": DEVICE[name]}
    spaces = doc.dict(resources.get("ColorSpace", {}))
    if name not in spaces:
        raise PdfError("ColorSpace", f"colour space {name} is missing")
    return parsed(doc, spaces[name])


def parsed(doc: Document, x, inside: tuple = ()) -> dict:
    """inside: the spaces that this one is the alternate of; one that is its own is not supported."""
    x = doc.get(x)
    if isinstance(x, Name):
        return {"kind": DEVICE.get(str(x), "unsupported")}
    if not isinstance(x, list) or not x or any(x is y for y in inside):
        return {"kind": "unsupported"}
    kind = str(doc.get(x[0]))
    if kind == "Separation":
        alternate = parsed(doc, x[2], (*inside, x))
        return {"kind": kind, "name": str(doc.get(x[1])), "alternate": alternate["kind"], "tint": function(doc, x[3])}
    if kind == "ICCBased":
        return {"kind": kind, "icc": doc.decoded(doc.get(x[1]))}
    if kind in MEASURED:
        p = doc.dict(x[1])
        for key, n in MEASURED[kind].items():
            if len(_numbers(doc, p.get(key)) or []) < n:
                raise PdfError("ColorSpace", f"{kind} has no {key}")
        gamma = doc.get(p.get("Gamma"))
        return {"kind": kind, "white_point": _numbers(doc, p["WhitePoint"]), "black_point": _numbers(doc, p.get("BlackPoint")), "gamma": [float(gamma)] if isinstance(gamma, (int, float)) else _numbers(doc, gamma) if gamma else None, "matrix": _numbers(doc, p.get("Matrix")), "range": _numbers(doc, p.get("Range"))}
    return {"kind": DEVICE.get(kind, "unsupported")}
