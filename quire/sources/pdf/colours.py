"""Colour spaces of a file: components to red, green and blue in 0 to 1, from the published formulas."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field
from typing import Any

from quire.functions import formcalc
from quire.functions.colour import CMYK, CMYK_TERMS
from quire.sources.pdf.objects import File, Stream

RGB = tuple[float, float, float]
MOST_DEPTH = 6
_DEVICE = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}
#: XYZ to linear sRGB, of light as profiles have it (D50) and as CalRGB's is taken (D65). Fixed values.
_D50 = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
_D65 = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def unit(x: float) -> float:
    return 0.0 if x != x else min(1.0, max(0.0, x))


def cmyk(c: float, m: float, y: float, k: float) -> RGB:
    v = dict(zip("cmyk", map(unit, (c, m, y, k)), strict=True))
    terms = [math.prod(v[x] for x in t) for t in CMYK_TERMS]
    return tuple(unit((255 + sum(a * t for a, t in zip(row, terms, strict=True))) / 255) for row in CMYK)


def shown(v: float) -> float:
    """sRGB's transfer of a linear value."""
    v = unit(v)
    return 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055


def _xyz(xyz: list[float], matrix) -> RGB:
    return tuple(shown(sum(a * x for a, x in zip(row, xyz, strict=True))) for row in matrix)


@dataclass
class Space:
    kind: str
    n: int
    base: Space | None = None
    gamma: list[float] = field(default_factory=lambda: [1.0, 1.0, 1.0])
    matrix: list[float] = field(default_factory=lambda: [1.0, 0, 0, 0, 1, 0, 0, 0, 1])
    white: list[float] = field(default_factory=lambda: [0.9505, 1.0, 1.089])
    range: list[float] = field(default_factory=lambda: [-100.0, 100.0, -100.0, 100.0])
    table: bytes = b""
    tint: Any = None
    profile: Any = None

    def rgb(self, v: list[float]) -> RGB | None:
        """None where there are too few components, or no colour (a pattern)."""
        if self.kind == "Pattern" or len(v) < self.n:
            return None
        v = v[-self.n :]
        if self.kind == "Indexed":
            at = min(max(0, int(v[0])), max(0, len(self.table) // self.base.n - 1)) * self.base.n
            row = [x / 255 for x in self.table[at : at + self.base.n]]
            if self.base.kind == "Lab":
                lo = [0.0, self.base.range[0], self.base.range[2]]
                hi = [100.0, self.base.range[1], self.base.range[3]]
                row = [a + x * (b - a) for x, a, b in zip(row, lo, hi, strict=False)]
            return self.base.rgb(row)
        if self.kind == "Tint":
            got = self.tint(v) if self.tint else None
            return self.base.rgb(got) if got else (1 - unit(v[0]),) * 3
        if self.kind == "Lab":
            f = (v[0] + 16) / 116
            back = [t**3 if t >= 6 / 29 else 108 / 841 * (t - 4 / 29) for t in (f + v[1] / 500, f, f - v[2] / 200)]
            return _xyz([w * t for w, t in zip((0.9505, 1.0, 1.089), back, strict=True)], _D65)
        if self.kind == "CalRGB":
            a = [unit(x) ** g for x, g in zip(v, self.gamma, strict=True)]
            return _xyz([sum(a[i] * self.matrix[3 * i + k] for i in range(3)) for k in range(3)], _D65)
        if self.profile:
            return self.profile(v)
        return cmyk(*v) if self.n == 4 else tuple(map(unit, v)) if self.n == 3 else (unit(v[0]),) * 3


def device(n: int) -> Space:
    return Space("Device", n)


def space(f: File, v: Any, resources: Any = None, depth: int = 0) -> Space:
    """The space that a name or array stands for; what cannot be read is taken for grey."""
    v = f.get(v)
    if isinstance(v, str):
        if v in _DEVICE:
            return device(_DEVICE[v])
        if v == "Pattern":
            return Space("Pattern", 0)
        named = f.at(f.at(resources, "ColorSpace"), str(v))
        return space(f, named, resources, depth + 1) if named is not None and depth < MOST_DEPTH else device(1)
    if not isinstance(v, list) or not v or depth >= MOST_DEPTH:
        return device(1)
    kind, rest = str(f.get(v[0])), v[1:]
    numbers = lambda d, key, default: [float(x) for y in (f.at(d, key) or []) if isinstance(x := f.get(y), int | float)] or default
    if kind == "ICCBased" and rest:
        s = f.get(rest[0])
        n = int(f.at(s, "N", 3) or 3)
        return Space("ICC", n if n in (1, 3, 4) else 3, profile=profile(f.decoded(s), n) if isinstance(s, Stream) else None)
    if kind == "CalRGB" and rest:
        out = Space("CalRGB", 3, gamma=numbers(rest[0], "Gamma", [1.0] * 3), matrix=numbers(rest[0], "Matrix", [1.0, 0, 0, 0, 1, 0, 0, 0, 1]))
        return out if len(out.gamma) == 3 and len(out.matrix) == 9 else device(3)
    if kind == "Lab" and rest:
        return Space("Lab", 3, range=(numbers(rest[0], "Range", []) + [-100.0, 100.0, -100.0, 100.0])[:4])
    if kind in ("Indexed", "I") and len(rest) >= 3:
        table = f.get(rest[2])
        base = space(f, rest[0], resources, depth + 1)
        return Space("Indexed", 1, base=base if base.n else device(3), table=f.decoded(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b"")
    if kind in ("Separation", "DeviceN") and len(rest) >= 3:
        names = f.get(rest[0])
        n = len(names) if kind == "DeviceN" and isinstance(names, list) else 1
        return Space("Tint", n, base=space(f, rest[1], resources, depth + 1), tint=function(f, rest[2]))
    if kind == "Pattern":
        return Space("Pattern", 0)
    return device(_DEVICE.get(kind, 1))


def function(f: File, v: Any):
    """A function of numbers to numbers, of types 0 (sampled), 2, 3 and 4; None if it cannot be read."""
    o = f.get(v)
    d = o.head if isinstance(o, Stream) else o
    if not isinstance(d, dict):
        return None
    numbers = lambda key: [float(x) for y in (f.get(d.get(key)) or []) if isinstance(x := f.get(y), int | float)]
    kind, domain = f.get(d.get("FunctionType")), numbers("Domain") or [0.0, 1.0]
    if kind == 2:
        c0, c1, n = numbers("C0") or [0.0], numbers("C1") or [1.0], float(f.get(d.get("N"), 1))
        return lambda x: formcalc.exponential(min(max(x[0], domain[0]), domain[1]), c0, c1, n)
    if kind == 3:
        parts = [function(f, x) for x in f.get(d.get("Functions")) or []]
        if not parts or None in parts:
            return None
        bounds, encode = numbers("Bounds"), numbers("Encode") or [0.0, 1.0] * len(parts)
        single = [lambda t, p=p: p([t]) for p in parts]
        return lambda x: formcalc.stitched(x[0], (domain[0], domain[1]), bounds, encode, single)
    if kind == 4 and isinstance(o, Stream):
        code = f.decoded(o).decode("latin-1")
        limits = numbers("Range")
        return lambda x: [min(max(y, a), b) for y, a, b in zip(formcalc.postscript(code, x), limits[::2], limits[1::2], strict=False)]
    if kind == 0 and isinstance(o, Stream):
        return _sampled(f, o, domain, numbers("Range"), numbers)
    return None


def _sampled(f: File, o: Stream, domain: list[float], limits: list[float], numbers):
    """Type 0: a grid of samples, linear between them in every input."""
    sizes, bits, outputs = [int(x) for x in numbers("Size")], int(f.at(o, "BitsPerSample", 8)), len(limits) // 2
    inputs, data = len(domain) // 2, f.decoded(o)
    if len(sizes) != inputs or not outputs or bits not in (1, 2, 4, 8, 12, 16, 24, 32) or min(sizes) < 1:
        return None
    encode = numbers("Encode") or [x for s in sizes for x in (0.0, s - 1.0)]
    decode = numbers("Decode") or limits
    whole, most = int.from_bytes(data, "big"), (1 << bits) - 1
    total = len(data) * 8

    def sample(at: int) -> float:
        end = (at + 1) * bits
        return ((whole >> (total - end)) & most) / most if end <= total else 0.0

    def run(x: list[float]) -> list[float]:
        corners = [(0, 1.0)]
        step = 1
        for i in range(inputs):
            lo, hi = domain[2 * i : 2 * i + 2]
            a, b = encode[2 * i : 2 * i + 2]
            t = a + (min(max(x[i], lo), hi) - lo) / ((hi - lo) or 1.0) * (b - a)
            t = min(max(t, 0.0), sizes[i] - 1.0)
            k = min(int(t), max(0, sizes[i] - 2))
            corners = [(at + step * j, w * share) for at, w in corners for j, share in ((k, 1 - (t - k)), (min(k + 1, sizes[i] - 1), t - k)) if share]
            step *= sizes[i]
        out = [sum(w * sample(at * outputs + j) for at, w in corners) for j in range(outputs)]
        return [decode[2 * j] + v * (decode[2 * j + 1] - decode[2 * j]) for j, v in enumerate(out)]

    return run


def _curve(data: bytes, at: int, size: int):
    """A profile's tone curve: a power, a table, or one of the parametric kinds."""
    if data[at : at + 4] == b"para":
        kind = struct.unpack_from(">H", data, at + 8)[0]
        n = (1, 3, 4, 5, 7)[kind] if kind < 5 else 1
        g, *p = (x / 65536 for x in struct.unpack_from(f">{n}i", data, at + 12))
        a, b, c, d, e, h = (list(p) + [1.0, 0.0, 0.0, 0.0, 0.0, 0.0][len(p) :])[:6]
        if kind == 0:
            return lambda x: x**g
        if kind in (1, 2):
            return lambda x: (max(0.0, a * x + b)) ** g + (c if kind == 2 else 0.0) if x >= -b / (a or 1.0) else (c if kind == 2 else 0.0)
        return lambda x: max(0.0, a * x + b) ** g + e if x >= d else c * x + h
    n = struct.unpack_from(">I", data, at + 8)[0]
    if n == 0:
        return lambda x: x
    if n == 1:
        power = struct.unpack_from(">H", data, at + 12)[0] / 256
        return lambda x: x**power
    n = min(n, (size - 12) // 2)
    table = struct.unpack_from(f">{n}H", data, at + 12)
    return lambda x: formcalc.sampled(x, [[v / 65535] for v in table])[0]


def profile(data: bytes, n: int):
    """An ICC profile of curves and a matrix (three components) or one curve, as a function to sRGB; None for others."""
    try:
        tags = {}
        for i in range(min(struct.unpack_from(">I", data, 128)[0], 100)):
            name, at, size = struct.unpack_from(">4sII", data, 132 + 12 * i)
            tags[name] = (at, size)
        if n == 1 and b"kTRC" in tags:
            curve = _curve(data, *tags[b"kTRC"])
            return lambda v: (shown(curve(unit(v[0]))),) * 3
        if n == 3 and all(x + b"XYZ" in tags and x + b"TRC" in tags for x in (b"r", b"g", b"b")):
            curves = [_curve(data, *tags[x + b"TRC"]) for x in (b"r", b"g", b"b")]
            columns = [[x / 65536 for x in struct.unpack_from(">3i", data, tags[c + b"XYZ"][0] + 8)] for c in (b"r", b"g", b"b")]
            return lambda v: _xyz([sum(c(unit(x)) * col[k] for c, x, col in zip(curves, v, columns, strict=True)) for k in range(3)], _D50)
    except (struct.error, IndexError, ZeroDivisionError):
        return None
    return None
