"""Content streams: a stack machine from instructions to text pieces and drawing operations."""

from __future__ import annotations

import math
from typing import Any

from quire.sources.pdf import colours
from quire.sources.pdf.fonts import Font
from quire.sources.pdf.objects import File, Op, Stream, parse, skip, text

MOST_OPERANDS, MOST_FORMS = 32, 12
Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)
# Codes of the drawing operations.
CODES = {"move": 1, "line": 2, "curve": 3, "close": 4, "rect": 5, "fill": 6, "stroke": 7, "fillstroke": 8, "end": 9, "clip": 10, "fillcolor": 11, "strokecolor": 12, "linewidth": 13, "save": 14, "restore": 15, "transform": 16, "text": 17, "image": 18, "linecap": 19, "linejoin": 20, "alpha": 21, "inline": 22, "strokealpha": 23, "dash": 24, "miter": 25, "blend": 26, "shade": 27, "mask": 30, "unmask": 32}
BLENDS = "Normal Multiply Screen Overlay Darken Lighten ColorDodge ColorBurn HardLight SoftLight Difference Exclusion Hue Saturation Color Luminosity".split()
_DEVICES = {"g": 1, "G": 1, "rg": 3, "RG": 3, "k": 4, "K": 4}
_STROKE = {"w": "linewidth", "J": "linecap", "j": "linejoin", "M": "miter"}
_PAINT = {"f": "fill", "F": "fill", "f*": "fill", "S": "stroke", "s": "stroke", "B": "fillstroke", "B*": "fillstroke", "b": "fillstroke", "b*": "fillstroke", "n": "end"}


def times(m: Matrix, n: Matrix) -> Matrix:
    """m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


class Page:
    """What the instructions of one page make: pieces (text) and ops (code, arguments)."""

    def __init__(self, f: File, hidden: set[int] | None = None):
        self.f, self.hidden = f, hidden or set()
        self.pieces: list[dict] = []
        self.ops: list[tuple[int, list[float]]] = []
        self.fonts: dict[int, Font] = {}
        self.marks: list[tuple[int | None, bool]] = []

    def run(self, data: bytes, resources: Any, ctm: Matrix = UNIT, depth: int = 0) -> None:
        f, i, args = self.f, 0, []
        s = {"ctm": ctm, "font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "th": 1.0, "tl": 0.0, "rise": 0.0, "mode": 0, "fill": colours.device(1), "stroke": colours.device(1)}
        here = (0.0, 0.0)
        stack: list[dict] = []
        tm = tlm = UNIT
        marks = len(self.marks)
        while (i := skip(data, i)) < len(data):
            x, j = parse(data, i, refs=False)
            i = max(j, i + 1)
            if not isinstance(x, Op):
                args.append(x)
                del args[:-MOST_OPERANDS]
                continue
            op, n = x.decode("latin-1"), [float(a) if isinstance(a, int | float) and not isinstance(a, bool) else 0.0 for a in args]
            if op == "q":
                stack.append(dict(s))
                self._op("save")
            elif op == "Q":
                if stack:
                    s = stack.pop()
                    self._op("restore")
            elif op == "cm" and len(n) >= 6:
                s["ctm"] = times(tuple(n[-6:]), s["ctm"])
                self._op("transform", *n[-6:])
            elif op in ("m", "l") and len(n) >= 2:
                self._op("move" if op == "m" else "line", *n[-2:])
                here = (n[-2], n[-1])
            elif (op == "c" and len(n) >= 6) or (op in ("v", "y") and len(n) >= 4):
                # v begins at the current point, y ends at its second control point.
                self._op("curve", *(n[-6:] if op == "c" else [*here, *n[-4:]] if op == "v" else [*n[-4:], *n[-2:]]))
                here = (n[-2], n[-1])
            elif op == "h":
                self._op("close")
            elif op == "re" and len(n) >= 4:
                self._op("rect", *n[-4:])
                here = (n[-4], n[-3])
            elif op in _PAINT:
                if op in ("s", "b", "b*"):
                    self._op("close")
                self._op(_PAINT[op])
            elif op in ("W", "W*"):
                self._op("clip")
            elif op in _DEVICES:
                s["fill" if op.islower() else "stroke"] = colours.device(_DEVICES[op])
                self._colour(s, op.islower(), n)
            elif op in ("cs", "CS") and args:
                own = colours.space(f, args[-1], resources)
                s["fill" if op == "cs" else "stroke"] = own
                self._colour(s, op == "cs", [1.0] * own.n if own.kind == "Tint" else [0.0] * (own.n - 1) + [1.0 if own.n == 4 else 0.0])
            elif op in ("sc", "scn", "SC", "SCN"):
                self._colour(s, op.islower(), [v for v, a in zip(n, args, strict=True) if not isinstance(a, str)])
            elif op == "sh" and args:
                o = f.get(f.at(resources, "Shading")) or {}
                self._op("shade", float(getattr(o.get(str(args[-1])), "num", 0)) if isinstance(o, dict) else 0.0)
            elif op in _STROKE and n:
                self._op(_STROKE[op], n[-1])
            elif op == "d" and len(args) >= 2 and isinstance(args[-2], list):
                self._op("dash", *(float(v) for v in args[-2] if isinstance(v, int | float)), n[-1])
            elif op == "BT":
                tm = tlm = UNIT
            elif op == "Tf" and len(args) >= 2:
                s["font"], s["size"] = self._font(resources, str(args[-2])), n[-1]
            elif op in ("Tc", "Tw", "TL", "Ts", "Tr", "Tz") and n:
                key = {"Tc": "tc", "Tw": "tw", "TL": "tl", "Ts": "rise", "Tr": "mode", "Tz": "th"}[op]
                s[key] = n[-1] / 100 if op == "Tz" else n[-1]
            elif op in ("Td", "TD") and len(n) >= 2:
                if op == "TD":
                    s["tl"] = -n[-1]
                tm = tlm = times((1, 0, 0, 1, n[-2], n[-1]), tlm)
            elif op == "Tm" and len(n) >= 6:
                tm = tlm = tuple(n[-6:])
            elif op in ("T*", "'", '"', "Tj", "TJ"):
                if op == '"' and len(n) >= 3:
                    s["tw"], s["tc"] = n[-3], n[-2]
                if op in ("T*", "'", '"'):
                    tm = tlm = times((1, 0, 0, 1, 0, -s["tl"]), tlm)
                if op != "T*" and args:
                    parts = args[-1] if isinstance(args[-1], list) else [args[-1]]
                    tm = self._show(parts, s, tm)
            elif op in ("BMC", "BDC"):
                self._begin(args, resources)
            elif op == "EMC":
                if len(self.marks) > marks:
                    self.marks.pop()
            elif op == "Do" and args:
                self._object(str(args[-1]), resources, s["ctm"], depth)
            elif op == "BI":
                i = self._inline(data, i)
            elif op == "gs" and args:
                self._state(f.at(f.at(resources, "ExtGState"), str(args[-1])), s)
            args = []
        del self.marks[marks:]

    def _op(self, name: str, *args: float) -> None:
        self.ops.append((CODES[name], list(map(float, args))))

    def _colour(self, s: dict, fill: bool, n: list[float]) -> None:
        if got := s["fill" if fill else "stroke"].rgb(n):
            self._op("fillcolor" if fill else "strokecolor", *got)

    def _state(self, d: Any, s: dict) -> None:
        """What a dictionary of the graphics state sets."""
        f = self.f
        if not isinstance(d, dict):
            return
        font = f.get(d.get("Font"))
        if isinstance(font, list) and len(font) == 2:
            s["font"], s["size"] = Font(f, font[0], ""), float(f.get(font[1]) or 0)
        for key, name in (("ca", "alpha"), ("CA", "strokealpha"), ("LW", "linewidth"), ("LC", "linecap"), ("LJ", "linejoin"), ("ML", "miter")):
            if isinstance(v := f.get(d.get(key)), int | float):
                self._op(name, float(v))
        dash = f.get(d.get("D"))
        if isinstance(dash, list) and len(dash) == 2 and isinstance(f.get(dash[0]), list):
            self._op("dash", *(float(v) for v in f.get(dash[0]) if isinstance(v, int | float)), float(f.get(dash[1]) or 0))
        if (mode := f.get(d.get("BM"))) is not None:
            names = mode if isinstance(mode, list) else [mode]
            self._op("blend", float(next((BLENDS.index(str(f.get(m))) for m in names if str(f.get(m)) in BLENDS), 0)))
        if (mask := f.get(d.get("SMask"))) is not None:
            self._op("unmask") if mask == "None" else self._op("mask", float(mask.get("S") == "Luminosity") if isinstance(mask, dict) else 0.0)

    def _font(self, resources: Any, name: str) -> Font | None:
        d = self.f.at(self.f.at(resources, "Font"), name)
        if not isinstance(d, dict):
            return None
        if id(d) not in self.fonts:
            self.fonts[id(d)] = Font(self.f, d, name)
        return self.fonts[id(d)]

    def _begin(self, args: list, resources: Any) -> None:
        mcid, muted = self.marks[-1] if self.marks else (None, False)
        tag, props = (args[0] if args else ""), (args[1] if len(args) > 1 else None)
        ref = None
        if isinstance(props, str):
            ref = (self.f.get(self.f.at(resources, "Properties")) or {}).get(str(props))
            props = self.f.get(ref)
        if tag == "Artifact":
            mcid = -2
        if isinstance(props, dict) and isinstance(self.f.get(props.get("MCID")), int):
            mcid = self.f.get(props["MCID"])
        if tag == "OC" and ref is not None and getattr(ref, "num", None) in self.hidden:
            muted = True
        self.marks.append((mcid, muted))

    def _show(self, parts: list, s: dict, tm: Matrix) -> Matrix:
        font, size, th = s["font"], s["size"], s["th"]
        for part in parts:
            if isinstance(part, int | float):
                shift = -part / 1000 * size
                tm = times((1, 0, 0, 1, 0, shift) if font and font.vertical else (1, 0, 0, 1, shift * th, 0), tm)
                continue
            if not isinstance(part, bytes) or font is None:
                continue
            said, start = [], tm
            far, blanks = 0.0, 0
            for _, ch, w, blank in font.codes(part):
                said.append(ch)
                far += w
                blanks += blank
            far = far * size + s["tc"] * len(said) + s["tw"] * blanks
            tm = times((1, 0, 0, 1, 0, far) if font.vertical else (1, 0, 0, 1, far * th, 0), tm)
            self._piece("".join(said), font, s, start, tm)
        return tm

    def _piece(self, said: str, font: Font, s: dict, start: Matrix, end: Matrix) -> None:
        mcid, muted = self.marks[-1] if self.marks else (None, False)
        if not said or muted:
            return
        a, b = times((1, 0, 0, 1, 0, s["rise"]), times(start, s["ctm"])), times((1, 0, 0, 1, 0, s["rise"]), times(end, s["ctm"]))
        dx, dy = b[4] - a[4], b[5] - a[5]
        rtl = not said.isascii() and sum("֐" <= c <= "ࣿ" or "יִ" <= c <= "ﻼ" for c in said) > sum(c.isascii() and c.isalpha() for c in said)
        self.pieces.append({"x": a[4], "y": a[5], "size": abs(s["size"]) * math.hypot(a[2], a[3]), "w": math.hypot(dx, dy), "ang": math.atan2(a[1], a[0]), "text": said, "font": font.name, "base": font.base, "bold": font.bold, "mcid": mcid if mcid is not None else -1, "dir": "ttb" if font.vertical else "rtl" if rtl else "ltr"})
        self._op("text", a[4], a[5], s["size"], s["mode"])

    def _object(self, name: str, resources: Any, ctm: Matrix, depth: int) -> None:
        f = self.f
        o = f.at(f.at(resources, "XObject"), name)
        if not isinstance(o, Stream):
            return
        oc = o.head.get("OC")
        if getattr(oc, "num", None) in self.hidden:
            return
        if f.at(o, "Subtype") == "Form" and depth < MOST_FORMS:
            m = [f.get(v) for v in (f.at(o, "Matrix") or UNIT)]
            own = times(tuple(map(float, m)) if len(m) == 6 else UNIT, ctm)
            self._op("save")
            self._op("transform", *(tuple(map(float, m)) if len(m) == 6 else UNIT))
            self.run(f.decoded(o), o.head.get("Resources", resources), own, depth + 1)
            self._op("restore")
        elif f.at(o, "Subtype") == "Image":
            self._op("image", float(f.at(o, "Width", 0) or 0), float(f.at(o, "Height", 0) or 0), float(o.num))

    def _inline(self, data: bytes, i: int) -> int:
        at = data.find(b"ID", i)
        end = at
        while end >= 0:
            end = data.find(b"EI", end + 2)
            if end < 0 or (data[end - 1 : end] in b"\n\r \t" and data[end + 2 : end + 3] in (b"", b"\n", b"\r", b" ", b"\t")):
                break
        self._op("inline")
        return len(data) if end < 0 else end + 2


def boxes(f: File, page: dict) -> tuple[float, float, float, float, int]:
    """x0, y0, width, height (of the crop box within the media box) and the turn of a page."""

    def box(name: str) -> list[float] | None:
        v = [f.get(x) for x in (f.get(page.get(name)) or [])]
        if len(v) != 4 or not all(isinstance(x, int | float) for x in v):
            return None
        return [min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])]

    m, c = box("MediaBox"), box("CropBox")
    if m and c:
        m = [max(m[0], c[0]), max(m[1], c[1]), min(m[2], c[2]), min(m[3], c[3])]
    if not m or not (0 < m[2] - m[0] <= 20000 and 0 < m[3] - m[1] <= 20000):
        m = [0, 0, 612, 792]
    turn = f.get(page.get("Rotate"), 0)
    return m[0], m[1], m[2] - m[0], m[3] - m[1], int(turn) // 90 * 90 % 360 if isinstance(turn, int | float) else 0


def contents(f: File, page: dict) -> bytes:
    c = f.get(page.get("Contents"))
    return b"\n".join(f.decoded(x) for x in (c if isinstance(c, list) else [c]) if x is not None)


def read(f: File, page: dict, hidden: set[int] | None = None) -> Page:
    p = Page(f, hidden)
    p.run(contents(f, page), page.get("Resources", {}))
    return p


__all__ = ["Page", "boxes", "contents", "read", "text", "times"]
