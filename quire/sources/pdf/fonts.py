"""What a font makes of a string: codes, characters and widths."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from typing import Any

from quire.sources import cmaps
from quire.sources.pdf import metrics
from quire.sources.pdf.objects import File, Name, Stream, parse, text

# Names of ASCII punctuation and digits, of other characters, and of accents.
_ASCII = "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at"
_MORE = {"bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "Euro": "€", "sterling": "£", "yen": "¥", "section": "§", "degree": "°", "copyright": "©", "registered": "®", "trademark": "™", "minus": "−", "multiply": "×", "nbspace": " "}
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "breve": "̆", "macron": "̄", "ogonek": "̨", "dotaccent": "̇"}
_NAMES = {n: chr(32 + i) for i, n in enumerate(_ASCII.split())} | _MORE
_LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}


def glyph(name: str) -> str:
    """A glyph name's character: by table, as uniXXXX or uXXXX, or as a letter with an accent."""
    name = name.split(".")[0]
    if len(name) == 1 or name in _NAMES:
        return _NAMES.get(name, name)
    if m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)", name):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else ""
    if name[1:] in _ACCENTS:
        return unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
    return ""


@lru_cache(maxsize=8)
def to_unicode(data: bytes) -> tuple[dict[int, str], set[int]]:
    """Characters by code, and the code lengths, of a ToUnicode CMap."""
    out: dict[int, str] = {}
    sizes: set[int] = set()
    number = lambda b: int.from_bytes(b, "big")
    said = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"begin(codespacerange|bfchar|bfrange)(.*?)end", data, re.S):
        items, i = [], 0
        while i < len(body):
            x, j = parse(body, i, refs=False)
            if x is None or j <= i:
                break
            items.append(x)
            i = j
        if kind == b"codespacerange":
            sizes |= {len(x) for x in items if isinstance(x, bytes)}
        elif kind == b"bfchar":
            for a, b in zip(items[::2], items[1::2]):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[number(a)] = said(b)
        else:
            for lo, hi, to in zip(items[::3], items[1::3], items[2::3]):
                if not isinstance(lo, bytes) or not isinstance(hi, bytes):
                    continue
                for k in range(min(number(hi) - number(lo) + 1, 1 << 16)):
                    if isinstance(to, list):
                        if k < len(to) and isinstance(to[k], bytes):
                            out[number(lo) + k] = said(to[k])
                    elif isinstance(to, bytes) and to:
                        last = (number(to[-2:]) + k) & 0xFFFF
                        out[number(lo) + k] = said(to[:-2] + last.to_bytes(2, "big")) if len(to) > 1 else chr(to[0] + k)
    return out, sizes


# Fixed value.
BOLD = r"bold|black|heavy|semibold|demibold|-bd\b|medi\b|cmbx|\bbd\b"
#: Predefined character maps by a part of their name, and the encoding that they are of; the first that fits counts.
ENCODINGS = {"UCS2": "utf-16-be", "UTF16": "utf-16-be", "UTF8": "utf-8", "UTF32": "utf-32-be", "RKSJ": "cp932", "GBK2K": "gb18030", "GBK": "gbk", "GBpc": "gb2312", "GB-": "gb2312", "HKscs": "big5hkscs", "B5": "cp950", "CNS-EUC": "", "UHC": "cp949", "KSC-Johab": "johab", "KSCpc": "cp949", "KSC": "euc_kr", "EUC": "euc_jp"}
#: Codes of the standard encoding that are others in Windows', and the letters and signs above them.
STANDARD = {0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "fi", 0xAF: "fl", 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}


@lru_cache(maxsize=4)
def characters(base: str) -> dict[int, str]:
    """Characters by code of a base encoding; Windows' where it is another."""
    codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
    out = {c: bytes([c]).decode(codec, "replace") for c in range(32, 256)}
    return {c: ch for c, ch in out.items() if c < 127} | STANDARD if base == "StandardEncoding" else out


class Codes:
    """How a composite font's strings fall into codes, and codes into glyph numbers (CIDs) and characters."""

    def __init__(self, f: File, encoding: Any, sizes: set[int]):
        name = encoding if isinstance(encoding, Name) else ""
        given = f.cmaps.get(str(name)) if name else f.decoded(encoding).decode("latin-1") if isinstance(encoding, Stream) else None
        self.space, ranges = cmaps.parse(given) if given else ([], [])
        if given and (parent := re.search(r"/(\S+)\s+usecmap", given)) and parent[1] in f.cmaps:
            space, more = cmaps.parse(f.cmaps[parent[1]])
            self.space, ranges = self.space or space, sorted([*ranges, *more])
        self.ranges = ranges
        self.lows = [r[0] for r in ranges]
        self.codec = "" if str(name).startswith("Identity") else next((c for k, c in ENCODINGS.items() if k in str(name)), "")
        self.fixed = 0
        if not self.space and (not self.codec or self.codec.startswith("utf")):
            self.fixed = {"utf-32-be": 4}.get(self.codec, 2 if 2 in sizes or not sizes or self.codec else max(sizes))
        if self.codec == "utf-8":
            self.fixed = 0

    def length(self, s: bytes, at: int) -> int:
        """By the code space if it is known, else by the lead byte, as the encoding has it."""
        lead = s[at]
        if self.fixed:
            n = self.fixed
            # A surrogate pair is one code.
            n = 4 if self.codec == "utf-16-be" and 0xD8 <= lead <= 0xDB else n
        elif self.space:
            n = next((size for size, lo, hi in self.space if lo >> 8 * (size - 1) <= lead <= hi >> 8 * (size - 1)), 1)
        elif self.codec == "utf-8":
            n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        elif self.codec == "cp932":
            n = 2 if 0x81 <= lead <= 0x9F or 0xE0 <= lead <= 0xFC else 1
        elif self.codec == "euc_jp" and lead == 0x8F:
            n = 3
        elif self.codec == "gb18030" and lead >= 0x81 and at + 1 < len(s) and 0x30 <= s[at + 1] <= 0x39:
            n = 4
        else:
            n = 2 if lead >= 0x81 else 1
        return min(n, len(s) - at)

    def cid(self, code: int, size: int) -> int:
        """Of the range that holds the code; the code itself where nothing is known of the map."""
        if not self.ranges:
            return code
        k = bisect_right(self.lows, code) - 1
        while k >= 0 and self.lows[k] <= code:
            lo, hi, n, cid = self.ranges[k]
            if code <= hi and n == size:
                return cid + code - lo
            k -= 1
            if k < 0 or self.ranges[k][1] < code:
                break
        return 0

    def said(self, raw: bytes) -> str:
        try:
            return raw.decode(self.codec) if self.codec else ""
        except UnicodeDecodeError:
            return ""


def cid_text(f: File, kid: Any) -> dict[int, str]:
    """Characters by CID, of the font's character collection, if a map for it is given (Adobe-…-UCS2)."""
    info = f.at(kid, "CIDSystemInfo")
    name = f"{text(f.at(info, 'Registry', b''))}-{text(f.at(info, 'Ordering', b''))}-UCS2"
    if name not in f.cmaps:
        return {}
    if name not in f.cid_maps:
        f.cid_maps[name] = to_unicode(f.cmaps[name].encode("latin-1"))[0]
    return f.cid_maps[name]


class Single(dict):
    """A simple font's codes, as they are asked for."""

    def __init__(self, font: Font):
        self.font = font

    def __missing__(self, c: int) -> tuple[int, str, float, bool]:
        self[c] = self.font._code(bytes([c]))
        return self[c]


@lru_cache(maxsize=64)
def _standard(base: str, encoding: str) -> dict[int, float]:
    return metrics.widths(base, characters(encoding))


class Font:
    def __init__(self, f: File, d: Any, name: str):
        self.name, self.f = name, f
        self.base = re.sub(r"^[A-Z]{6}\+", "", text(f.at(d, "BaseFont", Name("")))) or name
        kind = f.at(d, "Subtype")
        self.wide = kind == "Type0"
        lowered = self.base.lower()
        flags = 0
        self.map: dict[int, str] = {}
        self.by_cid: dict[int, str] = {}
        #: What each code of a simple font is, from when it is first shown.
        self.single = Single(self)
        sizes: set[int] = set()
        u = f.at(d, "ToUnicode")
        if isinstance(u, Stream):
            self.map, sizes = to_unicode(f.decoded(u))
        self.widths: dict[int, float] = {}
        encoding = f.at(d, "Encoding")
        self.vertical = self.wide and (isinstance(encoding, Name) and encoding.endswith("V") or isinstance(encoding, Stream) and f.at(encoding, "WMode") == 1)
        if self.wide:
            self.split = Codes(f, encoding, sizes)
            kids = f.at(d, "DescendantFonts") or [{}]
            kid = f.get(kids[0])
            self.default = float(f.at(kid, "DW", 1000))
            self.widths = self._runs(f.at(kid, "W") or [], 1)
            self.by_cid = cid_text(f, kid)
            flags = int(f.at(f.at(kid, "FontDescriptor"), "Flags", 0) or 0)
            # Downwards: how far, by CID; the sideways width is no part of it.
            down = [float(x) for y in (f.at(kid, "DW2") or []) if isinstance(x := f.get(y), int | float)]
            self.down, self.downs = down[1] if len(down) == 2 else -1000.0, self._runs(f.at(kid, "W2") or [], 3)
        else:
            first, ws = int(f.at(d, "FirstChar", 0) or 0), f.at(d, "Widths") or []
            self.widths = {first + i: float(x) for i, w in enumerate(ws) if isinstance(x := f.get(w), (int, float))}
            descriptor = f.at(d, "FontDescriptor")
            flags = int(f.at(descriptor, "Flags", 0) or 0)
            self.default = float(f.at(descriptor, "MissingWidth", 0) or 0) if self.widths else 500.0
            chars, named = self._encoded(encoding)
            if not self.widths:
                self.widths = _standard(self.base, named) if chars is characters(named) else metrics.widths(self.base, chars)
            if not self.map:
                self.map = chars
        self.bold = bool(flags & 1 << 18) or bool(re.search(BOLD, lowered))
        m = f.at(d, "FontMatrix") if kind == "Type3" else None
        self.unit = float(f.get(m[0])) if isinstance(m, list) and m else 0.001

    def _runs(self, w: list, each: int) -> dict[int, float]:
        """Of a list of first code and values, or first, last and value: the value by code, the first of each so many."""
        w, i, out = [self.f.get(x) for x in w], 0, {}
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                values = [self.f.get(x) for x in w[i + 1]][::each]
                out |= {int(w[i]) + k: float(x) for k, x in enumerate(values) if isinstance(x, int | float)}
                i += 2
            elif i + 1 + each < len(w):
                out |= dict.fromkeys(range(int(w[i]), min(int(w[i + 1]), int(w[i]) + 65535) + 1), float(w[i + 2]))
                i += 2 + each
            else:
                break
        return out

    def _encoded(self, encoding: Any) -> tuple[dict[int, str], str]:
        """Characters by code: of the base encoding, and the differences from it (without any, the encoding's own table); the encoding's name."""
        base = str(encoding if isinstance(encoding, Name) else self.f.at(encoding, "BaseEncoding"))
        base = base if base in ("MacRomanEncoding", "StandardEncoding") else "WinAnsiEncoding"
        out, code = characters(base), 0
        differences = self.f.at(encoding, "Differences")
        if not differences:
            return out, base
        out = dict(out)
        for x in differences:
            x = self.f.get(x)
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                if g := glyph(x):
                    out[code] = g
                code += 1
        return out, base

    def codes(self, s: bytes) -> list[tuple[int, str, float, bool]]:
        """For each code: it, its characters, how far it moves on in text units (downwards below 0), and whether word spacing goes with it."""
        if not self.wide:
            return [self.single[c] for c in s]
        out, i = [], 0
        while i < len(s):
            n = self.split.length(s, i)
            out.append(self._code(s[i : i + n]))
            i += n
        return out

    def _code(self, raw: bytes) -> tuple[int, str, float, bool]:
        c = int.from_bytes(raw, "big")
        cid = self.split.cid(c, len(raw)) if self.wide else c
        ch = self.map.get(c)
        if ch is None and self.wide:
            ch = self.split.said(raw) or self.by_cid.get(cid)
        if ch is None:
            ch = chr(c) if 32 <= c < 0x110000 and not 0xD800 <= c < 0xE000 else ""
        if len(ch) == 1 and ord(ch) in _LIGATURES:
            ch = _LIGATURES[ord(ch)]
        far = self.downs.get(cid, self.down) if self.vertical else self.widths.get(cid, self.default)
        return c, ch, far * (0.001 if self.wide else self.unit), len(raw) == 1 and c == 32
