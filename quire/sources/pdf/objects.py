"""Objects of a PDF file: found by scanning, resolved, decrypted and decoded."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from quire.functions import ciphers, filters

MOST_DEPTH = 16
_SPACE, _DELIM = b"\0\t\n\f\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_OBJ = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![A-Za-z])")
_REF = re.compile(rb"(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+R(?![A-Za-z0-9])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
#: What is left of an array of numbers alone.
_NUMBERS = re.compile(rb"(?>[\t\n\f\r ]*[+-]?(?:\d++(?:\.\d*+)?|\.\d++)(?=[\t\n\f\r \]]))*+[\t\n\f\r ]*\]")
_ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}


class Name(str):
    """A name object, without its slash."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Op(bytes):
    """A word of a content stream that is no object."""

    __slots__ = ()


class Stream:
    def __init__(self, head: dict, raw: bytes, num: int = 0, gen: int = 0):
        self.head, self.raw, self.num, self.gen = head, raw, num, gen


class PasswordNeeded(ValueError):
    """The file is encrypted, and not by the password given."""


def skip(b: bytes, i: int) -> int:
    return _SKIP.match(b, i).end()


def parse(b: bytes, i: int, refs: bool = True, depth: int = 0) -> tuple[Any, int]:
    """The object at i and where it ends; Op for other words; None with the end of b."""
    i = skip(b, i)
    if i >= len(b):
        return None, i
    c = b[i : i + 1]
    if depth > 64:
        return None, len(b)
    if c == b"/":
        m = _TOKEN.match(b, i + 1)
        raw = m.group() if m else b""
        if b"#" in raw:
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
        return Name(raw.decode("utf-8", "replace")), m.end() if m else i + 1
    if c == b"(":
        return _literal(b, i + 1)
    if b[i : i + 2] == b"<<":
        return _dict(b, i + 2, refs, depth)
    if c == b"<":
        end = b.find(b">", i)
        end = len(b) if end < 0 else end
        return filters.ascii_hex(b[i + 1 : end]), end + 1
    if c == b"[":
        if m := _NUMBERS.match(b, i + 1):
            return [float(w) if b"." in w else int(w) for w in b[i + 1 : m.end() - 1].split()], m.end()
        out, i = [], i + 1
        while (i := skip(b, i)) < len(b) and b[i : i + 1] != b"]":
            x, j = parse(b, i, refs, depth + 1)
            if j <= i:
                break
            out.append(x)
            i = j
        return out, i + 1
    if c in b")>]{}":
        return Op(c), i + (2 if b[i : i + 2] == b">>" else 1)
    if refs and c.isdigit() and (m := _REF.match(b, i)):
        return Ref(int(m[1]), int(m[2])), m.end()
    m = _TOKEN.match(b, i)
    word = m.group()
    if _NUMBER.match(word):
        return (float(word) if b"." in word else int(word)), m.end()
    fixed = {b"true": True, b"false": False, b"null": None}
    return (fixed[word] if word in fixed else Op(word)), m.end()


def _literal(b: bytes, i: int) -> tuple[bytes, int]:
    out, deep = bytearray(), 1
    while i < len(b):
        c = b[i]
        if c == 92 and i + 1 < len(b):
            d = b[i + 1]
            m = re.compile(rb"[0-7]{1,3}").match(b, i + 1)
            if m:
                out.append(int(m.group(), 8) & 255)
                i = m.end()
                continue
            if d in _ESCAPES:
                out.append(_ESCAPES[d])
            elif d == 13 and b[i + 2 : i + 3] == b"\n":
                i += 1
            elif d not in (10, 13):
                out.append(d)
            i += 2
            continue
        deep += (c == 40) - (c == 41)
        if not deep:
            return bytes(out), i + 1
        out.append(c)
        i += 1
    return bytes(out), i


def _dict(b: bytes, i: int, refs: bool, depth: int) -> tuple[dict, int]:
    out: dict = {}
    while (i := skip(b, i)) < len(b):
        if b[i : i + 2] == b">>":
            return out, i + 2
        key, j = parse(b, i, refs, depth + 1)
        if not isinstance(key, Name):
            i = max(j, i + 1)
            continue
        out[str(key)], i = parse(b, j, refs, depth + 1)
    return out, i


def text(raw: Any) -> str:
    """A text string: UTF-16 or UTF-8 by its mark, else one byte a character."""
    if not isinstance(raw, bytes):
        return str(raw) if isinstance(raw, Name) else ""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("cp1252", "replace")


class File:
    """The objects of one file. Of several with a number, the one that begins a line, and then the last, counts."""

    def __init__(self, data: bytes, password: str = "", cmaps: dict[str, str] | None = None):
        #: Predefined character maps by name, as far as given; and characters by CID, as they are read.
        self.cmaps, self.cid_maps = cmaps or {}, {}
        if b"%PDF" not in data[:1024]:
            raise ValueError("no PDF: its mark is not in the first 1024 bytes")
        self.data, self.cache, self.packed = data, {}, {}
        self.where: dict[int, tuple[int, int, int]] = {}
        for m in _OBJ.finditer(data):
            at = m.start()
            rank = 2 if at == 0 or data[at - 1] in b"\r\n" else 1
            num = int(m[1])
            if num < 1 << 22 and (num not in self.where or rank >= self.where[num][0]):
                self.where[num] = (rank, at, int(m[2]))
        self.key, self.method = None, ""
        self.trailer = self._trailer()
        self._unlock(password)
        self._unpack()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self.trailer["Root"] = next((Ref(n, 0) for n in sorted(self.numbers(), reverse=True) if isinstance(o := self.object(n), dict) and o.get("Type") == "Catalog"), None)

    def numbers(self) -> set[int]:
        return self.where.keys() | self.packed.keys()

    def _trailer(self) -> dict:
        found = []
        for m in re.finditer(rb"trailer", self.data):
            d, _ = parse(self.data, m.end())
            if isinstance(d, dict):
                found.append((m.start(), d))
        for num, (_, at, _) in self.where.items():
            if b"/XRef" in self.data[at : at + 400]:
                s = self._parse_at(num)
                if isinstance(s, Stream) and s.head.get("Type") == "XRef":
                    found.append((at, s.head))
        out: dict = {}
        for _, d in sorted(found, key=lambda x: x[0]):
            out.update({k: d[k] for k in ("Root", "Info", "ID", "Encrypt", "Size") if k in d})
        return out

    def _unlock(self, password: str) -> None:
        e = self.get(self.trailer.get("Encrypt"))
        if not isinstance(e, dict):
            return
        ids = self.get(self.trailer.get("ID")) or [b""]
        self.key = ciphers.file_key({k: self.get(v) for k, v in e.items()}, ids[0] if isinstance(ids[0], bytes) else b"", password.encode("utf-8"))
        if self.key is None:
            raise PasswordNeeded("password needed")
        v, method = int(e.get("V", 0)), "V2"
        if v >= 4:
            cf = self.get(self.get(e.get("CF"), {}).get(str(e.get("StmF", "Identity"))), {})
            method = str(self.get(cf.get("CFM", "None")))
        self.method, self.cache = method, {}
        self.skip = self.trailer["Encrypt"].num if isinstance(self.trailer["Encrypt"], Ref) else -1

    def _plain(self, data: bytes, num: int, gen: int) -> bytes:
        if self.key is None or self.method in ("None", "Identity") or not data:
            return data
        if self.method == "V2":
            return ciphers.rc4(ciphers.object_key(self.key, num, gen, False), data)
        key = self.key if self.method == "AESV3" else ciphers.object_key(self.key, num, gen, True)
        return ciphers.aes_cbc_decrypt(key, data[:16], data[16:])

    def _strings(self, o: Any, num: int, gen: int) -> Any:
        if isinstance(o, bytes) and not isinstance(o, Op):
            return self._plain(o, num, gen)
        if isinstance(o, list):
            return [self._strings(x, num, gen) for x in o]
        if isinstance(o, dict):
            return {k: self._strings(v, num, gen) for k, v in o.items()}
        return o

    def _parse_at(self, num: int) -> Any:
        _, at, gen = self.where[num]
        b = self.data
        o, i = parse(b, _OBJ.match(b, at).end())
        i = skip(b, i)
        if not isinstance(o, dict) or b[i : i + 6] != b"stream":
            return o
        i += 6
        i += 2 if b[i : i + 2] == b"\r\n" else 1 if b[i : i + 1] in (b"\n", b"\r") else 0
        n = o.get("Length")
        n = self.get(n) if isinstance(n, Ref) and n.num != num else n
        if not isinstance(n, int) or n < 0 or not re.match(rb"[\0\t\n\f\r ]*endstream", b[i + n : i + n + 20]):
            end = b.find(b"endstream", i)
            end = len(b) if end < 0 else end
            n = end - i - (2 if b[end - 2 : end] == b"\r\n" else 1 if b[end - 1 : end] in (b"\n", b"\r") else 0)
        return Stream(o, b[i : i + n], num, gen)

    def _unpack(self) -> None:
        """Objects in object streams; later streams win, and objects of their own that come after a stream, too."""
        for at, num in sorted((w[1], n) for n, w in self.where.items() if b"/ObjStm" in self.data[w[1] : w[1] + 600]):
            s = self.object(num)
            if not isinstance(s, Stream) or s.head.get("Type") != "ObjStm":
                continue
            data, first = self.decoded(s), int(self.get(s.head.get("First", 0)) or 0)
            head = re.findall(rb"\d+", data[:first])[: 2 * int(self.get(s.head.get("N", 0)) or 0)]
            for k in range(0, len(head) - 1, 2):
                n = int(head[k])
                if n not in self.where or self.where[n][1] < at:
                    self.packed[n] = parse(data, first + int(head[k + 1]))[0]
                    self.cache.pop(n, None)

    def object(self, num: int) -> Any:
        if num not in self.cache:
            if num in self.packed:
                self.cache[num] = self.packed[num]
            elif num in self.where:
                self.cache[num] = None
                o = self._parse_at(num)
                gen = self.where[num][2]
                if self.key is not None and num != getattr(self, "skip", -1):
                    if isinstance(o, Stream):
                        if o.head.get("Type") != "XRef":
                            o = Stream(self._strings(o.head, num, gen), self._plain(o.raw, num, gen), num, gen)
                    else:
                        o = self._strings(o, num, gen)
                self.cache[num] = o
            else:
                return None
        return self.cache[num]

    def get(self, o: Any, default: Any = None) -> Any:
        """o, or what it refers to."""
        if not isinstance(o, Ref):
            return default if o is None else o
        for _ in range(MOST_DEPTH):
            if not isinstance(o, Ref):
                break
            o = self.object(o.num)
        return default if o is None else o

    def at(self, d: Any, key: str, default: Any = None) -> Any:
        d = self.get(d)
        d = d.head if isinstance(d, Stream) else d
        return self.get(d.get(key), default) if isinstance(d, dict) else default

    def filters_of(self, s: Stream) -> tuple[list[str], list[dict]]:
        names, parms = self.at(s, "Filter", self.at(s, "F", [])), self.at(s, "DecodeParms", self.at(s, "DP", []))
        names = names if isinstance(names, list) else [names]
        parms = parms if isinstance(parms, list) else [parms]
        plain = [{k: self.get(v) for k, v in self.get(p, {}).items()} if isinstance(self.get(p), dict) else {} for p in parms]
        return [str(self.get(n)) for n in names], plain

    def decoded(self, s: Any) -> bytes:
        s = self.get(s)
        return filters.decoded(s.raw, *self.filters_of(s))[0] if isinstance(s, Stream) else b""

    def refs(self, o: Any) -> set[int]:
        """Numbers of the objects that o names."""
        out, todo = set(), [o.head if isinstance(o, Stream) else o]
        while todo:
            x = todo.pop()
            if isinstance(x, Ref):
                out.add(x.num)
            elif isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                todo += x.values()
        return out

    def root(self) -> dict:
        r = self.get(self.trailer.get("Root"))
        return r if isinstance(r, dict) else {}

    def pages(self) -> list[dict]:
        """Each page's dict with what it inherits, and its object number (_num)."""
        out: list[dict] = []

        def walk(node: Any, have: dict, depth: int) -> None:
            d = self.get(node)
            if not isinstance(d, dict) or depth > MOST_DEPTH or len(out) > len(self.data):
                return
            have = have | {k: d[k] for k in ("MediaBox", "CropBox", "Resources", "Rotate") if k in d}
            kids = self.get(d.get("Kids"))
            if isinstance(kids, list):
                for k in kids:
                    walk(k, have, depth + 1)
            else:
                out.append(have | d | {"_num": node.num if isinstance(node, Ref) else 0})

        walk(self.root().get("Pages"), {}, 0)
        if not out:
            out = [o | {"_num": n} for n in sorted(self.numbers()) if isinstance(o := self.object(n), dict) and o.get("Type") == "Page"]
        return out
