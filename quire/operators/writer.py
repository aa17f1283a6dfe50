"""Writing PDF files: rewriting what is reachable, picking, merging, filling, encrypting."""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Callable
from typing import Any

from quire.functions import ciphers
from quire.sources.pdf.extract import Document
from quire.sources.pdf.objects import File, Name, Ref, Stream


def shown(o: Any) -> bytes:
    """An object as it stands in a file."""
    if type(o) is int:
        return b"%d" % o
    if o is None:
        return b"null"
    if isinstance(o, bool):
        return b"true" if o else b"false"
    if isinstance(o, Ref):
        return b"%d %d R" % (o.num, o.gen)
    if isinstance(o, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in o.encode())
    if isinstance(o, int):
        return b"%d" % o
    if isinstance(o, float):
        return (f"{o:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(o, bytes):
        return b"<" + o.hex().encode() + b">"
    if isinstance(o, str):
        return shown(o.encode("latin-1") if o.isascii() else b"\xfe\xff" + o.encode("utf-16-be"))
    if isinstance(o, list):
        return b"[" + b" ".join(map(shown, o)) + b"]"
    if isinstance(o, dict):
        return b"<<" + b" ".join(shown(Name(k)) + b" " + shown(v) for k, v in o.items()) + b">>"
    if isinstance(o, Stream):
        return shown(o.head | {"Length": len(o.raw)}) + b"\nstream\n" + o.raw + b"\nendstream"
    raise TypeError(type(o))


def assembled(objects: dict[int, Any], trailer: dict, start: bytes = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n") -> bytes:
    """A file of these objects with its cross-reference table."""
    out, at = bytearray(start), {}
    for n in sorted(objects):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + shown(objects[n]) + b"\nendobj\n"
    xref = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for n in sorted(at):
        out += b"%d 1\n%010d 00000 n \n" % (n, at[n])
    out += b"trailer\n" + shown(trailer | {"Size": max(at, default=0) + 1}) + b"\nstartxref\n%d\n%%%%EOF\n" % xref
    return bytes(out)


def update(data: bytes, changed: dict[int, Any], f: File) -> bytes:
    """An incremental update: the bytes as they were, then the changed objects and a table of theirs."""
    out, at = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for n in sorted(changed):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + shown(changed[n]) + b"\nendobj\n"
    xref = len(out)
    out += b"xref\n"
    for n in sorted(at):
        out += b"%d 1\n%010d 00000 n \n" % (n, at[n])
    before = data.rfind(b"startxref")
    prev = int(data[before + 9 :].split()[0]) if before >= 0 and data[before + 9 :].split()[:1] and data[before + 9 :].split()[0].isdigit() else 0
    trailer = {k: f.trailer[k] for k in ("Root", "Info", "ID") if k in f.trailer}
    out += b"trailer\n" + shown(trailer | {"Size": max(f.numbers() | at.keys()) + 1, "Prev": prev}) + b"\nstartxref\n%d\n%%%%EOF\n" % xref
    return bytes(out)


def _moved(o: Any, to: Callable[[int], int]) -> Any:
    if isinstance(o, Ref):
        return Ref(to(o.num), 0)
    if isinstance(o, list):
        return [_moved(x, to) for x in o]
    if isinstance(o, dict):
        return {k: _moved(v, to) for k, v in o.items()}
    if isinstance(o, Stream):
        return Stream(_moved(o.head, to), o.raw, o.num, o.gen)
    return o


def _closure(f: File, roots: set[int], skip: set[int]) -> set[int]:
    seen, front = set(), roots - skip
    while front:
        seen |= front
        front = {r for n in front for r in f.refs(f.object(n))} - seen - skip
    return seen


class Build:
    """A new file out of one or more: pages picked in any order and number, with turns, labels and field values."""

    def __init__(self):
        self.objects: dict[int, Any] = {1: None, 2: None}
        self.kids: list[Ref] = []
        self.root: dict = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
        self.info: Ref | None = None

    def add(self, d: Document, picks: list[int] | None = None, turn: int = 0) -> Build:
        """Pages (from 1; None: all) of d, with what they need. The first file's catalog entries stay."""
        f, shift = d.f, max(self.objects) + 1
        to = lambda n: n + shift
        chosen = [i for i in (picks if picks is not None else range(1, len(d.pages) + 1)) if 1 <= i <= len(d.pages)]
        tree = self._tree(f)
        pages = {p["_num"] for p in d.pages}
        extra = {k: v for k, v in f.root().items() if k not in ("Type", "Pages", "Metadata") and not self.kids}
        need = _closure(f, {r for i in chosen for k, v in d.pages[i - 1].items() if k != "Parent" for r in f.refs(v)} | f.refs(extra), tree)
        for n in need - pages:
            self.objects[to(n)] = _moved(f.object(n), to)
        used: set[int] = set()
        for i in chosen:
            p = d.pages[i - 1]
            own = {k: _moved(v, to) for k, v in p.items() if k not in ("_num", "Parent")} | {"Type": Name("Page"), "Parent": Ref(2, 0)}
            if turn:
                own["Rotate"] = (int(f.get(p.get("Rotate"), 0)) + turn) % 360
            n = to(p["_num"]) if p["_num"] and p["_num"] not in used else max(self.objects) + 1
            used.add(p["_num"])
            self.objects[max(n, 3)] = own
            self.kids.append(Ref(max(n, 3), 0))
        if len(self.kids) == len(chosen):
            self.root |= {k: _moved(v, to) for k, v in extra.items()}
            info = f.get(f.trailer.get("Info"))
            if isinstance(info, dict):
                n = max(self.objects) + 1
                self.objects[n], self.info = {k: f.get(v) for k, v in info.items()}, Ref(n, 0)
        return self

    def _tree(self, f: File) -> set[int]:
        """Page tree nodes that are no pages."""
        out, todo = set(), [f.root().get("Pages")]
        while todo:
            r = todo.pop()
            d = f.get(r)
            if isinstance(r, Ref) and isinstance(d, dict) and "Kids" in d and r.num not in out:
                out.add(r.num)
                todo += f.get(d["Kids"]) or []
        return out

    def turned(self, turns: dict[int, int]) -> Build:
        """Pages (from 1, as they now stand) turned on by so many degrees each."""
        for i, degrees in turns.items():
            if 1 <= i <= len(self.kids):
                n = self.kids[i - 1].num
                self.objects[n] = self.objects[n] | {"Rotate": (int(self._of(self.objects[n].get("Rotate", 0)) or 0) + degrees) % 360}
        return self

    def dropped(self, pages: list[int]) -> Build:
        """Without these pages (from 1, as they now stand)."""
        self.kids = [k for i, k in enumerate(self.kids, 1) if i not in pages]
        return self

    def told(self, info: dict[str, str]) -> Build:
        """With these entries of the document information (Title, Author, …); an empty one goes."""
        if self.info is None:
            self.info = Ref(max(self.objects) + 1, 0)
            self.objects[self.info.num] = {}
        have = self.objects[self.info.num] | {k: b"\xfe\xff" + v.encode("utf-16-be") for k, v in info.items()}
        self.objects[self.info.num] = {k: v for k, v in have.items() if info.get(k, v)}
        return self

    def labels(self, ranges: list[tuple[int, str, str, int]]) -> Build:
        """(start page from 1, style, prefix, first number)."""
        nums: list = []
        for start, style, prefix, first in sorted(ranges):
            nums += [start - 1, ({"S": Name(style)} if style else {}) | {"P": prefix, "St": first}]
        self.root["PageLabels"] = {"Nums": nums}
        return self

    def _of(self, o: Any) -> Any:
        return self.objects.get(o.num) if isinstance(o, Ref) else o

    def watermark(self, said: str) -> Build:
        """said across each page, as large as its diagonal allows, in light grey under nothing else's state."""
        font = Ref(max(self.objects) + 1, 0)
        self.objects[font.num] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
        before = Ref(font.num + 1, 0)
        self.objects[before.num] = Stream({}, b"q\n")
        raw = said.encode("cp1252", "replace")
        for k in {k.num for k in self.kids}:
            page = self.objects[k]
            box = [float(self._of(x)) for x in self._of(page.get("MediaBox")) or (0, 0, 612, 792)]
            w, h = box[2] - box[0], box[3] - box[1]
            diagonal = math.hypot(w, h)
            size = 0.62 * diagonal / max(1.0, 0.5 * len(raw))
            c, s = w / diagonal, h / diagonal
            start = (box[0] + w / 2 - 0.31 * diagonal * c, box[1] + h / 2 - 0.31 * diagonal * s)
            text = b"Q q 0.85 g %s %s %s %s %s %s cm BT /QuireMark %s Tf <%s> Tj ET Q" % (*(shown(float(v)) for v in (c, s, -s, c, *start)), shown(size), raw.hex().encode())
            own = Ref(max(self.objects) + 1, 0)
            self.objects[own.num] = Stream({}, text)
            res = dict(self._of(page.get("Resources")) or {})
            res["Font"] = dict(self._of(res.get("Font")) or {}) | {"QuireMark": font}
            old = self._of(page.get("Contents")) if isinstance(self._of(page.get("Contents")), list) else [page["Contents"]] if "Contents" in page else []
            self.objects[k] = page | {"Resources": res, "Contents": [before, *old, own]}
        return self

    def bytes(self, password: str | Lock | None = None, random: Callable[[int], bytes] = os.urandom) -> bytes:
        objects = self.objects | {1: self.root, 2: {"Type": Name("Pages"), "Kids": self.kids, "Count": len(self.kids)}}
        trailer: dict = {"Root": Ref(1, 0)} | ({"Info": self.info} if self.info else {})
        ident = hashlib.md5(b"".join(shown(objects[n])[:4096] for n in sorted(objects))).digest()
        trailer["ID"] = [ident, ident]
        if password is not None:
            objects, trailer = sealed(objects, trailer, password, random)
        return assembled(objects, trailer)


class Lock:
    """A password with salts and what the slow hash makes of them. Files that one task seals share these; each has a key of its own."""

    def __init__(self, password: str, random: Callable[[int], bytes] = os.urandom):
        pw = password.encode()[:127]
        us, uk, os_, ok = (random(8) for _ in range(4))
        self.u = ciphers.hash_2b(pw, us, b"") + us + uk
        self.o = ciphers.hash_2b(pw, os_, self.u) + os_ + ok
        self._user, self._owner = ciphers.hash_2b(pw, uk, b""), ciphers.hash_2b(pw, ok, self.u)

    def wrapped(self, key: bytes) -> tuple[bytes, bytes]:
        """A file's key under the user's and the owner's."""
        return ciphers.aes_cbc_encrypt(self._user, bytes(16), key, pad=False), ciphers.aes_cbc_encrypt(self._owner, bytes(16), key, pad=False)


def sealed(objects: dict[int, Any], trailer: dict, password: str | Lock, random: Callable[[int], bytes] = os.urandom) -> tuple[dict[int, Any], dict]:
    """All strings and streams under AES-256 (V 5, R 6), by a key of the file's own."""
    lock_ = password if isinstance(password, Lock) else Lock(password, random)
    key, perm, u, o = random(32), -4, lock_.u, lock_.o
    ue, oe = lock_.wrapped(key)
    perms = (perm & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + random(4)
    e = {"Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "P": perm, "U": u, "UE": ue, "O": o, "OE": oe, "Perms": ciphers.aes_cbc_encrypt(key, bytes(16), perms, pad=False), "CF": {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def lock(x: Any) -> Any:
        if isinstance(x, str) and not isinstance(x, Name):
            x = x.encode("latin-1") if x.isascii() else b"\xfe\xff" + x.encode("utf-16-be")
        if isinstance(x, bytes):
            iv = random(16)
            return iv + ciphers.aes_cbc_encrypt(key, iv, x)
        if isinstance(x, list):
            return [lock(y) for y in x]
        if isinstance(x, dict):
            return {k: lock(v) for k, v in x.items()}
        if isinstance(x, Stream):
            iv = random(16)
            return Stream(lock(x.head), iv + ciphers.aes_cbc_encrypt(key, iv, x.raw))
        return x

    n = max(objects) + 1
    return {k: lock(v) for k, v in objects.items()} | {n: e}, trailer | {"Encrypt": Ref(n, 0)}


def filled(data: bytes, values: dict[str, str], password: str = "") -> bytes:
    """data with fields' values set by an incremental update; boxes are on for any value but '' and Off."""
    d = Document(data, password)
    changed: dict[int, Any] = {}
    for row in d.fields():
        if row["name"] not in values or not row["obj"]:
            continue
        v, o = values[row["name"]], dict(d.f.object(row["obj"]))
        if row["kind"] in (1, 2):
            on = Name(row["on"]) if v not in ("", "Off") and (row["kind"] == 1 or v == row["on"]) else Name("Off")
            o |= {"V": on, "AS": on}
        else:
            o["V"] = v.encode("latin-1") if v.isascii() else b"\xfe\xff" + v.encode("utf-16-be")
            o.pop("AP", None)
        changed[row["obj"]] = o
    return update(data, changed, d.f) if changed else data


def with_fields(data: bytes, fields: list[dict], password: str = "") -> bytes:
    """data with new fields (page_no, name, rect, kind 0 text or 1 check box, value) appended."""
    d = Document(data, password)
    f, changed = d.f, {}
    n = max(f.numbers()) + 1
    refs = []
    for x in fields:
        page = d.pages[x["page_no"] - 1]
        p = changed.get(page["_num"]) or dict(f.object(page["_num"]))
        p["Annots"] = [*(f.get(p.get("Annots")) or []), Ref(n, 0)]
        changed[page["_num"]] = p
        own: dict = {"Type": Name("Annot"), "Subtype": Name("Widget"), "T": x["name"], "Rect": list(map(float, x["rect"])), "F": 4, "P": Ref(page["_num"], 0)}
        if x.get("kind", 0) == 1:
            on = Name("Yes") if x.get("value") not in (None, "", "Off") else Name("Off")
            own |= {"FT": Name("Btn"), "V": on, "AS": on, "AP": {"N": {"Yes": None, "Off": None}}}
        else:
            own |= {"FT": Name("Tx"), "V": x.get("value") or ""}
        changed[n] = own
        refs.append(Ref(n, 0))
        n += 1
    root = dict(f.root())
    form = dict(f.get(root.get("AcroForm")) or {})
    form["Fields"] = [*(f.get(form.get("Fields")) or []), *refs]
    root["AcroForm"] = form | {"NeedAppearances": True}
    changed[f.trailer["Root"].num] = root
    return update(data, changed, f)


def noted(data: bytes, notes: list[dict], password: str = "") -> bytes:
    """data with annotations (page_no, subtype, rect, contents, color) appended."""
    d = Document(data, password)
    n, changed = max(d.f.numbers()) + 1, {}
    for x in notes:
        page = d.pages[x["page_no"] - 1]
        p = changed.get(page["_num"]) or {k: v for k, v in d.f.object(page["_num"]).items()}
        p["Annots"] = [*(d.f.get(p.get("Annots")) or []), Ref(n, 0)]
        changed[page["_num"]] = p
        changed[n] = {"Type": Name("Annot"), "Subtype": Name(x["subtype"]), "Rect": list(map(float, x["rect"])), "Contents": x.get("contents", ""), "C": list(map(float, x.get("color", (1, 1, 0)))), "F": 4}
        n += 1
    return update(data, changed, d.f)
