"""Records of a document besides its text: information, outline, destinations, links, annotations, fields, layers, labels, attachments, signatures, structure."""

from __future__ import annotations

import hashlib
from typing import Any

from quire.functions import filters
from quire.sources.pdf.content import boxes
from quire.sources.pdf.objects import File, Name, Ref, Stream, text

INFO = ("Title", "Author", "Subject", "Creator", "Producer", "CreationDate", "ModDate")
FITS = {"XYZ", "Fit", "FitH", "FitV", "FitR", "FitB", "FitBH", "FitBV"}
FIELD_KINDS = {"Tx": 0, "Btn": 1, "Ch": 3, "Sig": 4}


def _rect(f: File, v: Any) -> list[float]:
    r = [f.get(x) for x in (f.get(v) or [])]
    if len(r) != 4 or not all(isinstance(x, int | float) for x in r):
        return [0.0] * 4
    return [float(min(r[0], r[2])), float(min(r[1], r[3])), float(max(r[0], r[2])), float(max(r[1], r[3]))]


class Document:
    """A parsed file with its pages counted and numbered from 1."""

    def __init__(self, data: bytes, password: str = "", cmaps: dict[str, str] | None = None):
        self.f = File(data, password, cmaps)
        self.pages = self.f.pages()
        self.page_of: dict[int, int] = {}
        for i, p in enumerate(self.pages, 1):
            self.page_of.setdefault(p["_num"], i)
        self._dests: dict[str, Any] | None = None
        #: Names of the layers to hide; None: those that the file hides.
        self.hide: set[str] | None = None
        #: What could not be read so far: table, page_no (if it is a page's), reason.
        self.faults: list[dict] = []

    # One record.
    def record(self) -> dict:
        f, root = self.f, self.f.root()
        info = f.get(f.trailer.get("Info")) or {}
        ids = f.get(f.trailer.get("ID"))
        meta = f.at(root, "Metadata")
        encrypt = f.get(f.trailer.get("Encrypt"))
        xfa = f.at(f.at(root, "AcroForm"), "XFA")
        action = self.open_action()
        return {
            "n_pages": len(self.pages),
            "info": {k: text(f.get(info.get(k))) for k in INFO if isinstance(f.get(info.get(k)), bytes)},
            "perm": int(f.get(encrypt.get("P"), -1)) if isinstance(encrypt, dict) else None,
            "page_mode": str(f.at(root, "PageMode", "")),
            "page_layout": str(f.at(root, "PageLayout", "")),
            "fingerprint": f.get(ids[0]).hex() if isinstance(ids, list) and ids and isinstance(f.get(ids[0]), bytes) else "",
            "tagged": bool(f.at(f.at(root, "MarkInfo"), "Marked", False)),
            "lang": text(f.at(root, "Lang", b"")),
            "xmp": f.decoded(meta).decode("utf-8", "replace") if isinstance(meta, Stream) else "",
            "xfa": xfa is not None,
            "xfa_xml": self.xfa(xfa),
            "open_page": action[0] if action else None,
            "open_fit": action[1] if action else None,
            "viewer_preferences": {k: str(f.get(v)).lower() if isinstance(f.get(v), bool) else str(f.get(v)) for k, v in list((f.at(root, "ViewerPreferences") or {}).items())[:24]},
            "calc_order": [r.num for r in (f.at(f.at(root, "AcroForm"), "CO") or []) if isinstance(r, Ref)],
        }

    def xfa(self, xfa: Any) -> str:
        f = self.f
        parts = [x for x in (xfa or [])[1::2]] if isinstance(xfa, list) else [xfa]
        return b"".join(f.decoded(x) for x in parts if isinstance(f.get(x), Stream)).decode("utf-8", "replace")

    # Pages.
    def page_rows(self) -> list[dict]:
        labels = self.labels()
        return [dict(zip(("x0", "y0", "w", "h", "rot"), boxes(self.f, p), strict=True)) | {"page_no": i, "obj": p["_num"], "label": labels[i - 1]} for i, p in enumerate(self.pages, 1)]

    def label_ranges(self) -> list[dict]:
        f, out = self.f, []

        def walk(node: Any, depth: int) -> None:
            d = f.get(node)
            if not isinstance(d, dict) or depth > 8:
                return
            nums = f.get(d.get("Nums")) or []
            for k, v in zip(nums[::2], nums[1::2]):
                v = f.get(v) or {}
                if isinstance(f.get(k), int):
                    out.append({"start_page": f.get(k) + 1, "style": str(f.get(v.get("S"), "")), "prefix": text(f.get(v.get("P"), b"")), "first": int(f.get(v.get("St"), 1))})
            for kid in f.get(d.get("Kids")) or []:
                walk(kid, depth + 1)

        walk(f.root().get("PageLabels"), 0)
        return sorted(out, key=lambda r: r["start_page"])

    def labels(self) -> list[str]:
        ranges, out = self.label_ranges(), []
        for i in range(1, len(self.pages) + 1):
            r = next((r for r in reversed(ranges) if r["start_page"] <= i), None)
            out.append(str(i) if r is None else r["prefix"] + _styled(r["style"], r["first"] + i - r["start_page"]))
        return out

    # Destinations and what leads to them.
    def dests(self) -> dict[str, Any]:
        if self._dests is None:
            f, out = self.f, {}

            def walk(node: Any, depth: int) -> None:
                d = f.get(node)
                if not isinstance(d, dict) or depth > 8:
                    return
                names = f.get(d.get("Names")) or []
                for k, v in zip(names[::2], names[1::2]):
                    out.setdefault(text(f.get(k)), v)
                for kid in (f.get(d.get("Kids")) or [])[:256]:
                    walk(kid, depth + 1)

            walk(f.at(f.root(), "Names", {}).get("Dests"), 0)
            if not out:
                out = {str(k): v for k, v in (f.at(f.root(), "Dests") or {}).items()}
            self._dests = out
        return self._dests

    def target(self, d: Any, depth: int = 0) -> tuple[int | None, str]:
        """Page and fit of a destination: an array, a name or a dict with one."""
        f = self.f
        d = f.get(d)
        if depth > 4 or d is None:
            return None, ""
        if isinstance(d, bytes | Name):
            return self.target(self.dests().get(text(d)), depth + 1)
        if isinstance(d, dict):
            return self.target(d.get("D"), depth + 1)
        if isinstance(d, list) and d:
            page = self.page_of.get(d[0].num) if isinstance(d[0], Ref) else d[0] + 1 if isinstance(d[0], int) else None
            fit = str(f.get(d[1])) if len(d) > 1 and str(f.get(d[1])) in FITS else "Fit"
            return page, fit
        return None, ""

    def open_action(self) -> tuple[int, str] | None:
        f = self.f
        a = f.at(f.root(), "OpenAction")
        if isinstance(a, dict):
            if f.at(a, "S") not in (None, "GoTo"):
                return None
            a = a.get("D")
        page, fit = self.target(a)
        return (page, fit) if page else None

    def dest_rows(self) -> list[dict]:
        return [{"name": k, "page_no": self.target(v)[0]} for k, v in self.dests().items()]

    def outline(self) -> list[dict]:
        f, out = self.f, []

        def walk(first: Any, depth: int, parent: int | None) -> None:
            seen: set[int] = set()
            while isinstance(first, Ref) and first.num not in seen and depth <= 4 and len(out) < 65536:
                seen.add(first.num)
                d = f.get(first)
                if not isinstance(d, dict):
                    return
                action = f.get(d.get("A")) or {}
                to = d.get("Dest") if "Dest" in d else action.get("D") if isinstance(action, dict) else None
                here = len(out)
                out.append({"ord": here, "depth": depth, "title": text(f.get(d.get("Title"))), "page_no": self.target(to)[0], "parent_ord": parent})
                walk(d.get("First"), depth + 1, here)
                first = d.get("Next")

        walk((f.at(f.root(), "Outlines") or {}).get("First"), 0, None)
        return out

    def annotations(self) -> list[dict]:
        f, out = self.f, []
        for n, p in enumerate(self.pages, 1):
            for i, a in enumerate(f.get(p.get("Annots")) or []):
                d = f.get(a)
                if not isinstance(d, dict):
                    continue
                action = f.get(d.get("A")) or {}
                uri = f.at(action, "URI")
                uri = text(uri) if isinstance(uri, bytes) and uri else None
                color = [float(f.get(x)) for x in f.get(d.get("C")) or []]
                row = {"page_no": n, "ord": i, "obj": a.num if isinstance(a, Ref) else 0, "subtype": str(f.get(d.get("Subtype"), "")), "rect": _rect(f, d.get("Rect")), "contents": text(f.get(d.get("Contents"))), "author": text(f.get(d.get("T"))), "date": text(f.get(d.get("M"))), "color": color if len(color) == 3 else None, "flags": int(f.get(d.get("F"), 0)), "uri": uri, "target_page": None if uri else self.target(d.get("Dest") if "Dest" in d else action.get("D") if isinstance(action, dict) else None)[0]}
                out.append(row)
        return out

    def links(self) -> list[dict]:
        """Link annotations that lead somewhere."""
        return [{k: a[k] for k in ("page_no", "ord", "rect", "uri", "target_page")} for a in self.annotations() if a["subtype"] == "Link" and (a["uri"] or a["target_page"])]

    # Forms.
    def fields(self) -> list[dict]:
        f, out = self.f, []

        def up(d: dict, key: str) -> Any:
            for _ in range(8):
                if key in d:
                    return f.get(d[key])
                d = f.get(d.get("Parent"))
                if not isinstance(d, dict):
                    return None
            return None

        for n, p in enumerate(self.pages, 1):
            for a in f.get(p.get("Annots")) or []:
                d = f.get(a)
                if not isinstance(d, dict) or f.get(d.get("Subtype")) != "Widget":
                    continue
                kind, flags, rect = FIELD_KINDS.get(str(up(d, "FT"))), int(up(d, "Ff") or 0), _rect(f, d.get("Rect"))
                if kind is None or int(f.get(d.get("F"), 0)) & 2 or rect[2] - rect[0] < 1 or rect[3] - rect[1] < 1:
                    continue
                if kind == 1:
                    if flags & 1 << 16:
                        continue
                    kind = 2 if flags & 1 << 15 else 1
                names, x = [], d
                for _ in range(8):
                    if isinstance(f.get(x.get("T")), bytes):
                        names.append(text(f.get(x["T"])))
                    x = f.get(x.get("Parent"))
                    if not isinstance(x, dict):
                        break
                value = up(d, "V")
                on = next((str(k) for k in (f.at(f.at(d, "AP"), "N") or {}) if k != "Off"), "") if kind in (1, 2) and isinstance(f.at(f.at(d, "AP"), "N"), dict) else ""
                opts = [text(f.get(f.get(o)[-1])) if isinstance(f.get(o), list) else text(f.get(o)) for o in (up(d, "Opt") or [])[:200]]
                out.append({"page_no": n, "obj": a.num if isinstance(a, Ref) else 0, "kind": kind, "flags": flags, "max_len": int(up(d, "MaxLen") or 0), "name": ".".join(reversed(names)), "value": text(value) if isinstance(value, bytes | Name) else "", "on": on, "opts": opts, "checked": kind in (1, 2) and bool(on) and (str(f.get(d.get("AS"), "")) == on), "calc": self._script(d, "C"), "format": self._script(d, "F"), "parent": d["Parent"].num if isinstance(d.get("Parent"), Ref) else 0, "rect": rect})
        return out

    def _script(self, d: dict, key: str) -> str:
        js = self.f.at(self.f.at(self.f.get(d.get("AA")), key), "JS")
        return self.f.decoded(js).decode("utf-8", "replace") if isinstance(js, Stream) else text(js) if isinstance(js, bytes) else ""

    def xfa_boxes(self) -> list[dict]:
        from quire.sources.xfa import read_xfa

        boxes, _ = read_xfa(self.xfa(self.f.at(self.f.at(self.f.root(), "AcroForm"), "XFA")))
        return [{"ord": i} | b for i, b in enumerate(boxes)]

    def images(self) -> list[dict]:
        """Image objects: size, bits, colour space, filter that is left, and the bytes before it."""
        f, out = self.f, []
        for n in sorted(f.numbers()):
            o = f.object(n)
            if not isinstance(o, Stream) or f.at(o, "Subtype") != "Image":
                continue
            data, left = filters.decoded(o.raw, *f.filters_of(o))
            space = f.at(o, "ColorSpace")
            mask = o.head.get("SMask")
            out.append({"obj": n, "w": int(f.at(o, "Width", 0) or 0), "h": int(f.at(o, "Height", 0) or 0), "bits": int(f.at(o, "BitsPerComponent", 1 if f.at(o, "ImageMask") else 8) or 8), "space": str(f.get(space[0]) if isinstance(space, list) and space else space or ""), "filter": left, "stencil": bool(f.at(o, "ImageMask", False)), "smask": mask.num if isinstance(mask, Ref) else 0, "data": data})
        return out

    def checked_signatures(self) -> list[dict]:
        from quire.functions.signature import check

        data, out = self.f.data, []
        for s in self.signatures():
            a, b, c, d = s["byte_range"]
            out.append({k: s[k] for k in ("name", "date", "reason", "covers")} | check(s["der"], data[a : a + b] + data[c : c + d]) | {"told": s["reason"]})
        return out

    # Layers, attachments, signatures.
    def layers(self) -> list[dict]:
        f = self.f
        oc = f.at(f.root(), "OCProperties") or {}
        default = f.get(oc.get("D")) or {}
        off = {r.num for r in f.get(default.get("OFF")) or [] if isinstance(r, Ref)}
        on = {r.num for r in f.get(default.get("ON")) or [] if isinstance(r, Ref)}
        base_off = f.get(default.get("BaseState")) == "OFF"
        return [{"ord": i, "obj": r.num, "name": text(f.at(r, "Name")), "on": r.num in on if base_off else r.num not in off} for i, r in enumerate(f.get(oc.get("OCGs")) or []) if isinstance(r, Ref)]

    def hidden(self) -> set[int]:
        return {r["obj"] for r in self.layers() if (r["name"] in self.hide if self.hide is not None else not r["on"])}

    def attachments(self) -> list[dict]:
        f, out = self.f, []

        def walk(node: Any, depth: int) -> None:
            d = f.get(node)
            if not isinstance(d, dict) or depth > 8:
                return
            names = f.get(d.get("Names")) or []
            for k, v in zip(names[::2], names[1::2]):
                ef = f.at(v, "EF") or {}
                s = f.get(ef.get("UF", ef.get("F")))
                out.append({"ord": len(out), "name": text(f.at(v, "UF", f.at(v, "F"))) or text(f.get(k)), "data": f.decoded(s) if isinstance(s, Stream) else b""})
            for kid in f.get(d.get("Kids")) or []:
                walk(kid, depth + 1)

        walk(f.at(f.root(), "Names", {}).get("EmbeddedFiles"), 0)
        return out

    def collection(self) -> list[dict]:
        f = self.f
        schema = f.at(f.at(f.root(), "Collection"), "Schema") or {}
        rows = [{"key": str(k), "label": text(f.at(v, "N")), "order": int(f.at(v, "O", 0) or 0), "kind": str(f.at(v, "Subtype", ""))} for k, v in schema.items() if isinstance(f.get(v), dict)]
        return sorted(rows, key=lambda r: (r["order"], r["key"]))

    def signatures(self) -> list[dict]:
        f, data, out = self.f, self.f.data, []
        if b"/ByteRange" not in data:
            return out
        for n in sorted(f.numbers()):
            d = f.object(n)
            r = f.get(d.get("ByteRange")) if isinstance(d, dict) else None
            if not isinstance(r, list) or len(r) != 4 or not all(isinstance(x, int) for x in r):
                continue
            signed = data[r[0] : r[0] + r[1]] + data[r[2] : r[2] + r[3]]
            out.append({"name": text(f.get(d.get("Name"))), "date": text(f.get(d.get("M"))), "reason": text(f.get(d.get("Reason"))), "sub": str(f.get(d.get("SubFilter"), "")), "der": f.get(d.get("Contents"), b""), "byte_range": r, "covers": r[0] == 0 and abs(len(data) - r[2] - r[3]) <= 2, "sha256": hashlib.sha256(signed).hexdigest()})
        return out

    # Structure tree, flat and in preorder.
    def structure(self) -> list[dict]:
        f, out = self.f, []
        tree = f.at(f.root(), "StructTreeRoot")
        roles = f.at(tree, "RoleMap") or {}

        def role(name: str) -> str:
            for _ in range(4):
                if name not in roles:
                    break
                name = str(f.get(roles[name]))
            return name

        def leaf(mcid: Any, page: int | None, depth: int, parent: int | None, of: str) -> None:
            out.append({"node_id": len(out), "parent_id": parent, "depth": depth, "role": of, "alt": "", "page_no": page, "mcid": int(mcid)})

        def walk(k: Any, page: int | None, depth: int, parent: int | None, of: str) -> None:
            d = f.get(k)
            if depth > 32 or d is None:
                return
            if isinstance(d, int):
                leaf(d, page, depth, parent, of)
            elif isinstance(d, list):
                for x in d:
                    walk(x, page, depth, parent, of)
            elif isinstance(d, dict):
                pg = self.page_of.get(d["Pg"].num, page) if isinstance(d.get("Pg"), Ref) else page
                if f.get(d.get("Type")) == "MCR" or ("MCID" in d and "S" not in d):
                    leaf(f.get(d.get("MCID"), -1), pg, depth, parent, of)
                elif f.get(d.get("Type")) != "OBJR":
                    me, name = len(out), role(str(f.get(d.get("S"), "")))
                    out.append({"node_id": me, "parent_id": parent, "depth": depth, "role": name, "alt": text(f.get(d.get("Alt"))), "page_no": pg, "mcid": -1})
                    walk(d.get("K"), pg, depth + 1, me, name)

        walk(f.at(tree, "K"), None, 0, None, "")
        return out

    def objects(self) -> list[dict]:
        f, out = self.f, []
        for n in sorted(f.numbers()):
            o = f.object(n)
            rank, at, gen = f.where.get(n, (0, -1, 0))
            out.append({"num": n, "gen": gen, "offset": at, "rank": rank, "in_objstm": n in f.packed, "kind": str(f.at(o, "Type", "")) if isinstance(o, dict | Stream) else type(o).__name__, "refs": sorted(f.refs(o))})
        return out


def _styled(style: str, n: int) -> str:
    if style in ("A", "a"):
        s = chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1) if n > 0 else ""
        return s if style == "A" else s.lower()
    if style in ("R", "r"):
        out, rest = "", n
        for v, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out, rest = out + sign * (rest // v), rest % v
        return out if style == "R" else out.lower()
    return str(n) if style == "D" else ""
