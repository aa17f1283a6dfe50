"""Blocks from a structure tree: roles to kinds, leaves' text by page and marked-content id."""

from __future__ import annotations

import math
from collections import defaultdict

from quire.operators.reading import _SPACES, LIMITS, guessed_level, joined, weighted

PARA = {"P", "Note", "Caption", "BlockQuote", "Quote", "FENote", "BibEntry", "Formula", "Lbl"}
CONTAINERS = {"Document", "Part", "Art", "Sect", "Div", "NonStruct", "Private", "Index", "TOCI", "THead", "TBody", "TFoot", ""}


def tagged_blocks(nodes: list[dict], pieces: list[dict], lines: list[dict]) -> list[dict]:
    """Blocks of the tree; none if it has no block roles or covers less than half of the text."""
    if not any(n["mcid"] < 0 for n in nodes):
        return []
    parts: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for p in pieces:
        if p["mcid"] >= 0:
            parts[p["page_no"], p["mcid"]].append(p)
    total = sum(len(p["text"].strip()) for p in pieces if p["mcid"] != -2)
    tagged = sum(len(p["text"].strip()) for n in nodes if n["mcid"] >= 0 for p in parts.get((n["page_no"] or 1, n["mcid"]), []))
    kids: dict[int | None, list[dict]] = defaultdict(list)
    for n in nodes:
        kids[n["parent_id"]].append(n)
    if tagged < 0.5 * total:
        return []
    out: list[dict] = []

    def leaves(n: dict) -> list[dict]:
        own = [n] if n["mcid"] >= 0 else []
        return own + [x for k in kids[n["node_id"]] for x in leaves(k)]

    def said(n: dict) -> str:
        return _SPACES.sub(" ", " ".join(_rows(parts.get((x["page_no"] or 1, x["mcid"]), [])) for x in leaves(n))).strip()

    def add(n: dict, kind: str, **more) -> None:
        own = [p for x in leaves(n) for p in parts.get((x["page_no"] or 1, x["mcid"]), [])]
        box = [min(p["x"] for p in own), min(p["y"] for p in own), max(p["x"] + p["w"] for p in own), max(p["y"] + p["size"] for p in own)] if own else [0.0] * 4
        page = n["page_no"] or next((x["page_no"] for x in leaves(n) if x["page_no"]), 1)
        out.append({"block_id": len(out), "kind": kind, "page_no": page, "bbox": box, "level": 0, "text": "", "items": [], "rows": []} | more)

    def items(n: dict, deep: int) -> list[str]:
        found: list[str] = []
        for k in kids[n["node_id"]]:
            if k["role"] == "L":
                found += items(k, deep + 1)
            elif k["role"] == "LI":
                body, inner = [], []
                for x in kids[k["node_id"]]:
                    if x["role"] == "Lbl" and x["mcid"] < 0:
                        label = said(x)
                        if any(c.isalnum() for c in label):
                            body.append(label)
                    elif x["role"] == "L":
                        inner += items(x, deep + 1)
                    elif x["role"] == "LBody":
                        body.append(" ".join(said(y) for y in ([x] if not kids[x["node_id"]] else kids[x["node_id"]]) if y["role"] != "L"))
                        for y in kids[x["node_id"]]:
                            if y["role"] == "L":
                                inner += items(y, deep + 1)
                    else:
                        body.append(said(x))
                t = _SPACES.sub(" ", " ".join(body)).strip()
                found += (["\t" * deep + t] if t else []) + inner
        return found

    def rows(n: dict) -> list[list[str]]:
        found = []
        for k in kids[n["node_id"]]:
            if k["role"] == "TR":
                cells = [said(c) for c in kids[k["node_id"]] if c["role"] in ("TD", "TH")]
                if any(cells):
                    found.append(cells)
            elif k["role"] in ("THead", "TBody", "TFoot"):
                found += rows(k)
        return found

    def walk(n: dict, sect: int) -> None:
        role = n["role"]
        if n["mcid"] >= 0:
            if t := said(n):
                add(n, "para", text=t)
        elif role == "Title" or (role[:1] == "H" and (role[1:] == "" or role[1:].isdigit())):
            level = 1 if role == "Title" else min(6, int(role[1:])) if role[1:] else min(6, max(1, sect))
            if t := said(n):
                add(n, "heading", level=level, text=t)
        elif role == "Code":
            add(n, "code", text="\n".join(filter(None, (_rows(parts.get((x["page_no"] or 1, x["mcid"]), []), "\n") for x in leaves(n)))))
        elif role in ("L", "TOC"):
            if found := items(n, 0) or [t for k in kids[n["node_id"]] if (t := said(k))]:
                add(n, "list", items=found)
        elif role == "Table":
            found = rows(n)
            if found and max(map(len, found)) == 1:
                for r in found:
                    add(n, "para", text=r[0])
            elif found:
                add(n, "table", rows=found)
        elif role == "Figure":
            if t := said(n) or n["alt"]:
                add(n, "para", text=t)
        elif role in PARA:
            if t := said(n):
                add(n, "para", text=t)
        else:
            for k in kids[n["node_id"]]:
                walk(k, sect + (role == "Sect"))

    for n in kids[None]:
        walk(n, 0)
    if not any(b["kind"] == "heading" for b in out):
        _guess_headings(out, lines)
    _leftovers(out, lines, {(n["page_no"] or 1, n["mcid"]) for n in nodes if n["mcid"] >= 0})
    for k, b in enumerate(out):
        b["block_id"] = k
    return out


def _guess_headings(out: list[dict], lines: list[dict]) -> None:
    """A tree without headings: paragraphs of one or two lines that look like headings become some."""
    if not lines:
        return
    half = lambda x: math.floor(x["size"] * 2 + 0.5) / 2
    body = weighted((half(x), len(x["text"])) for x in lines)
    sizes = sorted({half(x) for x in lines if x["size"] > LIMITS.head_share * body and len(x["text"]) <= LIMITS.head_chars}, reverse=True)[: LIMITS.ranks]
    by_text: dict[tuple[int, str], list[dict]] = {}
    for a, b in zip(lines, [*lines[1:], None]):
        by_text.setdefault((a["page_no"], a["text"]), [a])
        if b is not None and a["page_no"] == b["page_no"]:
            by_text.setdefault((a["page_no"], a["text"] + " " + b["text"]), [a, b])
    for b in out:
        own = by_text.get((b["page_no"], b["text"])) if b["kind"] == "para" else None
        if own and (level := guessed_level(own, body, sizes)):
            b |= {"kind": "heading", "level": level}


def _leftovers(out: list[dict], lines: list[dict], known: set[tuple[int, int]]) -> None:
    """Lines that the tree does not know, and that are no artifacts, as paragraphs after their page's blocks."""
    free: list[dict] = []
    for x in lines:
        if abs(x["angle"]) > 0.01 or any((x["page_no"], m) in known or m == -2 for m in x["mcids"]):
            continue
        box = [x["x"], x["y"], x["x"] + x["w"], x["y"] + x["size"]]
        last = free[-1] if free else None
        if last and last["page_no"] == x["page_no"] and 0 <= x["y"] - last["bbox"][3] <= 0.8 * x["size"]:
            last["text"] += " " + x["text"]
            last["bbox"] = [min(last["bbox"][0], box[0]), last["bbox"][1], max(last["bbox"][2], box[2]), box[3]]
        else:
            free.append({"block_id": 0, "kind": "para", "page_no": x["page_no"], "bbox": box, "level": 0, "text": x["text"], "items": [], "rows": []})
    for b in free:
        at = max((i + 1 for i, x in enumerate(out) if x["page_no"] <= b["page_no"]), default=0)
        out.insert(at, b)


def _rows(pieces: list[dict], between: str = " ") -> str:
    """A fragment's text, row by row as its pieces come."""
    found: list[list[dict]] = []
    for p in pieces:
        if found and abs(found[-1][0]["y"] - p["y"]) <= 0.5 * max(p["size"], 1):
            found[-1].append(p)
        else:
            found.append([p])
    return between.join(joined(r) for r in found)
