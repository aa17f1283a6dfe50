"""Reading order: pieces of a page to lines, and lines to blocks.

Geometry that depends on what was decided before is a fold over one page (lines) or one
document (blocks), in plain Python for grouped functions; the same thresholds as the
column operators in ``blocks``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators.blocks import BEGINS, BULLET, CAPITALS, CAPTION, ENDED, LIMITS, NUMBERED, SIGN, SMALL

_SPACES = re.compile("[\\s ﻿]+")
#: Fixed value.
MONO = re.compile(r"courier|mono|sftt|consolas|menlo|typewriter|cmtt|lucidacon", re.I)


def upper_middle(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def weighted(pairs) -> object:
    """The key of most weight, of equal ones the first."""
    sums: dict = {}
    for k, w in pairs:
        sums[k] = sums.get(k, 0) + w
    return max(sums, key=lambda k: sums[k])


def within_page(p: dict, page: dict) -> bool:
    w = p["size"] if p["dir"] == "ttb" else p["w"]
    return p["x"] + w > page["x0"] - 2 and p["x"] < page["x0"] + page["w"] + 2 and page["y0"] - p["size"] <= p["y"] <= page["y0"] + page["h"] + p["size"]


class Printed:
    """What is on a page already, to tell what is printed over it again; by text and place, so that a word that fills a page costs no more than others."""

    CELL = 4.0

    def __init__(self):
        self.kept: dict[str, dict[tuple[int, int], list[tuple[float, float, float]]]] = {}

    def again(self, text: str, size: float, x: float, y: float) -> bool:
        c = self.CELL
        kept = self.kept.get(text)
        if kept is None:
            self.kept[text] = {(int(x // c), int(y // c)): [(size, x, y)]}
            return False
        near = max(0.5, 0.15 * size)
        for i in range(int((x - near) // c), int((x + near) // c) + 1):
            for j in range(int((y - near) // c), int((y + near) // c) + 1):
                for s, u, v in kept.get((i, j), ()):
                    if abs(s - size) < 0.1 and abs(u - x) < near and abs(v - y) < near:
                        return True
        kept.setdefault((int(x // c), int(y // c)), []).append((size, x, y))
        return False


def without_doubles(pieces: list[dict]) -> list[dict]:
    """Pieces but for those printed again over an earlier kept one."""
    page = Printed()
    return [p for p in pieces if not page.again(p["text"], p["size"], p["x"], p["y"])]


def pieces_without_doubles(pieces: DataFrame, group: list[str], order: str) -> DataFrame:
    """pieces (text, size, x, y, …) but for those printed again over an earlier kept one of their group: a fold over its pieces in order, as they stream by."""
    schema = pieces.schema
    at = [schema.names.index(c) for c in (*group, "text", "size", "x", "y")]

    def run(it):
        last, page = None, None
        for b in it:
            keep = []
            for *key, text, size, x, y in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                if key != last:
                    last, page = key, Printed()
                keep.append(not page.again(text, size, x, y))
            yield b.filter(pa.array(keep, pa.bool_()))

    return pieces.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(run, schema)


def spaced(a: dict, b: dict) -> bool:
    """Whether a blank belongs between neighbours."""
    gap, size = b["x"] - a["x"] - a["w"], min(a["size"], b["size"])
    return gap > LIMITS.space * size or gap < -LIMITS.back * size or a["text"][-1:].isspace() or b["text"][:1].isspace()


def joined(pieces: list[dict]) -> str:
    """A line's text; small raised or lowered pieces become ^ and _."""
    if len(pieces) == 1:
        return _SPACES.sub(" ", pieces[0]["text"]).strip()
    size, base = weighted(((p["size"], p["y"]), len(p["text"])) for p in pieces)
    out = ""
    for i, p in enumerate(pieces):
        off = p["y"] - base
        if p["size"] < 0.75 * size and abs(off) > 0.15 * size and (t := p["text"].strip()):
            mark = "^" if off > 0 else "_"
            out = out.rstrip() + mark + (t if len(t) == 1 or t.isdigit() else "{" + t + "}")
            continue
        if i and spaced(pieces[i - 1], p):
            out += " "
        out += p["text"]
    return _SPACES.sub(" ", out).strip()


def _cluster(runs: list[dict]) -> list[list[dict]]:
    """Runs to lines: a line goes on while a run's baseline is near that of the line's first run."""
    runs = sorted(runs, key=lambda p: (-p["_v"], p["_u"]))
    out: list[list[dict]] = []
    for p in runs:
        if out and abs(out[-1][0]["_v"] - p["_v"]) <= 0.5 * max(p["size"], 1):
            out[-1].append(p)
        else:
            out.append([p])
    return [layer for line in out for layer in ([line] if len(line) == 1 else _layers(sorted(line, key=lambda p: p["_u"])))]


def _layers(line: list[dict]) -> list[list[dict]]:
    """A line printed over by another on its baseline, as two: a run goes to the first layer that it does not cover."""
    layers: list[list[dict]] = []
    for p in line:
        for layer in layers:
            q = layer[-1]
            over = min(q["_u"] + q["w"], p["_u"] + p["w"]) - max(q["_u"], p["_u"])
            share = over / max(1e-6, min(q["w"], p["w"]))
            sizes = max(p["size"], q["size"]) / max(1e-6, min(p["size"], q["size"]))
            level = abs(p["_v"] - q["_v"]) <= 0.15 * max(p["size"], q["size"])
            if not (share > 0.3 and (sizes > 1.5 or share > 0.8) and level):
                layer.append(p)
                break
        else:
            layers.append([p])
    return layers


def _covered(lines: list[list[dict]], lo: float, bins: int) -> list[int]:
    """By bins of two units from lo: how many lines have a run there."""
    steps = [0] * (bins + 1)
    for line in lines:
        end = -1
        for p in line if len(line) == 1 else sorted(line, key=lambda p: p["_u"]):
            a, b = max(end + 1, int((p["_u"] - lo) // 2)), int((p["_u"] + p["w"] - lo) // 2)
            if b >= a:
                steps[a] += 1
                steps[b + 1] -= 1
                end = b
    return list(accumulate(steps))


def _columns(runs: list[dict], lines: list[list[dict]]) -> list[list[dict]] | None:
    """Left and right of the best gutter, with lines (the runs clustered) that span it cutting the page into bands; None without a gutter."""
    if len(runs) < 6:
        return None
    lo, hi = min(p["_u"] for p in runs), max(p["_u"] + p["w"] for p in runs)
    if hi - lo < 40:
        return None
    height = upper_middle([p["size"] for p in runs])
    bins, most, best, start = int((hi - lo) // 2) + 1, max(2, 0.15 * len(lines)), None, None
    cover = _covered(lines, lo, bins)
    for b in range(bins + 1):
        empty = b < bins and cover[b] <= most
        if empty and start is None:
            start = b
        elif not empty and start is not None:
            width = (b - start) * 2
            mid = lo + start * 2 + width / 2
            if width >= max(0.9 * height, 0.015 * (hi - lo)) and start > 0 and b < bins:
                sides = [sum(_end(p) <= mid for p in runs), sum(p["_u"] >= mid for p in runs)]
                score = min(sides) * 1000 + width
                if best is None or score > best[0]:
                    best = (score, lo + start * 2, mid, width)
            start = None
    if best is None:
        return None
    _, edge, mid, width = best
    table = _table_rows(lines, height)
    left, right, spans = [], [], []
    for line in lines:
        if len(line) == 1 and id(line) not in table:
            p = line[0]
            if p["_u"] < edge and _end(p) > mid:
                spans.append(line)
            else:
                (left if p["_u"] + max(p["w"], 1) / 2 < mid else right).append(p)
            continue
        near, far = ([p for p in line if (p["_u"] + max(p["w"], 1) / 2 < mid) == side] for side in (True, False))
        # A line spans the gutter if one of its runs goes over the middle, if it has no gap as wide there, or if it is a table's row.
        over = any(p["_u"] < edge and _end(p) > mid for p in line)
        if not over and near and far:
            over = min(p["_u"] for p in far) - max(map(_end, near)) < 0.8 * width or id(line) in table
        if over:
            spans.append(line)
        else:
            left += near
            right += far
    if len(spans) > max(3, 0.3 * len(lines)):
        return None
    if any(len(s) < 3 or len({round(p["_v"] / max(1, height)) for p in s}) < 4 for s in (left, right)):
        return None
    out: list[list[dict]] = []
    above = math.inf
    for v, line in sorted(((max(p["_v"] for p in ln), ln) for ln in spans), key=lambda t: -t[0]):
        floor = v + 0.5 * height
        for side in (left, right):
            out.append([p for p in side if floor < p["_v"] <= above])
        out.append(line)
        above = min(above, floor)
    for side in (left, right):
        out.append([p for p in side if p["_v"] <= above])
    return [g for g in out if g]


def _end(p: dict) -> float:
    return p["_u"] + max(p["w"], 1)


def _table_rows(lines: list[list[dict]], height: float) -> set[int]:
    """Lines (by identity) of three or more in a row, close, of three or more short cells, that begin where the first one's do."""
    out: set[int] = set()
    group: list[tuple[list[dict], list[float]]] = []

    def flush() -> None:
        if len(group) >= 3:
            out.update(id(line) for line, _ in group)
        group.clear()

    for line in sorted(lines, key=lambda ln: -ln[0]["_v"]):
        cells = _cell_starts(line, height)
        if group:
            same = sum(any(abs(x - y) <= height for y in cells) for x in group[0][1])
            if len(group[0][1]) < 3 or len(cells) < 3 or same < 3 or group[-1][0][0]["_v"] - line[0]["_v"] >= 2.5 * height:
                flush()
        group.append((line, cells))
    flush()
    return out


def _cell_starts(line: list[dict], height: float) -> list[float]:
    """Where a line's cells begin; none if one of them has over 40 characters."""
    if len(line) == 1:
        return [line[0]["_u"]] if len(line[0]["text"]) <= LIMITS.label_chars else []
    starts: list[float] = []
    size, end = 0, -math.inf
    for p in sorted(line, key=lambda p: p["_u"]):
        if p["_u"] - end > 2.2 * height:
            starts.append(p["_u"])
            size = 0
        size += len(p["text"])
        if size > LIMITS.label_chars:
            return []
        end = max(end, _end(p))
    return starts


def _bands(runs: list[dict], lines: list[list[dict]]) -> list[list[dict]]:
    if len(lines) < 3:
        return [runs]
    gaps = [a[0]["_v"] - b[0]["_v"] for a, b in zip(lines, lines[1:])]
    far = max(1.8 * upper_middle(gaps), 1.5 * upper_middle([p["size"] for p in runs]))
    out = [list(lines[0])]
    for gap, line in zip(gaps, lines[1:]):
        if gap > far:
            out.append([])
        out[-1] += line
    return out


def _ordered(runs: list[dict], depth: int = 0) -> list[list[dict]]:
    lines = _cluster(runs)
    if depth < 4 and len(runs) >= 4:
        if parts := _columns(runs, lines):
            return [line for p in parts for line in _ordered(p, depth + 1)]
        if len(parts := _bands(runs, lines)) > 1:
            return [line for p in parts for line in _ordered(p, depth + 1)]
    return lines


@lru_cache(maxsize=1024)
def _mono(base: str) -> bool:
    return MONO.search(base) is not None


def page_lines(pieces: list[dict], page: dict) -> list[dict]:
    """Lines in reading order; y from the top."""
    pieces = without_doubles([p for p in pieces if p["text"] and within_page(p, page)])
    groups: dict[float, list[dict]] = defaultdict(list)
    for p in pieces:
        groups[round(p["ang"], 2)].append(p)
    out = []
    for ang in sorted(groups, key=lambda a: (abs(a), a)):
        c, s = math.cos(ang), math.sin(ang)
        for p in groups[ang]:
            p["_u"], p["_v"] = p["x"] * c + p["y"] * s, p["y"] * c - p["x"] * s
        for line in _ordered(groups[ang]):
            top = page["y0"] + page["h"]
            if len(line) == 1:
                p = line[0]
                if said := joined(line):
                    out.append({"line_id": len(out), "text": said, "angle": ang, "x": p["x"], "y": top - (p["y"] + p["size"]), "w": p["x"] + p["w"] - p["x"], "size": p["size"], "font": p["base"], "bold": bool(p["bold"]), "mono": _mono(p["base"]), "cells": [(p["x"], said)], "mcids": [p["mcid"]]})
                continue
            said = joined(line) if abs(ang) < 0.01 else _SPACES.sub(" ", " ".join(p["text"] for p in line)).strip()
            if not said:
                continue
            size, font = weighted(((p["size"], p["base"]), len(p["text"])) for p in line)
            chars = sum(len(p["text"]) for p in line)
            x0, x1 = min(p["x"] for p in line), max(p["x"] + p["w"] for p in line)
            cells, at = [], None
            for p in line:
                if at is not None and p["x"] - at <= max(8, 2.2 * size):
                    cells[-1][1].append(p)
                else:
                    cells.append((p["x"], [p]))
                at = p["x"] + p["w"]
            out.append({"line_id": len(out), "text": said, "angle": ang, "x": x0, "y": top - max(p["y"] + p["size"] for p in line), "w": x1 - x0, "size": size, "font": font, "bold": sum(len(p["text"]) for p in line if p["bold"]) > 0.6 * chars, "mono": sum(len(p["text"]) for p in line if _mono(p["base"])) > 0.6 * chars, "cells": [(x, joined(ps)) for x, ps in cells], "mcids": sorted({p["mcid"] for p in line})})
    return out


def text_of(lines: list[dict]) -> str:
    return "\n".join(x["text"] for x in lines)


def _running(lines: list[dict], pages: dict[int, dict]) -> set[tuple[int, int]]:
    """Heads and feet that most pages repeat, and bare page numbers at the edge."""
    out, keys, seen = set(), {}, Counter()
    for x in lines:
        share = x["y"] / pages[x["page_no"]]["h"]
        if share < LIMITS.margin or share > 1 - LIMITS.margin - 0.02:
            k = (math.floor(share * 40 + 0.5), re.sub("[0-9]+", "#", x["text"])[:40])
            keys[x["page_no"], x["line_id"]] = k
            seen[k] += 1
            if (share < 0.1 or share > 0.88) and re.fullmatch("[0-9]{1,4}", x["text"]):
                out.add((x["page_no"], x["line_id"]))
    if len(pages) >= LIMITS.pages:
        least = max(2, math.floor(LIMITS.repeats * len(pages)))
        out |= {i for i, k in keys.items() if seen[k] >= least}
    return out


def _tables(lines: list[dict], body: float) -> dict[int, tuple[int, list[list[str]]]]:
    """Borderless tables: index of the first line to the number of lines and the rows."""
    out, i = {}, 0
    while i < len(lines):
        j = i
        while j < len(lines) and len(lines[j]["cells"]) >= 2 and lines[j]["page_no"] == lines[i]["page_no"]:
            j += 1
        if j - i >= 3:
            columns: list[list[float]] = []
            for x in lines[i:j]:
                for at, _ in x["cells"]:
                    near = next((c for c in columns if abs(sum(c) / len(c) - at) <= max(6, 1.2 * body)), None)
                    if near is None:
                        columns.append([at])
                    else:
                        near.append(at)
            starts = sorted(sum(c) / len(c) for c in columns if len(c) >= 0.5 * (j - i))
            rows = []
            for x in lines[i:j]:
                row = [""] * len(starts)
                for at, said in x["cells"]:
                    if starts:
                        k = min(range(len(starts)), key=lambda k: (abs(starts[k] - at), -k))
                        row[k] = (row[k] + " " + said).strip()
                rows.append(row)
            cells = [c for r in rows for c in r if c]
            numeric = sum(bool(re.fullmatch(r"[-+(]?[$€£]?[0-9][0-9.,%)]*", c)) for c in cells)
            long = sum(len(c) > 60 for c in cells)
            if len(starts) >= 2 and numeric >= 3 and upper_middle([len(c) for c in cells]) <= 30 and long <= 0.2 * len(cells):
                out[i] = (j - i, rows)
        i = max(j, i + 1)
    return out


def merged_rules(rules: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Collinear segments (k, a, b) that touch, as one; what stays short goes."""
    out: list[list[float]] = []
    for k, a, b in sorted(rules):
        if out and abs(out[-1][0] - k) < 1.5 and a <= out[-1][2] + 2:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([k, a, b])
    return [(k, a, b) for k, a, b in out if b - a >= 8]


def ruled_tables(lines: list[dict], geom: list[dict]) -> list[dict]:
    """Tables between rules of one page: bbox, rows, and the lines inside (by line_id)."""
    flat = [g for g in geom if g["kind"] == "rule"]
    flat += [dict(g, kind="rule", y1=g["y0"]) for g in geom if g["kind"] == "box"] + [dict(g, kind="rule", y0=g["y1"]) for g in geom if g["kind"] == "box"]
    flat += [dict(g, kind="rule", x1=g["x0"]) for g in geom if g["kind"] == "box"] + [dict(g, kind="rule", x0=g["x1"]) for g in geom if g["kind"] == "box"]
    across = merged_rules([(g["y0"], min(g["x0"], g["x1"]), max(g["x0"], g["x1"])) for g in flat if abs(g["y0"] - g["y1"]) < 1])
    down = merged_rules([(g["x0"], min(g["y0"], g["y1"]), max(g["y0"], g["y1"])) for g in flat if abs(g["x0"] - g["x1"]) < 1])
    groups: list[list[tuple[float, float, float]]] = []
    for r in across:
        g = next((g for g in groups if any(min(r[2], q[2]) - max(r[1], q[1]) > 20 and abs(r[0] - q[0]) < 400 for q in g)), None)
        if g is None:
            groups.append([r])
        else:
            g.append(r)
    out = []
    for g in groups:
        ys = sorted({r[0] for r in g})
        x0, x1, top, bottom = min(r[1] for r in g), max(r[2] for r in g), ys[0], ys[-1]
        inside = [x for x in lines if top - 2 <= x["y"] + x["size"] / 2 <= bottom + 2 and x["x"] >= x0 - 4 and x["x"] + x["w"] <= x1 + 4]
        if len(ys) < 2 or len(inside) < 2:
            continue
        bounds: list[float] = []
        for k, a, b in down:
            if x0 - 4 <= k <= x1 + 4 and min(b, bottom) - max(a, top) >= 0.6 * (bottom - top) and not any(abs(k - q) < 4 for q in bounds):
                bounds.append(k)
        bounds.sort()
        if len(bounds) < 2:
            starts = sorted(at for x in inside for at, _ in x["cells"])
            bounds = [a for i, a in enumerate(starts) if i == 0 or a - starts[i - 1] > 6]
        elif bounds[0] > x0 + 4:
            bounds.insert(0, x0)
        bounds = [b for b in bounds if b < x1 - 4]
        if len(bounds) < 2:
            continue
        rows: list[list[str]] = []
        full = len(ys) > 3
        last = None
        for x in sorted(inside, key=lambda x: (x["y"], x["x"])):
            middle = x["y"] + x["size"] / 2
            band = sum(y <= middle for y in ys) if full else round(x["y"] / max(1, 0.8 * x["size"]))
            if band != last:
                rows.append([""] * len(bounds))
                last = band
            for at, said in x["cells"]:
                k = max(0, sum(b <= at + 1 for b in bounds) - 1)
                rows[-1][k] = (rows[-1][k] + " " + said).strip()
        cells = [c for r in rows for c in r]
        if len(rows) >= 2 and sum(not c for c in cells) <= 0.6 * len(cells):
            out.append({"bbox": [x0, top, x1, bottom], "rows": rows, "lines": {x["line_id"] for x in inside}})
    return out


_CONTENTS = re.compile(r"(?:table of )?contents|차례|목차", re.I)
_ENDS_IN_PAGE = re.compile(r"\s[0-9]{1,4}$")


def settled(blocks: list[dict]) -> list[dict]:
    """Contents pages and runs of numbered headings become lists; headings before the first section that are none become paragraphs."""
    out: list[dict] = []
    i = 0
    while i < len(blocks):
        b = blocks[i]
        out.append(b)
        i += 1
        if b["kind"] == "heading" and _CONTENTS.fullmatch(b["text"].strip()):
            j = i
            while j < len(blocks) and blocks[j]["page_no"] <= b["page_no"] + 1 and (blocks[j]["page_no"] == b["page_no"] or _ENDS_IN_PAGE.search(blocks[j]["text"])):
                j += 1
            if j > i:
                items = [t for x in blocks[i:j] for t in (x["items"] or [" ".join(r) for r in x["rows"]] or x["text"].split("\n")) if t]
                out.append(blocks[i] | {"kind": "list", "level": 0, "text": "", "items": items, "rows": []})
            i = j
    blocks, out, i = out, [], 0
    while i < len(blocks):
        j = i
        while j < len(blocks) and blocks[j]["kind"] == "heading" and _ENDS_IN_PAGE.search(blocks[j]["text"]):
            j += 1
        if j - i >= 4:
            out.append(blocks[i] | {"kind": "list", "level": 0, "text": "", "items": [x["text"] for x in blocks[i:j]]})
            i = j
        else:
            out.append(blocks[i])
            i += 1
    title = next((k for k, b in enumerate(out) if b["kind"] == "heading" and b["level"] == 1 and not re.match(NUMBERED, b["text"])), None)
    first = next((k for k, b in enumerate(out) if b["kind"] == "heading" and (re.match(NUMBERED, b["text"]) or re.fullmatch("abstract|introduction", b["text"], re.I))), None)
    if title is not None and first is not None:
        for b in out[title + 1 : first]:
            if b["kind"] == "heading" and b["level"] >= 2 and len(b["text"]) <= 60:
                b |= {"kind": "para", "level": 0}
    return out


def in_figures(lines: list[dict], geom: dict[int, list[dict]]) -> set[tuple[int, int]]:
    """Short lines over a box that is a figure's: three lines high, or with eight painted shapes or more around."""
    out = set()
    for n in {x["page_no"] for x in lines}:
        boxes = [g for g in geom.get(n, []) if g["kind"] == "box"]
        shapes = [((g["x0"] + g["x1"]) / 2, (g["y0"] + g["y1"]) / 2) for g in geom.get(n, []) if g["kind"] == "mark" and min(abs(g["x1"] - g["x0"]), abs(g["y1"] - g["y0"])) >= 3]
        for x in lines if boxes else []:
            if x["page_no"] != n or len(x["text"]) > LIMITS.label_chars:
                continue
            foot, base = x["y"] + 1.3 * x["size"], x["y"] + x["size"]
            over = [g for g in boxes if x["x"] + x["w"] > g["x0"] - 2 and x["x"] < g["x1"] + 2 and foot > g["y0"] - 2 and x["y"] < g["y1"] + 2]
            if any(g["y1"] - g["y0"] >= 3 * x["size"] for g in over) or over and sum(abs(v - base) < 160 and abs(u - x["x"]) < 260 for u, v in shapes) >= 8:
                out.add((n, x["line_id"]))
    return out


def in_paragraphs(lines: list[dict]) -> set[tuple[int, int]]:
    """Lines that stand with others of their size, close and one above the other: three or more, or two with over 100 characters.

    A short line and its neighbours must be equally bold, too; a long one belongs to its neighbours however bold they are.
    """
    out = set()
    for short in (True, False):
        island: list[dict] = []
        for x in [*lines, None]:
            if island and x is not None and _beside(island[-1], x) and (not short or island[-1]["bold"] == x["bold"]):
                island.append(x)
                continue
            if len(island) >= 3 or len(island) == 2 and sum(len(y["text"]) for y in island) > 100:
                out |= {(y["page_no"], y["line_id"]) for y in island if (len(y["text"]) <= LIMITS.label_chars) == short}
            island = [] if x is None else [x]
    return out


def _beside(a: dict, b: dict) -> bool:
    overlap = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    step = abs(b["y"] + b["size"] - a["y"] - a["size"])
    return a["page_no"] == b["page_no"] and abs(a["size"] - b["size"]) < 0.3 and overlap > 0 and 0.3 * b["size"] < step < 1.8 * b["size"]


def _unturned(lines: list[dict]) -> list[dict]:
    """Lines but for turned ones, on pages that are not turned for the most part."""
    turned, every = Counter(), Counter()
    for x in lines:
        every[x["page_no"]] += len(x["text"])
        turned[x["page_no"]] += len(x["text"]) * (abs(x["angle"]) > 0.1)
    return [x for x in lines if abs(x["angle"]) <= 0.1 or 2 * turned[x["page_no"]] > every[x["page_no"]]]


def document_blocks(lines: list[dict], pages: dict[int, dict], geom: dict[int, list[dict]] | None = None) -> list[dict]:
    """Blocks of a document's lines (with page_no): headings, paragraphs, items, code and tables.

    geom: rules, boxes and marks by page, for tables and figures that have them."""
    upright = _unturned(lines)
    if not upright:
        return []
    body = weighted((math.floor(x["size"] * 2 + 0.5) / 2, len(x["text"])) for x in upright)
    gone = _running(upright, pages)
    kept = [x for x in upright if (x["page_no"], x["line_id"]) not in gone]
    figures = in_figures(kept, geom or {})
    # Axis labels are no text.
    kept = [x for x in kept if (x["page_no"], x["line_id"]) not in figures or any(map(str.isalpha, x["text"]))]
    close = in_paragraphs(kept)
    known = {w for x in kept for w in re.findall("[a-z]+-[a-z]+", x["text"].lower())}
    tall = {math.floor(x["size"] * 2 + 0.5) / 2 for x in kept if (x["page_no"], x["line_id"]) not in figures and x["size"] > LIMITS.head_share * body and len(x["text"]) <= LIMITS.head_chars}
    sizes = sorted(tall, reverse=True)[: LIMITS.ranks]
    ruled: dict[tuple[int, int], dict] = {}
    for n, g in (geom or {}).items():
        for t in ruled_tables([x for x in kept if x["page_no"] == n], g):
            ruled |= {(n, i): t for i in t["lines"]}
    plain = [x if (x["page_no"], x["line_id"]) not in ruled | dict.fromkeys(figures) else x | {"cells": x["cells"][:1]} for x in kept]
    tables = _tables(plain, body)
    out: list[dict] = []
    shown: set[int] = set()
    i, last = 0, None

    def add(kind: str, x: dict, **more) -> dict:
        b = {"kind": kind, "page_no": x["page_no"], "bbox": [x["x"], x["y"], x["x"] + x["w"], x["y"] + x["size"]], "level": 0, "text": "", "items": [], "rows": []} | more
        out.append(b)
        return b

    def grow(b: dict, x: dict) -> None:
        if b["page_no"] == x["page_no"]:
            q = b["bbox"]
            b["bbox"] = [min(q[0], x["x"]), min(q[1], x["y"]), max(q[2], x["x"] + x["w"]), max(q[3], x["y"] + x["size"])]

    while i < len(kept):
        x = kept[i]
        at = (x["page_no"], x["line_id"])
        if i in tables:
            n, rows = tables[i]
            b = add("table", x, rows=rows)
            for y in kept[i : i + n]:
                grow(b, y)
            i, last = i + n, None
            continue
        i += 1
        if (t := ruled.get(at)) is not None:
            if id(t) not in shown:
                shown.add(id(t))
                add("table", x, rows=t["rows"], bbox=t["bbox"])
            last = None
            continue
        gap = x["y"] - last["y"] - last["size"] if last and last["page_no"] == x["page_no"] else None
        here = out[-1] if out else None
        bullet = re.match(BULLET, x["text"])
        if x["mono"]:
            pad = " " * max(0, math.floor((x["x"] - (here["bbox"][0] if here and here["kind"] == "code" else x["x"])) / (0.6 * x["size"]) + 0.5))
            if here and here["kind"] == "code" and gap is not None:
                here["text"] += "\n" + pad + x["text"]
                grow(here, x)
            else:
                add("code", x, text=x["text"])
        elif not any(map(str.isalnum, x["text"])):
            continue
        elif at not in figures and at not in close and not (re.match(SIGN, x["text"]) and len(x["text"]) > 2) and _heads(x, body):
            numbered = re.match(NUMBERED, x["text"])
            level = heading_level(x, sizes)
            if here and here["kind"] == "heading" and not numbered and gap is not None and gap < 0.6 * x["size"] and level >= here["level"] and abs(here["bbox"][0] - x["x"]) < 30:
                here["text"] += " " + x["text"]
                grow(here, x)
            else:
                add("heading", x, level=level, text=x["text"])
        elif bullet and len(x["text"]) > bullet.end():
            item = x["text"][bullet.end() :].strip()
            if here and here["kind"] == "list" and here["page_no"] == x["page_no"]:
                here["items"].append(item)
                grow(here, x)
            else:
                here = add("list", x, items=[item])
            here["_x"] = x["x"]
        elif here and here["kind"] == "list" and gap is not None and gap < 0.9 * x["size"] and x["x"] > here["_x"] + 0.5 * x["size"]:
            here["items"][-1] = _hyphenless(here["items"][-1], x["text"], known)
            grow(here, x)
        elif here and here["kind"] == "para" and gap is not None and gap <= 0.9 * x["size"] and -3 * x["size"] <= x["x"] - here["_x"] <= 1.2 * x["size"]:
            here["text"] = _hyphenless(here["text"], x["text"], known)
            grow(here, x)
        elif here and here["kind"] == "para" and here["page_no"] != x["page_no"] and not re.search(ENDED, here["text"]) and re.match("[a-z]", x["text"]):
            here["text"] = _hyphenless(here["text"], x["text"], known)
        else:
            add("para", x, text=x["text"])["_x"] = x["x"]
        last = x
    out = settled(out)
    for k, b in enumerate(out):
        b.pop("_x", None)
        b["block_id"] = k
    return out


def heading_level(x: dict, sizes: list[float]) -> int:
    """By the parts of a leading number, or the rank of the size; a bold line of no rank comes after all ranks, another is second."""
    if numbered := re.match(NUMBERED, x["text"]):
        return min(4, numbered[1].count(".") + 1)
    rank = next((k + 1 for k, s in enumerate(sizes) if abs(s - x["size"]) < 0.26), len(sizes) + 1 if x["bold"] else 2)
    return min(4, rank)


def _heads(x: dict, body: float) -> bool:
    t = x["text"]
    if not 0 < len(t) <= LIMITS.head_chars or re.match(CAPTION, t):
        return False
    shout = len(t) <= 60 and re.search(CAPITALS, t) and not re.search(SMALL, t) and re.match(BEGINS, t)
    strong = x["size"] >= 0.85 * body and x["bold"] and len(t) < 80 and t[-1] not in ".,;:"
    return bool(x["size"] > LIMITS.head_share * body or shout or strong)


def guessed_level(lines: list[dict], body: float, sizes: list[float]) -> int:
    """For a tagged document without headings: the level of a paragraph of these lines, 0 if it is none."""
    x = lines[0]
    if len(lines) > 2 or not _heads(x, body) or any(y["size"] < LIMITS.head_share * body and not y["bold"] for y in lines) or abs(lines[-1]["size"] - x["size"]) > 0.5:
        return 0
    return heading_level(x, sizes)


def _hyphenless(a: str, b: str, known: set[str]) -> str:
    m, n = re.search("([A-Za-z]+)-$", a), re.match("[a-z]+", b)
    if not m or not n:
        return a + " " + b
    return a + b if f"{m[1]}-{n[0]}".lower() in known else a[:-1] + b


def markdown(blocks: list[dict]) -> str:
    return "\n\n".join(_render(b) for b in blocks)


def _render(b: dict) -> str:
    if b["kind"] == "heading":
        return "#" * b["level"] + " " + b["text"]
    if b["kind"] == "list":
        return "\n".join("  " * (len(i) - len(i.lstrip("\t"))) + "- " + i.lstrip("\t") for i in b["items"])
    if b["kind"] == "code":
        return "```\n" + b["text"] + "\n```"
    if b["kind"] == "table":
        rows = [[c.replace("|", "\\|") for c in r] for r in b["rows"]]
        width = max(map(len, rows))
        show = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n".join([show[0], "|" + " --- |" * width, *show[1:]])
    return re.sub("^([#>])", r"\\\1", b["text"])


def rules(ops: list[tuple[int, list[float]]], page: dict) -> list[dict]:
    """Rules, boxes and marks of drawing operations, y from the top."""
    out, stack, ctm = [], [], (1, 0, 0, 1, 0, 0)
    points: list[tuple[float, float]] = []
    top = page["y0"] + page["h"]

    def at(x: float, y: float) -> tuple[float, float]:
        return x * ctm[0] + y * ctm[2] + ctm[4], top - (x * ctm[1] + y * ctm[3] + ctm[5])

    def geom(kind: str, x0: float, y0: float, x1: float, y1: float) -> None:
        out.append({"kind": kind, "x0": x0, "y0": y0, "x1": x1, "y1": y1})

    for code, a in ops:
        if code == 14:
            stack.append(ctm)
        elif code == 15 and stack:
            ctm = stack.pop()
        elif code == 16:
            m, c = a, ctm
            ctm = (m[0] * c[0] + m[1] * c[2], m[0] * c[1] + m[1] * c[3], m[2] * c[0] + m[3] * c[2], m[2] * c[1] + m[3] * c[3], m[4] * c[0] + m[5] * c[2] + c[4], m[4] * c[1] + m[5] * c[3] + c[5])
        elif code in (1, 2, 3):
            points += [at(x, y) for x, y in zip(a[::2], a[1::2])]
        elif code == 5:
            points += [at(a[0], a[1]), at(a[0] + a[2], a[1] + a[3])]
        elif code in (6, 7, 8) and points:
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
            w, h = x1 - x0, y1 - y0
            if h <= 2.5 and w >= 8:
                geom("rule", x0, (y0 + y1) / 2, x1, (y0 + y1) / 2)
            elif w <= 2.5 and h >= 8:
                geom("rule", (x0 + x1) / 2, y0, (x0 + x1) / 2, y1)
            elif w >= 8 and h >= 8 and not (w > 400 and h > 500):
                geom("box", x0, y0, x1, y1)
            if not (w > 400 and h > 500):
                geom("mark", x0, y0, x1, y1)
            points = []
        elif code == 9:
            points = []
        elif code in (18, 22):
            (xa, ya), (xb, yb) = at(0, 0), at(1, 1)
            geom("box", min(xa, xb), min(ya, yb), max(xa, xb), max(ya, yb))
    return out
