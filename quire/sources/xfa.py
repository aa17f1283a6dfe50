"""XFA forms: an XML template laid out with its data, as boxes on pages."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from typing import Any

from quire.functions.formcalc import Unreadable, form_calc, show

_UNITS = {"mm": 72 / 25.4, "cm": 72 / 2.54, "in": 72.0, "px": 0.75, "pt": 1.0, "": 1.0}


def to_points(s: str | None, default: float = 0.0) -> float:
    m = re.fullmatch(r"\s*(-?\d*\.?\d+)\s*([a-z]*)\s*", s or "")
    return float(m[1]) * _UNITS.get(m[2], 1.0) if m else default


def _bare(xml: str) -> ET.Element:
    root = ET.fromstring(xml if xml.lstrip().startswith("<?") else f"<r>{xml}</r>")
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    return root


def _plain(e: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip() if e is not None else ""


@dataclass
class Changes:
    """What scripts make of a form: names hidden, names repeated so often, names with new values, and what they said."""

    hidden: set[str] = field(default_factory=set)
    times: dict[str, int] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)
    said: list[str] = field(default_factory=list)
    failed: int = 0


#: Repeats that a script may force; repeats by data have no bound but the data.
MOST_REPEATS = 2000
_EVENTS = {"initialize", "calculate", "ready"}


def events(template: ET.Element, boxes: list[dict]) -> Changes:
    """The template's scripts of events that come before a form is shown, run in the sandbox on what is laid out."""
    from quire.functions.script import run

    out = Changes()
    shown = {b["name"]: b["text"] for b in reversed(boxes) if b["name"] and b["text"]}

    def node(name: str) -> dict:
        def times(n) -> None:
            out.times[name] = min(MOST_REPEATS, max(0, int(n) if isinstance(n, int | float) and n == n else 0))

        manager = {"setInstances": times, "addInstance": lambda *_: times(out.times.get(name, 1) + 1), "removeInstance": lambda *_: times(out.times.get(name, 1) - 1), "count": float(out.times.get(name, 1))}
        return {"name": name, "rawValue": shown.get(name, ""), "value": shown.get(name, ""), "presence": "hidden" if name in out.hidden else "visible", "instanceManager": manager}

    names = {e.get("name") for e in template.iter() if e.tag in ("field", "subform", "draw") and e.get("name")}
    nodes = {n: node(n) for n in names}
    host = {"host": {"messageBox": lambda m="", *_: out.said.append(str(m)) or 0.0, "setFocus": lambda *_: None}, "resolveNode": lambda path="": nodes.get(str(path).split(".")[-1])}
    for owner in template.iter():
        for event in owner.findall("event"):
            script = event.find("script")
            if event.get("activity") not in _EVENTS or script is None or "formcalc" in script.get("contentType", "").lower() or not (source := "".join(script.itertext()).strip()):
                continue
            this = nodes.get(owner.get("name", ""), node(owner.get("name", "")))
            out.failed += bool(run(source, nodes | {"xfa": host, "this": this})["error"])
            for n, x in nodes.items():
                for key in ("rawValue", "value"):
                    if x[key] != shown.get(n, ""):
                        out.values[n] = shown[n] = show(x[key]) if isinstance(x[key], str | float) else ""
                        x["rawValue"] = x["value"] = shown[n]
                        break
                (out.hidden.add if x["presence"] in ("hidden", "invisible") else out.hidden.discard)(n)
    return out


class Form:
    def __init__(self, xml: str, changes: Changes | None = None):
        self.changes = changes or Changes()
        root = _bare(xml)
        self.template = root if root.tag == "template" else root.find(".//template")
        data = root.find(".//datasets/data")
        self.data = data if data is not None else ET.Element("data")
        self.boxes: list[dict] = []
        self.stats = {"fields": 0, "draws": 0, "repeats": 0, "scripts_skipped": 0}
        self.values: dict[str, list[Any]] = {}
        self.page, self.y, self.pages = 1, 0.0, []

    def read(self) -> list[dict]:
        """page, x, y, w, h, text, name, size, bold, align, border, field of every box; y from the top."""
        if self.template is None:
            return []
        areas = self.template.findall(".//pageArea") or [None]
        medium = areas[0].find("medium") if areas[0] is not None else None
        content = areas[0].find("contentArea") if areas[0] is not None else None
        get = lambda e, k, d: to_points(e.get(k), d) if e is not None else d
        self.width, self.height = get(medium, "short", 612.0), get(medium, "long", 792.0)
        self.x0, self.top = get(content, "x", 0.0), get(content, "y", 0.0)
        self.h = get(content, "h", self.height - self.top)
        form = next((s for s in self.template if s.tag == "subform"), None)
        self.y = self.top
        if form is not None:
            records = list(self.data)
            self.collect(form, records[0] if records else self.data)
            self.subform(form, records[0] if records else self.data, self.x0, self.y)
        return self.boxes

    def collect(self, node: ET.Element, data: ET.Element) -> None:
        """Values by name first, so that formulas see fields that come later."""
        for e in data.iter():
            if len(e) == 0:
                self.values.setdefault(e.tag, []).append((e.text or "").strip())

    def height_of(self, e: ET.Element) -> float:
        return to_points(e.get("h"), to_points(e.get("minH"), 14.0 if e.tag in ("field", "draw") else 0.0))

    def subform(self, e: ET.Element, data: ET.Element, x: float, y: float) -> tuple[float, float]:
        """Width and height taken."""
        flow, cx, cy, row, right = e.get("layout", "position"), 0.0, 0.0, 0.0, 0.0
        widths = [to_points(w) for w in e.get("columnWidths", "").split()]
        room = to_points(e.get("w"), self.width - x)
        for k, child in enumerate(c for c in e if c.tag in ("subform", "field", "draw", "subformSet", "exclGroup")):
            if child.get("presence") in ("hidden", "inactive") or child.get("name") in self.changes.hidden:
                continue
            for record in self.records(child, data):
                ax, ay = to_points(child.get("x")), to_points(child.get("y"))
                if flow == "position":
                    w, h = self.place(child, record, x + ax, y + ay, None)
                    right, row = max(right, ax + w), max(row, ay + h)
                    cy = row
                    continue
                w = to_points(child.get("w"), widths[k] if flow == "row" and k < len(widths) else 0.0)
                if flow in ("lr-tb", "rl-tb") and cx and cx + w > room:
                    cx, cy, row = 0.0, cy + row, 0.0
                if flow in ("tb", "table") and child.tag != "subformSet" and y + cy + self.height_of(child) > self.top + self.h:
                    self.page, y, cy = self.page + 1, self.top, 0.0
                w, h = self.place(child, record, x + (cx if flow in ("lr-tb", "row", "rl-tb") else 0), y + cy, w or None)
                if flow in ("lr-tb", "row", "rl-tb"):
                    cx, row = cx + w, max(row, h)
                else:
                    cy += h
                right = max(right, cx, w)
        if flow in ("lr-tb", "row", "rl-tb"):
            cy += row
        return to_points(e.get("w"), right), max(to_points(e.get("h"), cy), cy)

    def records(self, child: ET.Element, data: ET.Element) -> list[ET.Element]:
        """A repeated subform's data: one for each element of its name, within its occurrences."""
        if child.tag not in ("subform", "subformSet"):
            return [data]
        found = [d for d in data if d.tag == child.get("name")]
        occur = child.find("occur")
        least = int(occur.get("min", 1)) if occur is not None else 1
        most = int(occur.get("max", max(1, least))) if occur is not None else 1
        most = len(found) if most < 0 else most
        n = max(least, min(len(found), most)) if occur is not None else 1
        n = self.changes.times.get(child.get("name", ""), n)
        if n > 1:
            self.stats["repeats"] += n - 1
        return [found[i] if i < len(found) else (ET.Element("none") if found else data) for i in range(n)]

    def place(self, e: ET.Element, data: ET.Element, x: float, y: float, w: float | None) -> tuple[float, float]:
        if e.tag in ("subform", "subformSet", "exclGroup"):
            return self.subform(e, data, x, y)
        w, h = w or to_points(e.get("w"), 72.0), self.height_of(e)
        font = e.find("font")
        size, bold = to_points(font.get("size") if font is not None else None, 10.0), font is not None and font.get("weight") == "bold"
        para = e.find("para")
        common = {"page": self.page, "h": h, "size": size, "bold": bold, "align": para.get("hAlign", "left") if para is not None else "left", "border": e.find("border") is not None}
        if e.tag == "draw":
            self.stats["draws"] += 1
            self.boxes.append(common | {"x": x, "y": y, "w": w, "text": _plain(e.find("value")), "name": e.get("name", ""), "field": False})
            return w, h
        self.stats["fields"] += 1
        caption, left = e.find("caption"), 0.0
        if caption is not None and (t := _plain(caption.find("value"))):
            left = to_points(caption.get("reserve"), w / 3)
            self.boxes.append(common | {"x": x, "y": y, "w": left, "text": t, "name": "", "field": False})
        self.boxes.append(common | {"x": x + left, "y": y, "w": w - left, "text": self.value(e, data), "name": e.get("name", ""), "field": True})
        return w, h

    def value(self, e: ET.Element, data: ET.Element) -> str:
        if e.get("name") in self.changes.values:
            return self.changes.values[e.get("name")]
        script = e.find("calculate/script")
        if script is not None:
            try:
                return show(form_calc(_plain(script), self.values))
            except (Unreadable, ValueError, TypeError):
                self.stats["scripts_skipped"] += 1
        own = data.find(e.get("name", "_"))
        if own is None:
            own = next((d for d in data.iter(e.get("name", "_"))), None) if data.tag != "none" else None
        return _plain(own) if own is not None else _plain(e.find("value"))


def read_xfa(xml: str) -> tuple[list[dict], dict]:
    """Boxes and counters of an XFA form; none from text that is no XML."""
    try:
        f = Form(xml)
        boxes = f.read()
        made = events(f.template, boxes) if f.template is not None else Changes()
        failed = made.failed
        if made.hidden or made.times or made.values:
            f = Form(xml, made)
            boxes = f.read()
        f.stats["scripts_skipped"] += failed
        if made.said:
            f.stats["messages"] = len(made.said)
        return boxes, f.stats
    except ET.ParseError:
        return [], {}
