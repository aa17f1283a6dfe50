"""Small PDF files for tests."""

from __future__ import annotations

import zlib

from quire.operators.writer import assembled
from quire.sources.pdf.objects import Name, Ref, Stream


class Maker:
    """Pages of text placed at (x, y) from the bottom left."""

    def __init__(self):
        self.objects: dict = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: None}
        self.fonts = {k: self.put({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(b), "Encoding": Name("WinAnsiEncoding")}) for k, b in (("F1", "Helvetica"), ("F2", "Helvetica-Bold"), ("F3", "Courier"))}
        self.kids: list = []

    def put(self, o) -> Ref:
        n = max(self.objects) + 1
        self.objects[n] = o
        return Ref(n, 0)

    def page(self, content: str, flate: bool = True, **more) -> Ref:
        raw = content.encode("cp1252")
        s = Stream({"Filter": Name("FlateDecode")}, zlib.compress(raw)) if flate else Stream({}, raw)
        r = self.put({"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": self.fonts}, "Contents": self.put(s)} | more)
        self.kids.append(r)
        return r

    def bytes(self, **trailer) -> bytes:
        self.objects[2] = {"Type": Name("Pages"), "Kids": self.kids, "Count": len(self.kids)}
        return assembled(self.objects, {"Root": Ref(1, 0)} | trailer)


def say(x: float, y: float, size: float, text: str, font: str = "F1") -> str:
    t = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    return f"BT /{font} {size} Tf 1 0 0 1 {x} {y} Tm ({t}) Tj ET\n"


def report(pages: int = 3) -> bytes:
    m = Maker()
    for n in range(1, pages + 1):
        c = say(250, 770, 8, "Annual Report") + say(300, 20, 8, str(n))
        if n == 1:
            c += say(72, 720, 20, "The Title", "F2") + say(72, 690, 14, "1. First Section", "F2")
            c += say(72, 670, 10, "A paragraph of the report that is long enough to be the body, and it is hyphen-") + say(72, 658, 10, "ated at the end of a line by the printer. It also knows well-known words as") + say(72, 646, 10, "such.")
            c += say(72, 620, 10, "• first item") + say(72, 607, 10, "• second item")
            c += say(72, 580, 9, "x = 1", "F3") + say(82.8, 569, 9, "y = 2", "F3")
        else:
            c += say(72, 640, 14, f"{n}. Section", "F2") + say(72, 620, 10, "More body text stands here to fill the page of this report with words.")
        m.page(c)
    return m.bytes(Info=m.put({"Title": "Report", "Author": b"\xfe\xff\x00J\x00\xf6"}))
