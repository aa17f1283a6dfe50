from quire.operators import reading
from quire.sources.pdf import reader
from quire.sources.pdf.extract import Document
from tests.pdfmaker import Maker, say


def blocks(m):
    return reader._blocks(Document(m.bytes()), None)


def test_table_between_rules():
    m = Maker()
    c = say(72, 740, 10, "A sentence of body text stands above the table, long enough to set the size.")
    rows = [("Name", "Town"), ("Ada", "London"), ("Max", "Göttingen"), ("Eva", "Wien")]
    for i, r in enumerate(rows):
        c += f"72 {712 - 20 * i} m 372 {712 - 20 * i} l S\n" + say(76, 698 - 20 * i, 10, r[0]) + say(226, 698 - 20 * i, 10, r[1])
    c += "72 632 m 372 632 l S\n" + "".join(f"{x} 632 m {x} 712 l S\n" for x in (72, 222, 372))
    m.page(c + say(72, 600, 10, "And a sentence of body text stands below the table as well, so that it ends."))
    b = blocks(m)
    assert [x["kind"] for x in b] == ["para", "table", "para"] and b[1]["rows"] == [list(r) for r in rows]
    assert "| Max | Göttingen |" in reading.markdown(b)


def test_contents_page():
    m = Maker()
    c = say(72, 690, 18, "Contents", "F2") + "".join(say(72, 650 - 20 * i, 10, f"Chapter of the book {i} ..... {10 * i + 1}") for i in range(6))
    m.page(c)
    m.page(say(72, 650, 18, "Chapter", "F2") + say(72, 620, 10, "The first chapter begins with a sentence of some length to be read."))
    b = blocks(m)
    assert [x["kind"] for x in b] == ["heading", "list", "heading", "para"] and len(b[1]["items"]) == 6


def test_numbered_heading_runs_and_front_matter():
    h = lambda t, level=2, page=1: {"kind": "heading", "page_no": page, "bbox": [0] * 4, "level": level, "text": t, "items": [], "rows": []}
    got = reading.settled([h("Title", 1), h("Ada Author"), h("1. First"), *[h(f"Part {i} {i}") for i in range(5)], h("Other")])
    assert [(b["kind"], b["text"]) for b in got] == [("heading", "Title"), ("para", "Ada Author"), ("heading", "1. First"), ("list", ""), ("heading", "Other")]
    assert got[3]["items"] == [f"Part {i} {i}" for i in range(5)]


def test_collinear_rules_merge():
    assert reading.merged_rules([(10, 0, 5), (10.4, 6, 40), (10, 100, 104), (30, 0, 9)]) == [(10, 0, 40), (30, 0, 9)] or reading.merged_rules([(10, 0, 5), (10.4, 6, 40)]) == [(10, 0, 40)]


def test_doubles_against_all_pairs_and_in_time():
    import random
    import time

    from quire.operators.reading import Printed, without_doubles

    rng = random.Random(2)
    pieces = [{"text": rng.choice("ab"), "size": rng.choice([8.0, 8.05, 12.0, 30.0]), "x": rng.uniform(-20, 60), "y": rng.uniform(-5, 30)} for _ in range(600)]
    kept = []
    for p in pieces:
        near = max(0.5, 0.15 * p["size"])
        if not any(q["text"] == p["text"] and abs(q["size"] - p["size"]) < 0.1 and abs(q["x"] - p["x"]) < near and abs(q["y"] - p["y"]) < near for q in kept):
            kept.append(p)
    assert without_doubles(pieces) == kept and len(kept) < 600
    page, began = Printed(), time.time()
    assert not any(page.again("w", 10.0, 8.0 * i, 0.0) for i in range(100_000)) and time.time() - began < 5
