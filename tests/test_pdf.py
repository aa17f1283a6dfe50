import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from quire.functions import ciphers, filters
from quire.operators import reading, writer
from quire.sources.pdf import colours, content, reader
from quire.sources.pdf.extract import Document
from quire.sources.pdf.fonts import glyph, to_unicode
from quire.sources.pdf.objects import File, Name, PasswordNeeded, Ref, Stream, parse, text
from tests.pdfmaker import Maker, report, say


def blocks(data: bytes, **k):
    d = Document(data, **k)
    pages = {r["page_no"]: r for r in d.page_rows()}
    return reading.document_blocks(list(reader._lines(d, None)), pages)


def test_objects_parse():
    o, _ = parse(b"<</A 1/B[1 0 R(a\\(b\\051\\n)<414>]/C#20D true/E null/F -.5>>", 0)
    assert o == {"A": 1, "B": [Ref(1, 0), b"a(b)\n", b"A@"], "C D": True, "E": None, "F": -0.5}
    assert text(b"\xfe\xff\x00\xe9") == "é" and text(b"\xe9") == "é"
    assert parse(writer.shown({"N": Name("a b"), "T": "é"}), 0)[0] == {"N": "a b", "T": b"\xfe\xff\x00\xe9"}


def test_filters():
    data = bytes(range(256)) * 3 + b"tail"
    assert filters.flate(zlib.compress(data)) == data and filters.flate(zlib.compress(data)[:-3])[:700] == data[:700]
    assert filters.ascii_hex(b"48 65 6C6c 6f7>") == b"Hellop" and filters.ascii85(b"87cURD]j7BEbo80~>") == b"Hello world!"
    assert filters.run_length(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128]) + b"z") == b"abcxxx"
    assert filters.lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 1, 1, 1, 3, 2, 2, 2, 4, 1, 1, 1])
    assert filters.predict(rows, 15, 1, 8, 3) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 5, 6, 4, 6, 7])
    assert filters.predict(bytes([1, 1, 1, 5, 1, 1]), 2, 1, 8, 3) == bytes([1, 2, 3, 5, 6, 7])


def test_ciphers_against_published_vectors():
    block, key = bytes.fromhex("00112233445566778899aabbccddeeff"), bytes(range(32))
    assert ciphers.aes_cbc_encrypt(key[:16], bytes(16), block, pad=False).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert ciphers.aes_cbc_encrypt(key, bytes(16), block, pad=False).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert ciphers.aes_cbc_decrypt(key, bytes(16), ciphers.aes_cbc_encrypt(key, bytes(16), b"any length")) == b"any length"
    assert ciphers.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_fonts():
    assert [glyph(x) for x in ("A", "space", "eacute", "uni00E9", "u1F600", "fi", "nosuch")] == ["A", " ", "é", "é", "😀", "fi", ""]
    m, sizes = to_unicode(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0061> <D83DDE00>] endbfrange")
    assert m == {3: "fi", 16: "A", 17: "B", 18: "C", 32: "a", 33: "😀"} and sizes == {2}


def test_report_reads_as_markdown():
    md = reading.markdown(blocks(report()))
    assert md.split("\n\n") == [
        "# The Title",
        "# 1. First Section",
        "A paragraph of the report that is long enough to be the body, and it is hyphenated at the end of a line by the printer. It also knows well-known words as such.",
        "- first item\n- second item",
        "```\nx = 1\n  y = 2\n```",
        "# 2. Section",
        "More body text stands here to fill the page of this report with words.",
        "# 3. Section",
        "More body text stands here to fill the page of this report with words.",
    ]


def test_columns_and_doubles():
    m, c = Maker(), ""
    for i in range(12):
        c += say(72, 700 - 14 * i, 10, f"left column line number {i} of it") + say(330, 700 - 14 * i, 10, f"right column line number {i} of it")
    c += say(72.2, 700, 10, "left column line number 0 of it")
    m.page(c)
    lines = list(reader._lines(Document(m.bytes()), None))
    assert [x["text"] for x in lines] == [f"{s} column line number {i} of it" for s in ("left", "right") for i in range(12)]


def test_table_without_rules():
    m, c = Maker(), say(72, 740, 10, "Some body text comes before the table in this document.")
    for i, r in enumerate([("Item", "Qty", "Price"), ("Pen", "3", "4.50"), ("Ink", "12", "1,500.00"), ("Pad", "7", "2.25")]):
        c += "".join(say(x, 700 - 14 * i, 10, t) for x, t in zip((72, 220, 330), r))
    m.page(c)
    t = [b for b in blocks(m.bytes()) if b["kind"] == "table"]
    assert len(t) == 1 and t[0]["rows"] == [["Item", "Qty", "Price"], ["Pen", "3", "4.50"], ["Ink", "12", "1,500.00"], ["Pad", "7", "2.25"]]


def test_text_state_and_marks():
    m = Maker()
    m.page("q 2 0 0 2 10 20 cm BT /F3 10 Tf 5 Tc 100 Tz 1 0 0 1 0 0 Tm [(ab) -500 (c)] TJ ET Q /Artifact BMC " + say(0, 0, 5, "gone") + "EMC /P <</MCID 4>> BDC " + say(50, 300, 8, "kept") + "EMC BT /F1 8 Tf 90 0 0 90 5 5 Tm 0 1 -1 0 40 40 Tm (up) Tj ET")
    p = list(reader._pieces(Document(m.bytes()), None))
    assert [(x["text"], x["mcid"]) for x in p] == [("ab", -1), ("c", -1), ("gone", -2), ("kept", 4), ("up", -1)]
    assert (p[0]["x"], p[0]["y"], p[0]["size"], p[0]["w"]) == (10, 20, 20, 2 * (6 + 5) * 2) and p[1]["x"] == 10 + 44 + 10
    assert abs(p[4]["ang"] - 1.5707963) < 1e-6


def test_rules_and_boxes():
    m = Maker()
    m.page("1 0 0 1 0 0 cm 72 700 200 1 re f 72 600 100 50 re S 72 500 m 72 400 l S 0 0 612 792 re f")
    d = Document(m.bytes())
    g = list(reader._geometry(d, None))
    assert [(x["kind"], x["x0"], x["y0"], x["x1"], x["y1"]) for x in g if x["kind"] != "mark"] == [("rule", 72, 91.5, 272, 91.5), ("box", 72, 142, 172, 192), ("rule", 72, 292, 72, 392)]


def rich() -> bytes:
    m = Maker()
    p = [m.page(say(72, 700, 12, f"Page {i}")) for i in range(4)]
    root = m.objects[1]
    inner = m.put({"Title": "Inner", "A": {"S": Name("GoTo"), "D": b"there"}})
    second = m.put({"Title": "Second", "Dest": [p[2], Name("Fit")], "First": inner})
    first = m.put({"Title": "First", "Dest": [p[0], Name("XYZ"), 0, 0, 0], "Next": second})
    layer, off = m.put({"Type": Name("OCG"), "Name": "Shown"}), m.put({"Type": Name("OCG"), "Name": "Off"})
    file = m.put({"Type": Name("Filespec"), "UF": "a.txt", "EF": {"F": m.put(Stream({}, b"attached"))}})
    parent = m.put({"FT": Name("Tx"), "T": "group", "V": b"inherited"})
    fields = [
        m.put({"Subtype": Name("Widget"), "Parent": parent, "T": "name", "Rect": [10, 10, 110, 30], "AA": {"C": {"S": Name("JavaScript"), "JS": b"event.value = 1 + 2;"}}}),
        m.put({"Subtype": Name("Widget"), "FT": Name("Btn"), "T": "box", "Rect": [10, 40, 30, 60], "AS": Name("Yes"), "V": Name("Yes"), "AP": {"N": {"Yes": None, "Off": None}}}),
        m.put({"Subtype": Name("Widget"), "FT": Name("Ch"), "T": "pick", "Ff": 1 << 17, "Opt": [b"a", [b"v", b"shown"]], "V": b"a", "Rect": [10, 70, 90, 90]}),
        m.put({"Subtype": Name("Widget"), "FT": Name("Btn"), "T": "push", "Ff": 1 << 16, "Rect": [0, 0, 50, 50]}),
    ]
    link = m.put({"Subtype": Name("Link"), "Rect": [1, 2, 3, 4], "A": {"S": Name("URI"), "URI": b"https://example.com"}})
    inside = m.put({"Subtype": Name("Link"), "Rect": [5, 6, 7, 8], "Dest": b"there"})
    note = m.put({"Subtype": Name("Text"), "Rect": [1, 1, 9, 9], "Contents": "hello", "T": "me", "C": [1, 0, 0], "F": 4})
    m.objects[p[0].num]["Annots"] = [*fields, link, inside, note]
    root |= {"Outlines": {"First": first}, "Names": {"Dests": {"Names": [b"there", {"D": [p[3], Name("FitH"), 5]}]}, "EmbeddedFiles": {"Names": [b"k", file]}}, "PageLabels": {"Nums": [0, {"S": Name("r")}, 2, {"S": Name("D"), "P": b"A-", "St": 5}]}, "OCProperties": {"OCGs": [layer, off], "D": {"OFF": [off]}}, "AcroForm": {"Fields": fields, "CO": [fields[0]]}, "OpenAction": {"S": Name("GoTo"), "D": b"there"}, "Lang": b"en", "PageMode": Name("UseOutlines"), "ViewerPreferences": {"HideToolbar": True}, "MarkInfo": {"Marked": True}}
    m.objects[p[1].num]["Resources"] = {"Font": m.fonts, "Properties": {"L0": layer, "L1": off}}
    m.objects[m.objects[p[1].num]["Contents"].num] = Stream({}, ("/OC /L1 BDC " + say(72, 700, 12, "hidden") + "EMC /OC /L0 BDC " + say(72, 680, 12, "seen") + "EMC").encode())
    m.objects[p[3].num] |= {"Rotate": 450, "CropBox": [10, 10, 300, 400]}
    return m.bytes(ID=[b"\x01\xab", b"\x02"])


def test_metadata():
    d = Document(rich())
    r = d.record()
    assert (r["n_pages"], r["fingerprint"], r["lang"], r["page_mode"], r["tagged"], r["open_page"], r["open_fit"]) == (4, "01ab", "en", "UseOutlines", True, 4, "FitH")
    assert r["viewer_preferences"] == {"HideToolbar": "true"} and len(r["calc_order"]) == 1
    assert d.labels() == ["i", "ii", "A-5", "A-6"]
    assert [(o["title"], o["depth"], o["page_no"], o["parent_ord"]) for o in d.outline()] == [("First", 0, 1, None), ("Second", 0, 3, None), ("Inner", 1, 4, 1)]
    assert d.dest_rows() == [{"name": "there", "page_no": 4}]
    assert [(x["uri"], x["target_page"]) for x in d.links()] == [("https://example.com", None), (None, 4)]
    assert [(a["contents"], a["author"], a["color"]) for a in d.annotations() if a["subtype"] == "Text"] == [("hello", "me", [1, 0, 0])]
    assert [(f["name"], f["kind"], f["value"], f["checked"], f["opts"]) for f in d.fields()] == [("group.name", 0, "inherited", False, []), ("box", 1, "Yes", True, []), ("pick", 3, "a", False, ["a", "shown"])]
    assert d.fields()[0]["calc"] == "event.value = 1 + 2;"
    assert [(x["name"], x["on"]) for x in d.layers()] == [("Shown", True), ("Off", False)]
    assert [(a["name"], a["data"]) for a in d.attachments()] == [("a.txt", b"attached")]
    last = d.page_rows()[3]
    assert (last["x0"], last["w"], last["h"], last["rot"]) == (10, 290, 390, 90)
    assert [p["text"] for p in reader._pieces(d, {2})] == ["seen"]


def tagged() -> bytes:
    m = Maker()
    mark = lambda tag, n, s: f"/{tag} <</MCID {n}>> BDC {s} EMC\n"
    c = mark("H1", 0, say(72, 700, 18, "Heading")) + mark("P", 1, say(72, 670, 10, "First part") + say(72, 658, 10, "of it.")) + mark("L", 2, say(72, 630, 10, "one")) + mark("L", 3, say(90, 618, 10, "nested")) + mark("T", 4, say(72, 590, 10, "h1")) + mark("T", 5, say(150, 590, 10, "h2")) + mark("T", 6, say(72, 578, 10, "a")) + mark("T", 7, say(150, 578, 10, "b")) + say(72, 300, 10, "Untagged line") + say(72, 288, 10, "goes on.") + "/Artifact BMC " + say(72, 20, 8, "foot") + "EMC"
    p = m.page(c)
    e = lambda s, k: m.put({"S": Name(s), "K": k, "Pg": p})
    inner = e("L", [e("LI", [e("LBody", 3)])])
    lst = e("L", [e("LI", [e("LBody", [2, inner])])])
    table = e("Table", [e("TR", [e("TH", 4), e("TH", 5)]), e("TBody", [e("TR", [e("TD", 6), e("TD", {"Type": Name("MCR"), "MCID": 7, "Pg": p})])])])
    m.objects[1] |= {"MarkInfo": {"Marked": True}, "StructTreeRoot": {"RoleMap": {"Kopf": Name("Top"), "Top": Name("H1")}, "K": [e("Document", [e("Kopf", 0), e("P", 1), lst, table, m.put({"S": Name("Figure"), "Alt": "A picture", "Pg": p})])]}}
    return m.bytes()


def test_tagged_structure():
    d = Document(tagged())
    b = reader._blocks(d, None)
    assert [(x["kind"], x["level"], x["text"], x["items"], x["rows"]) for x in b] == [("heading", 1, "Heading", [], []), ("para", 0, "First part of it.", [], []), ("list", 0, "", ["one", "\tnested"], []), ("table", 0, "", [], [["h1", "h2"], ["a", "b"]]), ("para", 0, "A picture", [], []), ("para", 0, "Untagged line goes on.", [], [])]
    assert [x["block_id"] for x in b] == list(range(6))
    assert "- one\n  - nested" in reading.markdown(b) and "| h1 | h2 |\n| --- | --- |\n| a | b |" in reading.markdown(b)


def test_object_streams_and_updates():
    inside = {5: b"<</Type/Pages/Kids[6 0 R]/Count 1>>", 6: b"<</Type/Page/Parent 5 0 R/MediaBox[0 0 100 100]>>"}
    head, body = "", b""
    for n, o in inside.items():
        head += f"{n} {len(body)} "
        body += o + b" "
    s = Stream({"Type": Name("ObjStm"), "N": 2, "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head.encode() + body))
    data = writer.assembled({1: {"Type": Name("Catalog"), "Pages": Ref(5, 0)}, 7: s}, {"Root": Ref(1, 0)})
    f = File(data)
    assert len(f.pages()) == 1 and 6 in f.packed
    newer = writer.update(data, {6: {"Type": Name("Page"), "Parent": Ref(5, 0), "MediaBox": [0, 0, 200, 200]}}, f)
    assert newer.startswith(data) and Document(newer).page_rows()[0]["w"] == 200


def test_build_merge_fill_encrypt():
    a, b = Document(rich()), Document(report(2))
    data = writer.Build().add(a, [3, 1, 1], 90).add(b).labels([(1, "A", "p", 1)]).bytes()
    d = Document(data)
    said = [p["text"] for p in reader._pieces(d, None) if p["text"].startswith(("Page", "The"))]
    assert said == ["Page 2", "Page 0", "Page 0", "The Title"] and d.labels()[:3] == ["pA", "pB", "pC"] and d.page_rows()[0]["rot"] == 90
    new = Document(writer.filled(rich(), {"group.name": "Ärger", "box": "Off"}))
    assert [(f["value"], f["checked"]) for f in new.fields()[:2]] == [("Ärger", False), ("Off", False)]
    locked = writer.Build().add(b).bytes("geheim")
    with pytest.raises(PasswordNeeded):
        Document(locked)
    assert reading.markdown(blocks(locked, password="geheim")) == reading.markdown(blocks(report(2)))
    assert Document(locked, "geheim").record()["info"]["Title"] == "Report"
    noted = Document(writer.noted(report(1), [{"page_no": 1, "subtype": "Square", "rect": [1, 2, 3, 4], "contents": "see"}]))
    assert [(x["subtype"], x["contents"]) for x in noted.annotations()] == [("Square", "see")]


def test_watermark_new_fields_and_layers():
    d = Document(writer.Build().add(Document(report())).watermark("Entwurf für alle").bytes())
    p = [x for x in reader._pieces(d, None) if "Entwurf" in x["text"]]
    assert len(p) == 3 and abs(p[0]["ang"] - 0.9125) < 0.01 and p[0]["text"] == "Entwurf für alle"
    assert [b["text"] for b in reader._blocks(d, None)][:1] == ["The Title"]
    new = Document(writer.with_fields(report(1), [{"page_no": 1, "name": "who", "rect": [10, 10, 90, 30], "value": "me"}, {"page_no": 1, "name": "ok", "rect": [10, 40, 30, 60], "kind": 1, "value": "x"}]))
    assert [(f["name"], f["kind"], f["value"], f["checked"]) for f in new.fields()] == [("who", 0, "me", False), ("ok", 1, "Yes", True)]
    layered = Document(rich())
    layered.hide = {"Shown"}
    assert [p["text"] for p in reader._pieces(layered, {2})] == ["hidden"]


@pytest.mark.parametrize("r", [2, 3])
def test_rc4_files(r):
    import hashlib

    n, ident, perm = (5 if r == 2 else 16), b"0123456789abcdef", -4
    pad = ciphers._PAD
    o = ciphers.rc4(hashlib.md5(pad).digest()[:5], pad) if r == 2 else bytes(32)
    k = hashlib.md5(pad + o + (perm & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
    for _ in range(50 if r == 3 else 0):
        k = hashlib.md5(k[:n]).digest()
    k = k[:n]
    if r == 2:
        u = ciphers.rc4(k, pad)
    else:
        u = ciphers.rc4(k, hashlib.md5(pad + ident).digest())
        for i in range(1, 20):
            u = ciphers.rc4(bytes(b ^ i for b in k), u)
        u += bytes(16)
    m = Maker()
    m.page(say(72, 700, 12, "secret text"))
    for num, x in m.objects.items():
        if isinstance(x, Stream):
            m.objects[num] = Stream(x.head, ciphers.rc4(ciphers.object_key(k, num, 0, False), x.raw))
    data = m.bytes(Encrypt={"Filter": Name("Standard"), "V": 1 if r == 2 else 2, "R": r, "Length": n * 8, "O": o, "U": u, "P": perm}, ID=[ident, ident])
    assert [p["text"] for p in reader._pieces(Document(data), None)] == ["secret text"]


def test_damaged_files_do_not_crash():
    import random

    rng, good = random.Random(4), rich()
    for _ in range(60):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 40)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        bad = bytes(bad[: rng.randrange(200, len(bad))])
        try:
            d = Document(bad)
        except ValueError:
            continue
        try:
            reader._blocks(d, None)
        except (ValueError, TypeError, AttributeError, KeyError, OverflowError, IndexError):
            pass  # a row of errors in the tables


def test_tables_in_spark(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "report.pdf").write_bytes(report())
    (tmp_path / "rich.pdf").write_bytes(rich())
    (tmp_path / "fake.pdf").write_bytes(b"<html>no</html>")
    (tmp_path / "locked.pdf").write_bytes(writer.Build().add(Document(report(1))).bytes("pw"))
    raw = reader.read_pdf(spark, str(tmp_path))
    assert raw.count() == 4
    counts = {n: reader.table(raw, n).count() for n in reader.SCHEMAS}
    assert counts["documents"] == 2 and counts["pages"] == 7 and counts["errors"] == 2 and counts["fields"] == 3 and counts["markdown"] == 2
    told = {Path(r.path).name: r.reason for r in reader.table(raw, "errors").collect()}
    assert "PasswordNeeded" in told["locked.pdf"] and "no PDF" in told["fake.pdf"]
    assert reader.table(raw, "documents", password="pw").count() == 3
    assert reader.table(raw, "pieces", pages=[2]).select("page_no").distinct().count() == 1
    assert reader.text_items(reader.table(raw, "pieces")).where("eol").count() > 5
    built = reader.build(raw.where("path like '%report%'"), pick=[2, 1])
    assert reader.table(built, "pages").count() == 2
    from pyspark.sql import functions as F

    both = reader.merged(raw.withColumn("g", F.lit("all")), "g", "path")
    assert reader.table(both, "pages").count() == 7
    assert Path(str(tmp_path)).exists() and content.UNIT


def test_a_fault_costs_its_page(spark, monkeypatch):
    """Page 2 of 3 cannot be read: pages 1 and 3 stay, and errors has one row, for that page."""
    read = content.read

    def broken(f, page, hidden):
        if page["_num"] == bad:
            raise ZeroDivisionError("broken page")
        return read(f, page, hidden)

    d = Document(report(3))
    bad = d.pages[1]["_num"]
    monkeypatch.setattr(content, "read", broken)
    for name in ("lines", "pieces", "ops", "page_text", "blocks"):
        rows = reader.records(name, "x", report(3))
        assert {r["page_no"] for r in rows} == {1, 3}, name
    assert reader.records("markdown", "x", report(3))[0]["n_blocks"] > 3 and len(reader.records("pages", "x", report(3))) == 3
    faults = reader.records("errors", "x", report(3))
    assert [(r["table"], r["page_no"], r["reason"]) for r in faults] == [("pieces", 2, "ZeroDivisionError: broken page")]


def test_a_fault_costs_its_record(monkeypatch):
    monkeypatch.setattr(Document, "links", lambda d: (_ for _ in ()).throw(KeyError("no link")))
    assert reader.records("links", "x", report(1)) == [] and len(reader.records("lines", "x", report(1))) > 5
    assert [(r["table"], r["page_no"]) for r in reader.records("errors", "x", report(1))] == [("links", None)]


def test_overprinted_title_above_columns():
    """Lines that span two columns, printed one over the other, are put in order like others."""
    m = Maker()
    c = say(72, 700, 30, "A TITLE OVER BOTH COLUMNS") + say(76, 700, 12, "A SMALLER TITLE OVER BOTH OF THE COLUMNS, TOO, AND WIDE ENOUGH")
    for i in range(8):
        c += say(72, 650 - 14 * i, 10, f"left column line {i} with words") + say(330, 650 - 14 * i, 10, f"right column line {i} with words")
    m.page(c)
    lines = [x["text"] for x in reader._lines(Document(m.bytes()), None)]
    assert sorted(lines[:2]) == ["A SMALLER TITLE OVER BOTH OF THE COLUMNS, TOO, AND WIDE ENOUGH", "A TITLE OVER BOTH COLUMNS"]
    assert lines[2:] == [f"{s} column line {i} with words" for s in ("left", "right") for i in range(8)]


def test_native_cipher_equals_the_plain_one():
    rng = random.Random(4)
    for n in (16, 32):
        key, iv, data = rng.randbytes(n), rng.randbytes(16), rng.randbytes(80)
        assert ciphers.aes_cbc_encrypt(key, iv, data, pad=False) == ciphers._plain_encrypt(key, iv, data)
        assert ciphers.aes_cbc_decrypt(key, iv, ciphers.aes_cbc_encrypt(key, iv, data)) == data
        assert ciphers._plain_decrypt(key, iv, ciphers._plain_encrypt(key, iv, data)) == data
    assert ciphers.aes_cbc_decrypt(bytes(16), bytes(16), b"") == b""


def composite(encoding, shown: bytes, more: dict | None = None, **font) -> bytes:
    """A page that shows these bytes in a composite font."""
    m = Maker()
    kid = m.put({"Type": Name("Font"), "Subtype": Name("CIDFontType0"), "BaseFont": Name("Kai"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Test1", "Supplement": 0}} | (more or {}))
    m.fonts["F9"] = m.put({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Kai"), "Encoding": m.put(encoding) if isinstance(encoding, Stream) else Name(encoding), "DescendantFonts": [kid]} | font)
    m.page(f"BT /F9 10 Tf 1 0 0 1 72 700 Tm <{shown.hex()}> Tj ET")
    return m.bytes()


@pytest.mark.parametrize("name,codec", [("90ms-RKSJ-H", "cp932"), ("EUC-H", "euc_jp"), ("GBK-EUC-H", "gbk"), ("KSCms-UHC-H", "cp949"), ("ETen-B5-H", "cp950"), ("UniJIS-UCS2-H", "utf-16-be"), ("UniGB-UTF16-H", "utf-16-be"), ("GBK2K-H", "gb18030")])
def test_codes_of_predefined_maps(name, codec):
    said = "漢字 ABC" if "UHC" not in name else "한글 漢字 ABC"
    p = reader.records("pieces", "x", composite(name, said.encode(codec)))
    assert "".join(x["text"] for x in p) == said


EMBEDDED = b"""/CMapName /Own def 2 begincodespacerange <00> <80> <8140> <9FFC> endcodespacerange
2 begincidrange <20> <7E> 1 <8140> <817E> 633 endcidrange"""


def test_embedded_map_widths_and_characters_by_glyph():
    ucs2 = "/CMapName /Adobe-Test1-UCS2 def 1 beginbfrange <0279> <027B> <6F22> endbfrange 1 beginbfchar <0022> <0041> endbfchar"
    data = composite(Stream({"CMapName": Name("Own")}, EMBEDDED), b"A\x81\x40\x81\x41", {"DW": 900, "W": [34, [250], 633, 633, 700]})
    p = reader.records("pieces", "x", data, cmaps={"Adobe-Test1-UCS2": ucs2})[0]
    assert p["text"] == "A漢漣" and abs(p["w"] - 10 * (0.25 + 0.7 + 0.9)) < 1e-6


def test_vertical_advance():
    data = composite("UniJIS-UCS2-V", "漢字永".encode("utf-16-be"), {"DW2": [880, -900], "W2": [ord("字"), [-500, 500, 880]]})
    p = reader.records("pieces", "x", data)[0]
    assert p["dir"] == "ttb" and abs(p["w"] - 10 * (0.9 + 0.5 + 0.9)) < 1e-6


@pytest.mark.parametrize("base,want", [("Times-Roman", 722 + 444 + 333), ("ABCDEF+TimesNewRoman,Bold", 722 + 444 + 500), ("Times-Italic", 611 + 444 + 333), ("Arial-BoldMT", 722 + 556 + 278), ("Helvetica", 667 + 556 + 222), ("Courier-Bold", 1800)])
def test_widths_of_standard_fonts(base, want):
    m = Maker()
    m.fonts["F9"] = m.put({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(base), "Encoding": Name("WinAnsiEncoding")})
    m.page(say(72, 700, 10, "Aé’", "F9"))
    p = reader.records("pieces", "x", m.bytes())[0]
    want = want if "Bold" not in base or "Courier" in base else {"ABCDEF+TimesNewRoman,Bold": 722 + 444 + 333, "Arial-BoldMT": 722 + 556 + 222}[base]
    assert p["text"] == "Aé’" and abs(p["w"] - want / 100) < 1e-6


def test_colour_spaces():
    m = Maker()
    tint = m.put({"FunctionType": 2, "Domain": [0, 1], "C0": [0, 0, 0], "C1": [1, 0.5, 0], "N": 1})
    table = m.put(Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1, 0, 1, 0, 1], "Size": [2], "BitsPerSample": 8}, bytes([0, 0, 0, 255, 0, 102])))
    spaces = {"S": [Name("Separation"), Name("Ink"), Name("DeviceRGB"), tint], "T": [Name("Separation"), Name("Ink"), Name("DeviceRGB"), table], "I": [Name("Indexed"), Name("DeviceRGB"), 1, b"\x00\x00\x00\xff\x00\x33"], "L": [Name("Lab"), {"WhitePoint": [0.95, 1, 1.09]}], "C": [Name("CalRGB"), {"WhitePoint": [0.95, 1, 1.09], "Gamma": [1, 1, 1], "Matrix": [0.4124, 0.2126, 0.0193, 0.3576, 0.7152, 0.1192, 0.1805, 0.0722, 0.9505]}], "P": [Name("Pattern")], "N": [Name("DeviceN"), [Name("A"), Name("B")], Name("DeviceCMYK"), m.put(Stream({"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1] * 4}, b"{ 0 0 }"))]}
    c = "/S cs 1 scn /T cs 0.5 sc /I cs 1 sc /L cs 100 0 0 sc /C CS 1 1 1 SC /P cs /X scn /N cs 0 0 scn 0 0 0 1 k /DeviceCMYK CS 0 0 0 0 SC 0.5 G"
    m.page(c, Resources={"Font": m.fonts, "ColorSpace": spaces})
    got = [(r["code"], [round(v, 2) for v in r["args"]]) for r in reader.records("ops", "x", m.bytes())]
    fills = [a for k, a in got if k == 11]
    assert [1.0, 0.5, 0.0] in fills and [0.5, 0.0, 0.2] in fills and [1.0, 0.0, 0.2] in fills and [1.0, 1.0, 1.0] in fills
    assert [round(v, 2) for v in colours.cmyk(0, 0, 0, 1)] == fills[-1] == [0.14, 0.12, 0.13]
    strokes = [a for k, a in got if k == 12]
    assert strokes[-1] == [0.5, 0.5, 0.5] and strokes[-2] == [1.0, 1.0, 1.0] and [1.0, 1.0, 1.0] in strokes[:3]


def icc(n: int, power: float) -> bytes:
    """A profile of one power curve, and the display's primaries as D50 has them."""
    curve = b"curv" + bytes(4) + (1).to_bytes(4, "big") + round(power * 256).to_bytes(2, "big") + bytes(2)
    xyz = lambda *v: b"XYZ " + bytes(4) + b"".join(round(x * 65536).to_bytes(4, "big", signed=True) for x in v)
    tags = [(b"kTRC", curve)] if n == 1 else [(x + b"TRC", curve) for x in (b"r", b"g", b"b")] + [(b"rXYZ", xyz(0.4361, 0.2225, 0.0139)), (b"gXYZ", xyz(0.3851, 0.7169, 0.0971)), (b"bXYZ", xyz(0.1431, 0.0606, 0.7141))]
    head, body, at = b"", b"", 132 + 12 * len(tags)
    for name, data in tags:
        head += name + (at + len(body)).to_bytes(4, "big") + len(data).to_bytes(4, "big")
        body += data
    return bytes(128) + len(tags).to_bytes(4, "big") + head + body


def test_profiles():
    for v in (0.0, 0.25, 0.6, 1.0):
        grey = colours.profile(icc(1, 1.0), 1)([v])
        assert max(abs(a - colours.shown(v)) for a in grey) < 1e-9
        rgb = colours.profile(icc(3, 2.0), 3)([v, v, v])
        assert max(abs(a - colours.shown(v * v)) for a in rgb) < 0.01
    assert colours.profile(icc(3, 1.0), 3)([1, 0, 0])[0] > 0.99 and colours.profile(b"junk", 3) is None


def test_paths_and_states():
    m = Maker()
    m.page("10 10 m 20 20 30 30 v 40 40 50 50 y S 2 J 1 j 4 M [3 1] 2 d /G gs /H gs /Z sh", Resources={"ExtGState": {"G": {"ca": 0.5, "CA": 0.25, "LW": 3, "BM": Name("Multiply"), "SMask": {"S": Name("Luminosity")}}, "H": {"SMask": Name("None")}}, "Shading": {"Z": m.put({"ShadingType": 2})}})
    got = [(r["code"], r["args"]) for r in reader.records("ops", "x", m.bytes())]
    assert (3, [10, 10, 20, 20, 30, 30]) in got and (3, [40, 40, 50, 50, 50, 50]) in got
    for want in ((19, [2]), (20, [1]), (25, [4]), (24, [3, 1, 2]), (21, [0.5]), (23, [0.25]), (13, [3]), (26, [1]), (30, [1]), (32, [])):
        assert want in got
    assert got[-1][0] == 27 and got[-1][1][0] > 0


def test_single_pages_turned_dropped_and_renamed():
    b = writer.Build().add(Document(report(3))).turned({2: 90, 3: 180, 9: 90}).dropped([1]).told({"Title": "Änderung", "Author": ""})
    d = Document(b.bytes())
    assert [r["rot"] for r in d.page_rows()] == [90, 180] and d.record()["info"] == {"Title": "Änderung"}


def two_columns(m: Maker, rows: int, middle: str = "") -> str:
    c = ""
    for i in range(rows):
        c += say(72, 650 - 14 * i, 10, f"left column line {i} with words") + say(330, 650 - 14 * i, 10, f"right column line {i} with words")
    return c + middle


def test_table_across_columns_stays_together():
    """Rows of short cells that go over the gutter are rows; the columns below are read one after the other."""
    m = Maker()
    table = "".join(say(72 + 100 * k, 720 - 14 * i, 10, f"c{i}{k}") for i in range(3) for k in range(5))
    m.page(table + two_columns(m, 10))
    lines = [x["text"] for x in reader._lines(Document(m.bytes()), None)]
    assert lines[:3] == [" ".join(f"c{i}{k}" for k in range(5)) for i in range(3)]
    assert lines[3:] == [f"{s} column line {i} with words" for s in ("left", "right") for i in range(10)]


def test_words_without_a_gap_at_the_gutter_are_one_line():
    m = Maker()
    title = "".join(say(100 + 60 * k, 700, 10, f"titlewd{k}") for k in range(7))
    m.page(title + two_columns(m, 10))
    lines = [x["text"] for x in reader._lines(Document(m.bytes()), None)]
    assert lines[0] == " ".join(f"titlewd{k}" for k in range(7)) and lines[1] == "left column line 0 with words" and lines[11] == "right column line 0 with words"


def test_ranged_reads_of_the_source(spark, tmp_path):
    from quire.sources.pdf.datasource import PdfSource, document_id

    (tmp_path / "a.pdf").write_bytes(report(2))
    spark.dataSource.register(PdfSource)
    load = lambda **o: spark.read.format("pdf").option("table", "lines").options(**o).load(str(tmp_path))
    rows = sorted(map(str, load().collect()))
    assert rows == sorted(map(str, load(ranged="true").collect())) == sorted(map(str, reader.table(reader.read_pdf(spark, str(tmp_path)), "lines").collect()))
    assert load().first().doc_id == document_id(f"file:{tmp_path}/a.pdf")


def test_content_keys():
    # FNV-1a of single bytes is published for "a": 0xE40C292C.
    assert ciphers.content_key(b"a") == "1-" + np.base_repr(0xE40C292C, 36).lower() and ciphers.content_key(b"") == "0-" + np.base_repr(2166136261, 36).lower()
    assert ciphers.content_key(b"abcd") == "4-" + np.base_repr((2166136261 ^ 0x64636261) * 16777619 % 2**32, 36).lower()
    assert len({ciphers.content_key(bytes(40) + bytes([i]) + bytes(40)) for i in range(256)}) == 256
