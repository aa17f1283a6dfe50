from quire.operators import forms, writer
from quire.sources.pdf import reader
from quire.sources.pdf.datasource import PdfSource
from quire.sources.pdf.extract import Document
from quire.sources.pdf.objects import Name, Stream
from tests.pdfmaker import Maker, report, say


def order_form() -> bytes:
    m = Maker()
    p = m.page(say(72, 700, 12, "Order") + "q 10 0 0 10 50 50 cm /I Do Q")
    js = lambda s: {"C": {"S": Name("JavaScript"), "JS": s}, "F": {"S": Name("JavaScript"), "JS": b"AFNumber_Format(2, 0)"}}
    make = lambda name, y, v=b"", **k: m.put({"Subtype": Name("Widget"), "FT": Name("Tx"), "T": name, "V": v, "Rect": [10, y, 100, y + 15]} | k)
    total = make("total", 10, AA=js(b"AFSimple_Calculate('SUM', ['amount', 'tax'])"))
    fields = [total, make("qty", 30, b"3"), make("price", 50, b"1,500"), make("amount", 70, AA=js(b"event.value = getField('qty').value * getField('price').value;")), make("tax", 90, b"10")]
    m.objects[p.num]["Annots"] = fields
    image = m.put(Stream({"Subtype": Name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray"), "Filter": Name("AHx")}, b"00ff>"))
    m.objects[p.num]["Resources"] = {"Font": m.fonts, "XObject": {"I": image}}
    m.objects[1]["AcroForm"] = {"Fields": fields, "CO": [fields[3], total], "XFA": m.put(Stream({}, b"<template><subform name='f'><draw w='9pt' h='9pt'><value><text>hi</text></value></draw></subform></template>"))}
    return m.bytes()


def test_forms_images_and_xfa_in_tables(spark, tmp_path):
    (tmp_path / "f.pdf").write_bytes(order_form())
    raw = reader.read_pdf(spark, str(tmp_path))
    got = {r["name"]: (r.value, r.skipped) for r in forms.recalculated(reader.table(raw, "fields"), reader.table(raw, "documents")).collect()}
    assert got == {"total": ("4510.00", False), "qty": ("3", False), "price": ("1,500", False), "amount": ("4500.00", False), "tax": ("10", False)}
    image = reader.table(raw, "images").first()
    assert (image.w, image.h, image.space, bytes(image.data)) == (2, 1, "DeviceGray", b"\0\xff")
    assert [r.kind for r in reader.table(raw, "geometry").collect()] == ["box"]
    assert [r.text for r in reader.table(raw, "xfa_boxes").collect()] == ["hi"] and reader.table(raw, "documents").first().xfa


def test_data_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(report(2))
    (tmp_path / "b.pdf").write_bytes(writer.Build().add(Document(report(1))).bytes("pw"))
    (tmp_path / "c.pdf").write_bytes(b"junk")
    spark.dataSource.register(PdfSource)
    load = lambda t, **o: spark.read.format("pdf").option("table", t).options(**o).load(str(tmp_path))
    assert load("pages").count() == 2 and load("pages", password="pw").count() == 3 and load("errors").count() == 2
    assert load("lines", pages="2").select("page_no").distinct().collect()[0].page_no == 2
