from quire.operators import reading
from quire.sources.pdf import reader
from quire.sources.pdf.extract import Document
from quire.sources.pdf.ranged import CHUNK, Ranged, first_page_end, missing
from tests.pdfmaker import Maker, report, say


def test_intervals():
    assert missing([(0, 5), (3, 8), (10, 12)], 15) == [(8, 10), (12, 15)] and missing([], 3) == [(0, 3)] and missing([(0, 9)], 5) == []


def test_reads_head_first_page_and_tail_then_the_rest():
    data = b"%PDF-1.4\n1 0 obj<</Linearized 1/L 9/E 300000/N 5>>endobj" + bytes(i % 251 for i in range(3 * CHUNK))
    asked = []

    def read(a, n):
        asked.append((a, n))
        return data[a : a + n]

    r = Ranged(read, len(data))
    assert first_page_end(data) == 300000 and not r.whole
    assert asked == [(0, CHUNK), (CHUNK, 300000 + 4096 - CHUNK), (len(data) - CHUNK, CHUNK)]
    assert r.complete() == data and r.whole and len(asked) == 4
    small = report(1)
    assert Ranged(lambda a, n: small[a : a + n], len(small)).complete() == small


def test_overprinted_lines_are_layers():
    m = Maker()
    m.page(say(72, 500, 10, "an ordinary line of text in the page") + say(80, 500, 24, "DRAFT OVER IT") + say(72, 480, 10, "and the next line below it"))
    lines = [x["text"] for x in reader._lines(Document(m.bytes()), None)]
    assert sorted(lines) == ["DRAFT OVER IT", "an ordinary line of text in the page", "and the next line below it"]
    assert reading.text_of([{"text": "a"}, {"text": "b"}]) == "a\nb"
