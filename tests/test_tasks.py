"""That work is spread over tasks, and what small things cost."""

from quire.functions import ciphers
from quire.plans import documents, files
from quire.sources.pdf import objects, reader
from quire.sources.pdf.content import read
from quire.sources.pdf.extract import Document
from quire.sources.pdf.fonts import Font

PARTS = "/root/testdata/sf0.01"


def test_parts_are_dealt_out(spark):
    raw = files.specimens(spark, PARTS)
    assert raw.rdd.getNumPartitions() == 4 and raw.select("doc_id").distinct().count() == 2000


def test_a_font_works_out_only_codes_that_are_shown():
    d = Document(files.specimen(5, "Brand#5 LARGE", 0.25))
    page = read(d.f, d.pages[0])
    assert [p["text"] for p in page.pieces] == ["Brand#5 LARGE", "Brand#5 LARGE", "漢字5"]
    simple = [f for f in page.fonts.values() if not f.wide]
    assert len(simple) == 2 and all(len(f.single) == len(set("Brand#5 LARGE")) for f in simple)


def test_differences_leave_the_base_encoding_as_it_is():
    f = Document(files.specimen(1, "x", 0.1)).f
    encoded = lambda e: Font(f, {"BaseFont": objects.Name("Times-Roman"), "Encoding": e}, "F")
    base = encoded(objects.Name("WinAnsiEncoding"))
    own = encoded({"BaseEncoding": objects.Name("WinAnsiEncoding"), "Differences": [65, objects.Name("B")]})
    again = encoded(objects.Name("WinAnsiEncoding"))
    assert own.map[65] == "B" and base.map[65] == again.map[65] == "A" and own.widths[65] != again.widths[65]


def test_arrays_of_numbers_are_read_at_once(monkeypatch):
    plain, calls = objects.parse, []
    monkeypatch.setattr(objects, "parse", lambda *a: calls.append(a) or plain(*a))
    assert plain(b" [1 -2. +.5\n07\r]x", 0) == ([1, -2.0, 0.5, 7], 16) and not calls
    assert plain(b"[]", 0) == ([], 2) and plain(b"[ 1 2 R 3]", 0) == ([objects.Ref(1, 2), 3], 10)
    assert plain(b"[1 2 (a)3]", 0) == ([1, 2, b"a", 3], 10) and plain(b"[1 2", 0) == ([1, 2], 5) and plain(b"[1-2]", 0)[0] == [b"1-2"]


def test_records_of_small_files_share_frames(monkeypatch):
    frames = []
    monkeypatch.setattr(reader.pd, "DataFrame", lambda d, f=reader.pd.DataFrame: frames.append(len(d["doc_id"])) or f(d))

    class Raw:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            made = {"doc_id": [*range(40)], "path": ["p"] * 40, "content": [files.specimen(i, "x y", 0.5) for i in range(40)]}
            return [run_row for f in run(iter([made])) for run_row in f["doc_id"]]

    got = reader.table(Raw(), "pieces")
    assert got == [i for i in range(40) for _ in range(3)] and frames == [120]


def test_words_of_documents_are_laid_out_a_row_at_a_time(spark, tmp_path):
    rows = [(1, " ".join(f"a{i}" for i in range(100))), (1, "b0  b1\tb2"), (2, None), (3, " "), (4, " ".join(f"c{i}" for i in range(16)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = documents.xy_cut_lines(spark, str(tmp_path))
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    want = [(1, i // 80 + 1, i % 80, f"a{i}") for i in range(100)] + [(1, 1, i, f"b{i}") for i in range(3)] + [(4, 1, i, f"c{i}") for i in range(16)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_files_sealed_together_share_the_slow_hash_and_no_key():
    files_ = [documents.typeset(t) for t in ("one", "two", "three")]
    made = []

    class Raw:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            for f in run(iter([{"doc_id": [1, 2, 3], "path": ["p"] * 3, "content": files_}])):
                made.extend(f["content"])

    ciphers.hash_2b.cache_clear()
    reader.build(Raw(), encrypt="pass")
    assert ciphers.hash_2b.cache_info().misses == 4
    opened = [Document(x, "pass") for x in made]
    assert ciphers.hash_2b.cache_info().misses == 4
    assert len({d.f.key for d in opened}) == 3 and [reader.records("lines", "p", x, "pass")[0]["text"] for x in made] == ["one", "two", "three"]
    assert all(reader.records("errors", "p", x, w)[0]["reason"].startswith("PasswordNeeded") for x in made for w in ("", "Pass"))
    # Sealed by another call: other salts.
    again, made[:] = made[0], []
    reader.build(Raw(), encrypt="pass")
    salts = lambda x: Document(x, "pass").f.get(Document(x, "pass").f.trailer["Encrypt"])["U"][32:]
    assert salts(again) != salts(made[0]) == salts(made[1])
