"""Queries that write, read and calculate documents: what they find is held against SQL over the texts."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import filters, formcalc
from quire.operators import reading, writer
from quire.session import Scratch, dealt
from quire.sources.pdf import reader
from quire.sources.pdf.objects import Name, Ref, Stream
from quire.sources.xfa import read_xfa

QUERIES: dict = {}
SQL: dict[str, str] = {}
PER_PAGE = 50
#: Documents a task, as one costs milliseconds; words a page of xy_cut_lines.
DOCUMENTS, WORDS = 125, 80


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def typeset(text: str) -> bytes:
    """A text as a PDF: a line a line, PER_PAGE to a page, with the first line as the title."""
    rows = text.split("\n")
    objects: dict = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Lang": b"en"}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")}}
    kids = []
    for at in range(0, len(rows), PER_PAGE):
        out = []
        for k, row in enumerate(rows[at : at + PER_PAGE]):
            raw = row.encode("cp1252", "replace")
            out.append(b"BT /F1 9 Tf 72 %d Td <" % (740 - 14 * k) + raw.hex().encode() + b"> Tj ET")
        n = max(objects) + 1
        objects[n] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"\n".join(out)))
        objects[n + 1] = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(3, 0)}}, "Contents": Ref(n, 0)}
        kids.append(Ref(n + 1, 0))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return writer.assembled(objects, {"Root": Ref(1, 0)})


def typeset_documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, content: every text of documents as a PDF file."""

    def run(it):
        for b in it:
            yield pd.DataFrame({"doc_id": b["doc_id"], "path": b["doc_id"].astype(str), "content": [typeset(t or "") for t in b["text"]]})

    d = dealt(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id", DOCUMENTS)
    return d.mapInPandas(run, "doc_id long, path string, content binary")


_COUNT = f"SELECT doc_id, CAST((max(n) + {PER_PAGE - 1}) // {PER_PAGE} AS INTEGER) AS n_pages, count(*) FILTER (WHERE trim(t) <> '') AS n_lines, CAST(sum(len(list_filter(string_split(t, ' '), lambda v: v <> ''))) AS BIGINT) AS n_words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) GROUP BY 1"


@query(_COUNT)
def pdf_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = typeset_documents(spark, sf)
    ln = reader.table(raw, "lines").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n_words"))
    d = reader.table(raw, "documents").select("doc_id", "n_pages")
    return d.join(ln, "doc_id").select("doc_id", "n_pages", "n_lines", "n_words")


_ROWS = f"rows AS (SELECT doc_id, n - 1 AS line_no, CAST((n - 1) // {PER_PAGE} + 1 AS INTEGER) AS page_no, t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"


@query(f"WITH {_ROWS} SELECT doc_id, page_no, count(*) FILTER (WHERE t <> '') AS n_shown FROM rows GROUP BY 1, 2")
def pdf_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Text operations of every page: one for each of its rows that is not empty."""
    raw = typeset_documents(spark, sf)
    shown = reader.table(raw, "ops").where("code = 17").groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    pages = reader.table(raw, "pages").select("doc_id", "page_no")
    return pages.join(shown, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("n", F.lit(0)).alias("n_shown"))


@query("SELECT doc_id, CAST(count(*) AS INTEGER) AS n_pages, true AS locked FROM (SELECT doc_id, unnest([3, 1, 1, 2]) AS p, (len(string_split(text, chr(10))) + 49) // 50 AS n FROM documents) WHERE p <= n GROUP BY 1")
def pdf_build(spark: SparkSession, sf: str) -> DataFrame:
    """Pages 3, 1, 1 and 2 of every file, written anew, turned, encrypted and read again with the password; without it they are locked."""
    built = Scratch(spark, "built").write(reader.build(typeset_documents(spark, sf), pick=[3, 1, 1, 2], turn=90, encrypt="pass"), "files")
    opened = reader.table(built, "pages", password="pass").where("rot = 90").groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    errors = reader.table(built, "errors").select("doc_id", F.col("reason").startswith("PasswordNeeded").alias("locked"))
    return opened.join(errors, "doc_id").select("doc_id", "n_pages", "locked")


VOLUME = 64


@query(f"SELECT CAST(doc_id // {VOLUME} AS VARCHAR) AS path, CAST(sum((len(string_split(text, chr(10))) + 49) // 50) AS INTEGER) AS n_pages FROM documents GROUP BY 1")
def pdf_merge(spark: SparkSession, sf: str) -> DataFrame:
    """One file for each VOLUME documents: a group is bounded, as the file that it becomes must be."""
    raw = typeset_documents(spark, sf).withColumn("volume", F.floor(F.col("doc_id") / VOLUME).cast("string"))
    return reader.table(reader.merged(raw, "volume", "doc_id"), "documents").select("path", "n_pages")


_SAID = r"trim(regexp_replace(t, '[ \t\n\v\f\r]+', ' ', 'g'))"
#: What the reader sees of a typeset row: its place from the top as a share of the page, and as heads and feet that repeat are known.
_SEEN = f"seen AS (SELECT doc_id, page_no, line_no, {_SAID} AS t, (43 + 14 * (line_no % {PER_PAGE})) / 792.0::DOUBLE AS place FROM rows WHERE {_SAID} <> '')"
_EDGES = "edge AS (SELECT *, concat(CAST(floor(place * 40 + 0.5) AS VARCHAR), '|', substring(regexp_replace(t, '[0-9]+', '#', 'g'), 1, 40)) AS k FROM seen WHERE place < 0.12 OR place > 0.86), total AS (SELECT doc_id, max(page_no) AS pages FROM rows GROUP BY 1), often AS (SELECT doc_id, k FROM edge JOIN total USING (doc_id) WHERE pages >= 3 GROUP BY doc_id, k, pages HAVING count(*) >= greatest(2, floor(0.4 * pages))), gone AS (SELECT doc_id, line_no FROM edge SEMI JOIN often USING (doc_id, k) UNION SELECT doc_id, line_no FROM edge WHERE (place < 0.1 OR place > 0.88) AND regexp_full_match(t, '[0-9]{1,4}'))"


@query(f"WITH {_ROWS}, {_SEEN}, {_EDGES}, kept AS (SELECT * FROM seen ANTI JOIN gone USING (doc_id, line_no)), page AS (SELECT doc_id, page_no, concat('```', chr(10), string_agg(t, chr(10) ORDER BY line_no), chr(10), '```') AS md FROM kept GROUP BY 1, 2) SELECT d.doc_id, CAST(count(md) AS INTEGER) AS n_blocks, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY page_no), '') AS markdown FROM documents d LEFT JOIN page USING (doc_id) GROUP BY 1")
def pdf_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in a typewriter's font are code, a block a page, without the heads and feet that pages repeat."""
    return reader.table(typeset_documents(spark, sf), "markdown").select("doc_id", "n_blocks", "markdown")


@query(f"WITH {_ROWS}, page AS (SELECT DISTINCT doc_id, 2 + 2 * page_no AS n FROM rows) SELECT doc_id, CAST(1 AS INTEGER) AS src, CAST(2 AS INTEGER) AS dst FROM page GROUP BY 1 UNION ALL SELECT doc_id, 2, CAST(n + 1 AS INTEGER) FROM page UNION ALL SELECT doc_id, CAST(n + 1 AS INTEGER), CAST(unnest([2, 3, n]) AS INTEGER) FROM page")
def pdf_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of every file's object graph."""
    o = reader.table(typeset_documents(spark, sf), "objects")
    return o.select("doc_id", F.col("num").alias("src"), F.explode("refs").alias("dst"))


def _run_lengths(raw: bytes) -> bytes:
    """Runs as runs, the rest a byte at a time."""
    out, i = bytearray(), 0
    while i < len(raw):
        n = 1
        while n < 128 and raw[i + n : i + n + 1] == raw[i : i + 1]:
            n += 1
        out += bytes([257 - n]) + raw[i : i + 1] if n > 1 else b"\0" + raw[i : i + 1]
        i += n
    return bytes(out) + b"\x80"


def _lzw(raw: bytes) -> bytes:
    """The published scheme: codes of 9 to 12 bits, grown one code early, the table begun anew when it is full."""
    bits, have, out = 0, 0, bytearray()
    table, width = {bytes([i]): i for i in range(256)}, 9

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            out.append(bits >> (have - 8) & 255)
            have -= 8
            bits &= (1 << have) - 1

    put(256)
    word = b""
    for c in raw:
        more = word + bytes([c])
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = len(table) + 2
        # The reader is one entry behind, and grows one code early.
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n >= 4094:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([c])
    if word:
        put(table[word])
        n = len(table) + 3
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def _rows_above(raw: bytes, columns: int) -> bytes:
    """PNG's up predictor: each row less the one above."""
    out, above = bytearray(), bytes(columns)
    for i in range(0, len(raw), columns):
        row = raw[i : i + columns]
        out += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=False))
        above = row
    return bytes(out)


@query("SELECT doc_id, unnest(['Flate', 'LZW', 'RunLength', 'predictor']) AS coder, md5(text) AS digest FROM documents")
def filter_coders(spark: SparkSession, sf: str) -> DataFrame:
    """Texts through each encoder, and back through the reader's filter."""

    def back(t: str | None) -> list[str]:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 16)
        got = [
            filters.decoded(zlib.compress(raw), ["FlateDecode"], [])[0],
            filters.decoded(_lzw(raw), ["LZWDecode"], [])[0],
            filters.decoded(_run_lengths(raw), ["RunLengthDecode"], [])[0],
            filters.decoded(zlib.compress(_rows_above(padded, 16)), ["FlateDecode"], [{"Predictor": 12, "Columns": 16}])[0][: len(raw)],
        ]
        return [hashlib.md5(x).hexdigest() for x in got]

    def run(it):
        for b in it:
            rows = [(d, c, x) for d, t in zip(b["doc_id"], b["text"], strict=True) for c, x in zip(("Flate", "LZW", "RunLength", "predictor"), back(t), strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "coder", "digest"])

    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").mapInPandas(run, "doc_id long, coder string, digest string")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Texts through encoders, and back through the filters in a chain."""

    def back(t: str | None) -> str:
        raw = base64.a85encode(zlib.compress((t or "").encode()).hex().encode()) + b"~>"
        return hashlib.md5(filters.decoded(raw, ["ASCII85Decode", "AHx", "Fl"], [])[0]).hexdigest()

    def run(it):
        for b in it:
            yield pd.DataFrame({"doc_id": b["doc_id"], "digest": [back(t) for t in b["text"]]})

    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").mapInPandas(run, "doc_id long, digest string")


@query("SELECT l_orderkey AS doc_id, floor(sum(floor(l_quantity * l_extendedprice * 100 + 0.5)) + 0.5) / 100 AS total, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def form_recalculation(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a form: an amount a line by formula, and their total, in calculation order."""

    def total(rows) -> float:
        fields, names = [], []
        for i, r in enumerate(rows):
            names.append(f"a{i}")
            fields += [_field(f"q{i}", str(r["l_quantity"])), _field(f"p{i}", repr(float(r["l_extendedprice"]))), _field(f"a{i}", "", f'event.value = this.getField("q{i}").value * getField("p{i}").value;', "AFNumber_Format(2, 0)", i + 1)]
        listed = ", ".join(f'"{n}"' for n in names)
        fields.append(_field("total", "", f'AFSimple_Calculate("SUM", new Array({listed}))', "AFNumber_Format(2, 0)", len(names) + 1))
        return float(formcalc.recalculated(fields, list(range(1, len(names) + 2)))[0]["total"])

    def run(it):
        for b in it:
            yield pd.DataFrame({"doc_id": b["l_orderkey"], "total": [total(r) for r in b["rows"]], "n": [len(r) for r in b["rows"]]})

    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_extendedprice")).alias("rows"))
    return li.mapInPandas(run, "doc_id long, total double, n long")


def _field(name: str, value: str, calc: str = "", fmt: str = "", obj: int = 0) -> dict:
    return {"name": name, "value": value, "calc": calc, "format": fmt, "obj": obj}


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * p_size + 1 AS y, CASE WHEN p_size < 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS low FROM part")
def calculator_function(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("y double, low double")
    def f(x: pd.Series) -> pd.DataFrame:
        rows = [formcalc.postscript("{ dup dup mul 1 add exch 25 lt { 1 } { 0 } ifelse }", [v]) for v in x]
        return pd.DataFrame(rows, columns=["y", "low"])

    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", f("p_size").alias("r")).select("p_partkey", "r.*")


_WORDS = "w AS (SELECT doc_id, substring(t, 1, 40) AS t, n - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), ' '), lambda v: v <> '')) AS t, generate_subscripts(list_filter(string_split(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), ' '), lambda v: v <> ''), 1) AS n FROM documents))"


@query(f"WITH {_WORDS} SELECT doc_id, CAST(k // 80 + 1 AS BIGINT) AS page_no, CAST(k % 80 AS INTEGER) AS line_id, t AS text FROM w")
def xy_cut_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words laid out 80 to a page, in two columns where a page has 16 or more, come out in the order of the text."""
    page = {"x0": 0.0, "y0": 0.0, "w": 612.0, "h": 792.0}

    def laid(words: list[str]) -> list[dict]:
        n = len(words)
        left = (n + 1) // 2 if n >= 16 else n
        piece = lambda r, c: {"x": 40.0 + 290 * c, "y": 770.0 - 9.0 * r, "size": 8.0, "w": 100.0, "ang": 0.0, "text": words[r + c * left], "font": "F", "base": "F", "bold": False, "mcid": -1, "dir": "ltr"}
        # Rows are handed over as they stand on the page, from the top, left and right in turn.
        return reading.page_lines([piece(r, c) for r in range(left) for c in (0, 1) if r + c * left < n and (not c or left < n)], page)

    def run(it):
        out: list[list] = [[], [], [], []]
        frame = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "page_no", "line_id", "text"])
        for b in it:
            for doc_id, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words.as_py() or []
                for at in range(0, len(words), WORDS):
                    found = laid(words[at : at + WORDS])
                    for column, values in zip(out, ([doc_id] * len(found), [at // WORDS + 1] * len(found), [x["line_id"] for x in found], [x["text"] for x in found]), strict=True):
                        column += values
                    if len(out[0]) >= 20000:
                        yield frame()
                        out[:] = [[], [], [], []]
        yield frame()

    words_ = F.filter(F.split(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", " "), " "), lambda v: v != "")
    d = dealt(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id", DOCUMENTS)
    return d.select("doc_id", F.transform(words_, lambda v: F.substring(v, 1, 40)).alias("words")).mapInArrow(run, "doc_id long, page_no long, line_id int, text string")


@query("SELECT o_custkey, count(*) AS repeats, sum(o_orderkey)::DOUBLE AS total FROM orders GROUP BY 1")
def xfa_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as an XFA form with a repeated subform and a sum."""

    def laid(keys) -> tuple[int, float]:
        items = "".join(f"<o><k>{k}</k></o>" for k in keys)
        xml = f'<xdp><template><subform name="f" layout="tb"><subform name="o" layout="tb"><occur min="0" max="-1"/><field name="k" h="10pt"/></subform><field name="t" h="10pt"><calculate><script>Sum(k[*])</script></calculate></field></subform></template><datasets><data><f>{items}</f></data></datasets></xdp>'
        boxes, _ = read_xfa(xml)
        return sum(b["name"] == "k" for b in boxes), float(boxes[-1]["text"])

    def run(it):
        for b in it:
            got = [laid(k) for k in b["keys"]]
            yield pd.DataFrame({"o_custkey": b["o_custkey"], "repeats": [n for n, _ in got], "total": [t for _, t in got]})

    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"))
    return o.mapInPandas(run, "o_custkey long, repeats long, total double")
