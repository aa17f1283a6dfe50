"""Queries over files with structure, outlines, links, notes, forms, attachments and layers: a file for each conversation, held against SQL over the turns."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import colour
from quire.operators import writer
from quire.operators.blocks import documents_json
from quire.session import Scratch, dealt
from quire.sources import cmaps
from quire.sources.pdf import metrics, reader
from quire.sources.pdf.objects import Name, Ref, Stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def utf16(s: str) -> bytes:
    return b"\xfe\xff" + s.encode("utf-16-be")


def conversation(number: int, turns: list[tuple[int, str, str]]) -> bytes:
    """A tagged file of a conversation: a page a turn, with its role as a heading and its text as a paragraph."""
    objects: dict = {}

    def put(o) -> Ref:
        objects[len(objects) + 1] = o
        return Ref(len(objects), 0)

    root, tree = put(None), put(None)
    bold, plain = (put({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(b), "Encoding": Name("WinAnsiEncoding")}) for b in ("Helvetica-Bold", "Helvetica"))
    group = put({"T": b"conv", "FT": Name("Tx")})
    roles = sorted({r for _, r, _ in turns})
    layers = {r: put({"Type": Name("OCG"), "Name": r.encode()}) for r in roles}
    struct, pages, names, files, items, widgets = put(None), [], [], [], [], []
    nodes: list[Ref] = []
    for turn, role, said in turns:
        show = [f"/H2 <</MCID 0>> BDC BT /B 14 Tf 72 740 Td <{role.encode('cp1252', 'replace').hex()}> Tj ET EMC", "/P <</MCID 1>> BDC"]
        for k, row in enumerate(said.split("\n")):
            show.append(f"BT /R 9 Tf 72 {710 - 12 * k} Td <{row.encode('cp1252', 'replace').hex()}> Tj ET")
        text = put(Stream({"Filter": Name("FlateDecode")}, zlib.compress("\n".join([*show, "EMC"]).encode("latin-1"))))
        page = put(None)
        link = {"Subtype": Name("Link"), "Rect": [10, 10, 50, 20]} | ({"A": {"S": Name("URI"), "URI": f"https://example.org/{number}/{turn}".encode()}} if turn % 2 == 0 else {"Dest": [pages[0], Name("Fit")]})
        note = {"Subtype": Name("Text"), "Rect": [60, 10, 80, 30], "Contents": utf16(said), "T": role.encode(), "C": [1, 0, 0], "F": turn}
        field = put({"Subtype": Name("Widget"), "Parent": group, "T": f"turn{turn}".encode(), "V": role.encode(), "Rect": [100, 10, 190, 30]})
        box = put({"Subtype": Name("Widget"), "FT": Name("Btn"), "T": f"user{turn}".encode(), "AP": {"N": {"Yes": plain, "Off": plain}}, "AS": Name("Yes" if role == "user" else "Off"), "Rect": [200, 10, 220, 30]})
        widgets += [field, box]
        height = max(792, 120 + 12 * said.count("\n"))
        objects[page.num] = {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 792 - height, 612, 792], "Resources": {"Font": {"B": bold, "R": plain}}, "Contents": text, "Annots": [put(link), put(note), field, box]}
        pages.append(page)
        names += [f"turn{turn}".encode(), [page, Name("Fit")]]
        files += [f"{turn}.txt".encode(), put({"Type": Name("Filespec"), "F": f"{turn}.txt".encode(), "EF": {"F": put(Stream({"Filter": Name("FlateDecode")}, zlib.compress(said.encode())))}})]
        nodes += [put({"S": Name("H2"), "P": struct, "Pg": page, "K": 0}), put({"S": Name("Said"), "P": struct, "Pg": page, "K": 1})]
    outlines, top = put(None), put(None)
    items = [put(None) for _ in turns]
    for i, ((turn, role, _), page) in enumerate(zip(turns, pages, strict=True)):
        objects[items[i].num] = {"Title": f"{turn}: {role}".encode(), "Parent": top, "Dest": [page, Name("Fit")]} | ({"Next": items[i + 1]} if i + 1 < len(items) else {})
    objects[top.num] = {"Title": utf16(f"Conversation {number}"), "Parent": outlines, "First": items[0], "Last": items[-1], "Count": len(items), "A": {"S": Name("GoTo"), "D": f"turn{turns[-1][0]}".encode()}}
    objects[outlines.num] = {"First": top, "Last": top, "Count": 1}
    objects[struct.num] = {"Type": Name("StructTreeRoot"), "RoleMap": {"Said": Name("P")}, "K": put({"S": Name("Document"), "P": struct, "K": nodes})}
    objects[tree.num] = {"Type": Name("Pages"), "Kids": pages, "Count": len(pages)}
    objects[group.num]["Kids"] = widgets[::2]
    objects[root.num] = {
        "Type": Name("Catalog"),
        "Pages": tree,
        "MarkInfo": {"Marked": True},
        "StructTreeRoot": struct,
        "Outlines": outlines,
        "Names": {"Dests": {"Names": names}, "EmbeddedFiles": {"Names": files}},
        "AcroForm": {"Fields": [group, *widgets[1::2]]},
        "OCProperties": {"OCGs": [layers[r] for r in roles], "D": {"OFF": [layers[r] for r in roles if r == "system"]}},
        "PageLabels": {"Nums": [0, {"S": Name("r"), "P": b"c-"}, 2, {"S": Name("D"), "St": 5}]},
        "PageLayout": Name("OneColumn"),
    }
    return writer.assembled(objects, {"Root": root, "Info": put({"Title": utf16(f"Conversation {number}"), "Author": b"quire"})})


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, content: a file a conversation; its turns are gathered, as the file that it becomes holds them."""

    def run(it):
        for b in it:
            made = [conversation(i, [(t["turn"], t["role"], t["text"] or "") for t in turns]) for i, turns in zip(b["conv_id"], b["turns"], strict=True)]
            yield pd.DataFrame({"doc_id": b["conv_id"], "path": b["conv_id"].astype(str), "content": made})

    c = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.mapInPandas(run, "doc_id long, path string, content binary")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return reader.table(conversations(spark, sf), name)


_T = "t AS (SELECT conv_id AS doc_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations)"
_SAID = r"trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))"


@query("SELECT conv_id AS doc_id, CAST(count(*) AS INTEGER) AS n_pages, concat('Conversation ', CAST(conv_id AS VARCHAR)) AS title, 'quire' AS author, 'OneColumn' AS page_layout, true AS tagged FROM conversations GROUP BY 1")
def file_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "n_pages", F.col("info")["Title"].alias("title"), F.col("info")["Author"].alias("author"), "page_layout", "tagged")


@query(f"WITH {_T} SELECT doc_id, CAST(n AS INTEGER) AS ord, CAST(1 AS INTEGER) AS depth, concat(CAST(turn AS VARCHAR), ': ', role) AS title, CAST(n AS INTEGER) AS page_no, CAST(0 AS INTEGER) AS parent_ord FROM t UNION ALL SELECT doc_id, 0, 0, concat('Conversation ', CAST(doc_id AS VARCHAR)), CAST(max(n) AS INTEGER), NULL FROM t GROUP BY doc_id")
def file_outline(spark: SparkSession, sf: str) -> DataFrame:
    """The top entry goes to the last page, by a named destination."""
    return _table(spark, sf, "outline")


@query(f"WITH {_T} SELECT doc_id, concat('turn', CAST(turn AS VARCHAR)) AS name, CAST(n AS INTEGER) AS page_no FROM t")
def file_destinations(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "destinations")


@query(f"WITH {_T} SELECT doc_id, CAST(n AS INTEGER) AS page_no, CASE WHEN turn % 2 = 0 THEN concat('https://example.org/', CAST(doc_id AS VARCHAR), '/', CAST(turn AS VARCHAR)) END AS uri, CAST(CASE WHEN turn % 2 <> 0 THEN 1 END AS INTEGER) AS target_page, 40.0::DOUBLE AS w FROM t")
def file_links(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "links").select("doc_id", "page_no", "uri", "target_page", (F.col("rect")[2] - F.col("rect")[0]).alias("w"))


@query(f"WITH {_T} SELECT doc_id, CAST(n AS INTEGER) AS page_no, md5(text) AS contents, role AS author, CAST(turn AS INTEGER) AS flags, 1.0::DOUBLE AS red FROM t")
def file_annotations(spark: SparkSession, sf: str) -> DataFrame:
    a = _table(spark, sf, "annotations").where("subtype = 'Text'")
    return a.select("doc_id", "page_no", F.md5("contents").alias("contents"), "author", "flags", F.col("color")[0].alias("red"))


@query(f"WITH {_T} SELECT doc_id, CAST(n AS INTEGER) AS page_no, concat('conv.turn', CAST(turn AS VARCHAR)) AS name, CAST(0 AS INTEGER) AS kind, role AS value, false AS checked FROM t UNION ALL SELECT doc_id, CAST(n AS INTEGER), concat('user', CAST(turn AS VARCHAR)), 1, '', role = 'user' FROM t")
def file_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Text fields of a group, by their full names, and boxes."""
    return _table(spark, sf, "fields").select("doc_id", "page_no", "name", "kind", "value", "checked")


@query(f"WITH {_T} SELECT doc_id, CAST(n - 1 AS INTEGER) AS ord, concat(CAST(turn AS VARCHAR), '.txt') AS name, md5(text) AS digest FROM t")
def file_attachments(spark: SparkSession, sf: str) -> DataFrame:
    """In the name tree's order, which is that of the turns here."""
    return _table(spark, sf, "attachments").select("doc_id", "ord", "name", F.md5("data").alias("digest"))


@query("WITH r AS (SELECT DISTINCT conv_id AS doc_id, role FROM conversations) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY role) - 1 AS INTEGER) AS ord, role AS name, role <> 'system' AS \"on\" FROM r")
def file_layers(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "layers").select("doc_id", "ord", "name", "on")


@query(f"WITH {_T} SELECT doc_id, CAST(n AS INTEGER) AS page_no, CASE n WHEN 1 THEN 'c-i' WHEN 2 THEN 'c-ii' ELSE CAST(n + 2 AS VARCHAR) END AS label FROM t")
def file_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("doc_id", "page_no", "label")


@query(f"WITH {_T}, k AS (SELECT unnest([0, 1, 2, 3]) AS k) SELECT doc_id, CAST(1 + (n - 1) * 4 + k AS INTEGER) AS node_id, CAST(CASE WHEN k % 2 = 0 THEN 0 ELSE (n - 1) * 4 + k END AS INTEGER) AS parent_id, CAST(1 + k % 2 AS INTEGER) AS depth, CASE WHEN k < 2 THEN 'H2' ELSE 'P' END AS role, CAST(n AS INTEGER) AS page_no, CAST(CASE k WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE -1 END AS INTEGER) AS mcid FROM t, k UNION ALL SELECT DISTINCT doc_id, 0, NULL, 0, 'Document', NULL, -1 FROM t")
def file_structure(spark: SparkSession, sf: str) -> DataFrame:
    """In preorder; roles as the file's role map has them."""
    return _table(spark, sf, "structure").drop("alt")


@query(f"WITH {_T} SELECT doc_id, CAST(2 * (n - 1) AS INTEGER) AS block_id, CAST(n AS INTEGER) AS page_no, 'heading' AS kind, CAST(2 AS INTEGER) AS level, role AS text FROM t UNION ALL SELECT doc_id, CAST(2 * (n - 1) + 1 AS INTEGER), CAST(n AS INTEGER), 'para', 0, {_SAID} FROM t WHERE {_SAID} <> ''")
def file_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks by the structure tree."""
    return _table(spark, sf, "blocks").select("doc_id", "block_id", "page_no", "kind", "level", "text")


_MARKDOWN = rf"SELECT doc_id, string_agg(concat('## ', role, chr(10), chr(10), regexp_replace({_SAID}, '^([#>])', '\\\1')), chr(10) || chr(10) ORDER BY n) AS markdown, CAST(2 * count(*) AS INTEGER) AS n_blocks FROM t GROUP BY 1"


@query(f"WITH {_T} {_MARKDOWN}")
def file_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "markdown").select("doc_id", "markdown", "n_blocks")


@query(f"WITH {_T} SELECT doc_id, count(*) FILTER (WHERE {_SAID} <> '') + count(*) AS n_blocks, CAST(sum(length({_SAID}) + length(role)) AS BIGINT) AS n_chars FROM t GROUP BY 1")
def file_json(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks as one JSON text a document, read back."""
    j = documents_json(_table(spark, sf, "blocks"))
    blocks = F.from_json("json", "array<struct<kind:string,text:string,level:int,page:int>>")
    n = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.length(b.text))
    return j.select("doc_id", F.size(blocks).cast("long").alias("n_blocks"), n.alias("n_chars"))


@query(f"WITH {_T} SELECT doc_id, concat('conv.turn', CAST(turn AS VARCHAR)) AS name, CASE turn WHEN 0 THEN 'Ärger ✓' WHEN 1 THEN '' ELSE role END AS value FROM t")
def file_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Fields filled by an update of the file, and read again."""
    raw = reader.filled(conversations(spark, sf), {"conv.turn0": "Ärger ✓", "conv.turn1": ""})
    return reader.table(raw, "fields").where("kind = 0").select("doc_id", "name", "value")


@query(f"WITH {_T} SELECT doc_id, CAST(n AS INTEGER) AS page_no, CAST(CASE WHEN n = 2 THEN 90 ELSE 0 END AS INTEGER) AS rot, {_SAID} AS said FROM t WHERE n <= 2")
def file_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """The first two pages written anew, the second turned, others left out, with what they say."""
    raw = Scratch(spark, "rebuilt").write(reader.build(conversations(spark, sf), pick=[1, 2], turns={2: 90}), "files")
    pages = reader.table(raw, "pages").select("doc_id", "page_no", "rot")
    said = reader.table(raw, "pieces").where("mcid = 1").groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_id", "text"))), lambda x: x.text), " ").alias("t"))
    return pages.join(said, ["doc_id", "page_no"], "left").select("doc_id", "page_no", "rot", F.coalesce(F.trim(F.regexp_replace("t", "[ \\t\\n\\x0B\\f\\r]+", " ")), F.lit("")).alias("said"))


@query("SELECT DISTINCT conv_id AS doc_id, 'documents' AS \"table\", CASE conv_id % 3 WHEN 0 THEN 'ValueError' ELSE 'PasswordNeeded' END AS told FROM conversations WHERE conv_id % 3 <> 1")
def pdf_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Of three files one is no PDF, one is whole and one is locked; the whole one has no row."""
    raw = conversations(spark, sf).withColumn("k", F.col("doc_id") % 3)
    locked = reader.build(raw.where("k = 2"), pick=[1], encrypt="pass")
    mixed = raw.where("k = 0").select("doc_id", "path", F.lit(b"<html></html>").alias("content")).unionByName(raw.where("k = 1").drop("k")).unionByName(locked)
    return reader.table(mixed, "errors").select("doc_id", "table", F.substring_index("reason", ":", 1).alias("told"))


_RANGES = "r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS name, CAST(p_partkey * 60 AS BIGINT) AS lo, CAST(p_partkey * 60 + p_size AS BIGINT) AS hi, CAST(p_partkey * 7 AS BIGINT) AS cid FROM part)"


@query(f"WITH {_RANGES}, c AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS name, o_orderkey AS code FROM orders) SELECT o_orderkey, coalesce(r.cid + code - lo, 0) AS cid FROM c LEFT JOIN r ON r.name = c.name AND code BETWEEN lo AND hi")
def cid_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of two character maps to glyph numbers."""
    name = lambda c: F.when(F.col(c) % 2 == 0, "even").otherwise("odd").alias("name")
    lo = (F.col("p_partkey") * 60).cast("long")
    r = spark.read.parquet(f"{sf}/part.parquet").select(name("p_partkey"), lo.alias("lo"), (lo + F.col("p_size")).alias("hi"), F.lit(2).alias("bytes"), (F.col("p_partkey") * 7).cast("long").alias("cid"))
    codes = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", name("o_custkey"), F.col("o_orderkey").alias("code"))
    return cmaps.to_cids(codes, r).select("o_orderkey", "cid")


SHIFT = 7
#: Parts a task: one costs milliseconds to write and read, and thousands have their rows in a megabyte.
PARTS = 500


_PALETTE = bytes(v for i in range(256) for v in (i, 255 - i, 51))


def specimen(key: int, name: str, share: float) -> bytes:
    """A page that says a name in a standard font, in codes of its own with a map to Unicode, and in an encoding of two bytes; and that fills by tint, ink and index."""
    objects: dict = {}

    def put(o) -> Ref:
        objects[len(objects) + 1] = o
        return Ref(len(objects), 0)

    root, tree = put(None), put(None)
    times = put({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Times-Roman"), "Encoding": Name("WinAnsiEncoding")})
    last = 126 - SHIFT
    cmap = f"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <{32 + SHIFT:02X}> <{last + SHIFT:02X}> <0020> endbfrange"
    shifted = put({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Own"), "FirstChar": 0, "Widths": [500] * 256, "ToUnicode": put(Stream({}, cmap.encode()))})
    kid = put({"Type": Name("Font"), "Subtype": Name("CIDFontType0"), "BaseFont": Name("Kai"), "DW": 800})
    kanji = put({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Kai"), "Encoding": Name("90ms-RKSJ-H"), "DescendantFonts": [kid]})
    tint = put({"FunctionType": 2, "Domain": [0, 1], "C0": [1, 1, 1], "C1": [0, 0.5, 0.25], "N": 1})
    spaces = {"S": [Name("Separation"), Name("Ink"), Name("DeviceRGB"), tint], "I": [Name("Indexed"), Name("DeviceRGB"), 255, _PALETTE]}
    rows = [("T", name.encode("ascii")), ("O", bytes(c + SHIFT for c in name.encode("ascii"))), ("K", f"漢字{key}".encode("cp932"))]
    shown = [f"BT /{f} 10 Tf 72 {700 - 40 * i} Td <{raw.hex()}> Tj ET" for i, (f, raw) in enumerate(rows)]
    fills = [f"/S cs {share:.2f} scn", f"/I cs {key % 256} sc", f"0 0 0 {share:.2f} k"]
    text = put(Stream({}, "\n".join([*shown, *fills]).encode()))
    page = put({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"T": times, "O": shifted, "K": kanji}, "ColorSpace": spaces}, "Contents": text})
    objects[tree.num] = {"Type": Name("Pages"), "Kids": [page], "Count": 1}
    objects[root.num] = {"Type": Name("Catalog"), "Pages": tree}
    return writer.assembled(objects, {"Root": root})


def specimens(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, content: a file a part."""

    def run(it):
        for b in it:
            made = [specimen(k, n, s / 100) for k, n, s in zip(b["p_partkey"], b["name"], b["p_size"], strict=True)]
            yield pd.DataFrame({"doc_id": b["p_partkey"], "path": b["p_partkey"].astype(str), "content": made})

    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("name"), "p_size")
    return dealt(p, "p_partkey", PARTS).mapInPandas(run, "doc_id long, path string, content binary")


_NAMES = "p AS (SELECT p_partkey AS doc_id, concat_ws(' ', p_brand, p_type) AS name, p_size / 100.0::DOUBLE AS share FROM part)"
_TIMES = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({32 + i}, {x})" for i, x in enumerate(metrics.TIMES)) + ") v(code, width))"


@query(f"WITH {_NAMES}, {_TIMES}, c AS (SELECT doc_id, unnest(string_split(name, '')) AS ch FROM p) SELECT doc_id, round(sum(width) / 100.0::DOUBLE, 6) AS w FROM c JOIN w ON w.code = ascii(ch) GROUP BY 1")
def font_widths(spark: SparkSession, sf: str) -> DataFrame:
    """How wide a name is in a standard font whose widths no file gives."""
    return reader.table(specimens(spark, sf), "pieces").where("base = 'Times-Roman'").select("doc_id", F.round("w", 6).alias("w"))


@query(f"WITH {_NAMES} SELECT doc_id, 'Own' AS base, name AS text, round(5.0::DOUBLE * length(name), 6) AS w FROM p UNION ALL SELECT doc_id, 'Kai', concat('漢字', CAST(doc_id AS VARCHAR)), round(8.0::DOUBLE * (2 + length(CAST(doc_id AS VARCHAR))), 6) FROM p")
def font_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes by a font's own map, and of one and two bytes by a predefined one."""
    return reader.table(specimens(spark, sf), "pieces").where("base <> 'Times-Roman'").select("doc_id", "base", "text", F.round("w", 6).alias("w"))


_BLACK = {n: dict(zip(colour.CMYK_TERMS, row, strict=True)) for n, row in zip("rgb", colour.CMYK, strict=True)}
_INK = ", ".join(f"round(least(1, greatest(0, (255 + ({_BLACK[n]['kk']!r}::DOUBLE) * share * share + ({_BLACK[n]['k']!r}::DOUBLE) * share) / 255)), 6)" for n in "rgb")


@query(f"WITH {_NAMES} SELECT doc_id, 'tint' AS kind, round(1 - share, 6) AS r, round(1 - 0.5 * share, 6) AS g, round(1 - 0.75 * share, 6) AS b FROM p UNION ALL SELECT doc_id, 'index', round(doc_id % 256 / 255.0::DOUBLE, 6), round((255 - doc_id % 256) / 255.0::DOUBLE, 6), 0.2 FROM p UNION ALL SELECT doc_id, 'ink', {_INK} FROM p")
def file_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Fills by a separation's tint, a palette's entry and black ink: the last colour operation of each kind."""
    ops = reader.table(specimens(spark, sf), "ops").where("code = 11")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("op_id"))
    # A space begins with a colour of its own; then comes the one that is asked for.
    kind = F.element_at(F.create_map(F.lit(2), F.lit("tint"), F.lit(4), F.lit("index"), F.lit(5), F.lit("ink")), F.col("k"))
    return ops.withColumn("k", k).where(F.col("k").isin(2, 4, 5)).select("doc_id", kind.alias("kind"), *(F.round(F.col("args")[i], 6).alias(n) for i, n in enumerate("rgb")))
