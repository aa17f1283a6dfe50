"""PDF files as DataFrames: one scan of bytes, and a table function for each kind of record.

``read_pdf`` gives a row a file; each table function parses only what it returns, one
document at a time, so that a worker holds one file. A fault costs the page, or the
record, that it is in: other pages keep their rows. The table ``errors`` runs the same
code for all tables and has a row for each fault: files that are no PDF, or cannot be
opened with the password given, pages and records that cannot be read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import reading
from quire.sources.pdf import content
from quire.sources.pdf.extract import Document

RECT = "array<double>"
#: Records of small files are handed on together, up to so many of them, or of so many bytes of files: a frame of its own costs more than a small file.
ROWS, HELD = 2000, 1 << 20
SCHEMAS = {
    "documents": "doc_id long, path string, n_pages int, info map<string,string>, perm long, page_mode string, page_layout string, fingerprint string, tagged boolean, lang string, xmp string, xfa boolean, xfa_xml string, open_page int, open_fit string, viewer_preferences map<string,string>, calc_order array<int>",
    "errors": "doc_id long, path string, table string, page_no int, reason string",
    "pages": "doc_id long, page_no int, obj int, x0 double, y0 double, w double, h double, rot int, label string",
    "pieces": "doc_id long, page_no int, piece_id int, x double, y double, size double, w double, ang double, text string, font string, base string, bold boolean, mcid int, dir string",
    "ops": "doc_id long, page_no int, op_id int, code int, args array<double>",
    "geometry": "doc_id long, page_no int, kind string, x0 double, y0 double, x1 double, y1 double",
    "lines": "doc_id long, page_no int, line_id int, text string, angle double, x double, y double, w double, size double, font string, bold boolean",
    "page_text": "doc_id long, page_no int, text string",
    "blocks": f"doc_id long, block_id int, page_no int, bbox {RECT}, kind string, level int, text string, items array<string>, rows array<array<string>>",
    "markdown": "doc_id long, n_blocks int, markdown string",
    "outline": "doc_id long, ord int, depth int, title string, page_no int, parent_ord int",
    "destinations": "doc_id long, name string, page_no int",
    "links": f"doc_id long, page_no int, ord int, rect {RECT}, uri string, target_page int",
    "annotations": f"doc_id long, page_no int, ord int, obj int, subtype string, rect {RECT}, contents string, author string, date string, color array<double>, flags int, uri string, target_page int",
    "fields": f"doc_id long, page_no int, obj int, kind int, flags int, max_len int, name string, value string, on string, opts array<string>, checked boolean, calc string, format string, parent int, rect {RECT}",
    "layers": "doc_id long, ord int, obj int, name string, on boolean",
    "attachments": "doc_id long, ord int, name string, data binary",
    "collection": "doc_id long, key string, label string, order int, kind string",
    "signatures": "doc_id long, name string, date string, reason string, sub string, der binary, byte_range array<long>, covers boolean, sha256 string",
    "structure": "doc_id long, node_id int, parent_id int, depth int, role string, alt string, page_no int, mcid int",
    "label_ranges": "doc_id long, start_page int, style string, prefix string, first int",
    "images": "doc_id long, obj int, w int, h int, bits int, space string, filter string, stencil boolean, smask int, data binary",
    "xfa_boxes": "doc_id long, ord int, page int, x double, y double, w double, h double, text string, name string, size double, bold boolean, align string, border boolean, field boolean",
    "checked_signatures": "doc_id long, name string, date string, told string, covers boolean, intact boolean, verified boolean, hash string, signer string, reason string",
    "objects": "doc_id long, num int, gen int, offset long, rank int, in_objstm boolean, kind string, refs array<int>",
}


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path, content of every file at path; ``errors`` tells which are no PDF."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def _try(d: Document, table: str, page_no: int | None, make: Callable[[], object]) -> object:
    """What make gives; None where it fails, which the document remembers."""
    try:
        return make()
    except Exception as e:  # noqa: BLE001  damage costs a page, not the job
        d.faults.append({"table": table, "page_no": page_no, "reason": _told(e)})
        return None


def _pages_of(d: Document, only: set[int] | None) -> Iterator[tuple[int, dict, content.Page]]:
    hidden = d.hidden()
    for row, page in zip(d.page_rows(), d.pages, strict=True):
        if only is None or row["page_no"] in only:
            p = _try(d, "pieces", row["page_no"], lambda: content.read(d.f, page, hidden))  # noqa: B023
            if p is not None:
                yield row["page_no"], row, p


def _pieces(d: Document, only: set[int] | None) -> Iterator[dict]:
    for n, _, p in _pages_of(d, only):
        for i, x in enumerate(p.pieces):
            yield {"page_no": n, "piece_id": i} | x


def _ops(d: Document, only: set[int] | None) -> Iterator[dict]:
    for n, _, p in _pages_of(d, only):
        for i, (code, args) in enumerate(p.ops):
            yield {"page_no": n, "op_id": i, "code": code, "args": args}


def _rules_of(d: Document, n: int, row: dict, p: content.Page) -> list[dict]:
    return _try(d, "geometry", n, lambda: reading.rules(p.ops, row)) or []


def _lines_of(d: Document, n: int, row: dict, p: content.Page) -> list[dict]:
    return _try(d, "lines", n, lambda: reading.page_lines(p.pieces, row)) or []


def _geometry(d: Document, only: set[int] | None) -> Iterator[dict]:
    for n, row, p in _pages_of(d, only):
        for g in _rules_of(d, n, row, p):
            yield {"page_no": n} | g


def _lines(d: Document, only: set[int] | None) -> Iterator[dict]:
    for n, row, p in _pages_of(d, only):
        for x in _lines_of(d, n, row, p):
            yield {"page_no": n} | x


def _text(d: Document, only: set[int] | None) -> Iterator[dict]:
    for n, row, p in _pages_of(d, only):
        yield {"page_no": n, "text": reading.text_of(_lines_of(d, n, row, p))}


def _blocks(d: Document, only: set[int] | None) -> list[dict]:
    from quire.operators.tagged import tagged_blocks

    pages, lines, pieces, geom = {}, [], [], {}
    for n, row, p in _pages_of(d, only):
        pages[n] = row
        pieces += [{"page_no": n} | x for x in p.pieces]
        lines += [{"page_no": n} | x for x in _lines_of(d, n, row, p)]
        geom[n] = _rules_of(d, n, row, p)
    nodes = _try(d, "structure", None, d.structure) or []
    return _try(d, "blocks", None, lambda: tagged_blocks(nodes, pieces, lines)) or reading.document_blocks(lines, pages, geom)


def _markdown(d: Document, only: set[int] | None) -> Iterator[dict]:
    b = _blocks(d, only)
    yield {"n_blocks": len(b), "markdown": reading.markdown(b)}


def _errors(d: Document, only: set[int] | None) -> Iterator[dict]:
    """The faults that any table meets; pages are interpreted once, for blocks."""
    for name, make in _RECORDS.items():
        if name not in ("errors", "pieces", "ops", "geometry", "lines", "page_text", "markdown"):
            _try(d, name, None, lambda: list(make(d, only)))  # noqa: B023
    seen = set()
    for fault in d.faults:
        if (key := tuple(fault.values())) not in seen:
            seen.add(key)
            yield fault


_RECORDS: dict[str, Callable[[Document, set[int] | None], object]] = {
    "documents": lambda d, _: [d.record()],
    "pages": lambda d, _: d.page_rows(),
    "pieces": _pieces,
    "ops": _ops,
    "geometry": _geometry,
    "lines": _lines,
    "page_text": _text,
    "blocks": _blocks,
    "markdown": _markdown,
    "outline": lambda d, _: d.outline(),
    "destinations": lambda d, _: d.dest_rows(),
    "links": lambda d, _: d.links(),
    "annotations": lambda d, _: d.annotations(),
    "fields": lambda d, _: d.fields(),
    "layers": lambda d, _: d.layers(),
    "attachments": lambda d, _: d.attachments(),
    "collection": lambda d, _: d.collection(),
    "signatures": lambda d, _: d.signatures(),
    "structure": lambda d, _: d.structure(),
    "label_ranges": lambda d, _: d.label_ranges(),
    "images": lambda d, _: d.images(),
    "xfa_boxes": lambda d, _: d.xfa_boxes(),
    "checked_signatures": lambda d, _: d.checked_signatures(),
    "objects": lambda d, _: d.objects(),
    "errors": _errors,
}


def records(name: str, path: str, data: bytes, password: str = "", only: set[int] | None = None, hide: set[str] | None = None, cmaps: dict[str, str] | None = None) -> list[dict]:
    """The rows of one table from one file, without doc_id; those read before a fault stay, and ``errors`` has the fault."""
    out, own = [], {"path": path}
    try:
        d = Document(data, password, cmaps)
    except Exception as e:  # noqa: BLE001  a damaged file is a row, not the end of the job
        return [own | {"table": "documents", "page_no": None, "reason": _told(e)}] if name == "errors" else []
    d.hide = hide
    _try(d, name, None, lambda: out.extend(own | r for r in _RECORDS[name](d, only)))
    return out


def table(raw: DataFrame, name: str, password: str = "", pages: list[int] | None = None, hide: list[str] | None = None, cmaps: dict[str, str] | None = None) -> DataFrame:
    """A table of SCHEMAS from the files of read_pdf.

    pages (from 1) limits what is interpreted; hide names the layers to leave out,
    instead of those that a file hides itself; cmaps has predefined character maps by
    name (``cmaps.given``), for the glyph numbers of fonts that refer to them and for text
    of fonts without a map to Unicode. Codes of the usual encodings are read without."""
    schema = SCHEMAS[name]
    columns = [c.split(" ")[0] for c in _split(schema)]
    only = set(pages) if pages is not None else None
    hidden = set(hide) if hide is not None else None

    def frames(found: list[dict]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(found), 20000):
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in found[at : at + 20000]], dtype=object) for c in columns})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for batch in batches:
            for doc_id, path, data in zip(batch["doc_id"], batch["path"], batch["content"], strict=True):
                found += [r | {"doc_id": doc_id} for r in records(name, path, bytes(data), password, only, hidden, cmaps)]
                held += len(data)
                if len(found) >= ROWS or held >= HELD:
                    yield from frames(found)
                    found, held = [], 0
        yield from frames(found)

    return raw.select("doc_id", "path", "content").mapInPandas(run, schema)


def _split(schema: str) -> list[str]:
    out, deep = [""], 0
    for ch in schema:
        deep += (ch == "<") - (ch == ">")
        if ch == "," and not deep:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out]


def text_items(pieces: DataFrame) -> DataFrame:
    """pieces with eol: whether a piece ends its row of the page (the rightmost one)."""
    from pyspark.sql import Window

    from quire.functions.scalars import half_up

    key = half_up(F.col("y") / F.greatest(F.lit(1.0), 0.6 * F.col("size")))
    w = Window.partitionBy("doc_id", "page_no", "_row").orderBy(F.desc("x"), "piece_id")
    return pieces.withColumn("_row", key).withColumn("eol", F.row_number().over(w) == 1).drop("_row")


def _files(raw: DataFrame, make: Callable[[bytes], bytes]) -> DataFrame:
    """New files; those that cannot be read give none (the table ``errors`` tells which)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, held = [], 0
            for doc_id, path, data in zip(batch["doc_id"], batch["path"], batch["content"], strict=True):
                try:
                    made = make(bytes(data))
                except Exception:  # noqa: BLE001, S112  a damaged file is not the end of the job
                    continue
                done.append((doc_id, path, made))
                held += len(made)
                if held >= HELD:
                    yield pd.DataFrame(done, columns=["doc_id", "path", "content"])
                    done, held = [], 0
            if done:
                yield pd.DataFrame(done, columns=["doc_id", "path", "content"])

    return raw.select("doc_id", "path", "content").mapInPandas(run, "doc_id long, path string, content binary")


def filled(raw: DataFrame, fields: dict[str, str], password: str = "") -> DataFrame:
    """The files with values in their fields (by full name), as an update behind their own bytes."""
    from quire.operators import writer

    return _files(raw, lambda data: writer.filled(data, fields, password))


def build(raw: DataFrame, pick: list[int] | None = None, turn: int = 0, turns: dict[int, int] | None = None, labels: list | None = None, fields: dict[str, str] | None = None, notes: list[dict] | None = None, new_fields: list[dict] | None = None, watermark: str = "", drop: list[int] | None = None, info: dict[str, str] | None = None, password: str = "", encrypt: str | None = None) -> DataFrame:
    """New files: pages picked in any order, turned (all by turn, single ones by turns), dropped, labelled, filled, noted, marked, renamed, encrypted; only what is reachable stays."""
    from quire.operators import writer

    locks: list[writer.Lock] = []  # the task's own

    def make(data: bytes) -> bytes:
        if encrypt is not None and not locks:
            locks.append(writer.Lock(encrypt))
        if fields:
            data = writer.filled(data, fields, password)
        if notes:
            data = writer.noted(data, notes, password)
        if new_fields:
            data = writer.with_fields(data, new_fields, password)
        b = writer.Build().add(Document(data, password), pick, turn)
        b = b.turned(turns) if turns else b
        b = b.dropped(drop) if drop else b
        b = b.told(info) if info else b
        b = b.labels(labels) if labels else b
        return (b.watermark(watermark) if watermark else b).bytes(locks[0] if locks else None)

    return _files(raw, make)


def merged(raw: DataFrame, group: str, order: str) -> DataFrame:
    """One file for each group (a column of raw), of its files' pages by order: doc_id, path (the group), content.

    Files that cannot be read are left out (the table ``errors`` tells which)."""
    from quire.operators import writer

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        b = writer.Build()
        for data in pdf["content"]:
            try:
                d = Document(bytes(data))
            except Exception:  # noqa: BLE001, S112  a damaged file is not the end of the job
                continue
            b.add(d)
        return pd.DataFrame({"doc_id": [int(pdf["doc_id"].min())], "path": [str(pdf[group].iloc[0])], "content": [b.bytes()]})

    return raw.groupBy(group).applyInPandas(run, "doc_id long, path string, content binary")
