"""Operator 10: secrets in whole texts.

An Aho-Corasick automaton finds the keywords that a secret of some kind must begin
with; only there an anchored regular expression is tried, leftmost first and
without overlap within a kind. Runs of hexadecimal digits have no keyword and are
found by their length. Tokens that carry a checksum count only if it holds:
GitHub's and npm's end in six base-62 digits of the CRC-32 of the rest.

All is done on UTF-8 bytes, whose ASCII letters alone change case; positions become
code points at the end. Null: empty text. Empty text: no spans. Very long texts are
scanned whole, a row at a time. Rows that repeat a doc_id are documents of their own; an
empty table gives no rows. Spans of different kinds may overlap; those that begin
together stand in the order of KINDS. Other columns, whatever their names, are not read
by ``scan``, and come through ``redacted`` (n_chars alone is counted anew).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches

KINDS = ("assign", "access", "hex", "github", "npm")
_WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
_ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_PATTERNS = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "npm": _NPM}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: bytes) -> bytes:
    """CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.encode()


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    return checksum(m[0][4:-6]) == m[0][-6:]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, ws in _WORDS.items():
        for w in ws:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    out = [(m.start(), m.end(), "hex") for m in _HEX.finditer(raw)]
    last: dict[str, int] = {}
    hits = [(i - n + 1, kind) for i, (kind, n) in _automaton().iter(raw.lower().decode("latin-1"))]
    for at, kind in sorted(hits) if len(hits) > 1 else hits:
        if at >= last.get(kind, 0) and (m := _PATTERNS[kind].match(raw, at)):
            last[kind] = m.end()
            if _valid(kind, m):
                out.append((at, m.end(), kind))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    if out and len(raw) != len(text):
        cuts = sorted({x for s in out for x in s[:2]})
        points, prev, n = {}, 0, 0
        for c in cuts:
            n += len(raw[prev:c].decode("utf-8", "surrogatepass"))
            points[c], prev = n, c
        out = [(points[a], points[b], k) for a, b, k in out]
    return out


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[{}]") -> str:
    """Spans, merged where they overlap, give way to a mark with the first one's kind."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], mark.format(k)]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, and the secrets of its text as array<struct<start,end,kind>>."""
    schema = pa.schema([("doc_id", pa.int64()), ("secrets", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))])

    def run(it):
        for b in it:
            rows = ((d, [{"start": a, "end": e, "kind": k} for a, e, k in find(t.as_py())]) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
            yield from batches(rows, schema)

    out = "doc_id long, secrets array<struct<start:long,end:long,kind:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the secrets of their texts marked out; other columns and rows as they were, n_chars counted anew."""
    schema = docs.schema
    names = schema.names

    def run(it):
        for b in it:
            i = names.index("text")
            texts = b.column(i).to_pylist()
            new = [redact(t, s) if (s := find(t)) else t for t in texts]
            cols = [pa.array(new, b.schema.field(i).type) if j == i else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns, from scan()."""
    s = F.col("secrets")
    base = F.filter(s, lambda x: x.kind.isin("assign", "access", "hex"))
    show = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter(s, lambda x: x.kind == k)).cast("long")
    return scan(docs).select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(show(base), 256).alias("base_sha256"), show(s).alias("spans"), *(count(k).alias(f"n_{k}") for k in KINDS[3:]))
