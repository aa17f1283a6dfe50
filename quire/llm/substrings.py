"""Operator 6: repeated passages by relative Lempel-Ziv parsing.

The reference of a document is what earlier documents (smaller doc_id) hold, each
phrase once: where it first stands, as (document, word). It is indexed by phrases, in
blocks dealt out by the phrases' hashes, so that no document meets a block that it
shares nothing with. A phrase is cut by content: among the 8-word grams of a 50-word
window the one with the least hash is its anchor, and neighbouring windows with one
anchor make a phrase (22 words on average, with the words that its windows reach).
Equal windows have equal anchors wherever they stand.

A document is parsed greedily, from left to right, into factors (reference document,
its first word, length): from each phrase that the reference holds, as many words as
the reference goes on with at that place. Where a document's phrase has a known anchor
and unknown words, a factor may begin or end within it: at these boundaries the windows
are looked up one by one, and take part in the parse like phrases. So a window is in a
factor exactly if its 50 words start in an earlier document. Factors have 50 words or
more each; together they are the spans to remove.

Only minima are gathered by phrase and by window, never their documents: hot passages
are pre-aggregated, and joins back to documents may be split by Spark.

A document with a null id has no place in the order: it is left alone, and is no
reference. Rows that share a doc_id are no reference for one another; equal rows are
parsed alike, and each is kept. Null and empty texts have no words; very long ones are
held whole, a row at a time, and hashed in slices; an empty table gives no rows. Other
columns are not read. Hashes are of 128 bits (anchor and words).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches
from quire.session import Scratch

WINDOW = 50
GRAM = 8
_BYTES = 1 << 22
_WORDS = 1 << 20
_B, _C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so powers have inverses mod 2^64


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _sized(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse mod 2^64, n of them or more; kept by the worker."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size, out = 1 << max(16, n.bit_length()), []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _tables[base] = (out[0], out[1])
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text."""
    if len(raw) <= _BYTES:
        return _hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _BYTES)
        while end < len(raw) and raw[end] != 32 and not 9 <= raw[end] <= 13:
            end += 1
        out.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def _hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    power, inverse = _sized(_B, len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _sums(h: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _sized(_C, len(h))[0][: len(h)], out=total[1:])
    return total


def runs(total: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = len(total) - size
    return _mix((total[size:] - total[:n]) * _sized(_C, len(total))[1][:n])


def phrases(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchor, words (hashes), first window, number of windows, of each phrase."""
    none = np.empty(0, np.uint64)
    parts = [(none, none, np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(h) - window + 1, _WORDS):
        total = _sums(h[at : at + _WORDS + window - 1])
        low = runs(total, gram)
        pos, span, width = np.arange(len(low)), 1, window - gram + 1
        while span < width:
            step = min(span, width - span)
            left, right = low[:-step], low[step:]
            first = left <= right
            low, pos, span = np.where(first, left, right), np.where(first, pos[:-step], pos[step:]), span + step
        start = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        count = np.diff(np.append(start, len(pos)))
        words = (total[start + count - 1 + window] - total[start]) * _sized(_C, len(total))[1][start]
        words = _mix(words + _mix((pos[start] - start).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64)))
        parts.append((low[start], words, start + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(column: pa.Array, *fields: str):
    """Of an array of structs: for each row a tuple of its fields as numpy arrays, empty where it is null."""
    values, ends = column.values, column.offsets.to_numpy()
    flat = [values.field(f).to_numpy() for f in fields]
    for a, b, known in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True):
        yield tuple(x[a:b] if known else x[:0] for x in flat)


def _index(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("a", pa.int64()), ("c", pa.int64()), ("s", pa.int64()), ("n", pa.int64())])

    def run(it):
        for b in it:
            held, rows = [], 0
            for d, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                p = phrases(word_hashes((x.as_py() or "").encode("utf-8", "surrogatepass")))
                if len(p[0]):
                    held.append((np.full(len(p[0]), d), np.full(len(p[0]), t), *p))
                    rows += len(p[0])
                if rows > 1 << 16:
                    yield pa.RecordBatch.from_arrays([_i64(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([_i64(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, t long, a long, c long, s long, n long")


def _windows(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, t, text, checks array<struct<s,n,a>>): the windows of those phrases, hashed."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("a", pa.int64()), ("w", pa.int64()), ("s", pa.int64())])

    def run(it):
        for b in it:
            held, rows = [], 0
            for d, t, x, (first, count, anchor) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), _lists(b.column(3), "s", "n", "a"), strict=True):
                h = word_hashes(x.as_py().encode("utf-8", "surrogatepass"))
                for s, n, a in zip(first.tolist(), count.tolist(), anchor.tolist(), strict=True):
                    held.append((np.full(n, d), np.full(n, t), np.full(n, a), runs(_sums(h[s : s + n + WINDOW - 1]), WINDOW), np.arange(s, s + n)))
                    rows += n
                if rows > 1 << 16:
                    yield pa.RecordBatch.from_arrays([_i64(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([_i64(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, t long, a long, w long, s long")


def factors(found: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """The greedy parse: (first word, words, reference document, its first word) by first word.

    found: rows of (first window, windows, reference document, its first window), in any order, each window once. A factor
    goes on while windows follow one another both in the document and in the reference.
    """
    out: list[list[int]] = []
    for s, n, doc, at in sorted(map(tuple, found.tolist())):
        if out:
            last = out[-1]
            if s == last[0] + last[1] and doc == last[2] and at == last[3] + last[1]:
                last[1] += n
                continue
        out.append([s, n, doc, at])
    return [(s, n + window - 1, doc, at) for s, n, doc, at in out]


def covered(parse: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end) of the words in factors: overlapping or touching factors are one span."""
    out: list[tuple[int, int]] = []
    for s, n, _, _ in parse:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(s + n, out[-1][1]))
        else:
            out.append((s, s + n))
    return out


_FOUND = ("s", "n", "ref", "at")


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, text, found (array<struct<s,n,ref,at>>: windows known from earlier documents, and where those stand) for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    index = scratch.write(_index(docs), "phrases")
    # What is aggregated is written before it is joined: then a join's hot keys can be split, as nothing asks for them whole.
    # Anchors of two documents or more; of them, each phrase's first place, and whether an anchor has several phrases.
    shared = scratch.write(index.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a"), "shared")
    known = scratch.write(index.join(shared, "a"), "known")
    scratch.drop("phrases")
    scratch.free()
    firsts = scratch.write(known.groupBy("a", "c").agg(F.min(F.struct("doc_id", "s")).alias("first")).select("a", "c", F.col("first.doc_id").alias("ref"), F.col("first.s").alias("at")), "firsts")
    several = scratch.write(firsts.groupBy("a").agg(F.count("*").alias("phrases")).where("phrases > 1").select("a", F.lit(True).alias("open")), "several")
    firsts = scratch.write(firsts.join(several, "a", "left"), "contexts")
    judged = known.join(firsts, ["a", "c"]).select("doc_id", "t", "a", "s", "n", "ref", "at", (F.col("ref") < F.col("doc_id")).alias("old"), F.coalesce("open", F.lit(False)).alias("open"))
    judged = scratch.write(judged.where("old or open"), "judged")
    for name in ("shared", "known", "firsts", "several", "contexts"):
        scratch.drop(name)
    # Equal rows (doc_id, text) say the same: sets, which grow with a text, not with its copies.
    checks = judged.where("not old").groupBy("doc_id", "t").agg(F.collect_set(F.struct("s", "n", "a")).alias("checks"))
    windows = scratch.write(_windows(docs.where("text is not null").join(checks, ["doc_id", "t"]).select("doc_id", "t", "text", "checks")), "windows")
    scratch.free()
    first = windows.groupBy("a", "w").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    first = scratch.write(first.select("a", "w", F.col("first.doc_id").alias("ref"), F.col("first.s").alias("at")), "first")
    single = windows.join(first, ["a", "w"]).where("ref < doc_id").select("doc_id", "t", "s", F.lit(1).cast("long").alias("n"), "ref", "at")
    found = judged.where("old").select("doc_id", "t", *_FOUND).unionByName(single)
    found = scratch.write(found.groupBy("doc_id", "t").agg(F.collect_set(F.struct(*_FOUND)).alias("found")), "found")
    for name in ("judged", "windows", "first"):
        scratch.drop(name)
    scratch.free()
    return docs.join(found, ["doc_id", "t"], "left").select("doc_id", "text", "found")


def parsed(docs: DataFrame) -> DataFrame:
    """The factors of every row of docs that has some: doc_id, start, length (words), ref_doc, ref_start."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])

    def run(it):
        def rows():
            for b in it:
                for d, f in zip(b.column(0).to_pylist(), _lists(b.column(1), *_FOUND), strict=True):
                    for factor in factors(np.column_stack(f)):
                        yield d, *factor

        yield from batches(rows(), schema)

    return matches(docs).where("found is not null").select("doc_id", "found").mapInArrow(run, "doc_id long, start long, length long, ref_doc long, ref_start long")


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(it):
        def rows():
            for b in it:
                for d, x, found in zip(b.column(0).to_pylist(), b.column(1), _lists(b.column(2), *_FOUND), strict=True):
                    w, n = (x.as_py() or "").encode("utf-8", "surrogatepass").split(), 0
                    kept = w
                    if len(found[0]):
                        kept, at = [], 0
                        for a, e in covered(factors(np.column_stack(found))):
                            kept += w[at:a]
                            n, at = n + e - a, e
                        kept += w[at:]
                    yield d, len(w), n, hashlib.sha256(b" ".join(kept)).hexdigest()

        yield from batches(rows(), schema)

    return matches(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
