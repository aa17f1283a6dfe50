"""Operator 8: benchmark passages in training documents, by an FM-index per shard.

A shard is what a task gathers until it has SHARD_WORDS words. Its words are numbered
by the benchmark's vocabulary; a run of documents' words outside it cannot hold part
of a window and becomes one separator, and so does a stretch too short for the
shortest window. Over the rest an FM-index is built; every benchmark window is
searched backwards through wavelet ranks, all at once; its occurrences are located
by sampled suffix positions and merged into removal spans by document.

The benchmark is read in blocks of at most BLOCK_CHARS characters (one item may be
longer), each sent to all tasks: what is sent, and what the driver holds, has that
bound whatever the benchmark. With more than one block, documents are written with a
row id first, each block's findings are a table, and those of a row are merged; every
block reads the documents once.

A null text has no words; an item without words has no window; rows that repeat a
doc_id are documents of their own, and items that share an item_id count once; without
items nothing is found; an item whose id is null counts for spans and is in no list; an
empty table gives no rows. A very long text is split into words whole and is a shard of
its own. Other columns, whatever their names, are not read, and come through ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches, fresh
from quire.llm.fmindex import FMIndex
from quire.session import Scratch

WINDOW = 13
SHARD_WORDS = 1 << 19
BLOCK_CHARS = 4 << 20
#: Bytes that are no part of a word become blanks; A-Z become a-z; bytes of other letters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "row long, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The windows of a block of items (item_id as string, text), numbered by their words."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        self.size, self.items = size, [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for k, (_, text) in enumerate(items):
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 2) for x in split(text)]
            n = min(size, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                by.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(k)
        self.patterns = {n: np.asarray(list(p), np.int64) for n, p in by.items()}
        self.owners = {n: list(p.values()) for n, p in by.items()}
        self.least = min(by, default=0)


def search(docs: list[list[bytes]], w: Windows) -> list[tuple[list[tuple[int, int]], set[int]]]:
    """For each document, merged spans [start, end) of words inside occurrences, and the items that occur."""
    out: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in docs]
    if not w.least:
        return out
    get, parts, doc_of, word_of, starts, at = w.vocabulary.get, [], [], [], [], 0
    for d, words in enumerate(docs):
        if len(words) < w.least:
            continue
        ids = np.fromiter(map(get, words, repeat(1)), np.int64, len(words))
        known = np.concatenate([[False], ids > 1, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= w.least:
                parts += [ids[a:b], _SEPARATOR]
                starts.append(at)
                doc_of.append(d)
                word_of.append(a)
                at += b - a + 1
    if not parts:
        return out
    index = FMIndex(np.concatenate(parts), len(w.vocabulary) + 2)
    begin, spans = np.asarray(starts), {}
    for n, patterns in w.patterns.items():
        lo, hi = index.count(patterns)
        # All rows of all windows are located at once: row r is the (r - begins)-th of its window.
        each = hi - lo
        of = np.repeat(np.arange(len(each)), each)
        pos = index.locate(np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + lo[of])
        k = np.searchsorted(begin, pos, "right") - 1
        for p, seg, x in zip(of.tolist(), k.tolist(), (pos - begin[k]).tolist(), strict=True):
            d, a = doc_of[seg], word_of[seg] + x
            spans.setdefault(d, []).append((a, a + n))
            out[d][1].update(w.owners[n][p])
    for d, s in spans.items():
        out[d] = (merged(s), out[d][1])
    return out


_SEPARATOR = np.asarray([1], np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block, size = [], 0
    for i, t in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        if block and size + len(t or "") > most:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t or "") + 64
    yield block


def _search_block(docs: DataFrame, w: Windows) -> DataFrame:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(it):
        def rows():
            held, words, n = [], [], 0
            for b in it:
                for r, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    x = split(t.as_py())
                    held.append((r, d, len(x)))
                    words.append(x)
                    n += len(x)
                    if n >= SHARD_WORDS:
                        yield from flush(held, words)
                        held, words, n = [], [], 0
            yield from flush(held, words)

        def flush(held, words):
            for (r, d, n), (spans, items) in zip(held, search(words, w), strict=True):
                yield r, d, n, [{"start": a, "end": b} for a, b in spans], sorted({x for k in items if (x := w.items[k]) is not None})

        yield from batches(rows(), schema)

    return docs.mapInArrow(run, FOUND)


def _each_block(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    """FOUND of docs (row, doc_id, text), for a benchmark of many blocks."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    kept = scratch.write(docs, "docs")
    every = kept.select("row", "doc_id", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for k, block in enumerate(_blocks(benchmark, block_chars)):
        found = _search_block(kept, Windows(block, window))
        # The first block's table tells all documents' words; the others only what they found.
        every = every.unionByName(scratch.write(found if k == 0 else found.where("size(spans) > 0"), f"block{k}"))
    # A row has as many lists as there are blocks that occur in it; spans are merged, and items are told apart.
    lists = F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    return every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists).withColumn("spans", _merged(F.array_sort("spans")))


def _single(benchmark: DataFrame, block_chars: int) -> list[tuple[str | None, str | None]] | None:
    """The benchmark's items, if they are one block."""
    size = benchmark.agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    return next(_blocks(benchmark, block_chars)) if size <= block_chars else None


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """row, doc_id, n_words, spans (of words, merged) and items (with occurring windows) of every document."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if (block := _single(benchmark, block_chars)) is not None:
        return _search_block(docs, Windows(block, window))
    return _each_block(docs, benchmark, window, block_chars)


def _merged(spans):
    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).end >= s.start), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.slice(spans, 1, 0), step)


def _hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, from find()."""
    f = find(docs, benchmark).select("doc_id", "n_words", _hit().alias("n_hit"), "items")
    return f.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated (the contract's rule).

    With a benchmark of one block, spans are found and judged where the text is; with
    more, a document's hit words are counted over all of them.
    """
    if (block := _single(benchmark, block_chars)) is None:
        row = fresh(docs, "_row")
        kept = Scratch(docs.sparkSession, "decontaminate").write(docs.select("*", F.monotonically_increasing_id().alias(row)), "docs")
        found = _each_block(kept.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, block_chars)
        bad = found.select("row", "n_words", _hit().alias("n_hit")).where(contaminated()).select(F.col("row").alias(row))
        return kept.join(bad, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    w, i = Windows(block, window), docs.columns.index("text")

    def run(it):
        held, words, n = [], [], 0

        def flush():
            hits = [sum(e - a for a, e in spans) for spans, _ in search(words, w)]
            keep = [not (k > 0 and 20 * k >= len(x)) for k, x in zip(hits, words, strict=True)]
            at = 0
            for b in held:
                yield b.filter(pa.array(keep[at : at + b.num_rows], pa.bool_()))
                at += b.num_rows

        for b in it:
            start = 0
            for k, t in enumerate(b.column(i), 1):
                words.append(split(t.as_py()))
                n += len(words[-1])
                if n >= SHARD_WORDS:
                    held.append(b.slice(start, k - start))
                    yield from flush()
                    held, words, n, start = [], [], 0, k
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield from flush()

    return docs.mapInArrow(run, docs.schema)
