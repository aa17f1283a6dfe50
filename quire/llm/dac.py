"""Operator 1: token ids as directly addressable codes.

An id is cut into chunks, low bits first, one chunk a level. Level l holds the l-th
chunks of the ids that have one, and a bitmap that says which of them go on; the
number of ones before a position (a rank directory: one count per 512 bits, and
popcounts within) is where the id's next chunk stands. So any token is read by as
many probes as it has chunks, without decoding a block.

A block (one row of the written table) is one binary value:

    magic "QDAC", version u32, levels u32, documents u64, tokens u64,
    widths u8[8],
    doc_id i64[documents], null flag u8[documents], end i64[documents] (tokens of
    the block up to and with the document), then per level: entries u64, chunks
    (u8 or u16 each), and but for the last level: bitmap bytes, rank u64 per 512 bits

all little-endian. Rows: part (writing task), block (from 0 in it), start (tokens
of the part before it), n_docs, n_tokens, first_doc, last_doc, payload. Parts are
ascending ranges of doc_id, and so are blocks and documents within them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import batches, parallelism
from quire.llm.tokenize import words
from quire.session import Scratch

WIDTHS = (8, 8, 16)
BLOCK_TOKENS = 1 << 20
BLOCK_DOCS = 4096
_HEAD = struct.Struct("<4sIIQQ8s")
SEGMENTS = "part int, block int, start long, n_docs long, n_tokens long, first_doc long, last_doc long, payload binary"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(width: int) -> np.dtype:
    return np.dtype("u1") if width <= 8 else np.dtype("<u2")


def pack(doc_ids: list[int | None], docs: list[np.ndarray], widths: tuple[int, ...] = WIDTHS) -> bytes:
    """A block of documents' ids; widths are the bits of each level's chunks, 32 or more in all."""
    if sum(widths) < 32 or max(widths) > 16 or len(widths) > 8:
        raise ValueError("widths: up to 8 of at most 16 bits, 32 or more in all")
    ids = np.concatenate(docs).astype("<u4") if docs else np.empty(0, "<u4")
    ends = np.cumsum([len(d) for d in docs], dtype="<i8") if docs else np.empty(0, "<i8")
    out = [
        _HEAD.pack(b"QDAC", 1, len(widths), len(docs), len(ids), bytes(widths).ljust(8, b"\0")),
        np.asarray([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.asarray([d is None for d in doc_ids], "u1").tobytes(),
        ends.tobytes(),
    ]
    rest = ids.copy()
    for level, w in enumerate(widths):
        out += [struct.pack("<Q", len(rest)), (rest & np.uint32((1 << w) - 1)).astype(_store(w)).tobytes()]
        if level == len(widths) - 1:
            break
        rest >>= np.uint32(w)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % 64))
        ones = np.bitwise_count(bits).reshape(-1, 64).sum(1, dtype="<u8") if len(bits) else np.empty(0, "<u8")
        out += [bits.tobytes(), (np.cumsum(ones, dtype="<u8") - ones).tobytes()]
        rest = rest[more]
    return b"".join(out)


class Block:
    """Views into a packed block; nothing is decoded until it is asked for."""

    def __init__(self, payload: bytes):
        magic, version, levels, n_docs, n, widths = _HEAD.unpack_from(payload)
        if magic != b"QDAC" or version != 1:
            raise ValueError("not a block of token ids")
        self.n, self.widths, at = n, tuple(widths[:levels]), _HEAD.size

        def view(dtype: str | np.dtype, count: int) -> np.ndarray:
            nonlocal at
            v = np.frombuffer(payload, dtype, count, at)
            at += v.nbytes
            return v

        ids, null, self.ends = view("<i8", n_docs), view("u1", n_docs), view("<i8", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.chunks, self.bits, self.ranks = [], [], []
        for level, w in enumerate(self.widths):
            m = int(view("<u8", 1)[0])
            self.chunks.append(view(_store(w), m))
            if level < levels - 1:
                size = (-(-m // 8) + 63) // 64 * 64
                self.bits.append(view("u1", size))
                self.ranks.append(view("<u8", size // 64))

    def access(self, positions: np.ndarray) -> np.ndarray:
        """Ids at these positions of the block, each by its chunks alone."""
        at = np.asarray(positions, np.int64)
        if at.size and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the block")
        out, left, shift = np.zeros(at.shape, np.uint64), np.arange(at.size), 0
        for level, w in enumerate(self.widths):
            out[left] |= self.chunks[level][at].astype(np.uint64) << np.uint64(shift)
            if level == len(self.widths) - 1:
                break
            bits, byte = self.bits[level], at >> 3
            more = (bits[byte] >> (at & 7).astype("u1")) & 1 == 1
            left, at, byte, shift = left[more], at[more], byte[more], shift + w
            block = at >> 9
            whole = np.arange(64)[None, :] < (byte - (block << 6))[:, None]
            within = (np.bitwise_count(bits.reshape(-1, 64)[block]) * whole).sum(1, dtype=np.int64)
            tail = np.bitwise_count(bits[byte] & ((1 << (at & 7)) - 1).astype("u1"))
            at = self.ranks[level][block].astype(np.int64) + within + tail
        return out.astype("<u4")

    def decode(self) -> np.ndarray:
        """All ids of the block."""
        out, left, shift = np.zeros(self.n, np.uint32), slice(None), 0
        for level, w in enumerate(self.widths):
            out[left] |= self.chunks[level].astype(np.uint32) << np.uint32(shift)
            if level == len(self.widths) - 1:
                break
            more = np.flatnonzero(np.unpackbits(self.bits[level], count=len(self.chunks[level]), bitorder="little"))
            left, shift = (more if level == 0 else left[more]), shift + w
            if not len(more):
                break
        return out.astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, widths: tuple[int, ...] = WIDTHS, cut: str = "drop") -> None:
    """Encode docs (doc_id, text) and write them in ascending doc_id order at path.

    Null and empty texts are documents of the end id alone; rows that repeat a doc_id
    stay rows, in no set order among equal (doc_id, text); a null doc_id comes first;
    an empty table makes an empty file. Other columns are not read. A very long text is
    encoded in slices and is one document of one block.
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("payload", pa.binary())])

    def encode(it):
        tok, end = words(tokenizer, cut), np.asarray([end_id], "<u4")
        part, block, before, held, ids, n = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush():
            nonlocal block, before, held, ids, n
            row = (part, block, before, len(held), n, held[0], held[-1], pack(held, ids, widths))
            block, before, held, ids, n = block + 1, before + n, [], [], 0
            return row

        def rows():
            for b in it:
                for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    x = np.concatenate([tok.encode(t.as_py()).astype("<u4"), end])
                    if held and (n + len(x) > BLOCK_TOKENS or len(held) >= BLOCK_DOCS):
                        yield flush()
                    take(d, x)
            if held:
                yield flush()

        def take(d, x):
            nonlocal n
            held.append(d)
            ids.append(x)
            n += len(x)

        yield from batches(rows(), schema, 1)

    n = parallelism(docs.sparkSession)
    by = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Ranges may part rows that share a doc_id, equal ones too.
    by = by.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    by = by.repartitionByRange(n, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    by.mapInArrow(encode, SEGMENTS).write.mode("errorifexists").option("compression", "lz4").parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, base: ids of all parts before. One row per writing task, whatever the rows."""
    rows, base, out = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect(), 0, []
    for part, n in rows:
        out.append((part, base))
        base += n
    return spark.createDataFrame(out, "part int, base long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the written files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(it):
        def rows():
            for b in it:
                for base, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    x = Block(payload.as_py())
                    ids, at = x.decode(), 0
                    for d, end in zip(x.doc_ids, x.ends.tolist(), strict=True):
                        yield d, base + at, end - at, zlib.crc32(ids[at:end].tobytes())
                        at = end

        yield from batches(rows(), schema)

    seg = spark.read.parquet(path).join(F.broadcast(part_starts(spark, path)), "part")
    return seg.select((F.col("base") + F.col("start")).alias("base"), "payload").mapInArrow(decode, TOKENS)


#: Positions that one task looks up in a block; more are spread over tasks, each with the block.
PROBES = 1 << 20


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """position, id for each row of positions (position long): looked up, blocks not decoded.

    Positions meet a directory of the blocks (a small row each, without their ids), joined by range on bins of BLOCK_TOKENS
    ids, and learn part and block. Then each block goes once to the positions that ask for it, before them in one stream; to
    as many tasks as PROBES positions each need. Positions outside the file and null ones give no row; repeated ones a row each.
    """
    spark = positions.sparkSession
    size = F.lit(BLOCK_TOKENS)
    seg = spark.read.parquet(path).join(F.broadcast(part_starts(spark, path)), "part").withColumn("at", F.col("base") + F.col("start"))
    bins = seg.select("part", "block", "at", "n_tokens", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n_tokens") - 1) / size))).alias("bin"))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("bin", F.floor(F.col("position") / size))
    met = asked.join(bins, "bin").where((F.col("position") >= F.col("at")) & (F.col("position") < F.col("at") + F.col("n_tokens")))
    met = Scratch(spark, "lookup").write(met.select("part", "block", (F.col("position") - F.col("at")).alias("probe"), "at"), "met")
    split = met.groupBy("part", "block").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("tasks"))
    blocks = seg.join(split, ["part", "block"]).select("part", "block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(-1).cast("long").alias("probe"), "at", "payload")
    probes = met.join(split, ["part", "block"]).select("part", "block", F.pmod(F.xxhash64("probe", F.monotonically_increasing_id()), "tasks").cast("int").alias("task"), "probe", "at", F.lit(None).cast("binary").alias("payload"))
    stream = blocks.unionByName(probes).repartition(parallelism(spark), "part", "block", "task").sortWithinPartitions("part", "block", "task", "probe")
    schema = pa.schema([("position", pa.int64()), ("id", pa.int64())])

    def look(it):
        block = None
        for b in it:
            probe, at, payload = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            heads = [*np.flatnonzero(probe < 0).tolist(), len(probe)]
            for i, (a, e) in enumerate(zip([0, *heads], heads)):
                if i:
                    block, a = Block(payload[a].as_py()), a + 1
                if e > a:
                    ids = block.access(probe[a:e])
                    yield pa.RecordBatch.from_arrays([pa.array(probe[a:e] + at[a:e]), pa.array(ids.astype(np.int64))], schema=schema)

    return stream.select("probe", "at", "payload").mapInArrow(look, "position long, id long")


def op1(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write, then read back: the contract's columns."""
    path = Scratch(spark, "tokens").path("ids")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
