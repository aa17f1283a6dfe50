"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half the XXH64 hashes (seed 42) of its
3-word shingles have it. Two fingerprints link at 2 or fewer differing bits.

Search: the 64 bits are cut into partitions of correlated bits, and partition i gets
a threshold t_i, -1 or more, with the t_i summing to 2 - m + 1: then linked
fingerprints differ in at most t_i bits of some partition i. Dynamic programming
picks the thresholds that cost least, by candidates estimated from the bits'
frequencies over all distinct fingerprints, for each number of partitions; the
cheapest is used. Each fingerprint is indexed by its bits in a partition and probes
every value within t_i; what meets is verified on all bits.

Candidates of a bucket with many fingerprints (a large family of near copies) are
not paired: fingerprints are within 2 bits exactly if some value lies within 1 bit
of both, so members of such buckets are grouped by the 65 values around each, and
each links to the smallest of its group. This is exact, and work stays in
proportion to the fingerprints whatever the families.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches, sized
from quire.llm.graph import components
from quire.session import Scratch

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: A bucket with more fingerprints than this is linked through common neighbours.
BUCKET = 64
_SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned; 0 for a text without words (null, too)."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        return xxh64_intdigest(b" ".join(w), SEED)
    n = len(w) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        part = w[at : at + _SLICE + SHINGLE - 1]
        h = np.array([xxh64_intdigest(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:])], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and as row the long column of that name, if any."""
    more = [F.col(row).alias("row")] if row else []
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *([("row", pa.int64())] if row else [])])

    def run(it):
        for b in it:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + ", row long" * len(more))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both: 64 x 64 sums over all rows, a task's at a time."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])

    def run(it):
        both = np.zeros((64, 64))
        rows = 0
        for b in it:
            x = np.ascontiguousarray(b.column(0).to_numpy()).view("u1").reshape(-1, 8)
            rows += len(x)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
        if rows:
            out = [(i, j, int(both[i, j])) for i in range(64) for j in range(i, 64)]
            yield from batches(iter([*out, (-1, -1, rows)]), schema)

    got = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect()
    total, both = 0, np.zeros((64, 64))
    for i, j, n in got:
        if i < 0:
            total = n
        else:
            both[i, j] = both[j, i] = n
    return total, both


def partitions(corr: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m parts of near equal size, each begun at the bit most correlated with those left and grown by the most correlated to it."""
    left, out = list(range(64)), []
    c = np.abs(corr) - np.eye(64)
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        part = [max(left, key=lambda b: (c[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            b = max(left, key=lambda b: (c[b, part].sum(), -b))
            part.append(b)
            left.remove(b)
        out.append(sorted(part))
    return out


def within(differ: np.ndarray) -> np.ndarray:
    """Probability of at most t differing bits, by t, if bit i differs with probability differ[i]."""
    p = np.array([1.0])
    for d in differ:
        p = np.convolve(p, [1 - d, d])
    return np.cumsum(p)


def allocate(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Least total cost of thresholds -1.. for each part (cost[i][t + 1]) that sum to distance - parts + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for have, (x, ts) in best.items():
            for t in range(-1, distance + 1):
                s = have + t
                if s not in new or x + c[t + 1] < new[s][0]:
                    new[s] = (x + c[t + 1], [*ts, t])
        best = new
    return best[distance - len(cost) + 1]


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions (bits) with thresholds of 0 or more."""
    f = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(f * (1 - f), 1e-9))
    corr = (both / max(n, 1) - np.outer(f, f)) / np.outer(var, var)
    differ = 2 * f * (1 - f)
    best = None
    for m in range(1, 5):
        parts = partitions(corr, m)
        cost = []
        for p in parts:
            near, w = within(differ[p]), len(p)
            probes = [sum(1 for k in range(t + 1) for _ in combinations(range(w), k)) for t in range(distance + 1)]
            # A row shuffled for each probe and index entry, and half the pairs that meet.
            cost.append([0.0, *(n * (probes[t] + 1.0) + 0.05 * n * n / 2 * near[t] for t in range(distance + 1))])
        x, ts = allocate(cost, distance)
        if best is None or x < best[0]:
            best = (x, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: linked distinct fingerprints of fps (fp, one row each), enough of them for the components."""
    n, both = bit_statistics(fps)
    chosen = plan(n, both, distance)
    masks = [sum(1 << b for b in bits) for bits, _ in chosen]
    index, probe = [], []
    for i, ((bits, t), mask) in enumerate(zip(chosen, masks, strict=True)):
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]
        index.append(F.struct(F.lit(i).alias("part"), own.alias("key")))
        probe += [F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(x)).alias("key")) for x in flips]
    indexed = fps.select(F.col("fp").alias("x"), F.inline(F.array(*index)))
    probes = fps.select(F.col("fp").alias("y"), F.inline(F.array(*probe)))
    scratch = Scratch(fps.sparkSession, "buckets")
    full = scratch.write(indexed.groupBy("part", "key").count().where(F.col("count") > BUCKET).select("part", "key"), "full")
    full = sized(full, full.count())
    cold = indexed.join(full, ["part", "key"], "left_anti")
    met = probes.join(cold.hint("merge"), ["part", "key"]).where((F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)).select(F.col("x").alias("u"), F.col("y").alias("v"))
    if distance != 2:
        raise ValueError("full buckets are linked through values 1 bit away, so the distance is 2")
    hot = probes.join(full, ["part", "key"], "left_semi").select(F.col("y").alias("x")).distinct()
    around = [0, *(_signed(1 << b) for b in range(64))]
    near = hot.select("x", F.explode(F.transform(F.array(*map(F.lit, around)), lambda z: F.col("x").bitwiseXOR(z))).alias("z"))
    low = scratch.write(near.groupBy("z").agg(F.min("x").alias("v"), F.max("x").alias("w")).where("v <> w").select("z", "v"), "low")
    return met.unionByName(near.join(sized(low, low.count()), "z").where("x <> v").select(F.col("x").alias("u"), "v"))


def _rooted(scratch: Scratch, own: DataFrame, order: Column) -> DataFrame:
    """fp, root (its component), first (the least order of its rows): a row for each distinct fingerprint of own."""
    distinct = scratch.write(own.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = scratch.write(components(links(distinct.select("fp"))), "roots")
    return distinct.join(sized(roots.withColumnRenamed("node", "fp"), roots.count()), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def firsts(docs: DataFrame, row: str) -> DataFrame:
    """row: of each component the row with the smallest doc_id (null after all others), then the smallest value of the unique long column row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.write(fingerprints(docs, row), "own")
    with_root = _rooted(scratch, own, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return with_root.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Null and empty texts have fingerprint zero and link like others; rows that repeat
    a doc_id are rows of their own; a component of null ids alone has a null id; an
    empty table gives no rows. Only doc_id and text are read; very long texts are hashed
    in slices of their words.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.write(fingerprints(docs), "own")
    with_root = _rooted(scratch, own, F.col("doc_id"))
    least = with_root.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.write(with_root.join(least.hint("merge"), "root").select("fp", "component_id"), "named")
    return own.join(sized(named, named.count()), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
