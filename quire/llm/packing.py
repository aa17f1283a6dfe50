"""Operator 9: packing documents into sequences of bounded length, best fit first,
then swap-based local search.

A document is its ids and an end id. One longer than a sequence is cut so that its
first piece may be short and the others are full; full pieces are sequences of their
own. What is left to pack is one piece of each document, and pieces of one length
are alike: so the packing is made on the histogram of lengths (as many numbers as a
sequence has tokens, whatever the documents) by classes of equal bins. Best fit
decreasing makes the classes; local search then moves documents out of the emptiest
bin, one into a gap, or exchanges one for one and two for one with fuller bins, each
time raising the sum of squared fills, until bins empty or no exchange is left.
Documents find their place by their rank among those of their length: ranges of
(length, doc_id) are dealt out, and each range's ranks start where the one before ended.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches, parallelism
from quire.llm.tokenize import words
from quire.session import Scratch

CAPACITY = 2048
#: The most exchanges of the local search, for each class of bins that best fit leaves: a bound on the driver's work that does not go by documents.
EXCHANGES = 60
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"

Bin = tuple[tuple[int, int], ...]  # (length, count) by falling length


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Bin]:
    """Best fit decreasing over a histogram: bins by what they hold, with their numbers."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]  # room left: [number, items]
    has = np.zeros(capacity + 1, bool)

    def put(room: int, n: int, items: Bin) -> None:
        by_room[room].append([n, items])
        has[room] = True

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = length + int(np.argmax(has[length:]))
            if not has[room]:
                room, n, items = capacity, left, ()
            else:
                n, items = by_room[room].pop()
                has[room] = bool(by_room[room])
            each = min(room // length, left)
            took = min(n, left // each)
            put(room - each * length, took, (*items, (length, each)))
            left -= took * each
            if took < n and items:
                put(room, n - took, items)
    return _counted((b, n) for rest in by_room for n, b in rest)


def _counted(pairs) -> Counter[Bin]:
    out: Counter[Bin] = Counter()
    for b, n in pairs:
        out[b] += n
    return out


def _fill(b: Bin) -> int:
    return sum(x * n for x, n in b)


def _changed(b: Bin, out: tuple[int, ...], into: tuple[int, ...]) -> Bin:
    c = Counter(dict(b))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((x, n) for x, n in c.items() if n > 0), reverse=True))


class _Classes:
    """Classes of equal bins that are not full, by fill; and one flat table of what each may give back in an exchange.

    A class that comes back after it was used up is a new one, so what was looked at once need not be again."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[Bin] = []
        self.number: list[int] = []
        self.ids: dict[Bin, int] = {}
        self.open: list[tuple[int, int]] = []  # (fill, class)
        self.seen: list[int] = []  # by class: how much of the table holds no exchange for it
        self.size = self.used = 0
        self.give, self.owner, self.fill = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.alive = np.zeros(1 << 12, bool)  # by class

    def put(self, b: Bin, n: int) -> None:
        k = self.ids.get(b)
        if k is None:
            k, fill = len(self.items), _fill(b)
            self.ids[b] = k
            self.items.append(b)
            self.number.append(0)
            self.seen.append(0)
            insort(self.open, (fill, k))
            gives = [0, *(y for y, _ in b)]
            while self.size + len(gives) > len(self.give):
                self.give, self.owner, self.fill = (np.concatenate([x, np.zeros_like(x)]) for x in (self.give, self.owner, self.fill))
            while k >= len(self.alive):
                self.alive = np.concatenate([self.alive, np.zeros_like(self.alive)])
            to = slice(self.size, self.size + len(gives))
            self.give[to], self.owner[to], self.fill[to], self.alive[k] = gives, k, fill, True
            self.size += len(gives)
            self.used += len(gives)
        self.number[k] += n

    def take(self, k: int, n: int) -> None:
        self.number[k] -= n
        if not self.number[k]:
            b = self.items[k]
            self.alive[k] = False
            del self.ids[b]
            del self.open[bisect_left(self.open, (_fill(b), k))]
            self.used -= len(b) + 1
            if self.size > 4 * self.used + 4096:
                self._compact()

    def _compact(self) -> None:
        """The table without what is used up."""
        keep = self.alive[self.owner[: self.size]]
        before = np.concatenate([[0], np.cumsum(keep)])
        for _, k in self.open:
            self.seen[k] = int(before[self.seen[k]])
        for x in (self.give, self.owner, self.fill):
            x[: before[-1]] = x[: self.size][keep]
        self.size = int(before[-1])

    def exchange(self, k: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """For bins of class k: a class as full or fuller, what goes there and what comes back, that leaves it least room."""
        start, own = self.seen[k], self.items[k]
        give, owner, fill = (x[start : self.size] for x in (self.give, self.owner, self.fill))
        good = self.alive[owner] & (fill >= _fill(own))
        if self.number[k] < 2:
            good &= owner != k
        room = self.capacity - fill
        out = [((x,), x) for x, _ in own] + [((x, z), x + z) for i, (x, n) in enumerate(own) for z, _ in own[i:] if z != x or n > 1]
        best, found = None, None
        for gone, total in out:
            gain = total - give
            # Two go for one alone; one goes for one, or for nothing.
            ok = good & (gain > 0) & (gain <= room) & ((give > 0) if len(gone) == 2 else True)
            if ok.any():
                left = np.where(ok, room - gain, self.capacity + 1)
                i = int(left.argmin())
                if best is None or (left[i], -gain[i]) < best:
                    best, found = (left[i], -gain[i]), (int(owner[i]), gone, (int(give[i]),) if give[i] else ())
        if found is None:
            self.seen[k] = self.size
        return found


def local_search(bins: Counter[Bin], capacity: int, most: int = EXCHANGES) -> Counter[Bin]:
    """Exchanges between underfull bins, until bins are as few as can be or no exchange is left, or after most exchanges for each class that there is to begin with.

    Each raises the squared fill and is made in all equal pairs of bins of its two classes at once, so work goes by the
    kinds of bins, not by their number. The emptiest bins give first, until they are empty and gone, or nobody takes more.
    """
    number, least = bins.total(), -(-sum(_fill(b) * n for b, n in bins.items()) // capacity)
    full, classes = Counter({b: n for b, n in bins.items() if _fill(b) == capacity}), _Classes(capacity)

    def put(b: Bin, n: int) -> None:
        if _fill(b) == capacity:
            full[b] += n
        else:
            classes.put(b, n)

    for b, n in bins.items():
        if _fill(b) < capacity:
            classes.put(b, n)
    left, at, moved = most * len(classes.items), 0, False
    while number > least and left:
        if at >= len(classes.open):
            if not moved:
                break
            at, moved = 0, False
            continue
        k = classes.open[at][1]
        found = classes.exchange(k)
        if found is None:
            at += 1
            continue
        other, gone, back = found
        small, fuller = classes.items[k], classes.items[other]
        pairs = classes.number[k] // 2 if other == k else min(classes.number[k], classes.number[other])
        classes.take(k, pairs)
        classes.take(other, pairs)
        put(_changed(fuller, back, gone), pairs)
        if rest := _changed(small, gone, back):
            put(rest, pairs)
            # What is left of the emptied bins goes on giving.
            at = bisect_left(classes.open, (_fill(rest), classes.ids[rest]))
        else:
            number -= pairs
        left, moved = left - 1, True
    return full + Counter({b: classes.number[k] for b, k in classes.ids.items()})


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, cut: str = "lead") -> DataFrame:
    """The pieces of every document: null and empty texts are the end id alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(it):
        tok, end = words(tokenizer, cut), np.asarray([end_id], "<u4")

        def rows():
            for b in it:
                for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = np.concatenate([tok.encode(t.as_py()).astype("<u4"), end])
                    at = 0
                    for i in range(-(-len(ids) // capacity)):
                        to = at + (len(ids) % capacity or capacity) if i == 0 else at + capacity
                        yield d, i, at, to - at, zlib.crc32(ids[at:to].tobytes())
                        at = to

        yield from batches(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def _ranked(short: DataFrame, n: int) -> DataFrame:
    """short with part (a range of length, doc_id) and nth (from 0 among those of its length in the part)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def number(it):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in it:
            nth = np.empty(b.num_rows, np.int64)
            for i, x in enumerate(b.column(3).to_pylist()):
                n = n + 1 if x == last else 0
                last, nth[i] = x, n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(nth)], schema=schema)

    # Ranges may part rows that share length and doc_id, equal ones too.
    by = short.withColumn("row", F.monotonically_increasing_id())
    by = by.repartitionByRange(n, "length", "doc_id", "row").sortWithinPartitions("length", "doc_id", "row").drop("row")
    return by.mapInArrow(number, PIECES + ", part int, nth long")


def layout(bins: Counter[Bin]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length: from which rank which class of bins takes it (first rank, first bin, documents a bin, offset); and the number of bins."""
    spots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    first = 0
    for b in sorted(bins, reverse=True):
        offset = 0
        for x, n in b:
            spots.setdefault(x, []).append((ranks[x], first, n, offset))
            ranks[x] += n * bins[b]
            offset += x * n
        first += bins[b]
    return {x: tuple(np.asarray(c, np.int64) for c in zip(*s, strict=True)) for x, s in spots.items()}, first


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, cut: str = "lead") -> DataFrame:
    """Where each piece of each document goes: PLACED.

    Null and empty texts are one piece of the end id; rows that repeat a doc_id are
    documents of their own; an empty table gives no rows; other columns are not read.
    A very long text is encoded in slices, and cut into pieces like others.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    every = scratch.write(pieces(docs, tokenizer, capacity, end_id, cut), "pieces")
    short = scratch.write(_ranked(every.where(F.col("length") < capacity), parallelism(docs.sparkSession)), "short")
    # One row for each length that a part has: parts are ranges, so at most capacity + parts rows.
    counts = short.groupBy("length", "part").count().orderBy("length", "part").collect()
    hist: Counter[int] = Counter()
    before: dict[int, tuple[list[int], list[int]]] = {}
    for length, part, n in counts:
        at = before.setdefault(length, ([], []))
        at[0].append(part)
        at[1].append(hist[length])
        hist[length] += n
    bins = local_search(best_fit(dict(hist), capacity), capacity)
    spots, n_bins = layout(bins)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(it):
        for b in it:
            length, part, nth = (b.column(i).to_numpy() for i in (3, 5, 6))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                parts, base = before[x]
                rank = nth[own] + np.asarray([base[bisect_right(parts, p) - 1] for p in part[own].tolist()])
                from_, first, each, offset = spots[x]
                k = np.searchsorted(from_, rank, "right") - 1
                i = rank - from_[k]
                seq[own], off[own] = first[k] + i // each[k], offset[k] + i % each[k] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], schema=schema)

    full = every.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + n_bins).withColumn("offset", F.lit(0).cast("long"))
    return short.mapInArrow(place, PLACED).unionByName(full)
