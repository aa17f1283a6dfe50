"""Operator 7: shards by balanced label propagation; law ``rows``.

Documents of equal text are linked, through a hub for each text, so that a group of n
has n links, not n squared. A group of more documents than a shard holds is cut into
as few hubs as fit. Every document starts in the shard that its hash names; in each
round a hub counts its documents by shard, and all of them want the shard with most
of them. Quotas: a shard takes linked documents up to its capacity, so hubs move in
by the share of the asked places that are free, and hubs left out ask elsewhere next
round. Unlinked documents, free to be anywhere, then even the shards out: each keeps
its linked documents first, and what is over goes where places are left, so that
counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered
from quire.session import Scratch

SHARDS = 40
ROUNDS = 4


def _share(*cols: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _pick(free: list[float], share: Column) -> Column:
    """The shard whose part of the free places (as a share of all) holds this number."""
    total, cuts, at = sum(free) or 1.0, [], 0.0
    for x in free[:-1]:
        at += x / total
        cuts.append(at)
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= share)).cast("int")


def shards(docs: DataFrame, n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, links (1 if another document has its text).

    A null text counts as an empty one; rows that repeat a doc_id are documents of
    their own; with fewer documents than shards some are empty; an empty table gives
    no rows. Only doc_id and text are read.
    """
    if n < 2:
        raise ValueError("two shards at least")
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    first = scratch.write(first, "first")
    total = first.count()
    capacity = max(1, total // n)
    key = ["h", "text_crc32", "size"]
    groups = first.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("hubs", F.ceil(F.col("n") / capacity))
    groups = scratch.write(groups.withColumn("hub", F.xxhash64(*key)), "groups")
    # The cut of a large group is by number, so that its hubs are even; it is as wide as the group has hubs.
    large = groups.where("hubs > 1").select(*key, "hub", "hubs")
    members = first.join(groups.where("hubs = 1").select(*key, "hub"), key).select("row", "hub")
    spread = first.join(large, key).select("row", F.xxhash64("hub", F.pmod(F.xxhash64("row"), "hubs")).alias("hub"))
    start = F.pmod(F.xxhash64("row", F.lit(n)), F.lit(n)).cast("int")
    now = scratch.write(members.unionByName(spread).withColumn("shard", start), "round0")
    for k in range(1, rounds + 1):
        tally = now.groupBy("hub", "shard").agg(F.count("*").alias("c"))
        hubs = tally.groupBy("hub").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.max(F.struct("c", (-F.col("shard")).alias("s"))).alias("best"))
        hubs = scratch.write(hubs.select("hub", "n", (F.col("k") == 1).alias("settled"), (-F.col("best.s")).alias("want")), f"hubs{k}")
        # Hubs of over an eighth of a shard: at most eight for each shard. They are placed one by one.
        big = hubs.where(F.col("n") * 8 > capacity).orderBy(F.desc("n"), "hub").collect()
        load, placed = [0] * n, []
        for r in big:
            s = r.want if load[r.want] + r.n <= capacity else min(range(n), key=lambda s: (load[s], s))
            load[s] += r.n
            placed.append((r.hub, s))
        small = hubs.where(F.col("n") * 8 <= capacity)
        asked = {(r.want, r.settled): r.n for r in small.groupBy("want", "settled").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, capacity - load[s] - asked.get((s, True), 0)) for s in range(n)]
        rate = [min(1.0, room[s] / a) if (a := asked.get((s, False), 0)) else 1.0 for s in range(n)]
        free = [max(0.0, room[s] - rate[s] * asked.get((s, False), 0)) for s in range(n)]
        come = F.col("settled") | (_share("hub", F.lit(k)) < F.element_at(F.array(*map(F.lit, rate)), F.col("want") + 1))
        moved = small.select("hub", F.when(come, F.col("want")).otherwise(_pick(free, _share("hub", F.lit(-k)))).alias("to"))
        if placed:
            moved = moved.unionByName(docs.sparkSession.createDataFrame(placed, "hub long, to int"))
        now = scratch.write(now.join(moved, "hub").select("row", "hub", F.col("to").alias("shard")), f"round{k}")
    # A hub's documents keep together, linked ones first; those over a shard's count fill the others.
    every = first.join(now.withColumnRenamed("shard", "linked"), "row", "left")
    every = every.select("doc_id", "size", "text_crc32", "row", F.coalesce("linked", start).alias("shard"), F.when(F.col("linked").isNull(), 1).otherwise(0).alias("alone"), F.coalesce("hub", "row").alias("by"))
    ranked = numbered(every, "shard", ["alone", "by", "row"])
    goal = [total // n + (s < total % n) for s in range(n)]
    have = {r.shard: r["count"] for r in every.groupBy("shard").count().collect()}
    over = F.col("nth") >= F.element_at(F.array(*map(F.lit, goal)), F.col("shard") + 1)
    spare, cuts = 0, []
    for s in range(n):
        spare += max(0, goal[s] - have.get(s, 0))
        cuts.append(spare)
    ranked = scratch.write(ranked, "ranked")
    moved = numbered(ranked.where(over).drop("nth").withColumn("one", F.lit(0)), "one", ["row"])
    to = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("nth"))).cast("int")
    placed = ranked.where(~over).drop("nth").unionByName(moved.withColumn("shard", to).drop("one", "nth"))
    out = numbered(placed, "shard", ["row"])
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("nth").alias("slot"), (1 - F.col("alone")).alias("links"))


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "links")
