"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import sized
from quire.session import Scratch


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is linked with) for every node of edges (u, v).

    Rounds grow with the logarithm of the longest chain; neighbours are never listed,
    only their minima; each round is a table in the shared folder. Self-links are
    dropped, so nodes without another link have no row.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "round0")
    last, k = _state(e), 0
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        k += 1
        # Minima are written before they are joined: then a merge can split a hub's links.
        low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"low{k}")
        large = scratch.write(both.join(sized(low, 2 * last[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"large{k}")
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"least{k}")
        small = large.join(sized(low, 2 * last[0]), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"round{k}")
        now = _state(new)
        for name in (f"round{k - 1}", f"low{k}", f"large{k}", f"least{k}"):
            scratch.drop(name)
        e, done, last = new, now == last, now
        if done:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
