"""Trees and graphs over tables of edges, by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import Scratch


def reachable(edges: DataFrame, roots: DataFrame, group: str, most: int | None = None) -> DataFrame:
    """group, node: what edges (group, src, dst) lead to from roots (group, node), roots included; in at most so many steps, if most is given.

    A frontier goes on from what is new in each round, so cycles end.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    seen = scratch.write(roots.select(group, "node").distinct(), "r0")
    front, k = seen, 0
    while (most is None or k < most) and front.head(1):
        k += 1
        new = front.join(edges, (front[group] == edges[group]) & (front["node"] == edges["src"])).select(front[group], edges["dst"].alias("node")).distinct()
        front = scratch.write(new.join(seen, [group, "node"], "left_anti"), f"f{k}")
        seen = seen.unionByName(front)
    return seen


def walked(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """nodes (tree, id, parent, ord) in preorder: with depth (from 0) and path, the array of ords from the root.

    parent null: a root. Sort by path for the order. A node has one parent, so levels end; most bounds them where a format
    does. Nodes are dealt out by parent once, and each level joins them where they are.
    """
    scratch = Scratch(nodes.sparkSession, "walk")
    held = nodes.select("tree", "id", "parent", "ord").where("parent is not null").repartition("tree", "parent").persist()
    front = scratch.write(nodes.where("parent is null").select("tree", "id", "parent", F.lit(0).alias("depth"), F.array("ord").alias("path")), "level0")
    out, k = front, 0
    while (most is None or k < most) and front.head(1):
        k += 1
        up = front.select("tree", F.col("id").alias("parent"), F.col("path").alias("_path"))
        front = scratch.write(held.join(up, ["tree", "parent"]).select("tree", "id", "parent", F.lit(k).alias("depth"), F.concat("_path", F.array("ord")).alias("path")), f"level{k}")
        out = out.unionByName(front)
    held.unpersist()
    return out


def inherited(nodes: DataFrame, value: str, most: int = 8) -> DataFrame:
    """nodes (tree, id, parent, value) with value from the nearest ancestor that has one, up to so many levels."""
    out = nodes.select("tree", "id", F.col(value).alias("_v"), F.col("parent").alias("_up"))
    up = nodes.select("tree", F.col("id").alias("_id"), F.col(value).alias("_w"), F.col("parent").alias("_p"))
    for _ in range(most):
        out = out.join(up, (out["tree"] == up["tree"]) & (out["_up"] == up["_id"]) & out["_v"].isNull(), "left").select(out["tree"], "id", F.coalesce("_v", "_w").alias("_v"), F.when(F.coalesce("_v", "_w").isNull(), F.col("_p")).alias("_up"))
    return out.select("tree", "id", F.col("_v").alias(value))


def parents_by_depth(df: DataFrame, group: str, order: str, depth: str) -> DataFrame:
    """df with parent: of a preorder list with depths, the last row before with a depth one less.

    Each row stands twice in one sort: where its children look, and where it looks itself. Any depth will do.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    sides = F.array(F.struct((F.col(depth) + 1).cast("long").alias("_d"), F.lit(True).alias("_up")), F.struct(F.col(depth).cast("long").alias("_d"), F.lit(False).alias("_up")))
    both = df.select(F.col(group).alias("_g"), F.col(order).alias("_o"), own.alias("_row"), F.inline(sides))
    w = Window.partitionBy("_g", "_d").orderBy("_o", "_up").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_parent", F.last(F.when(F.col("_up"), F.col("_o")), ignorenulls=True).over(w)).where(~F.col("_up"))
    return found.select("_row.*", F.when(F.col("_d") > 0, F.col("_parent")).alias("parent"))


def chased(df: DataFrame, col: str, mapping: DataFrame, hops: int = 4) -> DataFrame:
    """df with col followed through mapping (src, dst: at most one dst a src) for so many hops."""
    for k in range(hops):
        m = mapping.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        df = df.join(m, df[col] == m["_s"], "left").withColumn(col, F.coalesce("_d", col)).drop("_s", "_d")
    return df
