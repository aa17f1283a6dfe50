"""Holding what was extracted against what is known: facts, character bags, order, positions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.functions.scalars import character_counts, squeeze


def facts_found(blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """facts (doc_id, fact_id, kind, expected array<string>) with found.

    kind: heading or notheading (a heading equals or begins with it), text or notext
    (it stands somewhere), table (a row has, for each expected cell, one that contains
    it), code (a code block contains it), order (the first stands before the second).
    """
    low = lambda c: F.lower(squeeze(c))
    cells = F.transform("rows", lambda r: F.array_join(r, " "))
    flat = F.concat_ws(" ", "text", F.array_join("items", " "), F.array_join(cells, " "))
    doc = blocks.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("kind") == "heading", low(F.col("text")))).alias("_heads"),
        F.collect_list(F.when(F.col("kind") == "code", F.col("text"))).alias("_codes"),
        F.flatten(F.collect_list("rows")).alias("_rows"),
        low(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", flat.alias("t")))), lambda b: b.t), " ")).alias("_text"),
    )
    j = facts.join(doc, "doc_id", "left")
    first = low(F.element_at("expected", 1))
    head = F.coalesce(F.exists("_heads", lambda h: F.startswith(h, first)), F.lit(False))
    text = F.coalesce(F.contains(F.col("_text"), first), F.lit(False))
    row = F.coalesce(F.exists("_rows", lambda r: F.forall("expected", lambda e: F.exists(r, lambda c: F.contains(c, e)))), F.lit(False))
    code = F.coalesce(F.exists("_codes", lambda c: F.contains(c, F.element_at("expected", 1))), F.lit(False))
    a, b = F.instr(F.col("_text"), first), F.instr(F.col("_text"), low(F.try_element_at("expected", F.lit(2))))
    k = F.col("kind")
    found = F.when(k == "heading", head).when(k == "notheading", ~head).when(k == "text", text).when(k == "notext", ~text).when(k == "table", row).when(k == "code", code).when(k == "order", F.coalesce((a > 0) & (a < b), F.lit(False)))
    return j.withColumn("found", found).select(*facts.columns, "found")


def bag_agreement(mine: DataFrame, theirs: DataFrame, on: str) -> DataFrame:
    """on, precision, recall of the characters (but blanks) of two tables (on, text), as multisets."""

    def bag(df: DataFrame, name: str) -> DataFrame:
        bare = df.select(on, F.regexp_replace("text", "[ \\t\\n\\r]+", "").alias("_t"))
        counts = bare.select(on, F.inline(character_counts("_t")))
        return counts.groupBy(on, "ch").agg(F.sum("n").alias(name))

    j = bag(mine, "a").join(bag(theirs, "b"), [on, "ch"], "full").fillna(0, ["a", "b"])
    shared = F.sum(F.least("a", "b"))
    return j.groupBy(on).agg(F.try_divide(shared, F.sum("a")).alias("precision"), F.try_divide(shared, F.sum("b")).alias("recall"))


@F.pandas_udf(DoubleType())
def order_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two texts run, by their first 4,000 characters (the measure's own limit)."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "")[:4000], (y or "")[:4000], autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def position_agreement(mine: DataFrame, theirs: DataFrame, on: list[str], dx: float = 6.0, dy: float = 3.0) -> DataFrame:
    """on, n, agreed: of the characters (ch, x, y) of mine, those with an equal one of theirs that near.

    Both sides meet on a grid of dx by dy, theirs in all nine cells around."""
    cell = lambda c, d: F.floor(F.col(c) / d).cast("long")
    around = F.array(*(F.struct((cell("x", dx) + i).alias("cx"), (cell("y", dy) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    far = theirs.select(*on, "ch", F.col("x").alias("_x"), F.col("y").alias("_y"), F.inline(around))
    own = mine.withColumn("_id", F.monotonically_increasing_id()).withColumn("cx", cell("x", dx)).withColumn("cy", cell("y", dy))
    near = own.join(far, [*on, "ch", "cx", "cy"]).where((F.abs(F.col("x") - F.col("_x")) <= dx) & (F.abs(F.col("y") - F.col("_y")) <= dy)).select("_id").distinct()
    return own.join(near.withColumn("_ok", F.lit(1)), "_id", "left").groupBy(*on).agg(F.count("*").alias("n"), F.count("_ok").alias("agreed"))


def sampled_pages(pages: DataFrame, first: int = 5, spread: int = 3) -> DataFrame:
    """The first pages and some evenly spread over the rest, of each document (doc_id, page_no)."""
    counted = pages.withColumn("_n", F.max("page_no").over(Window.partitionBy("doc_id")))
    n = F.col("_n")
    picks = F.array(*(F.floor(first + 1 + (n - first - 1) * k / (spread + 1)) for k in range(1, spread + 1)))
    return counted.where((F.col("page_no") <= first) | F.array_contains(picks.cast("array<long>"), F.col("page_no").cast("long"))).drop("_n")


def share(flag: Column) -> Column:
    """Aggregate: the share of rows where flag holds."""
    return F.avg(flag.cast("int"))
