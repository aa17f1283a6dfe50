"""Grouped and ordered operators: modes, medians, islands, carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(group: list[str], *order: Column | str):
    return Window.partitionBy(*group).orderBy(*order)


def weighted_mode(df: DataFrame, group: list[str], key: Column, weight: Column, order: str) -> DataFrame:
    """group, key, weight: the key of most weight; of equal ones that which comes first by order."""
    sums = df.groupBy(*group, key.alias("key")).agg(F.sum(weight).alias("weight"), F.min(order).alias("_first"))
    # One row a key is left, so the best is an aggregate, too, and needs no sort.
    best = sums.groupBy(*group).agg(F.max_by(F.struct("key", "weight"), F.struct("weight", -F.col("_first"))).alias("b"))
    return best.select(*group, "b.key", "b.weight")


def top_one(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group by order; give a full order, so that it is one."""
    return df.withColumn("_n", F.row_number().over(_by(group, *order))).where("_n = 1").drop("_n")


def upper_median(value: str) -> Column:
    """Aggregate: the middle of a numeric column, of two values the upper one.

    Values are counted before they are shuffled, so a group costs its distinct values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def islands(df: DataFrame, group: list[str], order: list[Column | str], begins: Column, name: str = "island") -> DataFrame:
    """df with the number of its island: one begins with each first row and where begins holds."""
    w = _by(group, *order)
    flag = F.when(F.row_number().over(w) == 1, 0).when(begins, 1).otherwise(0)
    return df.withColumn("_flag", flag).withColumn(name, F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_flag")


def previous(col: Column | str, group: list[str], order: list[str]) -> Column:
    return F.lag(col).over(_by(group, *order))


def carried(col: Column | str, group: list[str], order: list[str]) -> Column:
    """The last value up to here that is not null."""
    return F.last(col, ignorenulls=True).over(_by(group, *order).rowsBetween(Window.unboundedPreceding, 0))


def reach(end: Column | str, group: list[str], order: list[Column | str]) -> Column:
    """The greatest end of all rows before."""
    return F.max(end).over(_by(group, *order).rowsBetween(Window.unboundedPreceding, -1))


def ranked_distinct(df: DataFrame, group: list[str], key: str, most: int) -> DataFrame:
    """group, key, rnk: the greatest distinct keys, at most so many."""
    d = df.select(*group, key).distinct()
    return d.withColumn("rnk", F.dense_rank().over(_by(group, F.desc(key))).cast("long")).where(F.col("rnk") <= most)


def merged_intervals(df: DataFrame, group: list[str], start: str, end: str, slack: float, tie: list[str]) -> DataFrame:
    """group, start, end, n: intervals that overlap, or touch within slack, as one.

    tie: what tells equal intervals of a group apart, as their order must be the same in every step.
    Intervals without a start come last, and so count with the last of their group."""
    w = [F.asc_nulls_last(c) for c in (start, end, *tie)]
    far = F.col(start) > reach(end, group, w) + slack
    return islands(df, group, w, far).groupBy(*group, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("island")


def gaps(df: DataFrame, group: list[str], start: str, end: str, tie: list[str]) -> DataFrame:
    """group, start, end: what no interval covers between the first and the last."""
    m = merged_intervals(df, group, start, end, 0, tie)
    nxt = F.lead("start").over(_by(group, "start"))
    return m.withColumn("_next", nxt).where(F.col("_next") > F.col("end")).select(*group, F.col("end").alias("start"), F.col("_next").alias("end"))


def joined_text(text: Column | str, order: list[str], separator: str) -> Column:
    """Aggregate: texts in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t") if isinstance(text, str) else text.alias("_t"))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), separator)


def depth(step: Column, group: list[str], order: list[str]) -> Column:
    """Running sum of +1 and -1: how deep a stack is after each row."""
    return F.sum(step).over(_by(group, *order).rowsBetween(Window.unboundedPreceding, 0))
