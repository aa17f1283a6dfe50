"""Joins that Spark has no plan of its own for, as equi-joins on bins with a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")))


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Rows whose value at lies in [lo, hi], both ends included.

    Ranges are repeated for each bin of the given width that they touch, and meet points
    by their bin; choose a width near the usual range, so that neither side multiplies.
    how: inner, left, left_semi or left_anti.
    """
    r = ranges.withColumn("_bin", _bins(F.col(lo), F.col(hi), width))
    p = points.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    keys = [*(on or []), "_bin"]
    if how == "inner":
        return p.join(r, keys).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bin")
    cond = (p["_bin"] == r["_bin"]) & p[at].between(r[lo], r[hi])
    for k in on or []:
        cond &= p[k] == r[k]
    drop = [r["_bin"], *(r[k] for k in on or [])] if how == "left" else []
    out = p.join(r, cond, how)
    for c in drop:
        out = out.drop(c)
    return out.drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], at: str, start: str, values: list[str]) -> DataFrame:
    """left with the values of the row of right with the greatest start up to at (null before the first).

    One sort of both sides together; no pair is made. Of equal starts the one with the
    greatest values counts.
    """
    r = right.select(*on, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    mine = F.struct(*(c for c in left.columns)).alias("_row")
    both = r.select(*on, "_at", "_side", "_v", F.lit(None).cast(left.select(mine).schema[0].dataType).alias("_row"))
    both = both.unionByName(left.select(*on, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), mine))
    w = Window.partitionBy(*on).orderBy("_at", "_side", F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], x: str, at: str, tolerance: float, row: list[str]) -> DataFrame:
    """Each row of left (row: its key) with the nearest row of right within tolerance; of equal ones the greater at."""
    width = max(tolerance, 1e-9)
    r = right.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(at) / width).cast("long") + k for k in (-1, 0, 1)))))
    met = left.withColumn("_bin", F.floor(F.col(x) / width).cast("long")).join(r, [*on, "_bin"]).where(F.abs(F.col(x) - F.col(at)) <= tolerance)
    w = Window.partitionBy(*row).orderBy(F.abs(F.col(x) - F.col(at)), F.desc(at))
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_bin")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str, str, str], b: tuple[str, str, str, str], slack: float, cell: float) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1) that overlap within slack, each pair once.

    Both sides are laid on a grid in y; a pair is kept in the cell where the later of
    the two begins, so that boxes over many cells meet once.
    """
    ly0, ly1 = F.col(a[1]) - slack, F.col(a[3]) + slack
    le = left.withColumn("_c", _bins(ly0, ly1, cell))
    ri = right.withColumn("_c", _bins(F.col(b[1]), F.col(b[3]), cell))
    met = le.join(ri, [*on, "_c"])
    first = F.greatest(F.floor(ly0 / cell), F.floor(F.col(b[1]) / cell)).cast("long")
    return met.where((F.col("_c") == first) & (F.col(a[0]) - slack < F.col(b[2])) & (F.col(b[0]) < F.col(a[2]) + slack) & (ly0 < F.col(b[3])) & (F.col(b[1]) < ly1)).drop("_c")


def near_match(left: DataFrame, right: DataFrame, on: list[str], coords: list[str], other: list[str], tolerance: float, row: list[str], order: str) -> DataFrame:
    """Each row of left (row: its key) with the first row of right, by order, whose coordinates all lie within tolerance."""
    width = max(4 * tolerance, 1e-9)
    r = right.withColumn("_bin", F.explode(F.array_distinct(F.array(F.floor((F.col(other[0]) - tolerance) / width).cast("long"), F.floor((F.col(other[0]) + tolerance) / width).cast("long")))))
    met = left.withColumn("_bin", F.floor(F.col(coords[0]) / width).cast("long")).join(r, [*on, "_bin"])
    for p, q in zip(coords, other, strict=True):
        met = met.where(F.abs(F.col(p) - F.col(q)) < tolerance)
    w = Window.partitionBy(*row).orderBy(order)
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_bin")


def bucket_of(bounds: Column, x: Column) -> Column:
    """In which of the intervals between ascending bounds x lies, from 0; clamped to the first and last."""
    return F.least(F.greatest(F.size(F.filter(bounds, lambda b: b <= x)) - 1, F.lit(0)), F.size(bounds) - 1)


def gathered(df: DataFrame, key: str, picks: list[int]) -> DataFrame:
    """Rows by key in the order picked, with repeats: ord from 0. Keys that do not exist give nothing."""
    pos = df.sparkSession.createDataFrame(list(enumerate(picks)), "ord long, _key long")
    return df.join(F.broadcast(pos), df[key] == pos["_key"]).drop("_key")
