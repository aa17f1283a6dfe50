"""Global ordinals without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import Scratch


def with_ordinal(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with each row's place from 0 in the order of by (distinct values).

    Ranges are dealt out; each is numbered alone, after the rows of the ranges before.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id())
    kept = Scratch(spark, "ordinal").write(ranged, "rows")
    before, counts = 0, []
    for part, k in kept.groupBy("_part").count().orderBy("_part").collect():  # one row a range
        counts.append((part, before))
        before += k
    base = spark.createDataFrame(counts, "_part int, _base long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return kept.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + within).drop("_part", "_base")
