"""What the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of more characters than this are worked on in slices where that is possible.
LONG = 1 << 20


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column (names are told apart without regard to case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Rows of a few numbers each that may go to all tasks: some 3 MB.
SMALL = 100_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, a table of at most so many rows of a few numbers, as the side of a join: sent to all tasks if it is small, else sorted and merged.

    Spark's own choice goes by the size of compressed files. A merge can split hot keys if df is a written table."""
    return F.broadcast(df) if rows <= SMALL else df.hint("merge")


def batches(rows, schema: pa.Schema, limit: int = 2048):
    """Gather tuples into record batches of at most ``limit`` rows."""
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) >= limit:
            yield to_batch(part, schema)
            part = []
    if part:
        yield to_batch(part, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def numbered(df: DataFrame, group: str, order: list[str], n: int | None = None) -> DataFrame:
    """df with nth: each row's number from 0 within its group (a column without nulls), by order.

    Ranges of (group, order) are dealt out and numbered as streams; a range starts
    where the one before it ended, so a group of any size spreads over tasks. The
    numbers of rows by range and group (at most ranges + groups rows) go to all tasks.
    """
    from quire.session import Scratch

    spark = df.sparkSession
    keys = list(dict.fromkeys([group, *order]))
    at = df.columns.index(group)

    def number(it):
        from pyspark import TaskContext

        part, last, k = TaskContext.get().partitionId(), None, -1
        for b in it:
            nth = []
            for x in b.column(at).to_pylist():
                k = k + 1 if x == last else 0
                last = x
                nth.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(nth, pa.int64())], names=[*b.schema.names, "_part", "_nth"])

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_nth", T.LongType())])
    by = df.repartitionByRange(n or parallelism(spark), *keys).sortWithinPartitions(*keys)
    made = Scratch(spark, "numbered").write(by.mapInArrow(number, schema), "rows")
    counts, before, base = made.groupBy(group, "_part").count().orderBy(group, "_part").collect(), [], 0
    for i, (g, part, k) in enumerate(counts):
        base = 0 if i == 0 or counts[i - 1][0] != g else base
        before.append((g, part, base))
        base += k
    kind = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("_part", T.IntegerType()), T.StructField("_base", T.LongType())])
    return made.join(F.broadcast(spark.createDataFrame(before, kind)), [group, "_part"]).withColumn("nth", F.col("_base") + F.col("_nth")).select(*df.columns, "nth")
