"""Files as they arrive: each new PDF once into the bronze tables. An addition to batch reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quire.sources.pdf import reader

TABLES = ("documents", "errors", "pages", "lines")
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, tables: tuple[str, ...] = TABLES) -> StreamingQuery:
    """Read what is at source and not yet taken, once; tables are folders of Parquet files at target.

    A file whose bytes were taken before, under whatever path, is left out: its digest
    is in the seen table. Run it again, or on a schedule, for what has come since.
    """
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(source)

    def take(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        raw = batch.select(F.xxhash64("path").alias("doc_id"), "path", "content", F.sha2("content", 256).alias("digest"))
        first = raw.groupBy("digest").agg(F.min("path").alias("path"))
        raw = raw.join(first, ["digest", "path"])
        try:
            raw = raw.join(s.read.schema("digest string, batch long").parquet(f"{target}/seen").where(F.col("batch") < number), "digest", "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        raw = raw.persist()
        for t in tables:
            # A batch that is run again after a failure writes over what it wrote.
            reader.table(raw, t).write.mode("overwrite").parquet(f"{target}/{t}/batch={number}")
        raw.select("digest", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{target}/seen")
        raw.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
