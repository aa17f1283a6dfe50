"""Session helpers: local sessions for tests and tools, and scratch tables."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests, tools and the benchmark."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests, notebooks)
    a new temporary folder is set as checkpoint folder and used. Elsewhere that would be
    a folder of its own on each machine, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df by key in tasks of about so many rows: for work that costs much a row, whose few bytes would be one task of a scan."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


class Scratch:
    """Tables written to the shared folder to cut lineage; readable after lost executors."""

    _made = threading.local()

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.live().append(self)

    @classmethod
    def live(cls) -> list[Scratch]:
        """Those that this thread has made and not cleared, in order."""
        if not hasattr(cls._made, "all"):
            cls._made.all = []
        return cls._made.all

    @classmethod
    def clear(cls, since: int = 0) -> None:
        """Delete the tables of all that this thread made from the since-th on; for results that are written or no longer asked for."""
        made = cls.live()
        for s in made[since:]:
            s.drop()
        del made[since:]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df and return a DataFrame that reads it back."""
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def free(self) -> None:
        """Let go of the shuffle files of finished steps, which else stay until the driver collects its garbage."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
