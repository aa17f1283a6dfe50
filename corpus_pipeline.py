"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes what its predecessor kept, as a table with the columns of documents,
and decides on all of it; its decisions take effect in what it returns. run() writes
each stage's result as Parquet to the shared folder and reads it again for the next.

In every stage a null text is an empty one, rows that repeat a doc_id are documents of
their own, an empty table gives no rows, very long texts are worked on whole, and other
columns, whatever their names, come through (but in the last stage, whose columns are
those of the packing).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, packing, quality, secrets, simhash
from quire.llm.common import fresh
from quire.session import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality passes, and that are not base_failed."""
    return quality.keep(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one row: the smallest doc_id, and the first of rows that share it.

    Rows without a doc_id come after all others. Rows are told apart by a written row id, not by doc_id."""
    row = fresh(docs, "_row")
    scratch = Scratch(spark, "rows")
    rows = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    return rows.join(simhash.firsts(rows, row), row, "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, whole."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts marked out, and n_chars counted anew; a null text stays null."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizers, SimHash components and expectation-maximisation are no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        held = len(Scratch.live())
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        # What the stage itself wrote on the way is of no more use.
        Scratch.clear(held)
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
