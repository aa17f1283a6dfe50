"""Documents without pages laid out by rule, as the tables that a page reader makes.

A text's lines stand 40 to a page in two columns, 16 points apart; a line's words
follow one another by their length, with a gap that varies. The rule is arithmetic, so
that other engines can state it too; see LINE and WORD.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same tables in SQL over ``documents``: line, and word of it.
LINE = """line AS (SELECT doc_id, n - 1 AS line_no, (n - 1) // 40 + 1 AS page_no, t AS text, CAST(72 + 240 * ((n - 1) % 2) AS DOUBLE) AS x,
  CAST(60 + 16 * ((n - 1) % 40) AS DOUBLE) AS y, CAST(CASE WHEN n = 1 THEN 16 ELSE 10 + doc_id % 3 END AS DOUBLE) AS size,
  CAST(least(220, 5 * length(t)) AS DOUBLE) AS w, (doc_id + n - 1) % 7 = 0 AS bold
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"""
WORD = """word0 AS (SELECT doc_id, page_no, line_no, y, size, n - 1 AS word_no, t AS text FROM (SELECT doc_id, page_no, line_no, y, size,
    unnest(list_filter(string_split(text, ' '), lambda v: v <> '')) AS t, generate_subscripts(list_filter(string_split(text, ' '), lambda v: v <> ''), 1) AS n FROM line)),
  word AS (SELECT doc_id, page_no, line_no, word_no, y, size, text, CAST(5 * length(text) AS DOUBLE) AS w,
    CAST(72 + coalesce(sum(5 * length(text)) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + (word_no % 4) * 1.5 AS x FROM word0)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, page_no, text, x, y, size, w, bold."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    n = F.col("n").cast("long")
    return d.select(
        "doc_id",
        n.alias("line_no"),
        (F.floor(n / 40) + 1).alias("page_no"),
        "text",
        (72 + 240 * (n % 2)).cast("double").alias("x"),
        (60 + 16 * (n % 40)).cast("double").alias("y"),
        F.when(n == 0, 16).otherwise(10 + F.pmod("doc_id", F.lit(3))).cast("double").alias("size"),
        F.least(F.lit(220), 5 * F.length("text")).cast("double").alias("w"),
        (F.pmod(F.col("doc_id") + n, F.lit(7)) == 0).alias("bold"),
    )


def words(line: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, word_no, y, size, text, w, x."""
    from pyspark.sql import Window

    d = line.select("doc_id", "page_no", "line_no", "y", "size", F.posexplode(F.filter(F.split("text", " "), lambda v: v != "")).alias("word_no", "text"))
    d = d.withColumn("word_no", F.col("word_no").cast("long")).withColumn("w", (5 * F.length("text")).cast("double"))
    before = F.sum("w").over(Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("x", 72 + F.coalesce(before, F.lit(0.0)) + (F.col("word_no") % 4) * 1.5)
