"""Character maps as tables: code space and ranges, and codes joined to them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.joins import range_join

RANGES = "name string, lo long, hi long, bytes int, cid long"


def parse(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Code space (bytes, lo, hi) and ranges (lo, hi, bytes, first cid), by lo; neighbours that go on are one range."""
    space, found = [], []
    for kind, body in re.findall(r"begin(codespacerange|cidrange|cidchar)(.*?)end\1", text, re.S):
        words = re.findall(r"<\s*([0-9A-Fa-f]+)\s*>|(?<![\w<])(\d+)(?![\w>])", body)
        if kind == "codespacerange":
            space += [(len(lo) // 2, int(lo, 16), int(hi, 16)) for (lo, _), (hi, _) in zip(words[::2], words[1::2]) if lo and hi]
            continue
        each = 3 if kind == "cidrange" else 2
        for row in zip(*(words[k::each] for k in range(each))):
            codes, number = [x for x, _ in row[:-1]], row[-1][1]
            if all(codes) and number:
                found.append((int(codes[0], 16), int(codes[-1], 16), len(codes[0]) // 2, int(number)))
    out: list[tuple[int, int, int, int]] = []
    for lo, hi, size, cid in sorted(found):
        if out and out[-1][1] + 1 == lo and out[-1][2] == size and out[-1][3] + lo - out[-1][0] == cid:
            out[-1] = (out[-1][0], hi, size, out[-1][3])
        else:
            out.append((lo, hi, size, cid))
    return space, out


#: Characters of map files that go to all tasks.
MOST = 64 << 20


def given(spark: SparkSession, path: str) -> dict[str, str]:
    """The CMap files at path by their names, for the reader; as they go to all tasks, no more than MOST characters in all."""
    files = spark.read.text(path, wholetext=True)
    if (files.agg(F.sum(F.length("value"))).first()[0] or 0) > MOST:
        raise ValueError(f"over {MOST} characters of character maps")
    return {m[1]: r.value for r in files.collect() if (m := re.search(r"/CMapName\s*/(\S+)", r.value))}


def read_cmaps(spark: SparkSession, path: str) -> DataFrame:
    """RANGES of every CMap file at path, named by its /CMapName."""

    def run(it):
        for batch in it:
            for text in batch["value"]:
                m = re.search(r"/CMapName\s*/(\S+)", text)
                rows = [(m[1] if m else "", lo, hi, size, cid) for lo, hi, size, cid in parse(text)[1]]
                yield pd.DataFrame(rows, columns=["name", "lo", "hi", "bytes", "cid"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, RANGES)


#: Ranges up to this number go to all tasks.
FEW = 100_000
_WIDTH = 256


def to_cids(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """codes (name, code, …) with cid: of the range of the map that holds code, else 0.

    Ranges of a map are disjoint. Needed maps alone are kept; codes meet them by bins of the code, so that the codes of one
    map spread over tasks.
    """
    needed = ranges.join(codes.select("name").distinct(), "name", "left_semi").select("name", "lo", "hi", F.col("cid").alias("_cid"))
    needed = F.broadcast(needed) if needed.limit(FEW + 1).count() <= FEW else needed
    met = range_join(codes, needed, "code", "lo", "hi", _WIDTH, ["name"], "left")
    return met.withColumn("cid", F.coalesce(F.col("_cid") + F.col("code") - F.col("lo"), F.lit(0))).drop("lo", "hi", "_cid")
