"""Queries on decoding, colour, scripts, structure, facts and sinks, each with its SQL where it has one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import colour
from quire.functions import scalars as fn
from quire.functions.script import run as run_script
from quire.operators import evaluation, joins
from quire.sources.synthetic import LINE, lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT o_orderkey, CAST(coalesce(CAST(n_regionkey + 1000 AS BIGINT), o_orderkey % 40) AS BIGINT) AS uni FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 40")
def code_map(spark: SparkSession, sf: str) -> DataFrame:
    """Codes through a font's map, themselves where it has none."""
    m = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("code"), (F.col("n_regionkey") + 1000).cast("long").alias("to"))
    o = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("code"))
    return o.join(m, "code", "left").select("o_orderkey", F.coalesce("to", "code").alias("uni"))


def _ink_sql(row: tuple[float, ...]) -> str:
    return "round(least(1, greatest(0, (255 + " + " + ".join(f"({w!r}::DOUBLE) * {' * '.join(t)}" for w, t in zip(row, colour.CMYK_TERMS, strict=True)) + ") / 255)), 9)"


@query("SELECT p_partkey, " + ", ".join(f"{_ink_sql(row)} AS {n}" for n, row in zip("rgb", colour.CMYK, strict=True)) + " FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS c, (p_partkey % 10) / 10.0::DOUBLE AS m, (p_partkey % 3) / 3.0::DOUBLE AS y, (p_partkey % 4) / 4.0::DOUBLE AS k FROM part)")
def colours(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda n: (F.col("p_partkey") % n) / float(n)
    rgb = colour.cmyk_rgb(F.col("p_size") / 50.0, share(10), share(3), share(4))
    return _t(spark, sf, "part").select("p_partkey", rgb.alias("c")).select("p_partkey", *(F.round(f"c.{n}", 9).alias(n) for n in "rgb"))


@query("SELECT p_partkey, CAST(p_size * 2 + CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS DOUBLE) AS value, concat(CAST(p_size AS VARCHAR), '-', upper(p_brand)) AS label FROM part")
def document_scripts(spark: SparkSession, sf: str) -> DataFrame:
    source = "let twice = x => x * 2; let v = twice(size); if (size > 25) v += 1; [v, `${size}-` + brand.toUpperCase()]"

    def run(it):
        for b in it:
            got = [run_script(source, {"size": float(s), "brand": t})["value"] for s, t in zip(b["p_size"], b["p_brand"], strict=True)]
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "value": [v for v, _ in got], "label": [t for _, t in got]})

    return _t(spark, sf, "part").select("p_partkey", "p_size", "p_brand").mapInPandas(run, "p_partkey long, value double, label string")


@query("SELECT l_orderkey, l_linenumber, CAST(k AS BIGINT) AS part, (l_quantity - CASE k WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 25 END) / CASE k WHEN 0 THEN 10 WHEN 1 THEN 15 ELSE 25 END AS t FROM (SELECT *, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 ELSE 2 END AS k FROM lineitem)")
def stitching(spark: SparkSession, sf: str) -> DataFrame:
    """Which part of a stitched function holds an input, and the input in the part's own domain."""
    lows, highs = F.array(*map(F.lit, (0.0, 10.0, 25.0))), F.array(*map(F.lit, (10.0, 25.0, 50.0)))
    k = joins.bucket_of(lows, F.col("l_quantity"))
    lo, hi = F.get(lows, k), F.get(highs, k)
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", k.cast("long").alias("part"), ((F.col("l_quantity") - lo) / (hi - lo)).alias("t"))


@query(f"WITH {LINE} SELECT doc_id, line_no FROM line WHERE x + w > 70 AND x < 330 AND y BETWEEN 100 AND 400 AND NOT (x > 300 AND size > 11)")
def page_box(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    inside = (F.col("x") + F.col("w") > 70) & (F.col("x") < 330) & F.col("y").between(100, 400)
    return ln.where(inside & ~((F.col("x") > 300) & (F.col("size") > 11))).select("doc_id", "line_no")


@query(f"WITH {LINE}, n AS (SELECT doc_id, line_no AS id, CASE WHEN line_no = 0 THEN NULL ELSE line_no // 3 END AS parent, page_no FROM line), want AS (SELECT doc_id, id, parent FROM n WHERE page_no = 2), a AS (SELECT doc_id, id, parent FROM want UNION SELECT n.doc_id, n.id, n.parent FROM want JOIN n ON n.doc_id = want.doc_id AND n.id = want.parent), b AS (SELECT * FROM a UNION SELECT n.doc_id, n.id, n.parent FROM a JOIN n ON n.doc_id = a.doc_id AND n.id = a.parent), c AS (SELECT * FROM b UNION SELECT n.doc_id, n.id, n.parent FROM b JOIN n ON n.doc_id = b.doc_id AND n.id = b.parent), d AS (SELECT * FROM c UNION SELECT n.doc_id, n.id, n.parent FROM c JOIN n ON n.doc_id = c.doc_id AND n.id = c.parent) SELECT DISTINCT doc_id, id FROM d")
def structure_of_page(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the second page with their ancestors (four levels: lines of a page have no more)."""
    ln = lines(spark, sf)
    n = ln.select("doc_id", F.col("line_no").alias("id"), F.when(F.col("line_no") > 0, F.floor(F.col("line_no") / 3)).alias("parent"), "page_no")
    front = n.where("page_no = 2").select("doc_id", "id", "parent")
    seen = front
    up = n.select("doc_id", F.col("id").alias("parent"), F.col("parent").alias("_next"))
    for _ in range(4):
        front = front.join(up, ["doc_id", "parent"]).select("doc_id", F.col("parent").alias("id"), F.col("_next").alias("parent")).distinct()
        seen = seen.unionByName(front)
    return seen.select("doc_id", "id").distinct()


_LOW = "trim(regexp_replace(lower({0}), '[ \t\n\v\f\r]+', ' ', 'g'))"


@query(f"WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS items, {_LOW.format('text')} AS fact FROM benchmark), d AS (SELECT doc_id, quality, {_LOW.format('text')} AS said, len(text) AS size FROM documents JOIN labels USING (doc_id)), f AS (SELECT doc_id, quality, said, unnest(['own', 'item', 'not item']) AS source, substring(said, CAST(size // 3 + 1 AS BIGINT), 30) AS own, fact FROM d JOIN b ON b.k = d.doc_id % b.items) SELECT doc_id, source, quality = 1 AS good, CASE source WHEN 'own' THEN contains(said, trim(own)) WHEN 'item' THEN contains(said, fact) ELSE NOT contains(said, fact) END AS found FROM f")
def known_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Of every labelled document three facts: words of its own from a third of it on, an item of the benchmark, and that the item is not there."""
    from quire.operators.ordinals import with_ordinal

    b = with_ordinal(_t(spark, sf, "benchmark").select("item_id", F.col("text").alias("fact")), "item_id", "k")
    d = _t(spark, sf, "documents").select("doc_id", "text").join(_t(spark, sf, "labels").select("doc_id", "quality"), "doc_id").withColumn("k", F.col("doc_id") % b.count())
    blocks = d.select("doc_id", F.lit(0).alias("block_id"), F.lit("para").alias("kind"), "text", F.array().cast("array<string>").alias("items"), F.array().cast("array<array<string>>").alias("rows"))
    own = F.substring(F.lower(fn.squeeze(F.col("text"))), (F.floor(F.length("text") / 3) + 1).cast("int"), F.lit(30))
    kinds = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(k).alias("kind"), F.array(v).alias("expected")) for s, k, v in (("own", "text", own), ("item", "text", F.col("fact")), ("not item", "notext", F.col("fact")))))
    facts = d.join(b, "k").select("doc_id", "quality", F.explode(kinds).alias("f")).select("doc_id", F.lit(0).alias("fact_id"), "f.*", (F.col("quality") == 1).alias("good"))
    return evaluation.facts_found(blocks, facts).select("doc_id", "source", "good", "found")


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<li')) AS items FROM pages")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li")).cast("long").alias("items"))


@query("SELECT n_nationkey, concat('| ', replace(n_name, '|', '\\|'), ' | ', CAST(n_regionkey AS VARCHAR), ' |') AS row FROM nation")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.concat_ws(" | ", fn.cell_escape(F.col("n_name")), F.col("n_regionkey").cast("string"))
    return _t(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("| "), cells, F.lit(" |")).alias("row"))


@query("SELECT c_mktsegment AS font, count(DISTINCT ch) AS covered FROM (SELECT c_mktsegment, unnest(string_split(c_name, '')) AS ch FROM customer) JOIN (SELECT DISTINCT unnest(string_split('Customer#1234', '')) AS want) ON ch = want GROUP BY 1 HAVING count(DISTINCT ch) = (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split('Customer#1234', '')) AS w))")
def fonts_for_text(spark: SparkSession, sf: str) -> DataFrame:
    """Fonts that have every character of a text: relational division."""
    want = spark.createDataFrame([(c,) for c in sorted(set("Customer#1234"))], "ch string")
    have = _t(spark, sf, "customer").select(F.col("c_mktsegment").alias("font"), F.explode(F.split("c_name", "")).alias("ch")).distinct()
    covered = have.join(F.broadcast(want), "ch").groupBy("font").agg(F.count("*").alias("covered"))
    return covered.where(F.col("covered") == len(set("Customer#1234")))
