"""Joins, sets, trees, functions and aggregates over the star tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import scalars as fn
from quire.operators import evaluation, forms, joins, trees
from quire.operators import windows as win
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


@query("WITH i AS (SELECT l_orderkey AS g, l_quantity AS a, l_quantity + 3 AS b, l_linenumber AS o FROM lineitem), f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY g ORDER BY a, b, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS new FROM i), s AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY a, b, o ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT g AS l_orderkey, min(a) AS start, max(b) AS \"end\", count(*) AS n FROM s GROUP BY g, island")
def rule_merge(spark: SparkSession, sf: str) -> DataFrame:
    i = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_quantity") + 3).alias("b"))
    return win.merged_intervals(i, ["l_orderkey"], "a", "b", 2.0, ["l_linenumber"])


@query("SELECT l_suppkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS mid FROM lineitem GROUP BY 1")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(win.upper_median("l_quantity").alias("mid"))


_LABEL = "r AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS start, CASE o_orderkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'r' WHEN 2 THEN 'A' ELSE '' END AS style, concat('p', CAST(o_orderkey % 3 AS VARCHAR), '-') AS prefix FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"WITH {_LABEL} SELECT o.o_custkey, o.o_orderkey, CASE WHEN r.start IS NULL THEN NULL ELSE concat(prefix, CASE style WHEN 'D' THEN CAST(o_orderkey - r.start + 1 AS VARCHAR) WHEN 'A' THEN repeat(chr(CAST(65 + (o_orderkey - r.start) % 26 AS INTEGER)), CAST((o_orderkey - r.start) // 26 + 1 AS BIGINT)) ELSE '' END) END AS label FROM orders o ASOF LEFT JOIN r ON o.o_custkey = r.c AND o.o_orderkey >= r.start")
def page_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    style = F.when(F.col("o_orderkey") % 4 == 0, "D").when(F.col("o_orderkey") % 4 == 1, "r").when(F.col("o_orderkey") % 4 == 2, "A").otherwise("")
    r = o.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("start"), style.alias("style"), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string"), F.lit("-")).alias("prefix"))
    j = joins.asof_join(o, r, ["o_custkey"], "o_orderkey", "start", ["start", "style", "prefix"])
    label = fn.page_label(F.col("style"), F.col("prefix"), F.col("o_orderkey") - F.col("start") + 1)
    return j.select("o_custkey", "o_orderkey", F.when(F.col("start").isNotNull(), label).alias("label"))


def _roman_sql(n: str) -> str:
    out, rest = [], n
    for v, s in fn.ROMAN:
        out.append(f"repeat('{s}', CAST(({rest}) // {v} AS BIGINT))")
        rest = f"({rest}) % {v}"
    return "concat(" + ", ".join(out) + ")"


@query(f"SELECT p_partkey, {_roman_sql('(p_partkey + p_size * 40) % 3999 + 1')} AS roman FROM part")
def roman(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", fn.roman((F.col("p_partkey") + F.col("p_size") * 40) % 3999 + 1).alias("roman"))


@query("SELECT p_partkey, repeat(chr(CAST(65 + (p_size - 1) % 26 AS INTEGER)), CAST((p_size - 1) // 26 + 1 AS BIGINT)) AS label FROM part")
def alpha_label(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", fn.alpha_label(F.col("p_size")).alias("label"))


_RANGES = "r AS (SELECT CAST(p_partkey * 37 AS BIGINT) AS lo, CAST(p_partkey * 37 + p_size AS BIGINT) AS hi, CAST(p_partkey * 100 AS BIGINT) AS v FROM part)"


@query(f"WITH {_RANGES} SELECT o_orderkey AS code, coalesce(v + o_orderkey - lo, 0) AS cid FROM orders LEFT JOIN r ON o_orderkey BETWEEN lo AND hi")
def cmap_range_join(spark: SparkSession, sf: str) -> DataFrame:
    lo = (F.col("p_partkey") * 37).cast("long")
    r = _t(spark, sf, "part").select(lo.alias("lo"), (lo + F.col("p_size")).alias("hi"), (F.col("p_partkey") * 100).cast("long").alias("v"))
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("code"))
    return joins.range_join(o, r, "code", "lo", "hi", 64, how="left").select("code", F.coalesce(F.col("v") + F.col("code") - F.col("lo"), F.lit(0)).alias("cid"))


@query('WITH c AS (SELECT DISTINCT s_nationkey * 4.0 AS a FROM supplier), m AS (SELECT l_orderkey, l_linenumber, a, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY abs(l_quantity * 2 - a), a DESC) AS n FROM lineitem JOIN c ON abs(l_quantity * 2 - a) <= 1.5) SELECT l_orderkey, l_linenumber, CAST(a AS DOUBLE) AS "at" FROM m WHERE n = 1')
def nearest_column(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "supplier").select((F.col("s_nationkey") * 4.0).alias("at"), F.lit(1).alias("one")).distinct()
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("x"), F.lit(1).alias("one"))
    return joins.nearest_join(li, c, ["one"], "x", "at", 1.5, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "at")


_RECT = "SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice / 100) AS x0, CAST(o_orderkey % 50 AS DOUBLE) AS y0"


@query(f"WITH a AS ({_RECT} FROM orders), b AS (SELECT k * 2 AS k2, c, x0 + (k % 3) * 0.24 AS bx, y0 - (k % 2) * 0.4 AS yy FROM a WHERE k % 5 <> 0) SELECT k, k2 FROM (SELECT k, k2, row_number() OVER (PARTITION BY k ORDER BY k2) AS n FROM a JOIN b ON a.c = b.c AND abs(x0 - bx) < 0.5 AND abs(y0 - yy) < 0.5) WHERE n = 1")
def link_annot_match(spark: SparkSession, sf: str) -> DataFrame:
    a = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("x0"), (F.col("o_orderkey") % 50).cast("double").alias("y0"))
    b = a.where("k % 5 <> 0").select((F.col("k") * 2).alias("k2"), "c", (F.col("x0") + (F.col("k") % 3) * 0.24).alias("bx"), (F.col("y0") - (F.col("k") % 2) * 0.4).alias("yy"))
    return joins.near_match(a, b, ["c"], ["x0", "y0"], ["bx", "yy"], 0.5, ["k"], "k2").select("k", "k2")


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(0, len(list_filter([0, 8, 16, 30, 44], lambda b: b <= l_quantity)) - 1) AS BIGINT) AS col FROM lineitem")
def cell_assign(spark: SparkSession, sf: str) -> DataFrame:
    bounds = F.array(*map(F.lit, (0.0, 8.0, 16.0, 30.0, 44.0)))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", joins.bucket_of(bounds, F.col("l_quantity")).cast("long").alias("col"))


@query("WITH b AS (SELECT max(o_orderkey) AS m FROM orders) SELECT 'a' AS part, o_orderkey AS num, CAST(o_custkey AS BIGINT) AS parent FROM orders UNION ALL SELECT 'b', c_custkey + m + 1, c_nationkey + m + 1 FROM customer, b")
def merge_docs(spark: SparkSession, sf: str) -> DataFrame:
    a = _t(spark, sf, "orders").select(F.lit("a").alias("part"), F.col("o_orderkey").alias("num"), F.col("o_custkey").cast("long").alias("parent"))
    shift = a.agg(F.max("num").alias("m")).first().m + 1
    b = _t(spark, sf, "customer").select(F.lit("b").alias("part"), (F.col("c_custkey") + shift).alias("num"), (F.col("c_nationkey") + F.lit(shift)).alias("parent"))
    return a.unionByName(b)


PICKS = [7, 3, 3, 24, 0, 99, 12]


@query(f"WITH p AS (SELECT unnest({PICKS}) AS k, generate_subscripts({PICKS}, 1) - 1 AS ord) SELECT CAST(ord AS BIGINT) AS ord, n_nationkey, n_name FROM p JOIN nation ON n_nationkey = k")
def pick_pages(spark: SparkSession, sf: str) -> DataFrame:
    return joins.gathered(_t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", PICKS)


_EDGES = "e AS (SELECT 'x' AS g, concat('c', CAST(c_custkey AS VARCHAR)) AS src, concat('n', CAST(c_nationkey AS VARCHAR)) AS dst FROM customer UNION ALL SELECT 'x', concat('n', CAST(n_nationkey AS VARCHAR)), concat('r', CAST(n_regionkey AS VARCHAR)) FROM nation UNION ALL SELECT 'x', concat('r', CAST(r_regionkey AS VARCHAR)), concat('n', CAST((r_regionkey * 3) AS VARCHAR)) FROM region)"


@query(f"WITH RECURSIVE {_EDGES}, t AS (SELECT 'x' AS g, concat('c', CAST(c_custkey AS VARCHAR)) AS node FROM customer WHERE c_acctbal > 9000 UNION SELECT e.g, e.dst FROM t JOIN e ON e.src = t.node) SELECT g, node FROM t")
def reachable(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (_t(spark, sf, t) for t in ("customer", "nation", "region"))
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    e = c.select(F.lit("x").alias("g"), name("c", F.col("c_custkey")).alias("src"), name("n", F.col("c_nationkey")).alias("dst"))
    e = e.unionByName(n.select(F.lit("x").alias("g"), name("n", F.col("n_nationkey")).alias("src"), name("r", F.col("n_regionkey")).alias("dst")))
    e = e.unionByName(r.select(F.lit("x").alias("g"), name("r", F.col("r_regionkey")).alias("src"), name("n", F.col("r_regionkey") * 3).alias("dst")))
    roots = c.where("c_acctbal > 9000").select(F.lit("x").alias("g"), name("c", F.col("c_custkey")).alias("node"))
    return trees.reachable(e, roots, "g")


_NODES = "nodes AS (SELECT o_orderkey AS tree, CAST(l_linenumber AS BIGINT) AS id, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber // 2 AS BIGINT) END AS parent, CAST(l_linenumber AS BIGINT) AS ord, CASE WHEN (l_linenumber + o_orderkey) % 3 = 0 THEN l_shipmode END AS v FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber, concat('m', CAST(l_linenumber AS VARCHAR)) AS l_shipmode FROM lineitem))"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tree"), F.col("l_linenumber").cast("long").alias("id")).distinct()
    v = F.when((F.col("id") + F.col("tree")) % 3 == 0, F.concat(F.lit("m"), F.col("id").cast("string")))
    return d.select("tree", "id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("parent"), F.col("id").alias("ord"), v.alias("v"))


@query(f"WITH RECURSIVE {_NODES}, t AS (SELECT tree, id, 0 AS depth, CAST(ord AS VARCHAR) AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.tree, n.id, t.depth + 1, concat(t.path, '.', CAST(n.ord AS VARCHAR)) FROM t JOIN nodes n ON n.tree = t.tree AND n.parent = t.id WHERE t.depth < 16) SELECT tree, id, CAST(depth AS BIGINT) AS depth, path FROM t")
def outline_tree(spark: SparkSession, sf: str) -> DataFrame:
    t = trees.walked(_nodes(spark, sf))
    return t.select("tree", "id", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@query(f"WITH {_NODES} SELECT a.tree, a.id, coalesce(a.v, b.v, c.v) AS v FROM nodes a LEFT JOIN nodes b ON b.tree = a.tree AND b.id = a.parent LEFT JOIN nodes c ON c.tree = b.tree AND c.id = b.parent")
def inherit_attr(spark: SparkSession, sf: str) -> DataFrame:
    return trees.inherited(_nodes(spark, sf), "v", 2)


@query("WITH m AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation WHERE n_nationkey % 4 <> 0) SELECT c_custkey, CAST(coalesce(m4.dst, m3.dst, m2.dst, m1.dst, c_nationkey) AS BIGINT) AS role FROM customer LEFT JOIN m m1 ON m1.src = c_nationkey LEFT JOIN m m2 ON m2.src = m1.dst LEFT JOIN m m3 ON m3.src = m2.dst LEFT JOIN m m4 ON m4.src = m3.dst")
def rolemap_chain(spark: SparkSession, sf: str) -> DataFrame:
    m = _t(spark, sf, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).cast("long").alias("dst"))
    return trees.chased(_t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("role")), "role", m)


@query("WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('JavaScript:', url) WHEN 1 THEN concat('  ', url) WHEN 2 THEN concat('mailto:', CAST(page_id AS VARCHAR), '@x.org') WHEN 3 THEN concat('/rel/', CAST(page_id AS VARCHAR)) WHEN 4 THEN '' ELSE url END AS url FROM pages) SELECT page_id, CASE WHEN trim(url) = '' THEN NULL WHEN lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'mailto', 'tel', 'ftp', 'ftps') THEN trim(url) END AS url FROM u")
def safe_url(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 6
    i = F.col("page_id").cast("string")
    u = F.when(k == 0, F.concat(F.lit("JavaScript:"), "url")).when(k == 1, F.concat(F.lit("  "), "url")).when(k == 2, F.concat(F.lit("mailto:"), i, F.lit("@x.org"))).when(k == 3, F.concat(F.lit("/rel/"), i)).when(k == 4, "").otherwise(F.col("url"))
    return _t(spark, sf, "pages").select("page_id", fn.safe_url(u).alias("url"))


@query("SELECT p_partkey, " + ", ".join(f"((p_partkey * 97 + p_size) & {1 << (b - 1)}) <> 0 AS {n}" for n, b in fn.PERMISSIONS.items()) + " FROM part")
def perm_bits(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", *(fn.permission(F.col("p_partkey") * 97 + F.col("p_size"), n).alias(n) for n in fn.PERMISSIONS))


@query("WITH t AS (SELECT p_partkey, p_size AS n, p_partkey % 6 AS k FROM part) SELECT p_partkey, round(CASE k WHEN 0 THEN n * 1.0 / 25.4 * 72 WHEN 1 THEN n * 1.0 / 2.54 * 72 WHEN 2 THEN n * 72.0 WHEN 3 THEN n * 1.0 / 96 * 72 WHEN 4 THEN CAST(n AS DOUBLE) ELSE 0 END::DOUBLE, 6) AS pt FROM t")
def to_points(spark: SparkSession, sf: str) -> DataFrame:
    units = F.array(*map(F.lit, ("mm", "cm", "in", "PX", "pt", "x")))
    k = (F.col("p_partkey") % 6).cast("int")
    text = F.when(k == 5, "none").otherwise(F.concat(F.col("p_size").cast("string"), F.get(units, k)))
    return _t(spark, sf, "part").select("p_partkey", F.round(fn.to_points(text), 6).alias("pt"))


@query("SELECT c_custkey, c_acctbal AS n FROM customer")
def plain_number(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("EUR "), F.format_string("%,.2f", F.col("c_acctbal")), F.lit(" net"))
    return _t(spark, sf, "customer").select("c_custkey", fn.plain_number(text).alias("n"))


@query("SELECT o_custkey, sum(l_quantity) AS sum, round(avg(l_quantity), 6) AS avg, min(l_quantity) AS min, max(l_quantity) AS max, count(*) AS n, round(exp(sum(ln(1 + l_discount))), 6) AS product FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def form_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    j = _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    q = F.col("l_quantity")
    return j.groupBy("o_custkey").agg(F.sum(q).alias("sum"), F.round(F.avg(q), 6).alias("avg"), F.min(q).alias("min"), F.max(q).alias("max"), F.count("*").alias("n"), F.round(F.product(1 + F.col("l_discount")), 6).alias("product"))


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity * l_extendedprice * 100 + 0.5) / 100 AS amount, floor(floor(l_quantity * l_extendedprice * 100 + 0.5) * (1 - l_discount) + 0.5) / 100 AS net, CASE WHEN l_tax = 0 THEN 0 ELSE round(l_discount / l_tax, 4) END AS ratio FROM lineitem")
def recalc_order(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.half_up(F.col("l_quantity") * F.col("l_extendedprice") * 100).alias("cents"), "l_discount", "l_tax")
    return li.select("l_orderkey", "l_linenumber", (F.col("cents") / 100).alias("amount"), (fn.half_up(F.col("cents") * (1 - F.col("l_discount"))) / 100).alias("net"), F.when(F.col("l_tax") == 0, 0.0).otherwise(F.round(F.try_divide("l_discount", "l_tax"), 4)).alias("ratio"))


@query("SELECT source, sum(CASE WHEN quality = 1 THEN length(text) ELSE 0 END)::BIGINT AS tagged, sum(length(text))::BIGINT AS total, 2 * sum(CASE WHEN quality = 1 THEN length(text) ELSE 0 END) >= sum(length(text)) AS trusted FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def trust_gate(spark: SparkSession, sf: str) -> DataFrame:
    j = _t(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n")).join(_t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    tagged = F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0))
    return j.groupBy("source").agg(tagged.alias("tagged"), F.sum("n").alias("total"), (2 * tagged >= F.sum("n")).alias("trusted"))


_TAGS = "tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<([a-z0-9]+)', 1), 1) - 1 AS mcid FROM pages)"


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "pages").select("page_id", F.posexplode(F.expr("regexp_extract_all(html, '<([a-z0-9]+)', 1)")).alias("mcid", "tag"))
    return t.select("page_id", "tag", F.col("mcid").cast("long").alias("mcid"))


@query(f"WITH {_TAGS} SELECT page_id, tag, count(*) AS n, min(mcid) AS first, max(mcid) AS last, string_agg(CAST(mcid AS VARCHAR), ',' ORDER BY mcid) AS ids FROM tags GROUP BY 1, 2")
def fragments(spark: SparkSession, sf: str) -> DataFrame:
    t = _tags(spark, sf).withColumn("s", F.col("mcid").cast("string"))
    return t.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("mcid").alias("first"), F.max("mcid").alias("last"), win.joined_text("s", ["mcid"], ",").alias("ids"))


@query(f"WITH {_TAGS}, role AS (SELECT * FROM (VALUES ('h1', 'heading'), ('p', 'para'), ('li', 'item'), ('a', 'link'), ('nav', 'artifact'), ('footer', 'artifact')) v(tag, kind)) SELECT page_id, mcid, coalesce(kind, 'container') AS kind FROM tags LEFT JOIN role USING (tag)")
def role_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [("h1", "heading"), ("p", "para"), ("li", "item"), ("a", "link"), ("nav", "artifact"), ("footer", "artifact")]
    role = spark.createDataFrame(kinds, "tag string, kind string")
    return _tags(spark, sf).join(F.broadcast(role), "tag", "left").select("page_id", "mcid", F.coalesce("kind", F.lit("container")).alias("kind"))


@query("WITH d AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY 1, 2), b AS (SELECT ch, sum(n) AS m FROM (SELECT item_id, ch, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark) GROUP BY 1, 2) GROUP BY 1) SELECT doc_id, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS shared, round(CAST(sum(least(n, coalesce(m, 0))) AS DOUBLE) / sum(n), 6) AS precision FROM d LEFT JOIN b USING (ch) GROUP BY 1")
def multiset_pr(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.inline(fn.character_counts("text")))
    b = _t(spark, sf, "benchmark").select(F.inline(fn.character_counts("text"))).groupBy("ch").agg(F.sum("n").alias("m"))
    shared = F.sum(F.least("n", F.coalesce("m", F.lit(0))))
    # One row for each character that there is.
    return d.join(F.broadcast(b), "ch", "left").groupBy("doc_id").agg(shared.alias("shared"), F.round(shared.cast("double") / F.sum("n"), 6).alias("precision"))


@query("WITH i AS (SELECT user_id AS u, event_id AS a, event_id + CAST(floor(value) AS BIGINT) % 40 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY u ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i) SELECT u AS user_id, far AS start, a AS \"end\" FROM m WHERE a > far")
def interval_gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.floor("value") % 40).alias("b"))
    return win.gaps(e, ["user_id"], "a", "b", [])


@query("SELECT doc_id, md5(text) AS fingerprint, sha256(text) AS digest, sha256(concat(substring(text, 1, 10), substring(text, 21))) AS signed FROM documents")
def digests(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.concat(F.substring("text", 1, 10), F.expr("substring(text, 21)"))
    return _t(spark, sf, "documents").select("doc_id", F.md5("text").alias("fingerprint"), F.sha2("text", 256).alias("digest"), F.sha2(cut, 256).alias("signed"))


@query("SELECT num, gen, pos FROM (SELECT o_custkey AS num, CAST(o_orderkey % 3 AS BIGINT) AS gen, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_object(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("num"), (F.col("o_orderkey") % 3).alias("gen"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 4).alias("rank"))
    best = o.groupBy("num").agg(F.max_by(F.struct("gen", "pos"), F.struct("rank", "pos")).alias("b"))
    return best.select("num", "b.gen", "b.pos")


@query("SELECT o_orderkey AS num, concat(lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 10, '0'), ' 00000 n') AS entry, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders")
def xref_entries(spark: SparkSession, sf: str) -> DataFrame:
    from quire.operators.ordinals import with_ordinal

    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("num"), F.concat(F.lpad(F.floor("o_totalprice").cast("string"), 10, "0"), F.lit(" 00000 n")).alias("entry"))
    return with_ordinal(o, "num", "ord")


@query("SELECT c_custkey, k, kind FROM (SELECT c_custkey, n_nationkey AS k, CASE WHEN n_regionkey = c_nationkey % 5 THEN 'own' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN n_regionkey = c_nationkey % 5 THEN 0 ELSE 1 END, n_nationkey) AS r FROM customer JOIN nation ON substring(n_name, 1, 1) = chr(CAST(65 + c_custkey % 20 AS INTEGER))) WHERE r = 1")
def scoped_resource(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.char(65 + F.col("c_custkey") % 20).alias("letter"))
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey", F.substring("n_name", 1, 1).alias("letter"))
    j = c.join(n, "letter").withColumn("own", F.col("n_regionkey") == F.col("c_nationkey") % 5)
    return win.top_one(j, ["c_custkey"], F.desc("own"), F.col("k")).select("c_custkey", "k", F.when(F.col("own"), "own").otherwise("other").alias("kind"))


@query("SELECT o_orderkey, p.picked IS NOT NULL AND p.picked = o_orderkey AS is_on, p.picked IS NOT NULL AND p.picked <> o_orderkey AS is_cleared FROM orders LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS picked FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) p USING (o_custkey)")
def radio_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Buttons of a group after the last pick of each group: that one is on, its siblings are cleared."""
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return forms.picked(o, ["o_custkey"], "o_orderkey", F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "is_on", "is_cleared")


@query("SELECT p_partkey, round(coalesce(CASE WHEN p_size % 3 = 0 THEN p_retailprice END, CASE WHEN p_size % 3 = 1 THEN CAST(s.s_nationkey AS DOUBLE) END, 500.0), 4) AS w FROM part LEFT JOIN supplier s ON s.s_suppkey = p_partkey")
def glyph_widths(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_nationkey").cast("double").alias("std"))
    w = F.coalesce(F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")), F.when(F.col("p_size") % 3 == 1, F.col("std")), F.lit(500.0))
    return p.join(s, "p_partkey", "left").select("p_partkey", F.round(w, 4).alias("w"))


@query("WITH d AS (SELECT c_name AS name, c_custkey AS page FROM customer WHERE c_custkey % 2 = 0) SELECT o_orderkey, coalesce(d.page, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END) AS page FROM orders JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN d ON d.name = c.c_name WHERE coalesce(d.page, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END) IS NOT NULL")
def named_destinations(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", "c_name")
    d = c.where("c_custkey % 2 = 0").select("c_name", F.col("c_custkey").alias("_page"))
    o = _t(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).join(d, "c_name", "left")
    return o.select("o_orderkey", F.coalesce("_page", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey"))).alias("page")).where("page is not null")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat(CASE WHEN o_orderkey % 100 >= 50 THEN '19' ELSE '20' END, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), '-03-', lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0')) WHEN o_orderkey % 3 = 1 THEN concat('20', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), '-11-05') END AS day FROM orders")
def asn1_dates(spark: SparkSession, sf: str) -> DataFrame:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    k, y = F.col("o_orderkey") % 3, two(F.col("o_orderkey") % 100)
    text = F.when(k == 0, F.concat(y, F.lit("03"), two(F.col("o_orderkey") % 28 + 1), F.lit("120000Z"))).when(k == 1, F.concat(F.lit("20"), y, F.lit("1105120000Z"))).otherwise("unknown")
    return _t(spark, sf, "orders").select("o_orderkey", fn.asn1_date(text).alias("day"))


@query("SELECT p_partkey, CAST(t AS BIGINT) AS turn, CASE t WHEN 0 THEN x * 1.5 WHEN 90 THEN y * 1.5 WHEN 180 THEN (612 - x) * 1.5 ELSE (792 - y) * 1.5 END AS sx, CASE t WHEN 0 THEN (792 - y) * 1.5 WHEN 90 THEN x * 1.5 WHEN 180 THEN y * 1.5 ELSE (612 - x) * 1.5 END AS sy FROM (SELECT p_partkey, CAST(p_size * 10 AS DOUBLE) AS x, p_retailprice / 2 AS y, (p_partkey % 4) * 90 AS t FROM part)")
def viewport_points(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10).cast("double").alias("x"), (F.col("p_retailprice") / 2).alias("y"), fn.quarter_turns((F.col("p_partkey") % 4) * 90 + 20).cast("long").alias("turn"))
    at = fn.to_screen(F.col("x"), F.col("y"), F.lit(612.0), F.lit(792.0), F.lit(1.5), F.col("turn"))
    return p.select("p_partkey", "turn", at.x.alias("sx"), at.y.alias("sy"))


@query(f"WITH {LINE}, page AS (SELECT DISTINCT doc_id, line_no // 8 + 1 AS page_no FROM line), n AS (SELECT doc_id, max(page_no) AS n FROM page GROUP BY 1) SELECT doc_id, page_no FROM page JOIN n USING (doc_id) WHERE page_no <= 5 OR page_no IN (CAST(floor(6 + (n - 6) * 1 / 4.0) AS BIGINT), CAST(floor(6 + (n - 6) * 2 / 4.0) AS BIGINT), CAST(floor(6 + (n - 6) * 3 / 4.0) AS BIGINT))")
def stratified_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of eight lines: the first five and three of the rest."""
    pages = lines(spark, sf).select("doc_id", (F.floor(F.col("line_no") / 8) + 1).alias("page_no")).distinct()
    return evaluation.sampled_pages(pages).select("doc_id", "page_no")


_SQUEEZED = "trim(regexp_replace(lower({0}), '[ \t\n\v\f\r]+', ' ', 'g'))"
_SAID = f"n AS (SELECT count(*) AS items FROM benchmark), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, {_SQUEEZED.format('text')} AS fact, split_part({_SQUEEZED.format('text')}, ' ', 1) AS first, split_part({_SQUEEZED.format('text')}, ' ', 2) AS second FROM benchmark), d AS (SELECT doc_id, doc_id % items AS k, {_SQUEEZED.format('text')} AS said FROM documents, n)"


@query(f"WITH {_SAID} SELECT doc_id, item_id, contains(said, fact) AS has_text, strpos(said, first) > 0 AND strpos(said, first) < strpos(said, second) AS in_order FROM d JOIN b USING (k)")
def fact_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against one item of the benchmark, dealt out evenly over all items: whether its whole text stands there, and its first two words in order."""
    from quire.operators.ordinals import with_ordinal

    b = _t(spark, sf, "benchmark").select("item_id", fn.squeeze(F.col("text")).alias("fact"))
    b = with_ordinal(b, "item_id", "k")
    d = _t(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % b.count()).alias("k"))
    blocks = d.select("doc_id", F.lit(0).alias("block_id"), F.lit("para").alias("kind"), "text", F.array().cast("array<string>").alias("items"), F.array().cast("array<array<string>>").alias("rows"))
    two = F.array(F.split_part("fact", F.lit(" "), F.lit(1)), F.split_part("fact", F.lit(" "), F.lit(2)))
    facts = d.join(b, "k").select("doc_id", "item_id", F.explode(F.array(F.struct(F.lit("text").alias("kind"), F.array("fact").alias("expected")), F.struct(F.lit("order").alias("kind"), two.alias("expected")))).alias("f"))
    found = evaluation.facts_found(blocks, facts.select("doc_id", "item_id", F.lit(0).alias("fact_id"), "f.kind", "f.expected"))
    return found.groupBy("doc_id", "item_id").agg(F.bool_or((F.col("kind") == "text") & F.col("found")).alias("has_text"), F.bool_or((F.col("kind") == "order") & F.col("found")).alias("in_order"))


_NEAR = "a AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag AS ch, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y FROM lineitem), b AS (SELECT l_orderkey, ch, x + 3 * (n % 4) AS x, y + n % 3 * 2 AS y FROM a)"


@query(f"WITH {_NEAR} SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = a.l_orderkey AND b.ch = a.ch AND abs(b.x - a.x) <= 6 AND abs(b.y - a.y) <= 3)) AS agreed FROM a GROUP BY 1")
def position_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each order against the same ones moved: how many have one near."""
    n = F.col("l_linenumber")
    a = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("ch"), F.col("l_quantity").cast("double").alias("x"), n.cast("double").alias("y"), n.alias("n"))
    b = a.select("l_orderkey", "ch", (F.col("x") + 3 * (F.col("n") % 4)).alias("x"), (F.col("y") + F.col("n") % 3 * 2).alias("y"))
    return evaluation.position_agreement(a.drop("n"), b, ["l_orderkey"])


@query("WITH d AS (SELECT doc_id, ch, count(*) AS a FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[ \t\n\r]+', '', 'g'), '')) AS ch FROM documents) GROUP BY 1, 2), e AS (SELECT doc_id, ch, a AS b FROM d WHERE ch NOT IN ('a', 'e') UNION ALL SELECT doc_id, '*', sum(a) FROM d WHERE ch IN ('a', 'e') GROUP BY 1), s AS (SELECT doc_id, ch, sum(b) AS b FROM e GROUP BY 1, 2) SELECT doc_id, round(sum(least(coalesce(a, 0), coalesce(b, 0)))::DOUBLE / sum(a), 6) AS precision, round(sum(least(coalesce(a, 0), coalesce(b, 0)))::DOUBLE / sum(b), 6) AS recall FROM d FULL JOIN s USING (doc_id, ch) GROUP BY 1")
def bag_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Every text against itself with two letters starred out."""
    d = _t(spark, sf, "documents").select("doc_id", "text")
    found = evaluation.bag_agreement(d, d.select("doc_id", F.translate("text", "ae", "**").alias("text")), "doc_id")
    return found.select("doc_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rtl' ELSE 'ltr' END AS dir, md5(text) AS plain, md5(text) AS unescaped, md5(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))) AS squeezed FROM documents WHERE text IS NOT NULL")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with ligatures set, escaped, and a third of them behind more letters that run from the right; each undone."""
    d = _t(spark, sf, "documents").select("doc_id", "text").where("text is not null")
    shin = F.repeat(F.lit("ש"), F.length("text") + 1)
    bound = F.replace(F.replace(F.replace("text", F.lit("ffi"), F.lit("ﬃ")), F.lit("ff"), F.lit("ﬀ")), F.lit("fl"), F.lit("ﬂ"))
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return d.select("doc_id", fn.direction(F.when(F.col("doc_id") % 3 == 0, F.concat(shin, "text")).otherwise(F.col("text"))).alias("dir"), F.md5(fn.unligature(bound)).alias("plain"), F.md5(fn.xml_unescape(escaped)).alias("unescaped"), F.md5(fn.squeeze(F.col("text"))).alias("squeezed"))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, min(turn) AS first_turn FROM conversations GROUP BY 1")
def distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.min("turn").alias("first_turn"))


@query("SELECT p_brand, CAST(sum(least(a, b)) AS BIGINT) AS shared FROM (SELECT p_brand, p_type, sum(CASE WHEN p_size <= 25 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS b FROM part GROUP BY 1, 2) GROUP BY 1")
def multiset_intersect(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    both = p.where("p_size <= 25").select("p_brand", "p_type").intersectAll(p.where("p_size > 25").select("p_brand", "p_type"))
    counted = both.groupBy("p_brand").agg(F.count("*").alias("shared"))
    return p.select("p_brand").distinct().join(counted, "p_brand", "left").select("p_brand", F.coalesce("shared", F.lit(0)).alias("shared"))


@query("SELECT n_name AS layer, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey NOT IN (1, 3)")
def visible_layers(spark: SparkSession, sf: str) -> DataFrame:
    off = _t(spark, sf, "nation").where("n_regionkey in (1, 3)").select("n_nationkey")
    c = _t(spark, sf, "customer").join(off, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")
    return c.join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("layer"), "c_custkey")

