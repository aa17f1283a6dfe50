"""Layout and block queries over documents laid out by rule, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import scalars as fn
from quire.operators import blocks as bl
from quire.operators import joins, reading, trees
from quire.operators import windows as win
from quire.operators.blocks import LIMITS
from quire.sources.synthetic import LINE, WORD, lines, words

HEIGHT = 700.0
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


BODY = "body AS (SELECT doc_id, key AS body, weight FROM (SELECT doc_id, key, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, o) AS k FROM (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS key, CAST(sum(length(text)) AS BIGINT) AS weight, min(line_no) AS o FROM line GROUP BY 1, 2)) WHERE k = 1)"


@query(f"WITH {LINE}, {BODY} SELECT doc_id, body AS key, weight FROM body")
def body_size(spark: SparkSession, sf: str) -> DataFrame:
    return bl.body_size(lines(spark, sf))


@query(f"WITH {LINE}, {BODY} SELECT * FROM (SELECT doc_id, key, dense_rank() OVER (PARTITION BY doc_id ORDER BY key DESC) AS rnk FROM (SELECT DISTINCT doc_id, floor(size * 2 + 0.5) / 2 AS key FROM line JOIN body USING (doc_id) WHERE floor(size * 2 + 0.5) / 2 > 1.15 * body AND length(text) <= 120)) WHERE rnk <= 3")
def heading_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return bl.size_ranks(lines(spark, sf))


#: Pages of eight lines, the first of which names the page's chapter.
_CHAPTERS = "line AS (SELECT * REPLACE (line_no // 8 + 1 AS page_no, CAST(60 + 80 * (line_no % 8) AS DOUBLE) AS y, CASE WHEN line_no % 8 = 0 THEN concat('Chapter ', CAST(line_no // 8 + 1 AS VARCHAR)) ELSE text END AS text) FROM laid)"


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    page, k = (F.floor(F.col("line_no") / 8) + 1).alias("page_no"), F.col("line_no") % 8
    head = F.concat(F.lit("Chapter "), (F.floor(F.col("line_no") / 8) + 1).cast("string"))
    return lines(spark, sf).select("doc_id", "line_no", page, F.when(k == 0, head).otherwise(F.col("text")).alias("text"), (60 + 80 * k).cast("double").alias("y"))


_KEY = "concat(CAST(CAST(floor(y / 700 * 40 + 0.5) AS BIGINT) AS VARCHAR), '|', substring(regexp_replace(text, '[0-9]+', '#', 'g'), 1, 40))"
_RUNNING = f"pages AS (SELECT doc_id, max(page_no) AS pages FROM line GROUP BY 1 HAVING max(page_no) >= 3), keyed AS (SELECT *, CASE WHEN y < 84 OR y > 616 THEN {_KEY} END AS key FROM line), running AS (SELECT doc_id, key, count(*) AS n FROM keyed JOIN pages USING (doc_id) WHERE key IS NOT NULL GROUP BY doc_id, key, pages HAVING count(*) >= greatest(2, floor(0.4 * pages)))"


@query(f"WITH {LINE.replace('line AS', 'laid AS', 1)}, {_CHAPTERS}, {_RUNNING} SELECT doc_id, key, n FROM running")
def running_lines(spark: SparkSession, sf: str) -> DataFrame:
    return bl.running_lines(_chapters(spark, sf), HEIGHT)


@query(f"WITH {LINE.replace('line AS', 'laid AS', 1)}, {_CHAPTERS}, {_RUNNING} SELECT doc_id, line_no FROM keyed WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.doc_id = keyed.doc_id AND r.key = keyed.key)")
def drop_running(spark: SparkSession, sf: str) -> DataFrame:
    return bl.without_running(_chapters(spark, sf), HEIGHT).select("doc_id", "line_no")


_NUM = "concat(CAST(doc_id % 9 + 1 AS VARCHAR), '.', CAST(line_no % 4 AS VARCHAR), CASE WHEN line_no % 3 = 0 THEN '.7.8.9 ' ELSE ' ' END, text)"


@query(f"WITH {LINE}, t AS (SELECT doc_id, line_no, {_NUM} AS text FROM line) SELECT doc_id, line_no, CAST(least(4, len(string_split(regexp_extract(text, '^([0-9]+(?:[.][0-9]+)*)[.)]? ', 1), '.'))) AS BIGINT) AS level FROM t")
def heading_level(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    tail = F.when(F.col("line_no") % 3 == 0, ".7.8.9 ").otherwise(" ")
    text = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), (F.col("line_no") % 4).cast("string"), tail, "text")
    return ln.select("doc_id", "line_no", bl.number_depth(text).alias("level"))


@query(f"WITH {LINE}, {BODY} SELECT doc_id, line_no FROM line JOIN body USING (doc_id) WHERE length(text) BETWEEN 1 AND 120 AND NOT regexp_matches(text, '{bl.CAPTION}') AND (size > 1.15 * body OR (length(text) <= 60 AND regexp_matches(text, '{bl.CAPITALS}') AND NOT regexp_matches(text, '{bl.SMALL}') AND regexp_matches(text, '{bl.BEGINS}')) OR (size >= 0.85 * body AND bold AND length(text) < 80 AND NOT regexp_matches(text, '[.,;:]$')))")
def is_heading(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    body = bl.body_size(ln).select("doc_id", F.col("key").alias("body"))
    return ln.join(body, "doc_id").where(bl.is_heading(F.col("size"), F.col("body"), F.col("bold"), F.col("text"))).select("doc_id", "line_no")


@query(f"WITH {LINE}, t AS (SELECT doc_id, line_no, concat(CASE line_no % 4 WHEN 0 THEN '• ' WHEN 1 THEN '  - ' WHEN 2 THEN concat(CAST(line_no AS VARCHAR), '. ') ELSE '' END, text) AS text FROM line) SELECT doc_id, line_no, regexp_replace(text, '{bl.BULLET}', '') AS item FROM t WHERE regexp_matches(text, '{bl.BULLET}') AND regexp_replace(text, '{bl.BULLET}', '') <> ''")
def bullets_strip(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("line_no") % 4 == 0, "• ").when(F.col("line_no") % 4 == 1, "  - ").when(F.col("line_no") % 4 == 2, F.concat(F.col("line_no").cast("string"), F.lit(". "))).otherwise("")
    return lines(spark, sf).select("doc_id", "line_no", bl.list_item(F.concat(mark, "text")).alias("item")).where("item is not null")


_HYPH = "regexp_replace(text, '([a-z][a-z][a-z]) ([a-z][a-z][a-z])', '\\1-\\2', 'g')"
_DICT = f"t AS (SELECT doc_id, line_no, {_HYPH} AS text FROM line), dict AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+-[a-z]+')) AS word FROM t)"


def _hyphened(ln: DataFrame) -> DataFrame:
    return ln.withColumn("text", F.regexp_replace("text", "([a-z][a-z][a-z]) ([a-z][a-z][a-z])", "$1-$2"))


@query(f"WITH {LINE}, {_DICT} SELECT doc_id, word FROM dict")
def hyphen_dict(spark: SparkSession, sf: str) -> DataFrame:
    return bl.hyphen_words(_hyphened(lines(spark, sf)))


@query(f"WITH {LINE}, {_DICT}, p AS (SELECT doc_id, line_no, regexp_extract(lower(text), '([a-z]+) ', 1) AS a, regexp_extract(lower(text), ' ([a-z]+)', 1) AS b FROM line) SELECT p.doc_id, line_no, CASE WHEN d.word IS NULL THEN concat(a, b) ELSE concat(a, '-', b) END AS joined FROM p LEFT JOIN dict d ON d.doc_id = p.doc_id AND d.word = concat(a, '-', b) WHERE a <> '' AND b <> ''")
def dehyphenate(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    pairs = ln.select("doc_id", "line_no", F.regexp_extract(F.lower("text"), "([a-z]+) ", 1).alias("a"), F.regexp_extract(F.lower("text"), " ([a-z]+)", 1).alias("b")).where("a <> '' and b <> ''")
    return bl.dehyphenated(pairs, bl.hyphen_words(_hyphened(ln))).select("doc_id", "line_no", "joined")


@query(f"WITH {LINE}, {WORD} SELECT doc_id, line_no, round(CAST(sum(CASE WHEN (doc_id + word_no) % 3 = 0 THEN length(text) ELSE 0 END) AS DOUBLE) / sum(length(text)), 6) AS bold_share FROM word GROUP BY 1, 2")
def bold_ratio(spark: SparkSession, sf: str) -> DataFrame:
    bold = F.when((F.col("doc_id") + F.col("word_no")) % 3 == 0, F.length("text")).otherwise(0)
    return words(lines(spark, sf)).groupBy("doc_id", "line_no").agg(F.round(F.sum(bold).cast("double") / F.sum(F.length("text")), 6).alias("bold_share"))


@query(f"WITH {LINE}, {WORD}, g AS (SELECT doc_id, line_no, word_no, size, x - lag(x + w) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS gap FROM word) SELECT doc_id, line_no, word_no, round(gap, 4) AS gap, gap > 0.12 * size OR gap < -0.5 * size AS spaced FROM g WHERE gap IS NOT NULL")
def space_gaps(spark: SparkSession, sf: str) -> DataFrame:
    w = words(lines(spark, sf)).withColumn("_end", F.col("x") + F.col("w"))
    w = w.withColumn("gap", F.col("x") - win.previous("_end", ["doc_id", "line_no"], ["word_no"])).where("gap is not null")
    return w.select("doc_id", "line_no", "word_no", F.round("gap", 4).alias("gap"), bl.needs_space(F.col("gap"), F.col("size")).alias("spaced"))


@query(f"WITH {LINE}, t AS (SELECT doc_id, page_no, line_no, y + 16 * (line_no % 40 // 5) AS y, size FROM line), g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY y, line_no) AS gap FROM t), m AS (SELECT doc_id, page_no, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS gap_mid, list_sort(list(size))[len(list(size)) // 2 + 1] AS size_mid FROM g WHERE gap IS NOT NULL GROUP BY 1, 2), f AS (SELECT g.doc_id, g.page_no, g.line_no, g.y, CASE WHEN gap > greatest(1.8 * gap_mid, 1.5 * size_mid) THEN 1 ELSE 0 END AS cut FROM g LEFT JOIN m USING (doc_id, page_no)) SELECT doc_id, page_no, line_no, CAST(sum(cut) OVER (PARTITION BY doc_id, page_no ORDER BY y, line_no) AS BIGINT) AS band FROM f")
def bands(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf).withColumn("y", F.col("y") + 16 * F.floor(F.col("line_no") % 40 / 5))
    page, order = ["doc_id", "page_no"], ["y", "line_no"]
    g = ln.withColumn("gap", F.col("y") - win.previous("y", page, order))
    mid = g.where("gap is not null").groupBy(*page).agg(win.upper_median("gap").alias("gap_mid"), win.upper_median("size").alias("size_mid"))
    g = g.join(mid, page, "left")
    cut = F.col("gap") > F.greatest(LIMITS.band * F.col("gap_mid"), LIMITS.band_lines * F.col("size_mid"))
    return win.islands(g, page, order, cut, "band").select(*page, "line_no", "band")


@query(f"WITH {LINE}, {WORD} SELECT doc_id, line_no, min(x) AS x0, max(x + w) AS x1, min(y) AS y0, max(y + size) AS y1, count(*) AS n FROM word GROUP BY 1, 2")
def line_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return words(lines(spark, sf)).groupBy("doc_id", "line_no").agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y0"), F.max(F.col("y") + F.col("size")).alias("y1"), F.count("*").alias("n"))


@query(f"WITH {LINE} SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM line GROUP BY 1, 2")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("doc_id", "page_no").agg(win.joined_text("text", ["line_no"], "\n").alias("text"))


@query(f"WITH {LINE}, {WORD} SELECT doc_id, page_no, row_key, line_no, word_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, row_key ORDER BY x DESC, line_no, word_no) AS k FROM (SELECT *, CAST(floor(y / greatest(1, 0.6 * size) + 0.5) AS BIGINT) AS row_key FROM word)) WHERE k = 1")
def line_eol(spark: SparkSession, sf: str) -> DataFrame:
    w = words(lines(spark, sf)).withColumn("row_key", fn.half_up(F.col("y") / F.greatest(F.lit(1.0), 0.6 * F.col("size"))))
    return win.top_one(w, ["doc_id", "page_no", "row_key"], F.desc("x"), F.col("line_no"), F.col("word_no")).select("doc_id", "page_no", "row_key", "line_no", "word_no")


_COVER = "cover AS (SELECT doc_id, page_no, bin, count(*) AS n FROM (SELECT doc_id, page_no, unnest(generate_series(CAST(floor(x / 2) AS BIGINT), CAST(floor((x + w) / 2) AS BIGINT))) AS bin FROM line WHERE w > 0) GROUP BY 1, 2, 3)"


def _cover(ln: DataFrame) -> DataFrame:
    bins = F.explode(F.sequence(F.floor(F.col("x") / 2), F.floor((F.col("x") + F.col("w")) / 2)))
    return ln.where("w > 0").select("doc_id", "page_no", bins.alias("bin")).groupBy("doc_id", "page_no", "bin").agg(F.count("*").alias("n"))


@query(f"WITH {LINE}, {_COVER} SELECT * FROM cover")
def coverage_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _cover(lines(spark, sf))


@query(f"WITH {LINE}, {_COVER}, e AS (SELECT doc_id, page_no, bin + 1 AS from_bin, lead(bin) OVER (PARTITION BY doc_id, page_no ORDER BY bin) - 1 AS to_bin FROM cover) SELECT doc_id, page_no, from_bin, to_bin FROM e WHERE to_bin >= from_bin")
def gutters(spark: SparkSession, sf: str) -> DataFrame:
    c = _cover(lines(spark, sf))
    nxt = F.lead("bin").over(Window.partitionBy("doc_id", "page_no").orderBy("bin"))
    return c.select("doc_id", "page_no", (F.col("bin") + 1).alias("from_bin"), (nxt - 1).alias("to_bin")).where("to_bin >= from_bin")


@query(f"WITH {LINE}, t AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS p, lag(page_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS pp FROM (SELECT doc_id, line_no, page_no, regexp_replace(text, '[.]$', CASE WHEN line_no % 40 = 39 THEN '' ELSE '.' END) AS text FROM line)), i AS (SELECT doc_id, line_no, text, sum(CASE WHEN p IS NULL OR NOT (pp <> page_no AND NOT regexp_matches(p, '{bl.ENDED}') AND regexp_matches(lower(text), '^[a-z]')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM t) SELECT doc_id, CAST(island - 1 AS BIGINT) AS para, count(*) AS n, string_agg(text, ' ' ORDER BY line_no) AS text FROM i GROUP BY 1, 2")
def para_join_cross_page(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    text = F.when(F.col("line_no") % 40 == 39, F.regexp_replace("text", "[.]\\z", "")).otherwise(F.col("text"))
    ln = ln.withColumn("text", text)
    p, pp = (win.previous(c, ["doc_id"], ["line_no"]) for c in ("text", "page_no"))
    ln = ln.withColumn("_goes_on", (pp != F.col("page_no")) & ~p.rlike(bl.ENDED) & F.lower("text").rlike("^[a-z]"))
    i = win.islands(ln, ["doc_id"], ["line_no"], ~F.col("_goes_on"), "para")
    return i.groupBy("doc_id", "para").agg(F.count("*").alias("n"), win.joined_text("text", ["line_no"], " ").alias("text"))


@query(f"WITH {LINE}, t AS (SELECT doc_id, line_no, concat(text, CASE WHEN (line_no // 6) % 2 = 0 THEN concat(' ', CAST(line_no AS VARCHAR)) ELSE '' END) AS text FROM line), f AS (SELECT *, CASE WHEN regexp_matches(text, '[ ][0-9]+$') AND NOT regexp_matches(text, '[ ][0-9][0-9][0-9][0-9][0-9]+$') THEN 1 ELSE 0 END AS hit FROM t), g AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, hit ORDER BY line_no) AS grp FROM f) SELECT doc_id, min(line_no) AS first_line, count(*) AS n FROM g WHERE hit = 1 GROUP BY doc_id, grp HAVING count(*) >= 4")
def page_number_runs(spark: SparkSession, sf: str) -> DataFrame:
    number = F.when(F.floor(F.col("line_no") / 6) % 2 == 0, F.concat(F.lit(" "), F.col("line_no").cast("string"))).otherwise("")
    ln = lines(spark, sf).withColumn("text", F.concat("text", number))
    ln = ln.withColumn("hit", F.col("text").rlike("[ ][0-9]+\\z") & ~F.col("text").rlike("[ ][0-9][0-9][0-9][0-9][0-9]+\\z"))
    i = win.islands(ln, ["doc_id"], ["line_no"], F.col("hit") != win.previous("hit", ["doc_id"], ["line_no"]))
    return i.where("hit").groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n")).where("n >= 4").drop("island")


@query(f"WITH {LINE}, box AS (SELECT DISTINCT doc_id, page_no, CAST(60 + (doc_id % 5) * 80 AS DOUBLE) AS y0, CAST(60 + (doc_id % 5) * 80 + 70 AS DOUBLE) AS y1, 60.0::DOUBLE AS x0, 200.0::DOUBLE AS x1 FROM line) SELECT l.doc_id, line_no, count(*) AS boxes FROM line l JOIN box b ON b.doc_id = l.doc_id AND b.page_no = l.page_no AND l.x - 2 < b.x1 AND b.x0 < l.x + l.w + 2 AND l.y - 2 < b.y1 AND b.y0 < l.y + l.size + 2 WHERE length(text) <= 40 GROUP BY 1, 2")
def figure_overlap(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    y0 = (60 + (F.col("doc_id") % 5) * 80).cast("double")
    box = ln.select("doc_id", "page_no").distinct().select("doc_id", "page_no", y0.alias("by0"), (y0 + 70).alias("by1"), F.lit(60.0).alias("bx0"), F.lit(200.0).alias("bx1"))
    short = ln.where(F.length("text") <= 40).select("doc_id", "page_no", "line_no", "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("size")).alias("y1"))
    met = joins.overlap_join(short, box, ["doc_id", "page_no"], ("x", "y", "x1", "y1"), ("bx0", "by0", "bx1", "by1"), 2.0, 64.0)
    return met.groupBy("doc_id", "line_no").agg(F.count("*").alias("boxes"))


@query(f"WITH {LINE}, {WORD}, p AS (SELECT doc_id, line_no, word_no * 2 AS ord, text, x, y, size FROM word UNION ALL SELECT doc_id, line_no, word_no * 2 + 1, text, x + 0.4, y + 0.3, size FROM word WHERE (doc_id + word_no) % 4 = 0) SELECT doc_id, line_no, ord, text FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.line_no = p.line_no AND q.text = p.text AND q.ord < p.ord AND abs(q.size - p.size) < 0.1 AND abs(q.x - p.x) < greatest(0.5, 0.15 * p.size) AND abs(q.y - p.y) < greatest(0.5, 0.15 * p.size))")
def dedupe_pieces(spark: SparkSession, sf: str) -> DataFrame:
    w = words(lines(spark, sf))
    p = w.select("doc_id", "line_no", (F.col("word_no") * 2).alias("ord"), "text", "x", "y", "size")
    p = p.unionByName(w.where((F.col("doc_id") + F.col("word_no")) % 4 == 0).select("doc_id", "line_no", (F.col("word_no") * 2 + 1).alias("ord"), "text", (F.col("x") + 0.4).alias("x"), (F.col("y") + 0.3).alias("y"), "size"))
    return reading.pieces_without_doubles(p, ["doc_id", "line_no"], "ord").select("doc_id", "line_no", "ord", "text")


@query(f"WITH {LINE}, {BODY}, h AS (SELECT doc_id, line_no, text, CASE WHEN size > 1.15 * body AND length(text) BETWEEN 1 AND 120 THEN 'heading' WHEN line_no % 7 = 3 THEN 'item' ELSE 'para' END AS kind FROM line JOIN body USING (doc_id) WHERE text <> '') SELECT doc_id, count(*) AS n_blocks, string_agg(CASE kind WHEN 'heading' THEN concat('# ', text) WHEN 'item' THEN concat('- ', text) ELSE regexp_replace(text, '^([#>])', '\\\\\\1') END, chr(10) || chr(10) ORDER BY line_no) AS markdown FROM h GROUP BY 1")
def block_markdown(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    body = bl.body_size(ln).select("doc_id", F.col("key").alias("body"))
    head = (F.col("size") > 1.15 * F.col("body")) & F.length("text").between(1, 120)
    kind = F.when(head, "heading").when(F.col("line_no") % 7 == 3, "item").otherwise("para")
    md = ln.join(body, "doc_id").where("text <> ''").select("doc_id", F.col("line_no").alias("ord"), bl.block_markdown(kind, F.lit(1), F.col("text")).alias("md"))
    return bl.documents_markdown(md)


@query(f"WITH {LINE}, d AS (SELECT doc_id, line_no, line_no % 3 AS depth FROM line) SELECT doc_id, line_no, depth, CASE WHEN depth > 0 THEN (SELECT max(p.line_no) FROM d p WHERE p.doc_id = d.doc_id AND p.line_no < d.line_no AND p.depth = d.depth - 1) END AS parent FROM d")
def struct_parent(spark: SparkSession, sf: str) -> DataFrame:
    d = lines(spark, sf).select("doc_id", "line_no", (F.col("line_no") % 3).alias("depth"))
    return trees.parents_by_depth(d, "doc_id", "line_no", "depth")


@query(f"WITH {LINE} SELECT doc_id, line_no, CASE WHEN length(text) > 0 THEN sum(length(text) * 0.5 * size + CASE WHEN line_no % 2 = 0 THEN 1.5 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) END AS advance FROM line")
def text_advance(spark: SparkSession, sf: str) -> DataFrame:
    step = F.length("text") * 0.5 * F.col("size") + F.when(F.col("line_no") % 2 == 0, 1.5).otherwise(0.0)
    w = Window.partitionBy("doc_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines(spark, sf).select("doc_id", "line_no", F.when(F.length("text") > 0, F.sum(step).over(w)).alias("advance"))


@query(f"WITH {LINE}, s AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 IN (0, 1) THEN 1 WHEN line_no % 5 IN (3, 4) THEN -1 ELSE 0 END AS step FROM line) SELECT doc_id, line_no, CAST(sum(step) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS depth FROM s")
def stack_depth(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("line_no") % 5
    step = F.when(r.isin(0, 1), 1).when(r.isin(3, 4), -1).otherwise(0)
    return lines(spark, sf).select("doc_id", "line_no", win.depth(step, ["doc_id"], ["line_no"]).alias("depth"))


@query(f"WITH {LINE}, h AS (SELECT doc_id, line_no, CASE WHEN line_no % 6 = 0 THEN page_no END AS hint FROM line) SELECT doc_id, line_no, last_value(hint IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page_hint FROM h")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    h = lines(spark, sf).select("doc_id", "line_no", F.when(F.col("line_no") % 6 == 0, F.col("page_no")).alias("hint"))
    return h.select("doc_id", "line_no", win.carried("hint", ["doc_id"], ["line_no"]).alias("page_hint"))


@query(f"WITH {LINE}, s AS (SELECT doc_id, min(line_no) AS first_section FROM line WHERE line_no > 0 AND line_no % 9 = 4 GROUP BY 1) SELECT doc_id, line_no, CASE WHEN line_no > 0 AND line_no < first_section AND length(text) <= 60 THEN 'para' WHEN line_no = 0 OR bold THEN 'heading' ELSE 'para' END AS kind FROM line LEFT JOIN s USING (doc_id)")
def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    first = F.min(F.when((F.col("line_no") > 0) & (F.col("line_no") % 9 == 4), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    ln = ln.withColumn("first_section", first)
    demoted = (F.col("line_no") > 0) & (F.col("line_no") < F.col("first_section")) & (F.length("text") <= 60)
    return ln.select("doc_id", "line_no", F.when(demoted, "para").when((F.col("line_no") == 0) | F.col("bold"), "heading").otherwise("para").alias("kind"))


@query(f"WITH {LINE}, c AS (SELECT doc_id, line_no, repeat(' ', CAST(greatest(0, floor((x - 72) / (0.6 * size) + 0.5)) AS BIGINT)) || text AS code, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM line WHERE line_no % 6 < 4) SELECT doc_id, min(line_no) AS first_line, string_agg(code, chr(10) ORDER BY line_no) AS code FROM c GROUP BY doc_id, grp")
def code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf).where("line_no % 6 < 4")
    pad = F.greatest(F.lit(0), fn.half_up((F.col("x") - 72) / (0.6 * F.col("size")))).cast("int")
    ln = ln.withColumn("code", F.concat(F.repeat(F.lit(" "), pad), "text"))
    i = win.islands(ln, ["doc_id"], ["line_no"], F.col("line_no") != win.previous("line_no", ["doc_id"], ["line_no"]) + 1)
    return i.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), win.joined_text("code", ["line_no"], "\n").alias("code")).drop("island")


@query(f"WITH {LINE}, {WORD}, r AS (SELECT doc_id, page_no, line_no, word_no, x - max(x + w) OVER (PARTITION BY doc_id, page_no, y ORDER BY x, line_no, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM word) SELECT doc_id, page_no, line_no, word_no, round(gap, 4) AS gap FROM r WHERE gap > 1")
def running_reach(spark: SparkSession, sf: str) -> DataFrame:
    w = words(lines(spark, sf)).withColumn("_end", F.col("x") + F.col("w"))
    gap = F.col("x") - win.reach("_end", ["doc_id", "page_no", "y"], ["x", "line_no", "word_no"])
    return w.withColumn("gap", gap).where("gap > 1").select("doc_id", "page_no", "line_no", "word_no", F.round("gap", 4).alias("gap"))
