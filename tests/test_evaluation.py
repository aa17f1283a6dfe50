from pyspark.sql import functions as F

from quire.operators import evaluation as ev


def test_facts(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", "The  Title here", [], []), (1, 1, "para", "Alpha before beta", [], []), (1, 2, "table", "", [], [["Pen", "3 pcs"], ["Ink", "x"]]), (1, 3, "code", "x = 1", [], [])], "doc_id long, block_id int, kind string, text string, items array<string>, rows array<array<string>>")
    facts = [(1, "heading", ["the title"], True), (2, "notheading", ["alpha"], True), (3, "text", ["alpha before"], True), (4, "notext", ["gamma"], True), (5, "table", ["Pen", "3"], True), (6, "table", ["Pen", "x"], False), (7, "code", ["= 1"], True), (8, "order", ["alpha", "beta"], True), (9, "order", ["beta", "alpha"], False)]
    df = spark.createDataFrame([(d, i, k, e) for d in (1, 2) for i, k, e, _ in facts], "doc_id long, fact_id int, kind string, expected array<string>")
    got = {(r.doc_id, r.fact_id): r.found for r in ev.facts_found(blocks, df).collect()}
    assert [got[1, i] for i, *_ in facts] == [w for *_, w in facts]
    assert [got[2, i] for i in (1, 2, 3, 4, 5, 7, 8)] == [False, True, False, True, False, False, False]


def test_agreement(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "k long, text string")
    r = ev.bag_agreement(t((1, "aab c")), t((1, "abbd")), "k").first()
    assert (r.precision, r.recall) == (0.5, 0.5)
    a = spark.createDataFrame([("abcd", "abcd"), ("abcd", "dcba"), (None, "x")], "a string, b string")
    s = [r.s for r in a.select(ev.order_similarity("a", "b").alias("s")).collect()]
    assert s[0] == 1 and s[1] < 0.5 and s[2] == 0
    chars = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "p long, ch string, x double, y double")
    r = ev.position_agreement(chars(("a", 0.0, 0.0), ("b", 10.0, 10.0), ("c", 5.0, 5.0)), chars(("a", 5.9, 2.9), ("b", 17.0, 10.0), ("d", 5.0, 5.0)), ["p"]).first()
    assert (r.n, r.agreed) == (3, 1)


def test_sampled_pages(spark):
    pages = spark.range(1, 31).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_no"))
    assert sorted(r.page_no for r in ev.sampled_pages(pages).collect()) == [1, 2, 3, 4, 5, 12, 18, 24]
