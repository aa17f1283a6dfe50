import re
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline as cp
from quire.llm import quality, secrets, simhash
from tests.llm.test_decontaminate import brute as contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in cp.STAGES:
        rows = (df := f(spark, docs, SF)).collect()
        docs = spark.createDataFrame(rows, df.schema)
        out.append((df.columns, {r[0]: r for r in rows} if len(out) < 4 else rows))
    return out


def test_columns_and_order(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(c == columns for c, _ in stages[:4])
    assert [n for n, _ in cp.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]


def test_each_stage_against_a_plain_one(spark, stages):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, second, third, fourth = (rows for _, rows in stages[:4])
    kept = {r.doc_id for r in quality.op2(spark.createDataFrame(list(docs.values()))).where("kept").collect()}
    assert set(first) == kept and all(first[i].text == docs[i].text for i in first)
    fps = {i: simhash.fingerprint(r.text) for i, r in first.items()}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert set(second) == {i for i in fps if find(i) == i} and len(second) < len(first)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contamination([(i, r.text) for i, r in second.items()], items) if r[-1]}
    assert set(third) == set(second) - bad
    assert set(fourth) == set(third)
    for i, r in fourth.items():
        assert r.text == secrets.redact(third[i].text, secrets.find(third[i].text)) and r.n_chars == len(r.text)
        assert not re.search("AKIA[A-Z0-9]{14}", r.text)


def test_packing_holds_every_document(stages):
    fourth, packed = stages[3][1], stages[4][1]
    assert {r.doc_id for r in packed} == set(fourth)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_run(spark, stages):
    got = cp.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[4][1])


def test_odd_rows_pass(spark, tmp_path):
    rows = [(None, "text without an id but words enough to pass the rules and be kept by them, so it goes on to the end.", None, None, None), (1, None, None, None, None), (1, "", "en", "s", 0), (2, "x", "en", "s", 1)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for _, f in cp.STAGES:
        assert f(spark, df, SF).count() >= 1
        assert f(spark, df.limit(0), SF).count() == 0


def test_rows_that_share_a_doc_id(spark):
    text = lambda k: " ".join(f"{k}w{i * i % 97}" for i in range(40))
    # Two unlinked texts of one id; an id whose rows are a copy of a smaller one and the head of a group; copies without an id.
    rows = [(5, text("a"), 1), (5, text("b"), 2), (1, text("c"), 3), (7, text("c"), 4), (7, text("d"), 5), (9, text("d"), 6), (None, text("e"), 7), (None, text("e"), 8), (None, text("a"), 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = cp.simhash_dedup(spark, df, SF)
    assert got.columns == df.columns
    kept = {r._row for r in got.collect()}
    assert kept in ({1, 2, 3, 5, 7}, {1, 2, 3, 5, 8})


def test_blocks_of_the_benchmark(spark):
    from quire.llm import decontaminate as dc

    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = ({r.doc_id for r in dc.clean(docs, items, block_chars=n).collect()} for n in (1 << 22, 2000))
    assert one == many
