import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import decontaminate as dc
from quire.llm.fmindex import FMIndex, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_fm_index_counts_and_locates(seq, n, sample):
    index = FMIndex(np.asarray(seq, np.int64), 6, sample)
    full = [*seq, 0]
    assert suffix_array(np.asarray(full)).tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    patterns = sorted({tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)} | {(1,) * n, (5,) * n})
    lo, hi = index.count(np.asarray(patterns, np.int64))
    for p, a, b in zip(patterns, lo, hi):
        where = [i for i in range(len(seq) - n + 1) if tuple(seq[i : i + n]) == p]
        assert b - a == len(where)
        assert sorted(index.locate(np.arange(a, b)).tolist()) == where


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=13):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths, out = {len(w) for w in windows}, []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= {*range(k, k + n)}
                    found |= x
        out.append((d, len(w), len(hit), len(found), dc.digest(list(map(str, found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abC 1-é", max_size=60), max_size=6), st.lists(st.text(alphabet="abc 1.É", max_size=40), max_size=4))
def test_search_against_brute_force(docs, items):
    w = dc.Windows([(str(i), t) for i, t in enumerate(items)], 3)
    got = [(i, len(dc.split(t)), sum(b - a for a, b in s), len(x), dc.digest([w.items[k] for k in x])) for (i, t), (s, x) in zip(enumerate(docs), dc.search([dc.split(t) for t in docs], w))]
    assert got == [r[:5] for r in brute(list(enumerate(docs)), list(enumerate(items)), 3)]


PASSAGE = " ".join(f"bench{i % 7}mark{i}" for i in range(40))
DOCS = [(1, "clean words only " * 30), (2, "before " + PASSAGE.upper() + " after"), (3, None), (4, ""), (None, PASSAGE[: len(PASSAGE) // 2]), (2, "Tiny, item!"), (6, ("long text " * 4000) + PASSAGE + "!" + PASSAGE), (7, PASSAGE.replace(" ", ", "))]
ITEMS = [(10, PASSAGE), (9, "tiny item"), (11, PASSAGE), (12, None), (13, "..."), (14, "clean words only clean words only clean words only clean words only clean")]


def test_query(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in DOCS], "doc_id long, text string, n_words int, row string")
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, doc_id int")
    want = Counter(map(tuple, brute(DOCS, ITEMS)))
    assert Counter(map(tuple, dc.op8(docs, items).collect())) == want
    assert dc.op8(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in dc.op8(docs, items.limit(0)).collect()} == {0}


@pytest.mark.parametrize("more", [[], [(10, "tiny item"), (10, PASSAGE + " tail")]])
def test_blocks_of_the_benchmark_merge(spark, more):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS + more, "item_id long, text string")
    one, many = (dc.find(docs, items, block_chars=n).drop("row").collect() for n in (1 << 20, 1))
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert all(len(set(r["items"])) == len(r["items"]) for r in one)


@pytest.mark.parametrize("block_chars", [1 << 20, 1])
def test_clean_rows_keep_their_columns(spark, monkeypatch, block_chars):
    monkeypatch.setattr(dc, "SHARD_WORDS", 50)
    docs = spark.createDataFrame([(*r, 1, "x", "y", 5) for r in DOCS], "doc_id long, text string, n_words int, row string, _ROW string, spans int")
    got = dc.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_chars=block_chars)
    assert got.columns == docs.columns
    bad = [r[-1] for r in brute(DOCS, ITEMS)]
    assert sorted(map(str, got.collect())) == sorted(map(str, (r for r, b in zip(docs.collect(), bad) if not b)))
