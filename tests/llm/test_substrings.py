import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from quire.llm import substrings as sb


def brute(rows, window=50):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= {*range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "é", "ga\x1cma", "x"]) + str(rng.randint(0, 400))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 70, 200, 400)]
    rows = [(None, " ".join(shared[4])), (-5, None), (-4, ""), (1000, "same " * 130), (1001, "same " * 120), (1002, "same " * 49)]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += text(rng.randint(0, 60))
            s = rng.choice(shared)
            a = rng.randint(0, max(0, len(s) - 50))
            parts += s if rng.random() < 0.5 else s[a : a + rng.randint(45, 60)]
        rows.append((rng.randint(0, 40), rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(2000 + i, rows[20 + i % 3][1]) for i in range(12)]
    rows += [(3000 + i, " ".join(text(i % 60) + shared[5] + text(60))) for i in range(25)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, t int, c string")
    assert Counter(map(tuple, sb.op6(df).collect())) == brute(rows)


def test_slices_change_nothing(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(sb, "_BYTES", 300)
    h = sb.word_hashes(rows[0][1].encode() if rows[0][1] else b"a b")
    monkeypatch.undo()
    assert (h == sb.word_hashes(rows[0][1].encode() if rows[0][1] else b"a b")).all()


def test_phrases_cover_all_windows_once():
    h = np.random.default_rng(0).integers(0, 2**63, 700).astype(np.uint64)
    a, c, s, n = sb.phrases(h)
    assert s[0] == 0 and (s[1:] == s[:-1] + n[:-1]).all() and s[-1] + n[-1] == len(h) - 49
    moved = sb.phrases(np.concatenate([h[:33], h]))
    assert set(a[1:-1].tolist()) <= set(moved[0].tolist()) and set(c[1:-1].tolist()) <= set(moved[1].tolist())
    assert len(sb.phrases(h[:49])[0]) == 0


def test_factors():
    found = np.array([(5, 1, 2, 9), (0, 2, 7, 40), (2, 3, 7, 42), (300, 3, 1, 0), (303, 1, 1, 4), (352, 1, 1, 0)])
    parse = sb.factors(found)
    assert parse == [(0, 54, 7, 40), (5, 50, 2, 9), (300, 52, 1, 0), (303, 50, 1, 4), (352, 50, 1, 0)]
    assert sb.covered(parse) == [(0, 55), (300, 402)]


def naive(rows, window=50):
    """Of each document the windows that start in an earlier one; and whether a factor is a match."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    old = {d: {i for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d} for d, w in words.items()}
    return words, old


@pytest.mark.parametrize("seed", [4, 5])
def test_factors_against_a_naive_parser(spark, seed):
    rows = list({d: (d, t) for d, t in corpus(seed) if d is not None}.values())
    words, old = naive(rows)
    got = sb.parsed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.ref_doc, r.ref_start))
    assert {d for d, o in old.items() if o} == set(by)
    for d, parse in by.items():
        for (s, n, ref, at), after in zip(sorted(parse), [*sorted(parse)[1:], None]):
            assert ref < d and n >= 50 and words[d][s : s + n] == words[ref][at : at + n]
            # The next factor begins behind the last window of this one, and does not go on where it stopped.
            assert after is None or (after[0] > s + n - 50 and after != (s + n - 49, after[1], ref, at + n - 49))
        seen = [i for s, n, _, _ in parse for i in range(s, s + n - 49)]
        assert len(seen) == len(set(seen)) and set(seen) == old[d]


def test_a_copy_is_one_factor(spark):
    text = " ".join(f"w{i * i % 911}" for i in range(700))
    rows = [(1, "before " + text), (2, "some other words " + text + " after"), (3, text)]
    got = {(r.doc_id, r.start, r.length, r.ref_doc, r.ref_start) for r in sb.parsed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 3, 700, 1, 1), (3, 0, 700, 1, 1)}


def test_equal_rows_take_time_in_proportion(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = lambda n: [(1, text)] + [(2, text + " more")] * n
    took = []
    for n in (50, 1600):
        df = spark.createDataFrame(rows(n), "doc_id long, text string")
        began = time.time()
        got = Counter(map(tuple, sb.op6(df).collect()))
        took.append(time.time() - began)
        assert got == brute(rows(n))
    assert took[1] < 4 * took[0] + 5


def test_empty_table(spark):
    assert sb.op6(spark.createDataFrame([], "doc_id long, text string")).count() == 0
