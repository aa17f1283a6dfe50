import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from quire.llm import simhash
from quire.llm.graph import components


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aB \t\nÉ\x0b\x1c", max_size=60)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_long_text_in_slices():
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    assert simhash.fingerprint(text) == plain(text)


def roots(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def family(rng, size, spread):
    x, out = rng.getrandbits(64), set()
    while len(out) < size:
        y = x
        for b in rng.sample(range(64), rng.randint(0, spread)):
            y ^= 1 << b
        out.add(y)
    return out


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_components_of_dense_families_and_chains(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = {0} | family(rng, 300, 3) | family(rng, 40, 2) | {rng.getrandbits(64) for _ in range(200)}
    x = rng.getrandbits(64)
    for i in range(0, 40, 2):  # a chain, each two bits from the next
        fps.add(x)
        x ^= 3 << i
    signed = [simhash._signed(f) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = roots(signed, [(a, b) for a, b in combinations(signed, 2) if (a ^ b & -1).bit_count() <= 2 or bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    sizes = Counter(want.values())
    assert got == {x: r for x, r in want.items() if sizes[r] > 1}


def test_links_are_true_links(spark):
    rng = random.Random(5)
    signed = [simhash._signed(f) for f in family(rng, 400, 3)]
    for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect():
        assert bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(*[st.integers(1, 99)] * 3), min_size=1, max_size=4))
def test_allocation_is_the_cheapest(costs):
    cost = [[0.0, *map(float, c)] for c in costs]
    total, ts = simhash.allocate(cost, 2)
    every = [t for t in product(range(-1, 3), repeat=len(cost)) if sum(t) == 2 - len(cost) + 1]
    assert total == min(sum(c[t + 1] for c, t in zip(cost, ts)) for ts in every)
    assert sum(ts) == 3 - len(cost) and total == sum(c[t + 1] for c, t in zip(cost, ts))


def test_plan_keeps_the_principle():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < 0.4).astype(float)
    for n in (10, 10**4, 10**7, 10**10):
        chosen = simhash.plan(n, bits.T @ bits * (n / 500))
        used = [b for p, _ in chosen for b in p]
        assert len(used) == len(set(used)) and all(t >= 0 for _, t in chosen)


def test_query(spark):
    rows = [(7, "a b c d e"), (3, "A B C d\te"), (9, None), (4, ""), (None, "a b c d e"), (3, "unlike all others here"), (8, "one two"), (1, "one TWO")]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, fp int, root int")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.op3(df).collect())
    comp = {"a": 3, "": 4, "u": 3, "o": 1}
    want = sorted((d or -1, f"{plain(t):016x}", comp[(t or "")[:1].lower()]) for d, t in rows)
    assert got == want
    assert simhash.op3(df.limit(0)).count() == 0


def test_components_by_merges_alone(spark, monkeypatch):
    from quire.llm import common

    monkeypatch.setattr(common, "SMALL", 0)
    edges = [(1, 9), (9, 8), (8, 2), (20, 21), (30, 31), (31, 32), (32, 30), *((100 + i, 100) for i in range(1, 60))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in roots({x for e in edges for x in e}, edges).items()}
    df = spark.createDataFrame([(i, f"the same words {i % 3} again and again") for i in range(12)], "doc_id long, text string")
    assert {r.component_id for r in simhash.op3(df).collect()} == {simhash_least(i) for i in range(12)}


def simhash_least(i):
    fps = [simhash.fingerprint(f"the same words {k} again and again") for k in range(3)]
    linked = [(a, b) for a in range(3) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    return roots(range(3), linked)[i % 3]
