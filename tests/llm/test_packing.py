import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bins_hold_every_piece_once(lengths):
    cap = 31
    first = packing.best_fit(dict(Counter(lengths)), cap)
    better = packing.local_search(first, cap)
    for bins in (first, better):
        held = Counter()
        for b, n in bins.items():
            assert n > 0 and sum(x * k for x, k in b) <= cap
            for x, k in b:
                held[x] += k * n
        assert held == Counter(lengths)
    assert better.total() <= first.total()
    assert better.total() >= -(-sum(lengths) // cap)
    fill = lambda bins: sum(n * sum(x * k for x, k in b) ** 2 for b, n in bins.items())
    assert fill(better) >= fill(first)


def test_local_search_empties_a_bin():
    # Three bins by hand that two can hold: 6+3 | 5+2 | 2+2 with room for 10.
    bins = Counter({((6, 1), (3, 1)): 1, ((5, 1), (2, 1)): 1, ((2, 2),): 1})
    assert packing.local_search(bins, 10).total() == 2


def test_local_search_of_many_equal_bins():
    bins = Counter({((6, 1), (3, 1)): 50_000, ((5, 1), (2, 1)): 50_000, ((2, 2),): 50_000})
    assert packing.local_search(bins, 10).total() == 100_000


def test_local_search_leaves_no_exchange():
    rng = random.Random(2)
    lengths = Counter(rng.randint(40, 140) for _ in range(20_000))
    first = packing.best_fit(dict(lengths), 205)
    bins = packing.local_search(first, 205, 1 << 20)
    least = -(-sum(x * n for x, n in lengths.items()) // 205)
    fill = {b: sum(x * k for x, k in b) for b in bins}

    def exchange(a, b):
        """Whether bin a, the emptier, has something to give to b, for something smaller or nothing."""
        room, mine = 205 - fill[b], [x for x, k in a for _ in range(k)]
        backs = [x for x, _ in b]
        one = any(0 < x - y <= room for x in mine for y in [0, *backs])
        return one or any(0 < x + z - y <= room for i, x in enumerate(mine) for z in mine[:i] for y in backs)

    left = [(a, b) for a in bins for b in bins if 205 > fill[b] >= fill[a] and (a != b or bins[a] > 1) and exchange(a, b)]
    assert bins.total() < first.total() and (bins.total() == least or not left)
    held = Counter()
    for b, n in bins.items():
        for x, k in b:
            held[x] += k * n
    assert held == lengths


def test_one_for_one_and_two_for_one():
    def best(*bins, capacity):
        c = packing._Classes(capacity)
        for b in bins:
            c.put(b, 1)
        return c.exchange(0)

    assert best(((5, 1),), ((4, 1), (3, 1)), capacity=9) == (1, (5,), (3,))
    assert best(((4, 1), (3, 1)), ((8, 1),), capacity=9) is None
    assert best(((4, 1), (2, 1)), ((5, 1), (4, 1)), capacity=10) == (1, (4, 2), (5,))
    assert best(((2, 1),), ((5, 1),), capacity=8) == (1, (2,), ())


def test_exchanges_have_a_bound():
    rng = random.Random(9)
    lengths = Counter(rng.randint(400, 1400) for _ in range(30_000))
    first = packing.best_fit(dict(lengths), 2048)
    bins = packing.local_search(first, 2048, 2)
    held = Counter()
    for b, n in bins.items():
        for x, k in b:
            held[x] += k * n
    assert held == lengths and bins.total() <= first.total()


def test_query_against_plain_encoding(spark):
    rows = [(i, "words of a text, " * (i * 13 % 700)) for i in range(60)] + [(3, "repeated"), (None, "no id"), (61, None), (62, ""), (63, "x " * 9000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, piece string, offset int")
    got = packing.pack(df, BYTE).collect()
    tok, want = Tokenizer.from_file(BYTE), Counter()
    for d, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1


def test_empty_and_one_length(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0
    same = spark.createDataFrame([(i, "copy " * 100) for i in range(500)], "doc_id long, text string")
    got = packing.pack(same, BYTE).collect()
    n = got[0].length
    assert len({r.sequence_id for r in got}) == -(-500 // (2048 // n))
    assert len({(r.sequence_id, r.offset) for r in got}) == 500
