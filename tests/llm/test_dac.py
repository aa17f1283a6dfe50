import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import dac, tokenize
from quire.llm.tokenize import Words
from quire.session import Scratch

WORD, BYTE = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", " ", "a", "  two  blanks ", "tab\tand\r\nline\n\n", "it's I'LL 12 345!?", "Équeêment ñoño ß Straße", "á é", "nb\xa0sp   em", "x <|endoftext|> y<|startoftext|>", "日本語 テキスト 😀😀", "\x1c\x85z \x0b q", "\n", "end \n", "end  \n  ", "Σίσυφος ΣΑΣ"]


@pytest.mark.parametrize("path,cut", [(WORD, "drop"), (BYTE, "lead")])
@settings(max_examples=600, deadline=None)
@given(st.one_of(st.sampled_from(ODD), st.text(alphabet=st.sampled_from("ab'sT1 .!\n\t\xa0éÉ—…“”’€你好<|>"), max_size=40), st.text(max_size=30)))
def test_cached_words_equal_plain_encoding(path, cut, text):
    tok, own = _tok(path), _own(path, cut)
    assert own.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


_tok = lru_cache(Tokenizer.from_file)
_own = lru_cache(Words)


MIXED = ["Hello World — ok", "THE “Quoted” Words", "Él Niño 日本 NIÑO", "x <|y Straße ÀÉÎ", "Hello, WORLD! 😀\nThe End…", "A Ā"]


@pytest.mark.parametrize("path,cut", [(WORD, "drop"), (BYTE, "lead")])
@pytest.mark.parametrize("text", MIXED)
def test_capitals_beside_wide_characters(path, cut, text):
    assert Words(path, cut).encode(text).tolist() == _tok(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path,cut", [(WORD, "drop"), (BYTE, "lead")])
def test_long_texts_in_slices(path, cut, monkeypatch):
    monkeypatch.setattr(tokenize, "LONG", 1000)
    text = "The quick\n\nbrown  fox's den, " * 300
    assert _own(path, cut).encode(text).tolist() == _tok(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=6), st.sampled_from([(8, 8, 16), (4, 12, 16), (16, 16)]))
def test_block_round_trip_and_random_access(docs, widths):
    arrays = [np.asarray(d, "<u4") for d in docs]
    b = dac.Block(dac.pack(list(range(len(docs))), arrays, widths))
    flat = np.concatenate(arrays) if docs else np.empty(0, "<u4")
    assert (b.decode() == flat).all() and b.doc_ids == list(range(len(docs)))
    at = np.random.default_rng(0).permutation(len(flat))
    assert (b.access(at) == flat[at]).all()
    with pytest.raises(IndexError):
        b.access(np.asarray([len(flat)]))


ROWS = [(11, "The “Quick” Brown—Fox… 5 € For You 你好 <|x It’s"), (5, "five is here"), (None, "no id"), (2, None), (9, ""), (2, "two"), (-3, "Minus!\n"), (7, "long words " * 3000)]


def test_query_against_plain_encoding(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "doc_id long, text string, part string, payload string")
    got = {(r.doc_id, r.n_tokens, r.ids_crc32): r.start for r in dac.op1(spark, df, WORD).collect()}
    want, n = [], 0
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray([*_tok(WORD).encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, got)) == sorted(map(str, want))
    starts = sorted((s, k[1]) for k, s in got.items())
    for s, length in starts:
        assert s == n
        n += length
    assert [d for d, *_ in sorted(got, key=got.get)] == [None, -3, 2, 2, 5, 7, 9, 11]


@pytest.mark.parametrize("probes", [dac.PROBES, 20])
def test_positions_are_looked_up(spark, monkeypatch, probes):
    monkeypatch.setattr(dac, "PROBES", probes)
    monkeypatch.setattr(dac, "BLOCK_TOKENS", 64)
    df = spark.createDataFrame([(i, f"word{i} and more " * (i % 5)) for i in range(40)], "doc_id long, text string")
    path = Scratch(spark, "t").path("ids")
    dac.write_tokens(df, path, WORD)
    flat = [x for i in range(40) for x in [*_tok(WORD).encode(f"word{i} and more " * (i % 5), add_special_tokens=False).ids, 1]]
    wanted = [*range(0, len(flat), 7), *[5] * 300, 0, len(flat) - 1]
    asked = spark.createDataFrame([(p,) for p in [*wanted, -1, len(flat), None]], "position long")
    assert Counter(map(tuple, dac.tokens_at(asked, path).collect())) == Counter((p, flat[p]) for p in wanted)
    assert dac.tokens_at(asked.limit(0), path).count() == 0


def test_rows_that_share_a_doc_id_spread(spark):
    df = spark.createDataFrame([(7, "the same text")] * 400 + [(8, "end")], "doc_id long, text string")
    path = Scratch(spark, "t").path("ids")
    dac.write_tokens(df, path, WORD)
    assert spark.read.parquet(path).where("first_doc = 7").count() > 1
    starts = sorted((r.start, r.n_tokens) for r in dac.read_tokens(spark, path).collect())
    assert len(starts) == 401 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dac.op1(spark, df, WORD).count() == 0
