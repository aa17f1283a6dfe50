"""Encoding whole texts with a public tokenizer, through a cache of their words.

A byte-level or word-end tokenizer never merges across the start of a run of white
space, so a text's ids are the joined ids of its chunks, and a corpus has far fewer
distinct chunks than chunks. Two ways to cut, by what the tokenizer does with blanks:

* ``drop``: it drops white space; chunks are what stands between ASCII blanks.
* ``lead``: a word keeps the blanks before it; a chunk is a run of ASCII blanks with
  the word after it. Texts with other white space are encoded whole, as their runs
  may begin with a character that this cut does not see.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

from quire.llm.common import LONG

LEAD = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
CUT = re.compile(r"(?<=[^\s])[ \n](?=[^\s])")
#: Where none of these is, and no blank at the ends, a text has single blanks and line ends only.
ODD_BLANKS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: A letter, then ASCII punctuation to the end: both kinds of tokenizer cut between them (but before an apostrophe).
TAIL = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-^`{-~]+)", re.S)
#: Words kept by a worker.
CACHE = 1_200_000


class Words:
    """One tokenizer with the ids of words that it has met.

    Where the tokenizer lower-cases, texts of Latin-1 characters are lower-cased
    first, which gives fewer words to know; others might compose differently, and
    their words with capitals go through the whole tokenizer.
    """

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if cut not in ("drop", "lead"):
            raise ValueError(f"cut: drop or lead, not {cut!r}")
        self.tok = Tokenizer.from_file(path)
        self.cut = cut
        self.lower = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("AZ") == "az"
        wide = self.tok.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype, self.code = (np.dtype("<u4"), "I") if wide else (np.dtype("<u2"), "H")
        # A word of letters alone goes straight to the model, if that gives what the whole tokenizer does.
        probe = [b + w for w in ("a", "reeder", "straße", "él", "niño") for b in (("", " ") if cut == "lead" else ("",))]
        self.direct = all([t.id for t in self.tok.model.tokenize(_letters(x))] == self.tok.encode(x, add_special_tokens=False).ids for x in probe)
        self.known = _Known(self._find)
        #: By a word after a single blank, without the blank; a line's first word with its line end.
        self.after = _Known(lambda w: self._find(w if w[0] == "\n" else " " + w))

    def chunks(self, text: str) -> list[str]:
        if self.cut == "lead":
            return LEAD.findall(text)
        if self.lower and "<|" not in text and _latin(text):
            text = text.lower()
        if "\n" in text:
            text = text.replace("\n", " ")
        if "\t" in text or "\r" in text:
            text = text.replace("\t", " ").replace("\r", " ")
        return text.split(" ")

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _plain(self, part: str) -> bytes:
        """Ids of a chunk, or of what stands before or after its TAIL cut."""
        if self.direct and (part[1:] if self.cut == "lead" and part[0] == " " else part).isalpha() and (not self.lower or (_latin(part) and part == part.lower())):
            return array(self.code, [t.id for t in self.tok.model.tokenize(_letters(part))]).tobytes()
        return array(self.code, self.tok.encode(part, add_special_tokens=False).ids).tobytes()

    def _find(self, chunk: str) -> bytes:
        m = TAIL.fullmatch(chunk) if not chunk[-1].isalpha() and "<|" not in chunk else None
        if m is None:
            return self._plain(chunk)
        word = m[1]
        return (self.after[word[1:]] if word[0] == " " and word[1] > " " else self.known[word]) + self.known[m[2]]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text (null: none), without special tokens at its ends."""
        if not text:
            return np.empty(0, self.dtype)
        if self.cut == "lead" and OTHER_SPACE.search(text):
            return self.whole(text)
        if len(text) <= LONG:
            return np.frombuffer(self._joined(text), self.dtype)
        out, at = [], 0
        while at < len(text):
            m = CUT.search(text, at + LONG)
            end = m.start() if m else len(text)
            out.append(self._joined(text[at:end]))
            at = end
        return np.frombuffer(b"".join(out), self.dtype)

    def _joined(self, text: str) -> bytes:
        self.known.limit()
        self.after.limit()
        if self.cut == "lead" and text[0] > " " and text[-1] > " " and not any(x in text for x in ODD_BLANKS):
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.known[first] + b"".join(map(self.after.__getitem__, rest))
        return b"".join(map(self.known.__getitem__, self.chunks(text)))


class _Known(dict):
    """Values by key; one that it lacks is found and kept. Two generations, half of CACHE each: what is used again stays."""

    def __init__(self, find):
        super().__init__({"": b""})
        self.find, self.old = find, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.find(key)
        self[key] = got
        return got

    def limit(self) -> None:
        if len(self) > CACHE // 2:
            self.old = dict(self)
            self.clear()
            self[""] = b""


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write a byte as a printable character: itself, or else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


def _letters(word: str) -> str:
    """A word of letters, with a blank before it or not, as the model spells it."""
    if word.isascii():
        return _BYTES[32] + word[1:] if word[0] == " " else word
    return word.encode("utf-8").decode("latin-1").translate(_BYTES)


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def words(path: str, cut: str) -> Words:
    """One per worker process and tokenizer."""
    return Words(path, cut)
