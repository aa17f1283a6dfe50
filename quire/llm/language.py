"""Operator 5: language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the share of byte
n-grams (1 to 4, over case-folded UTF-8, hashed to DIMENSIONS) that both have,
normalised by the geometric mean of their numbers. Its space is approximated by
Nyström landmarks: training texts, as many for each language; a text is described by
its kernels with them, whitened by the landmarks' own. One-versus-rest kernel ridge
regression in that space gives a score a language. As presence kernels are inner
products of presence vectors, landmarks, whitening and regression multiply out to one
matrix (dimensions x languages), by which batches of presence vectors are scored.

Learning takes a bounded sample of labelled rows, PER_LANGUAGE for each language and
MOST_ROWS in all (but one for each language, however many), drawn by hash of doc_id and
text from all of them, equal rows once; presence vectors come to the driver, not texts.
A model has WEIGHTS numbers at most: with many languages it has fewer dimensions, and no
language is left out. Whole texts are read, in learning as in prediction, very long ones
in slices. Only text is an input of a prediction.

A text that is null or has no letter is ``und`` with score 0; without training rows all
are. A text without n-grams known to the model gets the best prior language; of equal
scores the language first by name counts. Rows that repeat a doc_id are documents of
their own; a null doc_id counts as an empty one where rows are held out; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import LONG

DIMENSIONS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: Training rows and landmarks for each language.
PER_LANGUAGE, LANDMARKS = 400, 60
#: Training rows and landmarks in all, shared out evenly where languages are many: 16 MB of bits, 64 MB of landmarks.
MOST_ROWS, MOST_LANDMARKS = 4096, 512
#: Numbers in a model: 32 MB; and the fewest dimensions, however many languages.
WEIGHTS, FEWEST = 1 << 23, 1 << 10
RIDGE = 1e-3
_BATCH = 64


def presence(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of 0 and 1 (uint8) for each text: which hashed n-grams it has."""
    out = np.zeros((len(texts), dimensions), np.uint8)
    shift = np.uint32(32 - (dimensions - 1).bit_length())
    for row, text in zip(out, texts, strict=True):
        for at in range(0, max(1, len(text)), LONG):
            # Slices overlap by what the longest n-gram needs.
            raw = text[max(0, at - max(GRAMS)) : at + LONG].lower().encode("utf-8", "surrogatepass")
            b = np.frombuffer(raw, np.uint8).astype(np.uint32)
            code = np.zeros(len(b), np.uint32)
            for n in range(1, max(GRAMS) + 1):
                if len(b) < n:
                    break
                code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
                if n in GRAMS:
                    row[(code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> shift] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # dimensions x languages
    scale: float = 8.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        for k in range(0, len(known), _BATCH):
            own = known[k : k + _BATCH]
            x = presence([texts[i] for i in own], len(self.weights))
            size = np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1))[:, None]
            y = (x.astype(np.float32) @ self.weights) / size
            e = np.exp(self.scale * (y - y.max(1, keepdims=True)))
            p = e / e.sum(1, keepdims=True)
            for i, best, row in zip(own, y.argmax(1).tolist(), p, strict=True):
                names[i], scores[i] = self.languages[best], float(row[best])
        return names, scores


def train(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From (language, packed presence bits); the first rows of each language become its landmarks."""
    rows = sorted(rows, key=lambda r: r[0])
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros((0, 0), np.float32))
    bits = np.array([np.frombuffer(b, np.uint8) for _, b in rows])
    y = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(languages)))
    chosen = np.concatenate([np.flatnonzero([lang == x for lang, _ in rows])[:landmarks] for x in languages])

    def unit(at: np.ndarray) -> np.ndarray:
        x = np.unpackbits(bits[at], axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    z = unit(chosen)  # MOST_LANDMARKS rows at most
    kzz = (z @ z.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kzz)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])  # landmarks x features
    phi = np.concatenate([(unit(np.arange(i, min(i + 256, len(rows)))) @ z.T) @ whiten for i in range(0, len(rows), 256)])
    mean = phi.mean(0)
    balance = np.array([1.0 / max(1, sum(a == lang for a, _ in rows)) for lang, _ in rows])
    balance /= balance.mean()
    a = (phi - mean).T @ ((phi - mean) * balance[:, None]) + ridge * len(rows) * np.eye(phi.shape[1])
    beta = np.linalg.solve(a, (phi - mean).T @ (y * balance[:, None]))
    return Model(languages, (z.T @ (whiten @ beta)).astype(np.float32))


def held_out() -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def dimensions(languages: int) -> int:
    """A power of two, so that a model of so many languages has WEIGHTS numbers at most, or FEWEST dimensions."""
    return max(FEWEST, min(DIMENSIONS, 1 << (WEIGHTS // max(1, languages)).bit_length() - 1))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From docs (doc_id, text, lang) that are not held out and have a language."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    # One row for each language: how many different rows it has, within a twentieth.
    counts = own.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()
    if not counts:
        return train([])
    per_language, size = max(1, min(per_language, MOST_ROWS // len(counts))), dimensions(len(counts))
    # By hash about one and a half times what is taken, so that what is ranked has a bound too; equal rows are one.
    share = F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit((1.5 * per_language + 20) / max(1, r.n)))))
    drawn = own.where(F.pmod(F.xxhash64("h", F.lit(5)), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("bits", pa.binary())])

    def bits(it):
        for b in it:
            packed = [np.packbits(presence([t.as_py()], size)[0]).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], schema=schema)

    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).mapInArrow(bits, "lang string, h long, bits binary")
    first = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h", F.lit(6)), "h"))).where(F.col("k") <= per_language)
    return train([(r.lang, bytes(r.bits)) for r in first.orderBy("lang", "k").select("lang", "bits").collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WEIGHTS numbers at most (or FEWEST for each language)

    def run(it):
        for b in it:
            names, scores = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all."""
    return identify(docs, fit(docs))
