"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one binary classifier per bit, over hashed byte n-grams of
the whole text, predicts that bit.  Decoding sums, for each language, the logistic losses of the
classifiers' margins against its codeword, weighted by how well each classifier did in training;
the language of least loss is chosen, and ambiguity flagged where the runner-up is close.

The classifiers learn from a bounded sample: about ``SAMPLE`` documents, shared evenly between the
languages, and about ``LEAST`` of each language where there are very many, chosen by hashed id.  Every
language value is learned; the column is taken to hold tags, whose number does not grow with the rows.
Predictions use the text alone.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if
nothing can be learned; with a single language, every text with a letter is of that language;
repeated rows are each predicted; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textwork as tw
from .linear import sigmoid
from .shared import id_crc, materialize, table

SAMPLE = 4000
LEAST = 16
WIDTH = 2048
GRAMS = (2, 3, 4)
AMBIGUOUS = 0.9
_LETTER = regex.compile(r"\p{L}")


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """+1/-1 codes, a row per class: all different splits for up to five classes, else random columns
    of 10 log2(n) bits, the set of greatest least distance out of fifty."""
    if classes < 2:
        return np.ones((classes, 0), np.int64)
    if classes <= 5:
        splits = [[(s >> i) & 1 for i in range(classes)] for s in range(1, 2**classes, 2) if s != 2**classes - 1]
        return np.array(splits).T.reshape(classes, -1) * 2 - 1
    bits = math.ceil(10 * math.log2(classes))
    rng = np.random.default_rng(seed)
    tries = [rng.integers(0, 2, (classes, bits)) * 2 - 1 for _ in range(50)]
    least = [(m @ m.T - np.eye(classes) * 10**6).max() for m in tries]
    return tries[int(np.argmin(least))]


def gram_features(array: pa.Array, width: int = WIDTH) -> np.ndarray:
    """A row per text: square roots of hashed n-gram shares; separators count as one byte value."""
    flat, offsets = tw.text_bytes(array)
    rows = len(array)
    counts = np.zeros(rows * width)
    for at in range(0, len(flat), tw.PIECE_BYTES):  # n-grams that begin in this part
        part = flat[at : at + tw.PIECE_BYTES + max(GRAMS) - 1]
        row = np.searchsorted(offsets, np.arange(at, at + len(part)), "right") - 1
        mapped = tw.ALNUM[part].astype(np.uint64)
        mapped[(part >= 48) & (part <= 57)] = 0
        for n in GRAMS:
            last = min(len(part) - n + 1, tw.PIECE_BYTES)
            if last <= 0:
                continue
            code = np.zeros(last, np.uint64)
            for j in range(n):
                code = code * np.uint64(257) + mapped[j : j + last]
            whole = (row[:last] == row[n - 1 : n - 1 + last]) & (code > 0)
            slot = (tw.mix(code[whole] + np.uint64(n << 40)) % np.uint64(width)).astype(np.int64)
            counts += np.bincount(row[:last][whole] * width + slot, minlength=rows * width)
    counts = counts.reshape(rows, width)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


@dataclass
class Codes:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], steps: int = 120, rate: float = 0.5, l2: float = 1e-5) -> Codes:
        known = sorted(set(langs))
        code = codewords(len(known)).astype(np.float32)
        y = code[[known.index(v) for v in langs]] if known else np.zeros((0, 0), np.float32)
        bits = code.shape[1] if len(known) > 1 else 0
        w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
        gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        for _ in range(steps if bits else 0):
            g = -y * sigmoid(-y * (x @ w + b)).astype(np.float32) / len(y)
            dw, db = x.T @ g + l2 * w, g.sum(axis=0)
            gw += dw * dw
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
        right = ((x @ w + b) * y > 0).mean(axis=0) if bits else np.zeros(0)
        trust = np.maximum(right - 0.5, 0.01)
        return cls(known, code, w, b, trust / max(trust.sum(), 1e-9))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class number, probability and ambiguity of each row."""
        if len(self.langs) < 2:
            return np.zeros(len(x), np.int64), np.ones(len(x)), np.zeros(len(x), bool)
        margin = x @ self.weight + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = p[np.arange(len(x)), best]
        return best, top, top < AMBIGUOUS


def train(docs: DataFrame, learn: Column, size: int = SAMPLE, least: int = LEAST) -> Codes:
    """Fitted on documents with a language for which ``learn`` holds, of every language."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    many = counts.count()
    if not many:
        return Codes.fit(np.zeros((0, WIDTH), np.float32), [])
    each = max(size / many, least)
    # Of a language with more documents, those whose hashed ids fall below its share.
    place = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    shares = counts.select(F.col("lang").alias("__lang"), F.least(F.lit(1.0), each / F.col("n")).alias("__share"))
    sample = rows.join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(place < F.col("__share")).select("text", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tw.pieces(batch, most_rows=128):
                x = gram_features(piece.column(0)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), piece.column(1)], names=["x", "lang"])

    got = sample.mapInArrow(features, "x binary, lang string").toArrow()
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("x").to_pylist(), strict=True))
    x = np.frombuffer(b"".join(v for _, v in pairs), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return Codes.fit(x, [lang for lang, _ in pairs])


def identify(docs: DataFrame, model: Codes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred, score and ambiguous for every row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH and the number of bits bound it

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for piece in tw.pieces(batch, 1, most_rows=128):
                best, p, unsure = model.decode(gram_features(piece.column(1)))
                some = np.array([t is not None and _LETTER.search(t) is not None for t in piece.column(1).to_pylist()], bool)
                some &= bool(model.langs)
                names = [model.langs[i] if ok else "und" for i, ok in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(names, pa.string()), pa.array(np.where(some, p, 0.0)), pa.array(unsure | ~some)], names=["id", "lang_pred", "score", "ambiguous"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    cells = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return cells.mapInArrow(rows, f"id {kind}, lang_pred string, score double, ambiguous boolean")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    found = identify(docs, train(docs, ~held_out)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "ambiguous")
