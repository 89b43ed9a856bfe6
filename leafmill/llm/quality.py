"""Document quality: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of word characters or of punctuation, case kept, hashed to ``BUCKETS``.  Every
bucket has a fixed random index vector (few +1 and -1); a bucket's word vector is the sum of the
index vectors of its neighbours over all tokens of all documents, scaled, plus its own.  The sums are
integers, added up per task and then natively, so they are the same whatever the partitioning.
Vectors are centred on the corpus mean; a document is the mean of its tokens' vectors, drawn towards
the corpus mean if it is short.

The network (one hidden layer, numpy) is fitted on a bounded sample of ``SAMPLE`` labelled documents,
those of lowest hashed id; a fifth of it is set aside to calibrate a temperature.

Defined results: null, empty and blank texts are scored as a document of mean zero; a document
labelled more than once counts with its largest label; without labels, or with one kind of label
only, scores are that kind's constant (0.5 without labels).  Repeated rows are each scored; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textwork as tw
from .linear import sigmoid
from .shared import aside, hash_sample, id_crc, restored, table
from .toxicity import labelled

BUCKETS = 2048
DIMENSIONS = 64
NONZERO = 8
SAMPLE = 8000
HIDDEN = 32
THRESHOLD = 0.3
#: Tokens' weight of the corpus mean in a document's mean: short texts say little.
SHRINK = 8
_PAIRS = 4_000_000


def index_vectors(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS))
    for row in out:
        at = rng.choice(DIMENSIONS, NONZERO, replace=False)
        row[at] = rng.choice([-1, 1], NONZERO)
    return out


def _tokens(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each token.  Bucket 0 is kept for words that repeat the word before them."""
    words = tw.runs(array)
    bucket = (words.hash % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    word = np.flatnonzero(tw.RUN_CLASS[words.data[words.start]] == 1) if len(words.start) else np.zeros(0, np.int64)
    again = (words.hash[word[1:]] == words.hash[word[:-1]]) & (words.row[word[1:]] == words.row[word[:-1]])
    bucket[word[1:][again]] = 0
    return words.row, bucket


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all buckets, from all documents (a table of fixed size)."""
    index = index_vectors()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS * BUCKETS, np.int32)
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for piece in tw.pieces(batch):
                row, bucket = _tokens(piece.column(0))
                same = row[1:] == row[:-1]
                held.append((bucket[:-1] * BUCKETS + bucket[1:])[same].astype(np.int32))
                n += len(held[-1])
                if n > _PAIRS:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.int32)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.int32)
        if not counts.any():
            return
        pairs = counts.reshape(BUCKETS, BUCKETS)
        sums = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for at in range(0, BUCKETS, 256):
            sums[at : at + 256] += (pairs[at : at + 256].astype(np.float64) @ index).astype(np.int64)
            sums += (pairs[at : at + 256].T.astype(np.float64) @ index[at : at + 256]).astype(np.int64)
        seen = pairs.sum(axis=1, dtype=np.int64)
        some = np.flatnonzero(sums.any(axis=1) | (seen > 0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c) for c in sums[some].T), pa.array(seen[some])], names=["bucket", *names])

    names = [*(f"d{i}" for i in range(DIMENSIONS)), "seen"]
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(rows, ", ".join(["bucket long", *(f"{c} long" for c in names)]))
    summed = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # BUCKETS rows at most
    sums = np.zeros((BUCKETS, DIMENSIONS + 1))
    sums[summed.column("bucket").to_numpy()] = np.column_stack([summed.column(c).to_numpy() for c in names]) if summed.num_rows else 0
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    vectors = unit(sums[:, :-1]) + unit(index)
    seen = sums[:, -1:]
    return (vectors - (vectors * seen).sum(axis=0) / max(seen.sum(), 1)).astype(np.float32)


def pool(array: pa.Array, vectors: np.ndarray) -> np.ndarray:
    row, bucket = _tokens(array)
    n = len(array)
    counts = np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    return (counts @ vectors) / (counts.sum(axis=1, keepdims=True) + SHRINK)


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh, a logit divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 500, rate: float = 0.01, l2: float = 1e-4, seed: int = 3) -> Network:
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(x.shape[1]), np.ones(x.shape[1]), [], 1.0, float(y[0]) if len(y) else 0.5)
        aside_ = np.arange(len(y)) % 5 == 4
        inside = ~aside_ if len(y) >= 50 else np.ones(len(y), bool)
        mean, scale = x[inside].mean(axis=0), x[inside].std(axis=0) + 1e-6
        z, t = (x - mean) / scale, y.astype(np.float64)
        rng = np.random.default_rng(seed)
        layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
        zi, ti = z[inside], t[inside]
        for i in range(1, steps + 1):  # Adam on the full batch: the same sample gives the same network
            h = np.tanh(zi @ layers[0] + layers[1])
            g = (sigmoid(h @ layers[2] + layers[3]) - ti) / len(ti)
            back = np.outer(g, layers[2]) * (1 - h * h)
            grads = [zi.T @ back + l2 * layers[0], back.sum(axis=0), h.T @ g + l2 * layers[2], g.sum(keepdims=True)]
            for j, d in enumerate(grads):
                first[j] = 0.9 * first[j] + 0.1 * d
                second[j] = 0.999 * second[j] + 0.001 * d * d
                layers[j] = layers[j] - rate * (first[j] / (1 - 0.9**i)) / (np.sqrt(second[j] / (1 - 0.999**i)) + 1e-8)
        out = cls(mean, scale, layers, 1.0)
        if (~inside).any():
            logit, target = out.logit(x[~inside]), t[~inside]
            grid = np.geomspace(0.5, 8, 40)
            loss = [-(target * np.log(sigmoid(logit / k) + 1e-12) + (1 - target) * np.log(1 - sigmoid(logit / k) + 1e-12)).mean() for k in grid]
            out.temperature = float(grid[int(np.argmin(loss))])
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.layers[0] + self.layers[1])
        return h @ self.layers[2] + self.layers[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.logit(x) / self.temperature)


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, learn: Column | None = None, size: int = SAMPLE) -> Network:
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tw.pieces(batch):
                x = pool(piece.column(0), held.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), piece.column(1)], names=["x", "y"])

    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marks = (marks if learn is None else marks.where(learn)).select("doc_id", F.col("quality").cast("int").alias("y"))
    got = labelled(docs, hash_sample(marks, "doc_id", size)).mapInArrow(rows, "x binary, y int").toArrow()
    pairs = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist(), strict=True))
    order = np.random.default_rng(1).permutation(len(pairs))
    x = np.frombuffer(b"".join(v for v, _ in pairs), np.float32).reshape(-1, DIMENSIONS).astype(np.float64)
    return Network.fit(x[order], np.array([y for _, y in pairs])[order])


def score(docs: DataFrame, vectors: np.ndarray, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, the calibrated probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))  # of fixed size
    names = docs.columns
    place = names.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in batches:
            for piece in tw.pieces(batch, place):
                p = network.predict(pool(piece.column(place), vectors))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p)], names=[*names, "quality_score"])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose quality score reaches the threshold."""
    vectors = word_vectors(docs)
    tidy, moved = aside(docs, ("quality_score",))
    scored = score(tidy, vectors, train(docs, labels, vectors))
    return restored(scored.where(F.col("quality_score") >= threshold), docs.columns, moved)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    vectors = word_vectors(docs)
    network = train(docs, table(spark, sf_dir, "labels"), vectors, ~held_out)
    scored = score(docs, vectors, network).withColumn("score", F.round("quality_score", 6))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
