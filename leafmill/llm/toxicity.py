"""Toxicity by a classifier chain over categories, trained with out-of-fold predictions.

Features are the presence of words and of word beginnings in a document's whole text, hashed to 32
bits; those that tell the classes apart best on the training sample are kept.  The chain's linear
models are fitted in order: each sees the probabilities of the categories before it.  While training,
these are out-of-fold predictions, so later models meet them as they are on unseen documents; the final
models are fitted on the whole sample.

``labels`` marks only toxicity as a whole.  The categories before it in the chain are kinds of toxic
documents found in the labelled sample itself, whatever its languages: the toxic documents are parted
into ``KINDS`` groups by the telling features that they hold (k-means, begun with the farthest documents),
and the first models learn to tell each group; the last, ``toxic``, is fitted to the label.

The sample is bounded: the documents of ``SAMPLE`` labelled ids, those of lowest hashed id, up to
``TOXIC_SHARE`` of them toxic; rows are weighted so that the classes count as they do among all labels.
Its features are counted on the executors; the driver gets the kept ones and a bitmap of ``FEATURES`` bits
per document, six megabytes with the settings below.

Defined results: null, empty and word-less texts get the models' score of a document without
features; a document labelled more than once counts with its largest label, one that is repeated in the
sample counts once; without labelled documents, or with labels of one kind only, every score is that
kind's constant (0 without labels).  Repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textwork as tw
from .linear import Logistic, Sparse
from .shared import aside, discard, hash_sample, materialize, restored, table

SAMPLE = 12_000
#: Share of the sample that may be toxic.
TOXIC_SHARE = 0.4
FEATURES = 4096
FOLDS = 5
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)

#: Groups of toxic documents that the chain learns to tell before it decides.
KINDS = 2
#: The features most telling of toxic documents, by which these are grouped.
GROUPING = 256
CHAIN = [*(f"kind_{i + 1}" for i in range(KINDS)), "toxic"]


def _features(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of each row's distinct features, sorted by row."""
    words, starts = tw.tokenize(array, prefixes=PREFIXES)
    size = words.end - words.start
    rows, hashes = [words.row], [words.hash]
    for k, h in zip(PREFIXES, starts, strict=True):
        rows.append(words.row[size > k])
        hashes.append(h[size > k])
    row, h = np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[first], h[first]


def kinds(bits: np.ndarray, toxic: np.ndarray, groups: int = KINDS, rounds: int = 20) -> np.ndarray:
    """A row per document and a column per group: whether it is a toxic document of that group.
    ``bits``: documents by features, zeros and ones.  The same rows in the same order give the same
    groups."""
    out = np.zeros((len(bits), groups))
    rows = np.flatnonzero(toxic)
    if len(rows) < groups or not bits.shape[1]:
        return out
    lift = bits[toxic].mean(axis=0) - (bits[~toxic].mean(axis=0) if (~toxic).any() else 0.0)
    telling = np.argsort(-lift, kind="stable")[:GROUPING]
    x = bits[np.ix_(rows, telling[lift[telling] > 0])].astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1.0)
    centres = [x[0]]
    for _ in range(1, groups):
        gap = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[int(np.argmax(gap))])
    centre = np.array(centres)
    for _ in range(rounds):
        own = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1) if x.size < 1 << 22 else np.argmin([((x - c) ** 2).sum(axis=1) for c in centre], axis=0)
        new = np.array([x[own == g].mean(axis=0) if (own == g).any() else centre[g] for g in range(groups)])
        if np.array_equal(new, centre):
            break
        centre = new
    out[rows, own] = 1.0
    return out


@dataclass
class Chain:
    """``known``: the kept features' hashes, sorted.  One model per category."""

    names: list[str]
    known: np.ndarray
    models: list[Logistic]

    @classmethod
    def fit(cls, known: np.ndarray, bits: np.ndarray, toxic: np.ndarray, share: float | None = None, folds: int = FOLDS) -> Chain:
        """``bits``: a row per document, ones where it has the known feature.  ``share``: the toxic share
        among all labels, if the sample's is another."""
        own = toxic.mean() if len(toxic) else 0.0
        even = share is None or own in (0.0, 1.0)
        weight = np.ones(len(toxic)) if even else np.where(toxic, share / own, (1 - share) / (1 - own))
        targets = [*kinds(bits, toxic).T, toxic.astype(np.float64)]
        x = Sparse.of([np.flatnonzero(r) for r in bits], len(known))
        fold = np.arange(len(bits)) % folds
        seen = np.zeros((len(bits), 0))
        models = []
        for y in targets:
            models.append(Logistic.fit(x, seen, y, weight))
            out = np.zeros(len(bits))
            for f in range(folds if len(bits) else 0):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                part = Logistic.fit(x.take(inside), seen[inside], y[inside], weight[inside])
                out[outside] = part.predict(x.take(outside), seen[outside])
            seen = np.column_stack((seen, out))
        return cls(CHAIN, known, models)

    def predict(self, x: Sparse) -> np.ndarray:
        seen = np.zeros((len(x), 0))
        for model in self.models:
            seen = np.column_stack((seen, model.predict(x, seen)))
        return seen

    def score(self, array: pa.Array) -> np.ndarray:
        """Probabilities of all categories for each text."""
        row, h = _features(array)
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        start = np.concatenate(([0], np.cumsum(np.bincount(row[hit], minlength=len(array)))))
        return self.predict(Sparse(start.astype(np.int64), at[hit], len(self.known)))


def labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(text, y) of the documents in ``marks`` (doc_id, y), a bounded sample: its size bounds what is
    broadcast.  A document marked more than once counts with its largest mark, one that is repeated once."""
    once = marks.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(once), "doc_id")
    return found.dropDuplicates(["doc_id", "text"]).select("text", "y")


def telling_features(sample: DataFrame, features: int) -> np.ndarray:
    """The features of ``sample`` (text, y) whose document counts differ most between the classes
    (log-likelihood ratio), at most ``features``; ties go to the smaller hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tw.pieces(batch):
                row, h = _features(piece.column(0))
                toxic = piece.column(1).to_numpy() > 0
                seen, at = np.unique(h, return_inverse=True)
                n = np.bincount(at, minlength=len(seen))
                pos = np.bincount(at, toxic[row].astype(np.float64), minlength=len(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n), pa.array(pos)], names=["h", "n", "pos"])

    counts = sample.mapInArrow(rows, "h long, n long, pos long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where("n >= 2")
    share = sample.agg(F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0))).first()[0]
    if not share or share == 1.0:
        return np.zeros(0, np.uint32)
    half = lambda k, p: F.when(k > 0, k * F.ln(k / (F.col("n") * p))).otherwise(0.0)
    gain = half(F.col("pos"), share) + half(F.col("n") - F.col("pos"), 1 - share)
    best = counts.withColumn("gain", F.round(gain, 6)).where("gain > 2").orderBy(F.desc("gain"), "h").limit(features).select("h").toArrow()
    return np.sort(best.column("h").to_numpy().astype(np.uint32))


def present(known: np.ndarray, row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """A row of zeros and ones over the known features for each of ``rows`` documents."""
    out = np.zeros((rows, len(known)), np.uint8)
    if len(known):
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        hit = known[at] == h
        out[row[hit], at[hit]] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, features: int = FEATURES) -> Chain:
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    share = marks.agg(F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0))).first()[0]
    bad, good = hash_sample(marks.where("y > 0"), "doc_id", int(size * TOXIC_SHARE)), hash_sample(marks.where("y <= 0"), "doc_id", int(size * (1 - TOXIC_SHARE)))
    sample = materialize(labelled(docs, bad.unionByName(good)), "sample")
    known = telling_features(sample, features)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tw.pieces(batch):
                packed = np.packbits(present(known, *_features(piece.column(0)), piece.num_rows), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), piece.column(1)], names=["bits", "y"])

    got = sample.mapInArrow(rows, "bits binary, y int").toArrow()
    discard(sample)
    # In an order of their own, whatever the partitions: the same sample gives the same model.
    pairs = sorted(zip(got.column("bits").to_pylist(), got.column("y").to_pylist(), strict=True))
    packed = np.frombuffer(b"".join(v for v, _ in pairs), np.uint8).reshape(len(pairs), -1) if pairs else np.zeros((0, 0), np.uint8)
    bits = np.unpackbits(packed, axis=1, count=len(known)) if len(known) else np.zeros((len(pairs), 0), np.uint8)
    return Chain.fit(known, bits, np.array([y > 0 for _, y in pairs], bool), share)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` for every category."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES bounds it
    names = docs.columns
    place = names.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        for batch in batches:
            for piece in tw.pieces(batch, place):
                p = chain.score(piece.column(place))
                yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(c) for c in p.T)], names=[*names, *(f"p_{c}" for c in chain.names)])

    extra = [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.names]
    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *extra]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose probability of being toxic is below the threshold."""
    tidy, moved = aside(docs, tuple(f"p_{c}" for c in CHAIN))
    scored = score(tidy, train(docs, labels))
    return restored(scored.where(F.col("p_toxic") < threshold), docs.columns, moved)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CHAIN], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
