"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

An item window is ``window`` consecutive item words (a shorter item is one window), seen as the set
of its word shingles at their offsets.  To contain a window, a document must contain every one of
its shingles, so any single one is a necessary prefix: shingles are ordered by rarity over all
documents and only the rarest of each window is looked up.  A hit fixes where the window would
start; length and positional bounds discard starts outside the document, and the words of the whole
window are then compared exactly.

Benchmarks are processed in blocks of at most ``BLOCK_WINDOWS`` windows.  Each block is counted
before it is broadcast, and a larger benchmark only means more passes, each reading what the former
one wrote.

Defined results: null, empty or word-less texts have no words and no hits; null or word-less items
have no windows; windows of an item with a null id mark hits but name no item; repeated item rows
count once; repeated document rows are each reported.
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
from .shared import aside, materialize, restored, table

WINDOW = 10
SHINGLE = 5
#: Windows in a broadcast block: about 300 bytes each when sent (30 MB) and 2 kB each at the driver's peak
#: (200 MB), while the block's shingles are counted.
BLOCK_WINDOWS = 100_000


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``words`` (joined by spaces), ``n`` and the sorted ``items`` (as strings)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tw.pieces(batch, 1):
                words, _ = tw.tokenize(piece.column(1))
                bounds = np.searchsorted(words.row, np.arange(piece.num_rows + 1))
                out: list[tuple] = []
                for i, item in enumerate(piece.column(0).to_pylist()):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    n = min(window, hi - lo)
                    if n:
                        out += [(words.text(at, at + n), n, item) for at in range(lo, hi - n + 1)]
                if out:
                    w, n, item = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int32()), pa.array(item, pa.string())], names=["words", "n", "item"])

    cells = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return cells.mapInArrow(rows, "words binary, n int, item string").groupBy("words", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


@dataclass
class Block:
    """Windows of a block and the hashes of their shingles, flattened: shingle i is of window
    ``owner[i]``, at word ``offset[i]``, and ``size[i]`` words long."""

    words: list[bytes]
    n: np.ndarray
    items: list[list[str]]
    owner: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, rows: list, shingle: int = SHINGLE) -> Block:
        texts = pa.array([bytes(r["words"]).decode("utf-8", "replace") for r in rows], pa.string())
        words, _ = tw.tokenize(texts)
        owner, offset, size, hashes = [], [], [], []
        first = np.searchsorted(words.row, np.arange(len(rows)))
        n = np.bincount(words.row, minlength=len(rows))
        for k in range(1, shingle + 1):
            h, ok = tw.shingles(words, k)
            ok &= (n[words.row] == k) if k < shingle else True
            at = np.flatnonzero(ok)
            owner.append(words.row[at])
            offset.append(at - first[words.row[at]])
            size.append(np.full(len(at), k))
            hashes.append(h[at])
        return cls([bytes(r["words"]) for r in rows], n, [list(r["items"]) for r in rows], *map(np.concatenate, (owner, offset, size, hashes)))

    def rarest(self, counts: dict[int, int]) -> Block:
        """Only the rarest shingle of each window; windows with one that never occurs are dropped."""
        seen = np.array([counts.get(int(h), 0) for h in self.hash], np.int64)
        order = np.lexsort((self.offset, self.hash, seen, self.owner))
        lead = order[np.unique(self.owner[order], return_index=True)[1]]
        lead = lead[seen[lead] > 0]
        lead = lead[np.argsort(self.hash[lead], kind="stable")]
        return Block(self.words, self.n, self.items, self.owner[lead], self.offset[lead], self.size[lead], self.hash[lead])


def _hits(words: tw.Words, wanted: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per shingle size: positions whose shingle hash is in the sorted ``wanted``, and the hashes."""
    for k in sizes:
        h, ok = tw.shingles(words, k)
        at = np.searchsorted(wanted, h)
        at[at == len(wanted)] = 0
        found = np.flatnonzero(ok & (wanted[at] == h)) if len(wanted) else np.zeros(0, np.int64)
        yield k, found, h[found]


def shingle_counts(docs: DataFrame, block: Block, text_col: str = "text") -> dict[int, int]:
    """How often each shingle of the block occurs in all documents."""
    wanted, sizes = np.unique(block.hash), sorted({int(k) for k in block.size})
    held = docs.sparkSession.sparkContext.broadcast((wanted, sizes))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sizes = held.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for piece in tw.pieces(batch):
                words, _ = tw.tokenize(piece.column(0))
                for _, _, h in _hits(words, wanted, sizes):
                    total += np.bincount(np.searchsorted(wanted, h), minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["h", "c"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return {r["h"] & 0xFFFFFFFFFFFFFFFF: r["c"] for r in counted.collect()}  # one row per shingle of the block at most


def mark(docs: DataFrame, block: Block, text_col: str = "text") -> DataFrame:
    """Adds to ``docs`` n_words, and extends ``spans`` (hit words as [from, to) pairs, flattened) and
    ``items`` (ids of the items with occurring windows) by those of the block."""
    held = docs.sparkSession.sparkContext.broadcast(block)
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    again = "spans" in docs.columns
    place = names.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        sizes = sorted({int(k) for k in block.size})
        for batch in batches:
            for piece in tw.pieces(batch, place):
                words, _ = tw.tokenize(piece.column(place))
                bounds = np.searchsorted(words.row, np.arange(piece.num_rows + 1))
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for k, at, h in _hits(words, block.hash, sizes):
                    lo, hi = np.searchsorted(block.hash, h, "left"), np.searchsorted(block.hash, h, "right")
                    for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                        row = int(words.row[p])
                        for i in range(a, b):
                            w = int(block.owner[i])
                            start = p - int(block.offset[i])
                            end = start + int(block.n[w])
                            if int(block.size[i]) != k or start < bounds[row] or end > bounds[row + 1]:
                                continue
                            if words.text(start, end) == block.words[w]:
                                spans.setdefault(row, []).append((start - int(bounds[row]), end - int(bounds[row])))
                                items.setdefault(row, set()).update(block.items[w])
                old = [piece.column(piece.schema.get_field_index(c)).to_pylist() if again else [[]] * piece.num_rows for c in ("spans", "items")]
                new_spans = [_union(old[0][r], spans.get(r, [])) for r in range(piece.num_rows)]
                new_items = [sorted({*old[1][r], *items.get(r, ())}) for r in range(piece.num_rows)]
                columns = [piece.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array(new_spans, pa.list_(pa.int64())), pa.array(new_items, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])

    extra = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*(docs.schema[c] for c in names), *extra])
    return docs.select(*[F.col(f"`{c}`") for c in names], *(["spans", "items"] if again else [])).mapInArrow(rows, schema)


def _union(old: list[int], more: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted([*zip(old[::2], old[1::2], strict=True), *more]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, spans and items of all benchmark windows that occur."""
    windows = materialize(item_windows(benchmark, window=window), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    for i in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i) if blocks > 1 else windows
        block = Block.of(part.collect())
        lead = block.rarest(shingle_counts(docs, block, text_col))
        docs = mark(docs, lead, text_col)
        if i + 1 < blocks:
            docs = materialize(docs, "marked")
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs."""
    tidy, moved = aside(docs, ("n_words", "spans", "items"))
    found = find_contamination(tidy, benchmark, text_col)
    return restored(found.where(F.size("spans") == 0), docs.columns, moved)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    odd = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        odd.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (odd > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS t
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, pos.n, i FROM pos JOIN win ON pos.t = win.t AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
