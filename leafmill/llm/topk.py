"""Exact top-k inner products: tiles of queries by shards, partial selection, tree merging.

Queries are taken in blocks of bounded bytes; each block is sent to all tasks and multiplied with
every candidate vector, tile by tile, in one matrix product.  A task keeps the k best of each query,
and the lists are merged in two steps, first within groups of tasks and then per query, so no task
meets more than a fan-in of short lists.

Scores are integers and exact: products are taken in doubles where their sums stay below 2**53, else
in Python integers, and cut to the range of a long.

Defined results: vectors that are null, or hold a null or non-finite component, take no part;
vectors of different lengths are compared as if the shorter ended in zeros; rows of the query's own
id are no candidates; rows that repeat an id are candidates of their own, and a repeated query id
asks once, with its smallest vector.  A null id is a candidate that ranks after others of its score,
never a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, table

SCALE = 1024
#: Bytes of a query block; it is counted before it is broadcast.
BLOCK_BYTES = 16 << 20
#: Candidate vectors in a tile, and queries multiplied with it at once: 8 MB of scores.
TILE = 2048
QUERIES_AT_ONCE = 512
FAN_IN = 32
_NO_ID = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null and no non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    offsets = np.asarray(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    width = max(int(lengths.max(initial=0)), width or 0)
    if len(lengths) and (lengths == width).all():
        return np.floor(values[offsets[0] : offsets[-1]].reshape(-1, width) * SCALE)
    out = np.zeros((len(lengths), width))
    for i, (a, n) in enumerate(zip(offsets[:-1], lengths, strict=True)):
        out[i, :n] = values[a : a + n]
    return np.floor(out * SCALE)


def _scores(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    width = max(queries.shape[1], tile.shape[1])
    wide = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    q, t = wide(queries), wide(tile)
    most = np.abs(q).max(initial=0) * np.abs(t).max(initial=0) * max(width, 1)
    if most < 2**53:
        return (q @ t.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    product = exact(q).dot(exact(t).T) if width else np.zeros((len(q), len(t)), object)
    return np.clip(product, -(2**63), 2**63 - 1).astype(np.int64)


def _keep(scores: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of queries by candidates the k best of each row, without the query's own id: row
    numbers, scores and ids.  Ids are in ascending order, so that of equal scores the first columns count."""
    rows, width = scores.shape
    own = ids[None, :] == asked[:, None]
    if width > k:
        # The k-th highest score of a row, its own id left out; what is above it stays, and of those equal
        # to it as many of the first as there is room for.
        low = np.where(own, np.iinfo(np.int64).min, scores)
        edge = np.partition(low, width - k, axis=1)[:, width - k][:, None]
        above = low > edge
        level = (low == edge) & ~own
        room = k - above.sum(axis=1, keepdims=True)
        stay = (above | (level & (np.cumsum(level, axis=1) <= room))) & ~own
    else:
        stay = ~own
    row, at = np.nonzero(stay)
    return row, scores[row, at], ids[at]


def _partial(block: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query among each task's candidates."""
    rows = block.toArrow()
    ids = rows.column("id").to_numpy()
    lists = rows.column("v").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    held = candidates.sparkSession.sparkContext.broadcast((ids, _matrix(lists)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, queries = held.value
        none = np.zeros(0, np.int64)
        best_row, best_score, best_id = none, none, none
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                own = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                own, tile = own[order], _matrix(part.column(1))[order]
                found = [(best_row, best_score, best_id)]
                for lo in range(0, len(asked), QUERIES_AT_ONCE):
                    row, score, vec = _keep(_scores(queries[lo : lo + QUERIES_AT_ONCE], tile), own, asked[lo : lo + QUERIES_AT_ONCE], k)
                    found.append((row + lo, score, vec))
                row, score, vec = (np.concatenate(c) for c in zip(*found, strict=True))
                # ~score falls as the score rises and never overflows.
                line = np.lexsort((vec, ~score, row))
                row = row[line]
                place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                line = line[place < k]
                best_row, best_score, best_id = row[place < k], score[line], vec[line]
        if len(best_row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked[best_row]), pa.array(best_id, mask=best_id == _NO_ID), pa.array(best_score)], names=["query_id", "vec_id", "score"]
            )

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("shard", F.spark_partition_id())


def _merge(lists: DataFrame, k: int, *group: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id", *group).orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return lists.withColumn("rank", place).where(F.col("rank") <= k)


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query."""
    tidy = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    asked = tidy(queries).where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "queries")
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    from_all = tidy(candidates)
    merged = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else asked
        lists = _merge(_partial(block, from_all, k), k, F.floor(F.col("shard") / FAN_IN))
        final = _merge(lists.drop("rank"), k)
        if blocks > 1:
            final = materialize(final, "top")
        merged = final if merged is None else merged.unionByName(final)
    return merged.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where("vec_id % 100 = 0"), vectors)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
