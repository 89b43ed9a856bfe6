"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

Each source's documents queue in a shuffled order and may come round up to ``max_passes`` times.  A
copy's virtual finish time is the source's cumulative size up to it divided by the source's target;
copies are served in order of finish time until the budget is spent, so each source's served size
follows its target.

No source is gathered in one task: a document's place in its queue comes from a hash, whose leading
digits cut every queue into ``16 ** SLICE_DIGITS`` slices; slices are summed, the sums accumulated,
and documents ordered only within their slice.  In the same way virtual time is cut into slices,
that is a range sort with ranges known beforehand: slices before the one in which the budget ends
are taken whole, that one is cut into finer ones, and only the finer one in which it ends is sorted.

Defined results: a null or blank text has size 0 and is never taken; null sources form one source,
ranked last; rows that repeat each other are documents of their own; an empty table gives an empty
mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, table

#: Hexadecimal digits of the queue hash that number a slice: 4096 slices a source.
SLICE_DIGITS = 3
#: Slices of a unit of virtual time, and of the slice in which the budget ends.
TIME_SLICES = 4096
FINER = 1024
MAX_PASSES = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_passes: int = MAX_PASSES) -> DataFrame:
    """From (source, source_size): adds rank, weight and target.

    The weights repeat over the sources in order (null last).  Targets share the sum of all sizes
    by weight; what exceeds max_passes times a source's size is shared again by weight among the
    others.  In order of size per weight, a source is capped exactly if its cap is less than its
    share of what those before it leave.  One row per source; the windows run over those rows only.
    """
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    shared = weighed.withColumn("cap", F.col("source_size").cast("double") * max_passes).select(
        "*",
        ((F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)).alias("unit"),
    )
    free = shared.withColumn("free", F.col("cap") >= F.col("unit") * F.col("weight"))
    level = F.first(F.when(F.col("free"), F.col("unit")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first_free = F.min(F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(every)
    capped = F.col("cap") / F.col("weight") < first_free
    return free.select("source", "source_size", "rank", "weight", F.when(capped, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, place): size in words, place a hash that shuffles the source's documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary")).alias("place"),
    )


def finish_times(queued: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """Adds source_size, rank, target and ``before``: the size ahead of the document in its queue."""
    cut = queued.withColumn("slice", F.conv(F.substring("place", 1, SLICE_DIGITS), 16, 10).cast("int"))
    sums = cut.groupBy("source", "slice").agg(F.sum("size").alias("held"))
    sums = materialize(sums, "slices")
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goals = materialize(targets(sums.groupBy("source").agg(F.sum("held").alias("source_size")), max_passes=max_passes), "targets")
    slices = sums.select("source", "slice", ahead.alias("ahead"))
    slices = materialize(slices.join(goals, slices["source"].eqNullSafe(goals["source"])).drop(goals["source"]), "ahead")
    within = Window.partitionBy("source", "slice").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    on = placed["source"].eqNullSafe(slices["source"]) & (placed["slice"] == slices["slice"])
    return placed.join(slices, on).select(
        "id", placed["source"], "size", "place", "source_size", "rank", "target", (F.col("ahead") + F.col("inside")).alias("before")
    )


def _edge(spanned: DataFrame, room: int, most: int | None) -> Row | None:
    """The slice (span, held, spent) in which ``room`` ends, or None if it holds all.  Slices from ``most``
    on are summed as one first: targets add up to the budget, so virtual time hardly runs past 1, and
    only if it does are they told apart."""
    run = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    near = spanned.withColumn("span", F.least(F.col("span"), F.lit(most))) if most is not None else spanned
    sums = near.groupBy("span").agg(F.sum("size").alias("held"))  # a row per slice
    edge = sums.withColumn("spent", F.sum("held").over(run)).where(F.col("spent") > room).orderBy("span").first()
    return _edge(spanned, room, None) if edge is not None and edge["span"] == most else edge


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_passes: int = MAX_PASSES) -> DataFrame:
    """Per document: id, source, size, source_size, target, and ``copies``, how often it is taken."""
    queued = materialize(queue(docs, id_col, text_col, source_col), "queue")
    placed = materialize(finish_times(queued, max_passes), "placed")
    # Virtual finish time of each pass of a document; sizes of 0 never queue.
    finish = F.transform(
        F.sequence(F.lit(0), F.lit(max_passes - 1)),
        lambda p: (p * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target"),
    )
    timed = placed.where("size > 0").select("rank", "place", "id", "size", F.explode(finish).alias("finish"))
    budget = placed.agg(F.sum("size")).first()[0] or 0
    room, inside, cut = budget, timed, None
    # The budget ends in one slice of virtual time, and in one of that slice's slices; only these are sorted.
    for width in (TIME_SLICES, TIME_SLICES * FINER):
        edge = _edge(inside.withColumn("span", F.floor(F.col("finish") * width)), room, 2 * width if width == TIME_SLICES else None)
        if edge is None:
            break
        room -= edge["spent"] - edge["held"]
        inside = inside.where(F.floor(F.col("finish") * width) == edge["span"])
    else:
        order = Window.orderBy("finish", "rank", "place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
        used = inside.withColumn("used", F.sum("size").over(order))
        cut = used.where(F.col("used") > room).orderBy("finish", "rank", "place", "id", "size").first()

    def served(f: Column) -> Column:
        if cut is None:
            return F.lit(True)
        last = F.struct(*[F.lit(cut[c]).cast(timed.schema[c].dataType).alias(c) for c in ("rank", "place", "id", "size")])
        return (f < cut["finish"]) | ((f == cut["finish"]) & (F.struct("rank", "place", "id", "size") < last))

    taken = F.when(F.col("size") > 0, F.size(F.filter(finish, served))).otherwise(0)
    return placed.select("id", "source", "size", "source_size", "target", taken.alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP4_SQL = r"""
WITH RECURSIVE q AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS place FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM q GROUP BY source),
w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap, sum(CAST(source_size AS DOUBLE)) OVER () AS budget FROM s),
u AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM w),
f AS (SELECT cap / weight AS edge, unit FROM u WHERE cap >= unit * weight ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN cap / weight < (SELECT edge FROM f) THEN cap ELSE (SELECT unit FROM f) * weight END AS target FROM u),
p AS (
  SELECT q.*, t.source_size, t.rank, t.target,
    sum(q.size) OVER (PARTITION BY q.source ORDER BY place, doc_id, q.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(n * source_size + upto AS DOUBLE) / target AS finish FROM p, (SELECT unnest([0, 1, 2]) AS n) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, place, doc_id, size ROWS UNBOUNDED PRECEDING) AS used FROM c),
k AS (SELECT place, doc_id, rank, count(*) AS copies FROM o WHERE used <= (SELECT sum(size) FROM q) GROUP BY ALL)
SELECT p.doc_id, p.size, CAST(p.source_size AS BIGINT) AS source_size, p.target, CAST(p.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM p LEFT JOIN k ON p.place = k.place AND p.doc_id = k.doc_id AND p.rank = k.rank
"""
