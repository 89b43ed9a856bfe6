"""Structured Streaming forms: windows, deduplication, sessions, stateful outcomes, idempotent sinks.

The batch operators specify the results; a stream over the same rows with an available-now trigger
gives them.  Windows are kept as state only until the watermark passes them: changed ones are sent on at
once and the newest version of each counts, or, where a window may only be sent when it is closed, a last
row from far ahead closes those still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import replay
from ..sources.store import shared_path

#: When the row that closes all windows happens.
END = "2999-01-01 00:00:00"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events as a stream; event time becomes a TIMESTAMP, as watermarks need."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source reads folders; a glob also matches a single file.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path + "*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_errors(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    n = F.count("*")
    bad = F.count_if(F.col("event_type") == "error")
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(n.alias("n"), bad.alias("errors"))
    return g.select(F.col("window.start").alias("start"), "n", "errors", F.round(F.col("errors") / F.col("n"), 4).alias("error_ratio"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def streak_alerts(events: DataFrame, least: int = 3) -> DataFrame:
    """Failures in a row per user, kept as state: a row for each outcome that reaches ``least``."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        out = []
        for pdf in [pd.concat(list(batches)).sort_values("event_id")]:
            for event, kind in zip(pdf["event_id"], pdf["event_type"], strict=True):
                run = run + 1 if kind == "error" else 0
                if run >= least:
                    out.append((event, key[0], run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "streak"])

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, streak long", "run long", "append", GroupStateTimeout.NoTimeout)


def replayed(stream: DataFrame, machine: type, **settings: Any) -> DataFrame:
    """:func:`operators.replay.replayed` as a stream: every key's machine is kept as state from batch to
    batch.  Rows of a key come in order of event_id across batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = ["event_id", "k", *(n for n, _ in machine.outputs)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = machine(**settings)
        if state.exists:
            live.load(state.get)
        pdf = pd.concat(list(batches)).sort_values("event_id")
        out = [(event, key[0], *live.step(*values)) for event, *values in zip(pdf["event_id"], *[pdf[c] for c in machine.inputs], strict=True)]
        state.update(live.save())
        yield pd.DataFrame(out, columns=names)

    rows = stream.select("event_id", F.col("k").cast("long").alias("k"), *machine.inputs)
    return rows.groupBy("k").applyInPandasWithState(step, replay.schema_of(machine), machine.state, "append", GroupStateTimeout.NoTimeout)


def _run(stream: DataFrame, mode: str, path: str) -> bool:
    """Runs ``stream`` over what is there; its results are added to a table by batch.  False if there
    was no batch yet."""

    def each(batch: DataFrame, epoch: int) -> None:  # a folder per batch: one that runs again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{path}/table/epoch={epoch}")

    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return q.lastProgress is not None


def run_to_table(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its result table, written to the shared folder.
    With ``keys``, changed results are sent on and the newest row of a key counts."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    if not _run(stream, "update" if keys else "append", path):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, epoch long").parquet(f"{path}/table")
    if keys:
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("epoch")))
        rows = rows.withColumn("__n", newest).where("__n = 1")
    return rows.select(*stream.columns)


def run_closed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The windows that ``build`` makes of the events, each sent when it is closed.  After the events the
    same query goes on with one row from far ahead, which moves the watermark past all of them; that row's
    own window stays open."""
    path = shared_path(spark, "closed")
    live = event_stream(spark, sf_dir)
    last = f"{path}/last"
    spark.createDataFrame([], live.schema).write.parquet(last)

    def stream() -> DataFrame:
        return build(event_stream(spark, sf_dir).unionByName(spark.readStream.schema(live.schema).parquet(last)))

    if not _run(stream(), "append", path):
        return spark.createDataFrame([], stream().schema)
    row = spark.range(1).select(*[(F.lit(END) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in live.schema.fields])
    row.write.mode("append").parquet(last)
    done = stream()
    _run(done, "append", path)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in done.schema.fields)}, epoch long").parquet(f"{path}/table").select(*done.columns)


def fan_out(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> dict[str, str]:
    """Each batch goes to every handler; one that fails does not keep the others from running.
    Returns the errors by handler."""
    errors: dict[str, str] = {}

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for name, handle in handlers.items():
            try:
                handle(batch, epoch)
            except Exception as e:  # one handler's failure is its own
                errors[name] = str(e)
        batch.unpersist()

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return errors
