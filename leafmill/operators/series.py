"""Outcome series: sliding windows, rates, streaks, budgets, breakers and admission control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import replay
from .relational import running_sum


def failure_rate(df: DataFrame, rows: int = 50, least: int = 10, limit: float = 0.2) -> DataFrame:
    """Failure rate of the last ``rows`` outcomes of each key, and whether it throttles."""
    w = Window.partitionBy("k").orderBy("event_id").rowsBetween(-(rows - 1), 0)
    n, bad = F.count("*").over(w), F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w)
    out = df.withColumn("n", n).withColumn("failure_rate", F.round(bad / n, 6))
    return out.withColumn("throttled", (F.col("n") >= least) & (F.col("failure_rate") > limit))


def offered_load(df: DataFrame, seconds: int = 60, limit: int = 2) -> DataFrame:
    """Requests of a key in the trailing window, the present one included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("k").orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("in_window", F.count("*").over(w)).withColumn("over_limit", F.col("in_window") > limit)


def streaks(df: DataFrame, least: int = 3) -> DataFrame:
    """Consecutive failures up to each outcome; a success resets them."""
    w = Window.partitionBy("k").orderBy("event_id")
    grouped = df.withColumn("g", F.sum(F.col("ok").cast("int")).over(w))
    run = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("k", "g").orderBy("event_id"))
    return grouped.withColumn("streak", run).withColumn("suspend", F.col("streak") >= least).drop("g")


def budget_phase(df: DataFrame, budget: float) -> DataFrame:
    """Running cost per day and the phase it leaves: exhausted at 5 % left, warning at 20 %.  A day is
    summed by hours, so no task holds a whole day."""
    cents = F.round(F.col("value") * 100).cast("long")
    dated = df.withColumn("__day", F.to_date("ts"))
    spent = running_sum(dated, ["__day"], [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"), cents, "spent_cents").drop("__day")
    left = F.greatest(F.lit(0.0), (budget * 100 - F.col("spent_cents")) / (budget * 100))
    out = spent.withColumn("left", F.round(left, 6))
    return out.withColumn("phase", F.when(F.col("left") <= 0.05, "EXHAUSTED").when(F.col("left") <= 0.20, "WARNING").otherwise("NORMAL"))


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def breaker(df: DataFrame, failures: int = 5, window_s: float = 60.0, open_s: float = 60.0, successes: int = 2) -> DataFrame:
    """Circuit breaker state of each key after each outcome (:class:`replay.Breaker`)."""
    return replay.replayed(_timed(df), replay.Breaker, failures=failures, window_s=window_s, open_s=open_s, successes=successes)


def admission(df: DataFrame, limit: int, seconds: float = 60.0, tokens: float = 100_000, idle_s: float = 120.0) -> DataFrame:
    """Whether each request is admitted, and the limit that refuses it (:class:`replay.Admission`).
    ``df`` may have ``tokens``; without, only requests are limited."""
    timed = _timed(df)
    sized = timed.withColumn("tokens", F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)) if "tokens" in df.columns else F.lit(0.0))
    return replay.replayed(sized, replay.Admission, requests=limit, seconds=seconds, tokens=tokens, idle_s=idle_s)


def provider_chain(calls: DataFrame, providers: list[str], retries: int = 2) -> DataFrame:
    """The provider that answers each call, its attempts and the seconds waited: ``answers`` maps a
    provider to the attempt (from 0) that succeeds, if any; a provider is tried ``retries`` more times,
    after 3, 6, 12 ... seconds, before the next one is."""
    start = F.struct(F.lit(None).cast("string").alias("provider"), F.lit(0).alias("attempts"), F.lit(0).alias("waited"))

    def step(acc, name):  # noqa: ANN001, ANN202
        at = F.element_at("answers", name)
        hit = at.isNotNull() & (at <= retries)
        tries = F.when(hit, at).otherwise(retries)
        waited = (3 * (F.pow(F.lit(2), tries) - 1)).cast("int")
        then = F.struct(F.when(hit, name).alias("provider"), (acc["attempts"] + tries + 1).cast("int").alias("attempts"), (acc["waited"] + waited).alias("waited"))
        return F.when(acc["provider"].isNull(), then).otherwise(acc)

    chain = F.array(*[F.lit(p) for p in providers])
    return calls.withColumn("__c", F.aggregate(chain, start, step)).select("*", "__c.provider", "__c.attempts", "__c.waited").drop("__c")


def push_frames(events: DataFrame, terminal: list[str], seconds: int = 30) -> DataFrame:
    """Events (session, event_id, ts, event_type) sent to each session in order, up to the first of a
    terminal type, which closes it.  ``beats``: heartbeats sent before the event, one when the session
    opens, then one each time ``seconds`` pass without an event."""
    w = Window.partitionBy("session")
    ends = F.col("event_type").isin(*terminal)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(micros).over(w.orderBy("event_id"))
    idle = F.greatest(F.lit(0), F.ceil((micros - before) / (seconds * 1_000_000)) - 1)
    out = events.withColumns({"__stop": F.min(F.when(ends, F.col("event_id"))).over(w), "beats": F.when(before.isNull(), 1).otherwise(idle).cast("long"), "closes": ends})
    return out.where(F.col("__stop").isNull() | (F.col("event_id") <= F.col("__stop"))).drop("__stop")
