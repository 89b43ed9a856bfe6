"""Streaming queries and the SQL of the same windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replay
from ..sources import bindings as b
from ..streaming import jobs as st
from .registry import query

@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_ratio FROM events GROUP BY 1""")
def stream_tumbling_error_ratio(spark: SparkSession, sf: str) -> DataFrame:
    out = st.run_to_table(st.tumbling_errors(st.event_stream(spark, sf)), ["start"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = st.run_to_table(st.deduplicated(st.event_stream(spark, sf), ["user_id", "event_type"], "60 days"))
    return out.select("user_id", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session_gap(spark: SparkSession, sf: str) -> DataFrame:
    out = st.run_closed(spark, sf, st.sessions)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
s AS (SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS streak FROM g)
SELECT * FROM s WHERE streak >= 3""")
def stream_failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return st.run_to_table(st.streak_alerts(st.event_stream(spark, sf)))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    ev = st.event_stream(spark, sf)
    return ev.select(
        "event_id", F.col("user_id").alias("k"), (F.unix_micros("ts") / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("double").alias("tokens")
    )


@query(f"""WITH {b.OUTCOMES}, w AS (SELECT event_id, k, count(*) OVER f AS n, round(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER f / count(*) OVER f, 6) AS failure_rate FROM outcomes
  WINDOW f AS (PARTITION BY k ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT event_id, k, n, failure_rate, n >= 10 AND failure_rate > 0.2 AS throttled FROM w""")
def stream_failure_window(spark: SparkSession, sf: str) -> DataFrame:
    return st.run_to_table(st.replayed(_outcomes(spark, sf), replay.FailureWindow))


@query()
def stream_circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """Tested against the batch form."""
    return st.run_to_table(st.replayed(_outcomes(spark, sf), replay.Breaker, failures=3, window_s=86_400.0, open_s=43_200.0))


@query()
def stream_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Tested against the batch form."""
    return st.run_to_table(st.replayed(_outcomes(spark, sf), replay.Admission, requests=2, seconds=36_000.0, tokens=400.0, idle_s=172_800.0))
