"""Outcome series, tasks and jobs over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from ..operators import tasks as tk
from ..sources import bindings as b
from .registry import query


@query(f"""WITH {b.OUTCOMES}, w AS (SELECT event_id, k, count(*) OVER f AS n, round(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER f / count(*) OVER f, 6) AS failure_rate FROM outcomes
  WINDOW f AS (PARTITION BY k ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT event_id, k, n, failure_rate, n >= 10 AND failure_rate > 0.2 AS throttled FROM w""")
def sliding_failure_rate(spark: SparkSession, sf: str) -> DataFrame:
    return series.failure_rate(b.outcomes(spark, sf)).select("event_id", "k", "n", "failure_rate", "throttled")


@query(f"""WITH {b.OUTCOMES}, w AS (SELECT event_id, k, count(*) OVER (PARTITION BY k ORDER BY epoch_us(ts) RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) AS in_window FROM outcomes)
SELECT event_id, k, in_window, in_window > 2 AS over_limit FROM w""")
def rate_limit_window(spark: SparkSession, sf: str) -> DataFrame:
    """A window of ten hours, as the events are sparse."""
    return series.offered_load(b.outcomes(spark, sf), seconds=36_000).select("event_id", "k", "in_window", "over_limit")


@query(f"""WITH {b.OUTCOMES}, g AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY k ORDER BY event_id) AS g FROM outcomes),
s AS (SELECT event_id, k, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY k, g ORDER BY event_id) AS BIGINT) AS streak FROM g)
SELECT event_id, k, streak, streak >= 3 AS suspend FROM s""")
def fallback_streak(spark: SparkSession, sf: str) -> DataFrame:
    return series.streaks(b.outcomes(spark, sf)).select("event_id", "k", "streak", "suspend")


@query(f"""WITH {b.OUTCOMES}, c AS (SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent_cents FROM outcomes),
l AS (SELECT *, round(greatest(0.0, (1500000.0::DOUBLE - spent_cents) / 1500000.0::DOUBLE), 6) AS "left" FROM c)
SELECT event_id, spent_cents, "left", CASE WHEN "left" <= 0.05 THEN 'EXHAUSTED' WHEN "left" <= 0.2 THEN 'WARNING' ELSE 'NORMAL' END AS phase FROM l""")
def daily_budget_phase(spark: SparkSession, sf: str) -> DataFrame:
    return series.budget_phase(b.outcomes(spark, sf), 15_000.0).select("event_id", "spent_cents", "left", "phase")


@query()
def circuit_breaker_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds back on its own state: tested against a plain simulation."""
    return series.breaker(b.outcomes(spark, sf), failures=3, window_s=86_400.0, open_s=43_200.0)


@query()
def admission_control(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds back on its own decisions: tested against a plain simulation."""
    calls = b.outcomes(spark, sf).withColumn("tokens", F.get_json_object("props", "$.k").cast("double"))
    return series.admission(calls, limit=2, seconds=36_000.0, tokens=400.0, idle_s=172_800.0)


@query(f"""WITH {b.TASKS}, o AS (SELECT * FROM tasks WHERE status = 'CREATED'), a AS (SELECT *, CASE WHEN priority = 'NORMAL' AND age_minutes > 15 THEN 'HIGH' ELSE priority END AS p1 FROM o),
c AS (SELECT *, CASE WHEN p1 = 'HIGH' AND age_minutes > 30 THEN 'CRITICAL' ELSE p1 END AS p2 FROM a),
d AS (SELECT *, p2 = 'CRITICAL' AND age_minutes > 120 AND ai_confidence > 0.6 AS acc, CASE WHEN p2 = 'CRITICAL' AND age_minutes > 120 AND NOT ai_confidence > 0.6 THEN 'AUTO_RESOLVE' ELSE p2 END AS p3 FROM c),
e AS (SELECT *, NOT acc AND p3 = 'AUTO_RESOLVE' AND age_minutes > 180 AS part FROM d)
SELECT task, priority, age_minutes, p3 AS new_priority, CASE WHEN acc OR part THEN 'COMPLETED' ELSE status END AS new_status,
  CASE WHEN acc THEN 'auto_accepted' WHEN part THEN 'partial_acceptance' WHEN p3 <> priority THEN 'boosted' ELSE 'none' END AS action, acc AND task % 20 = 0 AS review_again FROM e""")
def sla_escalation(spark: SparkSession, sf: str) -> DataFrame:
    return tk.escalate(b.tasks(spark, sf))


@query(f"""WITH {b.TASKS} SELECT task, 'PROCESSING' AS from_status, CASE WHEN rework >= 5 THEN 'SKIPPED' ELSE 'CREATED' END AS to_status,
  CASE WHEN rework >= 5 THEN 'max_rework_exceeded' ELSE 'lock_timeout' END AS trigger FROM tasks WHERE status = 'PROCESSING' AND age_minutes > 5""")
def lock_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return tk.release_locks(b.tasks(spark, sf))


@query(f"""WITH {b.TASKS}, a AS (SELECT *, status IN ('COMPLETED', 'PROCESSING') AND (status = 'PROCESSING' OR rework < 5) AS ok FROM tasks)
SELECT task, status, ok AS allowed, CAST(CASE WHEN ok AND status <> 'PROCESSING' THEN rework + 1 ELSE rework END AS INTEGER) AS rework_after FROM a""")
def task_revert(spark: SparkSession, sf: str) -> DataFrame:
    return tk.revert(b.tasks(spark, sf))


_MOVES = """CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'ESCALATED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'SKIPPED' END"""
_ALLOWED = ", ".join(f"('{x}', '{y}')" for x, y in tk.TASK_TRANSITIONS)


@query(f"""WITH m AS (SELECT user_id AS entity, event_id AS seq, {_MOVES} AS to_status, lag({_MOVES}) OVER (PARTITION BY user_id ORDER BY event_id) AS from_status FROM events)
SELECT entity, seq, from_status, to_status, (from_status, to_status) IN ({_ALLOWED}) AS allowed FROM m WHERE from_status IS NOT NULL""")
def transition_audit(spark: SparkSession, sf: str) -> DataFrame:
    log = b.table(spark, sf, "events").selectExpr("user_id AS entity", "event_id AS seq", f"{_MOVES} AS status")
    return tk.audit(log, tk.transitions(spark))


_FIN = """count(*) AS total, count(*) FILTER (status = 'BLANK') AS blank, count(*) FILTER (status IN ('AI_FAILED','IMPORT_FAILED','DEAD_LETTER')) AS failed,
  count(*) FILTER (status IN ('HUMAN_QUEUED','HUMAN_PROCESSING')) AS human, count(*) FILTER (status IN ('AI_COMPLETED','HUMAN_COMPLETED','IMPORTED_CONFIRMED','IMPORTED_ASSUMED','SKIPPED')) AS done"""


@query(f"""WITH {b.JOB_PAGES}, g AS (SELECT job, {_FIN} FROM job_pages GROUP BY job),
s AS (SELECT *, CASE WHEN failed > 0 THEN 'PARTIAL_FAILED' WHEN human > 0 THEN 'PROCESSING' WHEN done >= total - blank THEN 'FULL_IMPORTED' ELSE 'PROCESSING' END AS job_status FROM g)
SELECT *, CASE job_status WHEN 'PARTIAL_FAILED' THEN 'partial_success' WHEN 'FULL_IMPORTED' THEN 'completed' ELSE 'processing' END AS user_status FROM s""")
def finalize_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return tk.finalise(b.job_pages(spark, sf))


_RECON = """CASE WHEN status = 'IMPORTED_ASSUMED' AND (downstream OR age_hours > 24) THEN 'IMPORTED_CONFIRMED' WHEN status = 'AI_FAILED' AND age_hours > 24 THEN 'BLANK' ELSE status END"""


@query(f"""WITH {b.JOB_PAGES}, r AS (SELECT job, {_RECON} AS s FROM job_pages),
g AS (SELECT job, count(*) AS total, count(*) FILTER (s = 'BLANK') AS blank, count(*) FILTER (s = 'AI_FAILED') AS failed, count(*) FILTER (s LIKE 'HUMAN_Q%' OR s = 'HUMAN_PROCESSING') AS human,
  count(*) FILTER (s IN ('IMPORTED_CONFIRMED','HUMAN_COMPLETED','SKIPPED')) AS done FROM r GROUP BY job)
SELECT *, CASE WHEN human > 0 THEN 'WAITING' WHEN total - blank > 0 AND failed = total - blank THEN 'STAYS_FAILED' WHEN done >= total - blank THEN 'FULL_IMPORTED' ELSE 'OPEN' END AS outcome FROM g""")
def reconcile_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return tk.reconcile_jobs(tk.reconcile_pages(b.job_pages(spark, sf)))


@query(f"""WITH {b.JOB_PAGES} SELECT job, page_no, status, {_RECON} AS new_status FROM job_pages WHERE {_RECON} <> status""")
def reconcile_pages(spark: SparkSession, sf: str) -> DataFrame:
    return tk.reconcile_pages(b.job_pages(spark, sf)).where("new_status <> status").select("job", "page_no", "status", "new_status")


@query("""SELECT DISTINCT concat_ws(':', l_orderkey, l_linenumber, l_partkey % 3, 1) AS dedup_key FROM lineitem WHERE l_returnflag <> 'N'
EXCEPT SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey % 3, 1) FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'""")
def import_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    li = b.table(spark, sf, "lineitem").withColumn("dedup_key", F.concat_ws(":", *[c.cast("string") for c in (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey") % 3, F.lit(1))]))
    imported = li.where("l_shipdate < TIMESTAMP_NTZ '1997-01-01'").select("dedup_key")
    return tk.import_plan(li.withColumn("validity", F.when(F.col("l_returnflag") != "N", "valid").otherwise("invalid")), imported)


_ENDED = "'FULL_IMPORTED', 'PARTIAL_IMPORTED'"


@query(f"""WITH {b.JOBS}, {b.JOB_PAGES}, {b.IMAGES}, {b.TASKS}, st AS (SELECT job, status, CASE WHEN job % 40 = 3 THEN 'completed' WHEN status IN ('UPLOADED','EVALUATING','EVALUATED','PROCESSING','ORPHANED') THEN 'processing'
  WHEN status IN ('EVAL_FAILED','CANCELLED','REJECTED') THEN 'failed' WHEN status IN ('PARTIAL_FAILED','PARTIAL_IMPORTED') THEN 'partial_success' WHEN status = 'DEGRADED_HUMAN' THEN 'needs_manual' ELSE 'completed' END AS stored,
  CASE WHEN status IN ('UPLOADED','EVALUATING','EVALUATED','PROCESSING','ORPHANED') THEN 'processing' WHEN status IN ('EVAL_FAILED','CANCELLED','REJECTED') THEN 'failed'
  WHEN status IN ('PARTIAL_FAILED','PARTIAL_IMPORTED') THEN 'partial_success' WHEN status = 'DEGRADED_HUMAN' THEN 'needs_manual' ELSE 'completed' END AS due FROM jobs)
SELECT 'INV-03' AS rule, image AS entity FROM images WHERE width > 150 AND least(width, height) < 200
UNION ALL SELECT 'INV-04', CAST(job AS VARCHAR) FROM jobs WHERE status IN ({_ENDED}) AND EXISTS (SELECT 1 FROM job_pages p WHERE p.job = jobs.job AND p.status NOT IN ('IMPORTED_CONFIRMED', 'IMPORTED_ASSUMED', 'BLANK', 'SKIPPED'))
UNION ALL SELECT 'INV-10', CAST(job AS VARCHAR) FROM st WHERE stored <> due
UNION ALL SELECT 'INV-11', CAST(job AS VARCHAR) FROM (SELECT job FROM tasks WHERE status = 'PROCESSING' GROUP BY job HAVING count(*) > 1)""")
def invariant_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Images marked for search though small, finished jobs with pages that are not imported, client
    states that do not follow the job's, and entities claimed more than once at a time (here a job's tasks)."""
    from ..functions.vocab import user_status
    from ..operators import audit

    j = b.jobs(spark, sf)
    shown = b.images(spark, sf).withColumns({"search_eligible": F.col("width") > 150, "short_edge": F.least("width", "height")})
    stored = j.withColumn("user_status", F.when(F.col("job") % 40 == 3, "completed").otherwise(user_status(F.col("status"))))
    claims = b.tasks(spark, sf).where("status = 'PROCESSING'").select(F.col("job").alias("entity"))
    return audit.violations(audit.small_eligible(shown, 200), audit.unfinished(j, b.job_pages(spark, sf)), audit.stale_user_status(stored), audit.double_claims(claims))


@query("""SELECT l_orderkey AS task, count(*) AS total, count(*) FILTER (l_returnflag <> 'N') AS succeeded, count(*) FILTER (l_returnflag = 'N') AS failed FROM lineitem GROUP BY 1""")
def batch_tallies(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("l_returnflag") == "N"
    return b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"))


@query("""SELECT user_id AS session, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30""")
def session_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The newest events of each session; older ones drop out."""
    from ..operators.relational import top_per

    ev = b.table(spark, sf, "events").select(F.col("user_id").alias("session"), "event_id")
    return top_per(ev, ["session"], [F.desc("event_id")], 30).select("session", "event_id")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_ratio, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.5), 4) AS p50 FROM events GROUP BY 1""")
def alert_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Error ratio and latency percentiles per tumbling window.  The percentiles are exact to a
    hundredth: a window's aggregate counts distinct values, rounded so, and never holds its rows."""
    ev = b.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp")).withColumn("value", F.round("value", 2))
    g = ev.groupBy(F.window("t", "1 hour"))
    out = g.agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 4).alias("error_ratio"),
        F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("p50"),
    )
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "error_ratio", "p95", "p50")
