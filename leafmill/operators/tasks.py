"""Human tasks and jobs: queues, service levels, locks, dispatch, transitions, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocab import TASK_TRANSITIONS, action_hint, user_status


def priority_order(priority: Column) -> Column:
    """Urgent first; priorities without a place in the queue (CRITICAL among them) come last."""
    return F.when(priority == "URGENT", 1).when(priority == "HIGH", 2).when(priority == "NORMAL", 3).asc_nulls_last()


def claim_next(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The tasks that would be claimed next."""
    return tasks.where("status = 'CREATED'").orderBy(priority_order(F.col("priority")), "created_at", "task").limit(n)


def escalate(tasks: DataFrame, accept: float = 0.6, review_share: int = 20) -> DataFrame:
    """The state of open tasks after one scan of the service levels at their age.  A boost within the
    scan counts for the later levels, so old tasks pass several; the third level accepts confident
    results, the fourth accepts partially.  One in ``review_share`` accepted tasks is reviewed again."""
    age, p, c = F.col("age_minutes"), F.col("priority"), F.col("ai_confidence")
    p1 = F.when((p == "NORMAL") & (age > 15), "HIGH").otherwise(p)
    p2 = F.when((p1 == "HIGH") & (age > 30), "CRITICAL").otherwise(p1)
    third = (p2 == "CRITICAL") & (age > 120)
    accepted = third & (c > accept)
    p3 = F.when(third & ~accepted, "AUTO_RESOLVE").otherwise(p2)
    partial = ~accepted & (p3 == "AUTO_RESOLVE") & (age > 180)
    out = tasks.where("status IN ('CREATED', 'ESCALATED')").withColumns({"new_priority": p3, "__a": accepted, "__p": partial})
    return out.select(
        "task", "priority", "age_minutes", "new_priority",
        F.when(F.col("__a") | F.col("__p"), "COMPLETED").otherwise(F.col("status")).alias("new_status"),
        F.when(F.col("__a"), "auto_accepted").when(F.col("__p"), "partial_acceptance").when(F.col("new_priority") != p, "boosted").otherwise("none").alias("action"),
        (F.col("__a") & (F.col("task") % review_share == 0)).alias("review_again"),
    )


def release_locks(tasks: DataFrame, timeout_minutes: int = 5, max_rework: int = 5) -> DataFrame:
    """Tasks whose lock expired go back to the queue, or are skipped after too much rework."""
    return tasks.where((F.col("status") == "PROCESSING") & (F.col("age_minutes") > timeout_minutes)).select(
        "task", F.lit("PROCESSING").alias("from_status"), F.when(F.col("rework") >= max_rework, "SKIPPED").otherwise("CREATED").alias("to_status"),
        F.when(F.col("rework") >= max_rework, "max_rework_exceeded").otherwise("lock_timeout").alias("trigger"),
    )


def revert(tasks: DataFrame, max_rework: int = 5) -> DataFrame:
    """Which tasks may be reverted; releasing one in work is no rework."""
    can = F.col("status").isin("COMPLETED", "SKIPPED", "PROCESSING") & ((F.col("status") == "PROCESSING") | (F.col("rework") < max_rework))
    return tasks.select("task", "status", can.alias("allowed"), F.when(can & (F.col("status") != "PROCESSING"), F.col("rework") + 1).otherwise(F.col("rework")).alias("rework_after"))


def load(annotators: DataFrame, tasks: DataFrame, most: int = 10) -> DataFrame:
    """Annotators with fewer than ``most`` tasks in work, the idle ones with 0."""
    on = (F.col("annotator") == F.col("assigned_to")) & (F.col("status") == "PROCESSING")
    return annotators.join(tasks.select("assigned_to", "status", "task"), on, "left").groupBy("annotator", "accuracy", "total_tasks").agg(F.count("task").alias("open")).where(F.col("open") < most)


def dispatch(loaded: DataFrame, difficulty: float = 0.4, cold: int = 20, hard: float = 0.85, most: int = 10) -> DataFrame:
    """Annotators ranked for a task: newcomers by a hash, others by accuracy and load; hard tasks go
    to accurate ones only."""
    new = F.col("total_tasks") < cold
    drawn = F.conv(F.substring(F.md5(F.col("annotator").cast("binary")), 1, 6), 16, 10).cast("double") / float(16**6)
    score = F.round(F.when(new, drawn).otherwise(0.6 * F.col("accuracy") + 0.4 * (1 - F.least(F.lit(1.0), F.col("open") / most))), 6)
    fit = loaded.where(new | (F.lit(difficulty) >= 0.5) | (F.col("accuracy") >= hard)).withColumn("score", score)
    return fit.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "annotator"))).select("annotator", "open", "score", "rank")


def transitions(spark: SparkSession) -> DataFrame:
    """The allowed moves, a fixed table."""
    return spark.createDataFrame(TASK_TRANSITIONS, "from_status string, to_status string")


def audit(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Moves of each entity in order (``entity``, ``seq``, ``status``), and whether they are allowed."""
    before = F.lag("status").over(Window.partitionBy("entity").orderBy("seq"))
    moves = events.withColumn("from_status", before).where(F.col("from_status").isNotNull()).withColumnRenamed("status", "to_status")
    return moves.join(F.broadcast(allowed.withColumn("allowed", F.lit(True))), ["from_status", "to_status"], "left").select("entity", "seq", "from_status", "to_status", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def with_status(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("user_status", user_status(F.col("status"))).withColumn("hint", action_hint(F.col("status")))


def orphans(jobs: DataFrame, alive: DataFrame, retries: Column, most: int = 3, delay_s: int = 300) -> DataFrame:
    """Uploaded jobs and jobs in evaluation or in work whose worker is not alive: they become orphaned,
    and are queued again after a delay unless that was done too often.  No alive worker at all means
    that nothing is known: then there are no orphans."""
    active = jobs.where(F.col("worker").isNotNull() & F.col("status").isin("UPLOADED", "EVALUATING", "PROCESSING"))
    known = alive.agg(F.count("*").alias("n")).where("n > 0")
    lost = active.join(alive.select("worker"), "worker", "left_anti").join(F.broadcast(known))
    again = retries < most
    return lost.select("job", "worker", F.col("status").alias("old_status"), F.lit("ORPHANED").alias("status"), again.alias("requeue"), F.when(again, delay_s).alias("after_s"))


def finalise(pages: DataFrame) -> DataFrame:
    """A job's status from its pages: failures, then human work, then completeness decide."""
    s = F.col("status")
    n = pages.groupBy("job").agg(
        F.count("*").alias("total"), F.count_if(s == "BLANK").alias("blank"), F.count_if(s.isin("AI_FAILED", "IMPORT_FAILED", "DEAD_LETTER")).alias("failed"),
        F.count_if(s.isin("HUMAN_QUEUED", "HUMAN_PROCESSING")).alias("human"),
        F.count_if(s.isin("AI_COMPLETED", "HUMAN_COMPLETED", "IMPORTED_CONFIRMED", "IMPORTED_ASSUMED", "SKIPPED")).alias("done"),
    )
    out = F.when(F.col("failed") > 0, "PARTIAL_FAILED").when(F.col("human") > 0, "PROCESSING").when(F.col("done") >= F.col("total") - F.col("blank"), "FULL_IMPORTED").otherwise("PROCESSING")
    return n.withColumn("job_status", out).withColumn("user_status", user_status(F.col("job_status")))


def reconcile_pages(pages: DataFrame, hours: int = 24) -> DataFrame:
    """Assumed imports are confirmed by the downstream or by age; old failures count as blank."""
    s, age = F.col("status"), F.col("age_hours")
    new = F.when((s == "IMPORTED_ASSUMED") & (F.col("downstream") | (age > hours)), "IMPORTED_CONFIRMED").when((s == "AI_FAILED") & (age > hours), "BLANK").otherwise(s)
    return pages.withColumn("new_status", new)


def reconcile_jobs(pages: DataFrame) -> DataFrame:
    """Jobs complete once all valid pages are done; human work waits, failed jobs stay."""
    s = F.col("new_status")
    n = pages.groupBy("job").agg(
        F.count("*").alias("total"), F.count_if(s == "BLANK").alias("blank"), F.count_if(s == "AI_FAILED").alias("failed"),
        F.count_if(s.isin("HUMAN_QUEUED", "HUMAN_PROCESSING")).alias("human"), F.count_if(s.isin("IMPORTED_CONFIRMED", "HUMAN_COMPLETED", "SKIPPED")).alias("done"),
    )
    valid = F.col("total") - F.col("blank")
    out = F.when(F.col("human") > 0, "WAITING").when((valid > 0) & (F.col("failed") == valid), "STAYS_FAILED").when(F.col("done") >= valid, "FULL_IMPORTED").otherwise("OPEN")
    return n.withColumn("outcome", out)


def import_plan(skus: DataFrame, imported: DataFrame) -> DataFrame:
    """Valid records not imported yet, by key; repeats of a key count once."""
    return skus.where("validity = 'valid'").select("dedup_key").distinct().join(imported.select("dedup_key").distinct(), "dedup_key", "left_anti")


def completion_imports(pages_done: DataFrame, tasks_done: DataFrame, skus: DataFrame) -> DataFrame:
    """The records to import when pages are completed automatically (attempt 1, as extracted) and when
    people completed their tasks (attempt 2, ``human``), with the key that keeps repeats out.  Pages
    that ended in another state import nothing."""
    auto = pages_done.where("status = 'AI_COMPLETED'").select("job", "page", F.lit(1).alias("attempt")).distinct()
    human = tasks_done.select("job", "page", F.lit(2).alias("attempt")).distinct()
    found = skus.where("validity = 'valid'").join(auto.unionByName(human), ["job", "page"])
    way = F.when(F.col("attempt") == 2, "human").otherwise(F.col("extraction_method"))
    return found.select("job", "page", "sku", way.alias("extraction_method"), F.concat_ws(":", *[F.col(c).cast("string") for c in ("job", "page", "sku", "attempt")]).alias("dedup_key"))


def create_jobs(uploads: DataFrame) -> DataFrame:
    """Uploads (upload, merchant, file_hash, issues, all_blank), in order of ``upload``: the first reason to
    reject one (its first issue, or the same file of the merchant before), or the state of its new job."""
    sound = F.size("issues") == 0
    w = Window.partitionBy("merchant", "file_hash", sound).orderBy("upload")
    again = sound & (F.row_number().over(w) > 1)
    out = uploads.withColumn("rejected", F.when(~sound, F.get("issues", F.lit(0))).when(again, "duplicate_file"))
    out = out.withColumn("status", F.when(F.col("rejected").isNull(), F.when(F.col("all_blank"), "DEGRADED_HUMAN").otherwise("UPLOADED")))
    return out.withColumn("user_status", F.when(F.col("status").isNotNull(), user_status(F.col("status")))).withColumn("hint", F.when(F.col("status").isNotNull(), action_hint(F.col("status"))))
