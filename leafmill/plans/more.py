"""Remaining small operators: prompts, gates, newest-first lists, set algebra on page numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import pages, records
from ..operators import relational as rel
from ..sources import bindings as b
from .documents import _FEATURES, _VALID
from .registry import query
from .spatial import _EDGE


@query(f"WITH {b.SKUS} SELECT page, string_agg(coalesce(product_name, '?'), ' ' ORDER BY pos)[1:100] AS text, min(x0) AS x0, max(y1) AS y1 FROM skus GROUP BY page")
def block_text_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Text of a page's blocks in order, cut to length, and its extent."""
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("product_name", F.lit("?")).alias("t")))), lambda e: e["t"]), " ")
    return b.skus(spark, sf).groupBy("page").agg(F.substring(words, 1, 100).alias("text"), F.min("x0").alias("x0"), F.max("y1").alias("y1"))


@query(f"""WITH {b.SKUS} SELECT page, round(avg(confidence), 6) AS avg_confidence, round(count(*) FILTER ({_VALID} < 2) / count(*), 6) AS invalid_share,
  round(count(*) FILTER ({_VALID} < 2) / count(*), 6) <= 0.3 AS accepted FROM skus GROUP BY page""")
def extraction_gates(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.round(F.count_if(records.validity() == "invalid") / F.count("*"), 6)
    g = b.skus(spark, sf).groupBy("page").agg(F.round(F.avg("confidence"), 6).alias("avg_confidence"), bad.alias("invalid_share"))
    return g.withColumn("accepted", F.col("invalid_share") <= 0.3)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_reports(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("SELECT n_regionkey AS capability, n_name AS client FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 7, n_nationkey) = 1")
def client_by_capability(spark: SparkSession, sf: str) -> DataFrame:
    n = b.table(spark, sf, "nation").select(F.col("n_regionkey").alias("capability"), F.col("n_name").alias("client"), "n_nationkey")
    return rel.latest(n, ["capability"], [F.col("n_nationkey") % 7, F.col("n_nationkey")]).select("capability", "client")


@query(f"WITH {b.JOBS} SELECT job, CAST(p AS INTEGER) AS page_no FROM (SELECT job, unnest(range(1, total_pages + 1)) AS p FROM jobs) WHERE p % 10 <> job % 10")
def non_blank_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page numbers of a job without its blank ones."""
    every = F.sequence(F.lit(1), F.col("total_pages"))
    blank = F.filter(every, lambda p: p % 10 == F.col("job") % 10)
    return b.jobs(spark, sf).select("job", F.explode(F.array_except(every, blank)).alias("page_no"))


@query(f"""WITH {_FEATURES} SELECT doc_id, concat_ws(', ', printf('text_density=%.2f', least(1.0::DOUBLE, n_blocks / 70.0::DOUBLE)), concat('images=', n_images), concat('tables=', n_tables), CASE WHEN has_price THEN 'has_prices' END, CASE WHEN has_model THEN 'has_model_numbers' END) AS context FROM features""")
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    p = pages.features(b.pages(spark, sf))
    line = tx.prompt_context(
        {"text_density": F.least(F.lit(1.0), F.col("n_blocks") / 70.0), "image_count": F.col("n_images"), "table_count": F.col("n_tables"), "has_price": F.col("has_price"), "has_model": F.col("has_model")}
    )
    return p.select("doc_id", line.alias("context"))


@query("""WITH t AS (SELECT conv_id, role, turn, CASE WHEN len(text) > 2000 THEN concat(text[1:2000], '... [truncated]') ELSE text END AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3)
SELECT conv_id, string_agg(concat(role, ': ', t), chr(10) ORDER BY turn) AS prompt FROM t GROUP BY conv_id""")
def fewshot_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The first examples of each group, joined to one prompt."""
    c = rel.top_per(b.table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], 3)
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), tx.marked_truncated(F.col("text"))).alias("t"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda e: e["t"]), "\n").alias("prompt"))


@query("SELECT doc_id, split_part(concat(source, ':v', doc_id % 3, ':x'), ':', 1) AS profile, concat('v', doc_id % 3, ':x') AS version FROM documents")
def profile_version_split(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.concat("source", F.lit(":v"), (F.col("doc_id") % 3).cast("string"), F.lit(":x"))
    parts = F.split(ref, ":", 2)
    return b.table(spark, sf, "documents").select("doc_id", F.get(parts, F.lit(0)).alias("profile"), F.get(parts, F.lit(1)).alias("version"))


@query("SELECT event_type AS field, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY event_type")
def ordered_by_value(spark: SparkSession, sf: str) -> DataFrame:
    n = rel.counts_by(b.table(spark, sf, "events").withColumnRenamed("event_type", "field"), "field")
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "field")))


@query(f"WITH {b.SKUS} SELECT page, concat('[', row_number() OVER (PARTITION BY page ORDER BY pos) - 1, '] ', coalesce(product_name, '')) AS label FROM skus")
def indexed_labels(spark: SparkSession, sf: str) -> DataFrame:
    named = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("product_name", F.lit("")).alias("n")))), lambda e: e["n"])
    g = b.skus(spark, sf).groupBy("page").agg(named.alias("names")).select("page", F.posexplode("names").alias("i", "name"))
    return g.select("page", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), "name").alias("label"))


@query(f"""WITH {b.LINES}, {b.IMAGES}, g AS (SELECT page, count(*) AS n, max((x1 - x0) * (y1 - y0)) AS most FROM images WHERE {_EDGE} >= 200 GROUP BY page)
SELECT page, n = 1 AND most > 0.6 * 60000 AS splits FROM g""")
def composite_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose one eligible image covers most of the page are split."""
    from ..operators.binding import image_metrics

    i = image_metrics(b.images(spark, sf)).where("search_eligible")
    g = i.groupBy("page").agg(F.count("*").alias("n"), F.max(geo.area(geo.box())).alias("most"))
    return g.select("page", ((F.col("n") == 1) & (F.col("most") > 0.6 * 60000)).alias("splits"))


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS f, CASE WHEN event_type <> 'error' THEN user_id % 4 END AS s FROM events),
r AS (SELECT *, coalesce(f <= 2, false) AS f_ok, coalesce(s <= 2, false) AS s_ok FROM a)
SELECT event_id, CASE WHEN f_ok THEN 'first' WHEN s_ok THEN 'second' END AS provider, CAST(CASE WHEN f_ok THEN f + 1 WHEN s_ok THEN 3 + s + 1 ELSE 6 END AS INTEGER) AS attempts,
  CAST(CASE WHEN f_ok THEN 3 * (2 ** f - 1) WHEN s_ok THEN 9 + 3 * (2 ** s - 1) ELSE 18 END AS INTEGER) AS waited FROM r""")
def provider_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The provider that answers after retries with growing waits, and the next one where none does."""
    from ..operators.series import provider_chain

    answers = F.map_filter(
        F.create_map(F.lit("first"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 5).cast("int")), F.lit("second"), F.when(F.col("event_type") != "error", (F.col("user_id") % 4).cast("int"))),
        lambda _, v: v.isNotNull(),
    )
    return provider_chain(b.table(spark, sf, "events").select("event_id", answers.alias("answers")), ["first", "second"]).drop("answers")


@query(f"WITH {b.SKUS} SELECT page, count(*) FILTER ({_VALID} >= 2) AS valid, count(*) FILTER ({_VALID} < 2) AS invalid, count(*) FILTER (confidence >= 0.9) AS confirmed FROM skus GROUP BY page")
def validity_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = records.validity()
    return b.skus(spark, sf).groupBy("page").agg(F.count_if(v == "valid").alias("valid"), F.count_if(v == "invalid").alias("invalid"), F.count_if(F.col("confidence") >= 0.9).alias("confirmed"))


@query(f"""WITH {b.TASKS}, c AS (SELECT * FROM tasks WHERE status = 'COMPLETED') SELECT c.task, count(*) AS notes, count(*) FILTER (event_type <> 'error') AS usable FROM c JOIN events ON c.task = event_id % 500 GROUP BY c.task""")
def completed_task_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations of completed tasks, as handed to the example store."""
    done = b.tasks(spark, sf).where("status = 'COMPLETED'").select("task")
    notes = b.table(spark, sf, "events").select((F.col("event_id") % 500).alias("task"), "event_type")
    return done.join(notes, "task").groupBy("task").agg(F.count("*").alias("notes"), F.count_if(F.col("event_type") != "error").alias("usable"))


@query(f"""WITH {b.TASKS} SELECT task, status, CASE WHEN status = 'CREATED' THEN 'done' ELSE 'illegal' END AS outcome FROM tasks""")
def batch_skip(spark: SparkSession, sf: str) -> DataFrame:
    """A batch operation: tasks that may not move are reported, not failed on."""
    ok = F.col("status") == "CREATED"
    return b.tasks(spark, sf).select("task", "status", F.when(ok, "done").otherwise("illegal").alias("outcome"))


@query(f"WITH {b.JOBS} SELECT job, score >= 0.85 AS auto FROM jobs WHERE score IS NOT NULL UNION ALL SELECT job, false FROM jobs WHERE score IS NULL")
def route_split(spark: SparkSession, sf: str) -> DataFrame:
    """Events split by route: automatic processing, or people."""
    return b.jobs(spark, sf).select("job", F.coalesce(F.col("score") >= 0.85, F.lit(False)).alias("auto"))


@query(f"WITH {b.JOBS} SELECT job, total_pages > 100 AS chunked, CAST(ceil(total_pages / 50) AS BIGINT) AS n_chunks FROM jobs")
def chunk_gate(spark: SparkSession, sf: str) -> DataFrame:
    return b.jobs(spark, sf).select("job", (F.col("total_pages") > 100).alias("chunked"), F.ceil(F.col("total_pages") / 50).alias("n_chunks"))


@query(f"""WITH {b.JOB_PAGES} SELECT job, count(*) AS pages, sum(n_skus)::BIGINT AS skus, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM job_pages GROUP BY job""")
def completion_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return b.job_pages(spark, sf).groupBy("job").agg(
        F.count("*").alias("pages"), F.sum("n_skus").alias("skus"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses")
    )


@query(f"""WITH {b.SKUS}, d AS (SELECT o_orderkey AS page, o_custkey AS job, CASE o_orderstatus WHEN 'O' THEN 'AI_COMPLETED' WHEN 'P' THEN 'AI_FAILED' ELSE 'HUMAN_QUEUED' END AS status, o_orderpriority AS p FROM orders),
v AS (SELECT page, sku FROM skus WHERE {_VALID} >= 2)
SELECT job, page, sku, 'two_stage_rule' AS extraction_method, concat_ws(':', job, page, sku, 1) AS dedup_key FROM d JOIN v USING (page) WHERE status = 'AI_COMPLETED'
UNION ALL SELECT job, page, sku, 'human', concat_ws(':', job, page, sku, 2) FROM d JOIN v USING (page) WHERE p = '1-URGENT'""")
def completion_imports(spark: SparkSession, sf: str) -> DataFrame:
    """What completed pages and completed human tasks hand to the importer."""
    from ..operators.tasks import completion_imports as imports

    s = F.col("o_orderstatus")
    done = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("job"), F.when(s == "O", "AI_COMPLETED").when(s == "P", "AI_FAILED").otherwise("HUMAN_QUEUED").alias("status"), "o_orderpriority")
    skus = b.skus(spark, sf).withColumn("validity", records.validity()).withColumn("extraction_method", F.lit("two_stage_rule")).join(done.select("page", "job"), "page")
    return imports(done, done.where("o_orderpriority = '1-URGENT'"), skus)


@query(f"""WITH {b.JOBS} SELECT job, concat('{{"job_id":"', job, '","file_hash":"', file_hash, '","merchant_id":"', merchant, '","status":"', status, '","total_pages":', total_pages, '}}') AS body FROM jobs""")
def job_json(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs as clients see them: only the fields meant for them, in a fixed order."""
    from ..functions.jsonx import projected

    j = b.jobs(spark, sf).withColumns({"job_id": F.col("job").cast("string"), "merchant_id": F.col("merchant")})
    return j.select("job", projected(j, ["job_id", "file_hash", "merchant_id", "status", "total_pages"]).alias("body"))


@query(f"""WITH m AS (SELECT user_id AS session, event_id, ts, event_type, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS stop, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
k AS (SELECT *, CAST(CASE WHEN before IS NULL THEN 1 ELSE greatest(0, ceil((epoch_us(ts) - epoch_us(before)) / 21600000000.0) - 1) END AS BIGINT) AS beats FROM m WHERE event_id <= coalesce(stop, event_id))
SELECT session, event_id, event_type, beats, event_type = 'error' AS closes FROM k""")
def session_push(spark: SparkSession, sf: str) -> DataFrame:
    """What each session is sent: its events up to the first that ends it, and heartbeats before each."""
    from ..operators.series import push_frames

    ev = b.table(spark, sf, "events").select(F.col("user_id").alias("session"), "event_id", "ts", "event_type")
    return push_frames(ev, ["error"], seconds=6 * 3600).select("session", "event_id", "event_type", "beats", "closes")
