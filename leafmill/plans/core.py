"""Dashboards, paging, queues and nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsonx, scoring
from ..functions.vocab import EVENT_NAMES, lookup, user_status
from ..operators import relational as rel
from ..operators import tasks as tk
from ..sources import bindings as b
from ..sources import readers
from .registry import query


@query(f"WITH {b.JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rel.counts_by(b.jobs(spark, sf), "status")


@query(f"""WITH {b.JOBS} SELECT count(*) AS total, count(*) FILTER (status IN ('UPLOADED','EVALUATING','EVALUATED','PROCESSING')) AS active,
  count(*) FILTER (status = 'FULL_IMPORTED') AS completed FROM jobs""")
def job_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("status")
    return b.jobs(spark, sf).agg(
        F.count("*").alias("total"), F.count_if(s.isin("UPLOADED", "EVALUATING", "EVALUATED", "PROCESSING")).alias("active"), F.count_if(s == "FULL_IMPORTED").alias("completed")
    )


@query(f"""WITH {b.JOB_PAGES}, n AS (
  SELECT job, status, count(*) AS n, sum(count(*)) OVER (PARTITION BY job) AS total FROM job_pages GROUP BY job, status)
SELECT job, CAST(max(total) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (status IN ('IMPORTED_CONFIRMED','IMPORTED_ASSUMED')), 0) AS BIGINT) AS done,
  round(coalesce(sum(n) FILTER (status IN ('IMPORTED_CONFIRMED','IMPORTED_ASSUMED')), 0) / greatest(1, max(total)), 4) AS completion_rate FROM n GROUP BY job""")
def page_status_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("status").isin("IMPORTED_CONFIRMED", "IMPORTED_ASSUMED")
    n = b.job_pages(spark, sf).groupBy("job").agg(F.count("*").alias("total"), F.count_if(done).alias("done"))
    return n.withColumn("completion_rate", scoring.ratio(F.col("done"), F.col("total")))


@query(f"""WITH {b.TASKS}, t AS (SELECT *, created_at >= TIMESTAMP '{b.AS_OF_ORDERS}' - INTERVAL 400 DAY AS recent FROM tasks)
SELECT count(*) FILTER (status = 'CREATED') AS queue_depth, count(*) FILTER (status = 'PROCESSING') AS in_work, count(*) FILTER (recent) AS recent,
  count(*) FILTER (recent AND status = 'CREATED' AND age_minutes > 180) AS overdue,
  round(1 - count(*) FILTER (recent AND status = 'CREATED' AND age_minutes > 180) / greatest(1, count(*) FILTER (recent)), 4) AS sla_health FROM t""")
def task_stats_sla(spark: SparkSession, sf: str) -> DataFrame:
    recent = F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{b.AS_OF_ORDERS}' - INTERVAL 400 DAYS")
    s = F.col("status")
    n = b.tasks(spark, sf).agg(
        F.count_if(s == "CREATED").alias("queue_depth"), F.count_if(s == "PROCESSING").alias("in_work"), F.count_if(recent).alias("recent"),
        F.count_if(recent & (s == "CREATED") & (F.col("age_minutes") > 180)).alias("overdue"),
    )
    return n.withColumn("sla_health", F.round(1 - F.col("overdue") / F.greatest(F.lit(1), F.col("recent")), 4))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value >= 50) AS ok, round(count(*) FILTER (value >= 50) / greatest(1, count(*)), 4) AS success_rate
FROM events GROUP BY event_type""")
def import_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    n = b.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("ok"))
    return n.withColumn("success_rate", scoring.ratio(F.col("ok"), F.col("n")))


@query(f"""WITH {b.ANNOTATIONS} SELECT count(*) AS pending, count(*) FILTER (annotated_at < TIMESTAMP '{b.AS_OF_EVENTS}' - INTERVAL 48 HOUR) AS stale
FROM annotations WHERE reworked""")
def pending_approvals(spark: SparkSession, sf: str) -> DataFrame:
    stale = F.col("annotated_at") < F.expr(f"TIMESTAMP_NTZ '{b.AS_OF_EVENTS}' - INTERVAL 48 HOURS")
    return b.annotations(spark, sf).where("reworked").agg(F.count("*").alias("pending"), F.count_if(stale).alias("stale"))


@query(f"""WITH {b.TASKS}, f AS (SELECT * FROM tasks WHERE status = 'CREATED' AND priority IN ('HIGH', 'URGENT')),
t AS (SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n_pages FROM f)
SELECT task, priority, total, n_pages FROM (SELECT * FROM f ORDER BY created_at DESC, task LIMIT 20 OFFSET 20), t""")
def filtered_page_with_total(spark: SparkSession, sf: str) -> DataFrame:
    found = rel.where_given(b.tasks(spark, sf), status="CREATED", priority=["HIGH", "URGENT"], job=None)
    return rel.one_page(found, [F.desc("created_at"), F.asc("task")], 2, 20).select("task", "priority", "total", "n_pages")


@query(f"WITH {b.TASKS} SELECT job, count(*) AS n_tasks FROM tasks WHERE status IN ('CREATED', 'PROCESSING') GROUP BY job")
def tasks_per_job(spark: SparkSession, sf: str) -> DataFrame:
    open_tasks = rel.where_given(b.tasks(spark, sf), status=["CREATED", "PROCESSING"])
    return rel.counts_by(open_tasks, "job", name="n_tasks").orderBy(F.desc("n_tasks"), "job")


_LOADED = f"""{b.TASKS}, {b.ANNOTATORS},
loaded AS (SELECT annotator, accuracy, total_tasks, count(task) AS open FROM annotators LEFT JOIN tasks ON annotator = assigned_to AND status = 'PROCESSING'
  GROUP BY annotator, accuracy, total_tasks HAVING count(task) < 10)"""


@query(f"WITH {_LOADED} SELECT annotator, accuracy, total_tasks, open FROM loaded")
def least_loaded_annotators(spark: SparkSession, sf: str) -> DataFrame:
    return tk.load(b.annotators(spark, sf), b.tasks(spark, sf))


@query(f"""WITH {_LOADED}, s AS (
  SELECT annotator, open, round(CASE WHEN total_tasks < 20 THEN CAST(('0x' || md5(annotator)[1:6]) AS INTEGER) / 16777216.0::DOUBLE
    ELSE 0.6 * accuracy + 0.4 * (1 - least(1.0, open / 10)) END, 6) AS score
  FROM loaded WHERE total_tasks < 20 OR accuracy >= 0.85)
SELECT annotator, open, score, CAST(row_number() OVER (ORDER BY score DESC, annotator) AS INTEGER) AS rank FROM s""")
def dispatch_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return tk.dispatch(tk.load(b.annotators(spark, sf), b.tasks(spark, sf)))


@query(f"""WITH {b.JOBS} SELECT job, worker, status AS old_status, 'ORPHANED' AS status, job % 5 < 3 AS requeue, CASE WHEN job % 5 < 3 THEN 300 END AS after_s FROM jobs
WHERE worker IS NOT NULL AND status IN ('UPLOADED','EVALUATING','PROCESSING') AND EXISTS (SELECT 1 FROM events WHERE ts >= TIMESTAMP '{b.AS_OF_EVENTS}' - INTERVAL 5 HOUR)
  AND worker NOT IN (SELECT concat('w', user_id) FROM events WHERE ts >= TIMESTAMP '{b.AS_OF_EVENTS}' - INTERVAL 5 HOUR)""")
def orphan_jobs_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Workers count as alive for five hours, as the events are sparse."""
    beats = b.table(spark, sf, "events").select(F.concat(F.lit("w"), "user_id").alias("worker"), "ts")
    return tk.orphans(b.jobs(spark, sf), readers.alive_workers(beats, b.AS_OF_EVENTS, 5 * 3600), F.col("job") % 5)


@query(f"""WITH {b.JOB_PAGES}, g AS (SELECT job, CASE WHEN status LIKE 'IMPORTED%' THEN 'imported' WHEN status LIKE 'HUMAN%' THEN 'human' WHEN status = 'BLANK' THEN 'blank' ELSE 'other' END AS g,
  page_no, needs_review, n_skus FROM job_pages)
SELECT job, coalesce(array_to_string(list(page_no ORDER BY page_no) FILTER (g = 'imported'), ','), '') AS imported,
  coalesce(array_to_string(list(page_no ORDER BY page_no) FILTER (g = 'human'), ','), '') AS human,
  coalesce(array_to_string(list(page_no ORDER BY page_no) FILTER (g = 'blank'), ','), '') AS blank,
  coalesce(array_to_string(list(page_no ORDER BY page_no) FILTER (needs_review), ','), '') AS review, CAST(sum(n_skus) AS BIGINT) AS skus FROM g GROUP BY job""")
def status_page_arrays(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("status")
    pages_where = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("page_no")))), ",")
    return b.job_pages(spark, sf).groupBy("job").agg(
        pages_where(s.startswith("IMPORTED")).alias("imported"), pages_where(s.startswith("HUMAN")).alias("human"), pages_where(s == "BLANK").alias("blank"),
        pages_where(F.col("needs_review")).alias("review"), F.sum("n_skus").alias("skus"),
    )


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_version_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return rel.latest(b.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"""WITH {b.JOBS}, e AS (SELECT concat('f', user_id) AS file_hash, event_id AS evaluation, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT job, jobs.file_hash, evaluation, value FROM jobs JOIN e ON jobs.file_hash = e.file_hash""")
def job_latest_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    newest = rel.latest(b.table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    evaluated = newest.select(F.concat(F.lit("f"), "user_id").alias("file_hash"), F.col("event_id").alias("evaluation"), "value")
    return b.jobs(spark, sf).join(evaluated, "file_hash").select("job", "file_hash", "evaluation", "value")


_ORDER = "CASE priority WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'NORMAL' THEN 3 END NULLS LAST, created_at, task"


@query(f"WITH {b.TASKS} SELECT task, job, priority FROM tasks WHERE status = 'CREATED' ORDER BY {_ORDER} LIMIT 1")
def claim_next_task(spark: SparkSession, sf: str) -> DataFrame:
    return tk.claim_next(b.tasks(spark, sf)).select("task", "job", "priority")


@query(f"""WITH {b.TASKS} SELECT status, task, CAST(row_number() OVER (PARTITION BY status ORDER BY created_at, task) AS INTEGER) AS rank FROM tasks WHERE rework < 5
QUALIFY row_number() OVER (PARTITION BY status ORDER BY created_at, task) <= 20""")
def poll_oldest_per_status(spark: SparkSession, sf: str) -> DataFrame:
    return rel.top_per(b.tasks(spark, sf).where("rework < 5"), ["status"], [F.col("created_at"), F.col("task")], 20).select("status", "task", "rank")


@query(f"WITH {b.TASKS} SELECT task, CASE WHEN rework >= 5 THEN 'DEAD_LETTER' ELSE status END AS status FROM tasks")
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return b.tasks(spark, sf).select("task", F.when(F.col("rework") >= 5, "DEAD_LETTER").otherwise(F.col("status")).alias("status"))


@query(f"""WITH {b.JOBS} SELECT job, status, CASE WHEN status IN ('UPLOADED','EVALUATING','EVALUATED','PROCESSING','ORPHANED') THEN 'processing'
  WHEN status IN ('EVAL_FAILED','CANCELLED','REJECTED') THEN 'failed' WHEN status IN ('PARTIAL_FAILED','PARTIAL_IMPORTED') THEN 'partial_success'
  WHEN status = 'DEGRADED_HUMAN' THEN 'needs_manual' ELSE 'completed' END AS user_status FROM jobs""")
def user_status_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return tk.with_status(b.jobs(spark, sf)).select("job", "status", "user_status")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'job_failed' WHEN 'view' THEN 'page_completed' ELSE 'heartbeat' END AS client_event FROM events""")
def event_name_map(spark: SparkSession, sf: str) -> DataFrame:
    own = {"error": "JobFailed", "view": "PageStatusChanged"}
    return b.table(spark, sf, "events").select("event_id", lookup(EVENT_NAMES, lookup(own, F.col("event_type"), "Other"), "heartbeat").alias("client_event"))


@query(f"""WITH {b.SKUS}, {b.IMAGES} SELECT s.page, s.sku, CAST(count(i.image) AS BIGINT) AS n_images, coalesce(string_agg(i.image, ',' ORDER BY i.image), '') AS images
FROM skus s LEFT JOIN images i ON s.page = i.page AND i.pos >= s.pos GROUP BY s.page, s.sku""")
def skus_with_images_nested(spark: SparkSession, sf: str) -> DataFrame:
    s, i = b.skus(spark, sf).select("page", "pos", "sku"), b.images(spark, sf).select("page", F.col("pos").alias("i_pos"), "image")
    bound = s.join(i, "page").where("i_pos >= pos").select("sku", "image")
    full = rel.nested(s, bound, "sku", ["image"], "images")
    return full.select("page", "sku", F.size("images").cast("long").alias("n_images"), F.array_join("images.image", ",").alias("images"))


@query(f"""WITH {b.SKUS}, {b.IMAGES}, a AS (SELECT page, count(*) AS n_skus FROM skus GROUP BY page), c AS (SELECT page, count(*) AS n_images FROM images GROUP BY page)
SELECT a.page, n_skus, coalesce(n_images, 0) AS n_images FROM a LEFT JOIN c USING (page)""")
def page_composite(spark: SparkSession, sf: str) -> DataFrame:
    s = b.skus(spark, sf).groupBy("page").agg(F.collect_list(F.struct("pos", "sku")).alias("skus"))
    full = rel.nested(s, b.images(spark, sf), "page", ["pos", "image"], "images")
    return full.select("page", F.size("skus").cast("long").alias("n_skus"), F.size("images").cast("long").alias("n_images"))


@query("""SELECT k.key AS key, event_type, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) k GROUP BY ALL""")
def json_key_frequency(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return b.table(spark, sf, "events").select("event_type", F.explode(keys).alias("key")).groupBy("key", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def json_value_buckets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return b.table(spark, sf, "events").groupBy("event_type", F.floor(k / 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 1 ELSE 0 END AS level,
  CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN concat('[', props, ']') WHEN 4 THEN json_extract_string(props, '$.k') END AS json FROM events""")
def json_parse_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as plain JSON, fenced, within a sentence, without JSON, as a number, and empty."""
    props, kind = F.col("props"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, props)
        .when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("see ["), props, F.lit("] there")))
        .when(kind == 3, "no json here")
        .when(kind == 4, F.get_json_object("props", "$.k"))
        .otherwise("")
    )
    json, level = jsonx.parse_levels(F.col("t"))
    return b.table(spark, sf, "events").select("event_id", text.alias("t")).select("event_id", level.cast("int").alias("level"), json.alias("json"))


@query("""SELECT l_orderkey, l_linenumber, p_brand AS brand, p_type AS kind, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE p_size END AS VARCHAR) AS size
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey""")
def attribute_merge_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    joined = li.join(b.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    product = F.create_map(F.lit("brand"), "p_brand", F.lit("kind"), "p_type", F.lit("size"), F.col("p_size").cast("string"))
    own = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("size"), F.col("l_linenumber").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    m = jsonx.merged(product, own)
    return joined.select("l_orderkey", "l_linenumber", *[F.element_at(m, k).alias(k) for k in ("brand", "kind", "size")])


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n_changed,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS old_size FROM part WHERE p_size % 2 = 0 OR p_partkey % 3 = 0""")
def attribute_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = b.table(spark, sf, "part")
    old = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    new = F.create_map(
        F.lit("size"), F.when(F.col("p_size") % 2 == 0, "changed").otherwise(F.col("p_size").cast("string")),
        F.lit("type"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")),
    )
    diff = jsonx.changed(old, new)
    return part.select("p_partkey", F.size(diff).alias("n_changed"), F.element_at(diff, "size")["old"].alias("old_size")).where("n_changed > 0")


@query("""SELECT p_partkey AS product, CASE WHEN p_partkey % 4 > 0 THEN CAST(i AS INTEGER) END AS n,
  CASE WHEN p_partkey % 4 > 0 THEN concat('v', i) ELSE CAST(p_size AS VARCHAR) END AS size, p_brand AS brand
FROM part, (SELECT unnest([0, 1, 2]) AS i) WHERE i < greatest(1, p_partkey % 4)""")
def product_variant_explode(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.records import variants

    part = b.table(spark, sf, "part")
    one = lambda i: F.create_map(F.lit("size"), F.concat(F.lit("v"), i.cast("string")))
    n = F.col("p_partkey") % 4
    own = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), one))
    attrs = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    rows = variants(part.select(F.col("p_partkey").alias("product"), attrs.alias("attrs"), own.alias("variants")))
    return rows.select("product", "n", *[F.element_at("attributes", k).alias(k) for k in ("size", "brand")])


@query(f"WITH {b.JOBS} SELECT a.job, a.merchant, a.file_hash, min(f.job) AS first FROM jobs a JOIN jobs f ON a.merchant = f.merchant AND a.file_hash = f.file_hash WHERE a.status NOT IN ('CANCELLED','REJECTED') AND f.status NOT IN ('CANCELLED','REJECTED') GROUP BY ALL HAVING a.job > min(f.job)")
def duplicate_jobs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluation import same_file_jobs

    return same_file_jobs(b.jobs(spark, sf))


@query("""SELECT coalesce(s.user_id, e.user_id) AS user_id, coalesce(e.n, s.n) AS n, CASE WHEN s.user_id IS NULL THEN 'insert' WHEN e.user_id IS NULL THEN 'keep' ELSE 'update' END AS action
FROM (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1) s
FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1) e ON s.user_id = e.user_id""")
def heartbeat_upsert(spark: SparkSession, sf: str) -> DataFrame:
    ev = b.table(spark, sf, "events")
    old = rel.counts_by(ev.where("ts < TIMESTAMP_NTZ '2024-01-10'"), "user_id")
    return rel.upsert(old, rel.counts_by(ev.where("ts >= TIMESTAMP_NTZ '2024-01-29'"), "user_id"), ["user_id"])


@query(f"WITH {b.TASKS} SELECT c.c_custkey, c.c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.job = c.c_custkey AND t.status = 'COMPLETED')")
def delete_jobs_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = b.tasks(spark, sf).where("status = 'COMPLETED'").select(F.col("job").alias("c_custkey"))
    return rel.without(b.table(spark, sf, "customer"), gone, "c_custkey").select("c_custkey", "c_name")


@query(f"WITH {b.TASKS} SELECT job, task, CAST(revision AS INTEGER) AS revision, is_latest FROM (SELECT *, row_number() OVER w AS revision, lead(1) OVER w IS NULL AS is_latest FROM tasks WINDOW w AS (PARTITION BY job ORDER BY created_at, task))")
def binding_scd2(spark: SparkSession, sf: str) -> DataFrame:
    return rel.versions(b.tasks(spark, sf), ["job"], [F.col("created_at"), F.col("task")]).select("job", "task", "revision", "is_latest")


@query("""SELECT n.n_name AS name, coalesce(100 + o.n_nationkey, n.n_regionkey) AS priority FROM nation n LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) o ON n.n_name = o.n_name WHERE n.n_regionkey > 0""")
def provider_config_merge(spark: SparkSession, sf: str) -> DataFrame:
    n = b.table(spark, sf, "nation")
    new = n.where("n_regionkey > 0").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("priority"))
    old = n.where("n_regionkey <> 3").select(F.col("n_name").alias("name"), (F.lit(100) + F.col("n_nationkey")).alias("priority"))
    return rel.merged_config(new, old, "name", ["priority"])


@query("""SELECT r_name, CAST(row_number() OVER (ORDER BY list_position(['EUROPE', 'ASIA'], r_name) NULLS LAST, r_name) AS INTEGER) AS position FROM region""")
def provider_reorder(spark: SparkSession, sf: str) -> DataFrame:
    return rel.reordered(b.table(spark, sf, "region").select("r_name"), ["EUROPE", "ASIA"], "r_name")


_RULES = [(None, 1, 2), (None, 50, 4), ("m1", 40, 6), ("m1", 120, 8), ("m2", 100, 3)]


@query(f"""WITH {b.JOBS}, r(provider, min_pages, n) AS (VALUES (NULL, 1, 2), (NULL, 50, 4), ('m1', 40, 6), ('m1', 120, 8), ('m2', 100, 3))
SELECT job, CAST(coalesce((SELECT arg_max(n, min_pages) FROM r WHERE provider = merchant AND min_pages <= total_pages),
  (SELECT arg_max(n, min_pages) FROM r WHERE provider IS NULL AND min_pages <= total_pages), 1) AS INTEGER) AS concurrency FROM jobs""")
def concurrency_rules(spark: SparkSession, sf: str) -> DataFrame:
    # A handful of rules: the step function is an expression, no join.
    def step(of: str | None) -> Column:
        out = F.lit(None).cast("int")
        for provider, least, n in sorted(_RULES, key=lambda r: r[1]):
            if provider == of:
                out = F.when(F.col("total_pages") >= least, n).otherwise(out)
        return out

    own = F.lit(None).cast("int")
    for p in sorted({r[0] for r in _RULES if r[0]}):
        own = F.when(F.col("merchant") == p, step(p)).otherwise(own)
    return b.jobs(spark, sf).select("job", F.coalesce(own, step(None), F.lit(1)).alias("concurrency"))


@query(f"""WITH {b.JOBS} SELECT job, status, CASE WHEN status = 'PROCESSING' AND job % 2 = 0 THEN 'CANCELLED' ELSE status END AS new_status FROM jobs WHERE status = 'PROCESSING'
UNION ALL SELECT job, status, status FROM jobs WHERE status <> 'PROCESSING'""")
def conditional_update(spark: SparkSession, sf: str) -> DataFrame:
    hit = (F.col("status") == "PROCESSING") & (F.col("job") % 2 == 0)
    return b.jobs(spark, sf).select("job", "status", F.when(hit, "CANCELLED").otherwise(F.col("status")).alias("new_status"))


@query(f"""WITH {b.JOBS} SELECT job, status AS from_status, 'CANCELLED' AS to_status, 'cancel' AS trigger, 'failed' AS user_status FROM jobs WHERE status IN ('UPLOADED', 'PROCESSING')""")
def status_change_audit(spark: SparkSession, sf: str) -> DataFrame:
    moved = b.jobs(spark, sf).where(F.col("status").isin("UPLOADED", "PROCESSING"))
    return moved.select("job", F.col("status").alias("from_status"), F.lit("CANCELLED").alias("to_status"), F.lit("cancel").alias("trigger"), user_status(F.lit("CANCELLED")).alias("user_status"))


@query("""SELECT c_mktsegment AS role, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS disabled, round(100 * count(*) FILTER (c_acctbal >= 0) / count(*), 2) AS active_percent FROM customer GROUP BY 1""")
def user_counts(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.count_if(F.col("c_acctbal") < 0)
    return b.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("role")).agg(
        F.count("*").alias("n"), bad.alias("disabled"), F.round(100 * F.count_if(F.col("c_acctbal") >= 0) / F.count("*"), 2).alias("active_percent")
    )


@query("""SELECT event_type AS provider, count(*) AS calls, round(sum(CAST(json_extract(props, '$.k') AS BIGINT) * CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 5 ELSE 2 END) / 1000000, 6) AS cost FROM events GROUP BY 1""")
def llm_cost(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.get_json_object("props", "$.k").cast("long")
    price = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 5).otherwise(2)
    return b.table(spark, sf, "events").groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("calls"), F.round(F.sum(tokens * price) / 1_000_000, 6).alias("cost"))


@query(f"""WITH {b.JOBS}, r AS (SELECT CASE WHEN score >= 0.85 THEN 'AUTO' WHEN score >= 0.45 THEN 'HYBRID' ELSE 'HUMAN_ALL' END AS route, count(*) AS n FROM jobs WHERE score IS NOT NULL GROUP BY 1)
SELECT route, n, round(n / sum(n) OVER (), 4) AS share FROM r""")
def route_shares(spark: SparkSession, sf: str) -> DataFrame:
    scored = b.jobs(spark, sf).where(F.col("score").isNotNull())
    n = rel.counts_by(scored.withColumn("route", scoring.route(F.col("score"), F.lit(False))), "route")
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (event_type = 'click') AS auto, count(*) FILTER (event_type = 'view') AS hybrid,
  count(*) FILTER (event_type = 'purchase') AS human, count(*) FILTER (event_type = 'error') AS failed FROM events WHERE ts >= TIMESTAMP '2024-01-17' GROUP BY 1""")
def trend_by_day(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"click": "auto", "view": "hybrid", "purchase": "human", "error": "failed"}
    ev = b.table(spark, sf, "events").where("ts >= TIMESTAMP_NTZ '2024-01-17'")
    return ev.groupBy(F.to_date("ts").alias("day")).agg(*[F.count_if(F.col("event_type") == k).alias(v) for k, v in kinds.items()])


@query(f"""WITH {b.JOB_PAGES} SELECT job, page_no, CAST((row_number() OVER (PARTITION BY job ORDER BY page_no) - 1) // 20 AS INTEGER) AS grid_row,
  CAST((row_number() OVER (PARTITION BY job ORDER BY page_no) - 1) % 20 AS INTEGER) AS grid_col FROM job_pages""")
def page_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("job").orderBy("page_no")) - 1
    return b.job_pages(spark, sf).select("job", "page_no", F.floor(i / 20).cast("int").alias("grid_row"), (i % 20).cast("int").alias("grid_col"))


@query(f"""WITH {b.TASKS} SELECT assigned_to AS annotator, count(*) AS n, round(avg(age_minutes), 4) AS avg_minutes, round(avg(CASE WHEN rework = 0 THEN 1.0 ELSE 0.0 END), 4) AS accuracy
FROM tasks WHERE status = 'COMPLETED' AND created_at >= TIMESTAMP '{b.AS_OF_ORDERS}' - INTERVAL 300 DAY GROUP BY 1""")
def annotator_profile(spark: SparkSession, sf: str) -> DataFrame:
    recent = b.tasks(spark, sf).where(F.expr(f"status = 'COMPLETED' AND created_at >= TIMESTAMP_NTZ '{b.AS_OF_ORDERS}' - INTERVAL 300 DAYS"))
    return recent.groupBy(F.col("assigned_to").alias("annotator")).agg(
        F.count("*").alias("n"), F.round(F.avg("age_minutes"), 4).alias("avg_minutes"), F.round(F.avg(F.when(F.col("rework") == 0, 1.0).otherwise(0.0)), 4).alias("accuracy")
    )


@query("""WITH u AS (SELECT o_custkey AS sku, concat('i', o_orderkey % 5) AS image, o_orderdate, o_orderkey FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY sku) AS c FROM u)
SELECT sku, image, CAST(max(n) AS INTEGER) AS revision, max(n) = max(c) AS is_latest FROM n GROUP BY sku, image""")
def binding_replacements(spark: SparkSession, sf: str) -> DataFrame:
    """Bindings of records after all corrections: an image bound before keeps its row."""
    o = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("sku"), F.concat(F.lit("i"), (F.col("o_orderkey") % 5).cast("string")).alias("image"), "o_orderdate", "o_orderkey")
    return rel.replaced_bindings(o, "sku", "image", [F.col("o_orderdate"), F.col("o_orderkey")])
