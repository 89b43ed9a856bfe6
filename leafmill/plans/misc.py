"""Smaller operators: files, metadata, coordinates, compact answers, configuration, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..functions import hashing, jsonx
from ..functions.scoring import stable_round
from ..functions.vocab import PAGE_RESULT_STATUS, lookup
from ..operators import evaluation
from ..operators import relational as rel
from ..sources import bindings as b
from ..sources import readers, sinks
from .registry import query
from .spatial import _EDGE


_FILE_ISSUES = """array_to_string(list_filter([CASE WHEN page_id % 3 <> 0 AND strlen(coalesce(html, '')) = 0 THEN 'empty_file' END, CASE WHEN page_id % 3 <> 0 THEN 'not_pdf' END,
  CASE WHEN page_id % 5 = 0 THEN 'no_pages' END, CASE WHEN page_id % 7 = 0 AND page_id % 5 <> 0 THEN 'too_many_pages' END, CASE WHEN page_id % 11 = 0 THEN 'encrypted_pdf' END,
  CASE WHEN contains(coalesce(html, ''), '/JavaScript') OR contains(coalesce(html, ''), '/JS') OR page_id % 13 = 0 THEN 'javascript_embedded' END, CASE WHEN page_id % 17 = 0 THEN 'object_count_exceeded' END], lambda x: x IS NOT NULL), ',')"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as uploaded files: some are PDF files by their first bytes, with a trailer."""
    p = b.table(spark, sf, "pages")
    k = F.col("page_id")
    text = F.concat(
        F.when(k % 3 == 0, "%PDF-1.7 ").otherwise(""), F.coalesce("html", F.lit("")), F.when(k % 13 == 0, " << /JS (x) >>").otherwise(""),
        F.when(k % 17 == 0, " trailer << /Size 500001 >>").otherwise(""),
    )
    n = F.when(k % 5 == 0, 0).when(k % 7 == 0, 2000).otherwise(3)
    return p.select("page_id", text.cast("binary").alias("content"), n.alias("n_pages"), (k % 11 == 0).alias("encrypted"))


@query(f"SELECT page_id, {_FILE_ISSUES} AS issues FROM pages")
def file_validation(spark: SparkSession, sf: str) -> DataFrame:
    issues = readers.file_issues(F.col("content"), F.col("n_pages"), F.col("encrypted"))
    return _files(spark, sf).select("page_id", F.array_join(issues, ",").alias("issues"))


@query(f"""WITH f AS (SELECT page_id AS upload, page_id % 4 AS merchant, sha256(concat(coalesce(html, ''), 'x')) AS h, {_FILE_ISSUES} AS issues, page_id % 9 = 0 AS blank FROM pages),
k AS (SELECT *, issues = '' AND row_number() OVER (PARTITION BY merchant, h, issues = '' ORDER BY upload) = 1 AS first FROM f)
SELECT upload, merchant, CASE WHEN issues <> '' THEN split_part(issues, ',', 1) WHEN NOT first THEN 'duplicate_file' END AS rejected,
  CASE WHEN first THEN CASE WHEN blank THEN 'DEGRADED_HUMAN' ELSE 'UPLOADED' END END AS status, CASE WHEN first THEN CASE WHEN blank THEN 'needs_manual' ELSE 'processing' END END AS user_status FROM k""")
def job_creation(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads through validation, security, duplicate check and prescan to a new job or a reason not to."""
    from ..operators.tasks import create_jobs

    f = _files(spark, sf)
    text = b.table(spark, sf, "pages").select("page_id", F.sha2(F.concat(F.coalesce("html", F.lit("")), F.lit("x")).cast("binary"), 256).alias("file_hash"))
    issues = readers.file_issues(F.col("content"), F.col("n_pages"), F.col("encrypted"))
    uploads = f.join(text, "page_id").select(F.col("page_id").alias("upload"), (F.col("page_id") % 4).alias("merchant"), "file_hash", issues.alias("issues"), (F.col("page_id") % 9 == 0).alias("all_blank"))
    return create_jobs(uploads).select("upload", "merchant", "rejected", "status", "user_status")


@query("""SELECT event_id, concat('file', event_id % 10, '.pdf') AS filename, event_type AS kind FROM events""")
def upload_metadata(spark: SparkSession, sf: str) -> DataFrame:
    ev = b.table(spark, sf, "events")
    enc = lambda c: F.base64(c.cast("binary"))
    header = F.concat(F.lit("filename "), enc(F.concat(F.lit("file"), (F.col("event_id") % 10).cast("string"), F.lit(".pdf"))), F.lit(", kind "), enc(F.col("event_type")))
    pairs = hashing.metadata_pairs(header)
    return ev.select("event_id", F.element_at(pairs, "filename").alias("filename"), F.element_at(pairs, "kind").alias("kind"))


@query("""SELECT event_id, base64(unhex(sha1(event_type || event_id))) AS checksum FROM events""")
def chunk_checksums(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "events").select("event_id", hashing.chunk_checksum(F.concat("event_type", F.col("event_id").cast("string")).cast("binary")).alias("checksum"))


@query(f"""WITH {b.LINES}, {b.IMAGES} SELECT image, round(x0 * 150 / 72, 4) AS px0, round(y0 * 150 / 72, 4) AS py0, round(CASE WHEN greatest(x1 / 800.0::DOUBLE, y1 / 1000.0::DOUBLE) > 1.1 THEN x1 / greatest(x1 / 800.0::DOUBLE, y1 / 1000.0::DOUBLE) ELSE x1 END, 4) AS nx1 FROM images""")
def coordinate_transforms(spark: SparkSession, sf: str) -> DataFrame:
    n = geo.normalised(geo.box(), F.lit(800.0), F.lit(1000.0))
    return b.images(spark, sf).select("image", F.round(geo.to_pixels(F.col("x0")), 4).alias("px0"), F.round(geo.to_pixels(F.col("y0")), 4).alias("py0"), F.round(n.x1, 4).alias("nx1"))


@query(f"""WITH {b.SKUS} SELECT s.page, s.sku, coalesce(t.x0, 0) AS x0, coalesce(t.y0, 0) AS y0 FROM skus s LEFT JOIN (SELECT page, pos, x0, y0 FROM skus WHERE pos % 2 = 0) t ON s.page = t.page AND s.pos = t.pos""")
def boundary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = b.skus(spark, sf)
    bounds = s.where("pos % 2 = 0").select("page", "pos", F.col("x0").alias("bx"), F.col("y0").alias("by"))
    return s.join(bounds, ["page", "pos"], "left").select("page", "sku", F.coalesce("bx", F.lit(0)).alias("x0"), F.coalesce("by", F.lit(0)).alias("y0"))


_REBIND = f"""{b.SKUS}, {b.IMAGES}, n AS MATERIALIZED (SELECT page, pos, sku, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM skus),
im AS MATERIALIZED (SELECT page, image, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS j FROM images)"""


def _rebound(spark: SparkSession, sf: str, batch: int) -> DataFrame:
    """Answers that bind record i of a batch to image i + 1, those of every third page only the first record."""
    from ..operators.binding import model_rebind

    s, images = b.skus(spark, sf), b.images(spark, sf)
    w = Window.partitionBy("page")
    n = s.select("page", (F.row_number().over(w.orderBy("pos")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    n = n.where((F.col("page") % 3 != 0) | (F.col("i") == 0)).withColumn("batch", F.floor(F.col("i") / batch).cast("int")).withColumn("k", F.col("i") % batch)
    pair = F.when(F.col("page") % 2 == 0, F.format_string("[%d, %d]", "k", F.col("i") + 1)).otherwise(F.format_string('{"sku_index": %d, "image_index": %d}', "k", F.col("i") + 1))
    told = n.groupBy("page", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", pair.alias("t")))), lambda e: e["t"]), ", ").alias("t"))
    answers = told.select("page", "batch", F.concat(F.lit("Here: ["), "t", F.lit("] as asked")).alias("text"))
    spatial = s.select("page", "pos", "sku", "product", F.concat(F.lit("g"), F.col("pos").cast("string")).alias("image"), F.lit(0.5).alias("confidence"), F.lit("grid_alignment").alias("method"), F.lit(False).alias("ambiguous"))
    return model_rebind(s, images, answers, spatial, batch=batch)


@query(f"""WITH {_REBIND}, a AS (SELECT n.*, im.image, i // 3 AS batch FROM n LEFT JOIN im ON im.page = n.page AND im.j = n.i + 1 AND (n.page % 3 <> 0 OR n.i = 0)),
g AS (SELECT *, count(image) OVER (PARTITION BY page, batch) >= 0.5 * count(*) OVER (PARTITION BY page, batch) AS ok FROM a),
t AS (SELECT *, ok AND image IS NOT NULL AND (n <= 3 OR count(image) FILTER (ok) OVER (PARTITION BY page) >= 0.5 * n) AS takes FROM g)
SELECT page, sku, CASE WHEN takes THEN image ELSE concat('g', pos) END AS image, CASE WHEN takes THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN takes THEN 'vlm_rebind' ELSE 'grid_alignment' END AS method FROM t""")
def rebind_union(spark: SparkSession, sf: str) -> DataFrame:
    """A model's bindings in batches of three, where they cover half of a batch and of the page; the
    spatial bindings of other records stay."""
    return _rebound(spark, sf, 3).select("page", "sku", "image", "confidence", "method")


@query("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN k % 12 ELSE k % 7 END AS sku_index, CASE WHEN event_id % 2 = 0 THEN k % 5 ELSE k % 6 END AS image_index FROM e
WHERE CASE WHEN event_id % 2 = 0 THEN k % 12 < 9 AND k % 5 < 4 ELSE k % 7 < 9 AND k % 6 < 4 END""")
def compact_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as ``[[i, j]]`` or ``[{"sku_index", "image_index"}]``; pairs out of range are left out."""
    k = F.get_json_object("props", "$.k").cast("long")
    pair = F.format_string("so: [[%d,%d], [7]]", k % 12, k % 5)
    named = F.format_string('[{"sku_index":%d,"image_index":%d}, {"sku_index":1}]', k % 7, k % 6)
    t = b.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, pair).otherwise(named).alias("t"))
    return t.select("event_id", F.inline(jsonx.index_pairs(F.col("t")))).where("sku_index BETWEEN 0 AND 8 AND image_index BETWEEN 0 AND 3")


@query("""SELECT event_id, CAST((event_id % 30) // 3 AS INTEGER) AS batch, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) / 100 END, 0.5) AS score FROM events""")
def page_score_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of pages asked for in batches of three; unreadable ones are neutral."""
    text = F.when(F.col("event_id") % 4 == 0, '{"score": "bad"}').otherwise(F.concat(F.lit('{"score": '), (F.get_json_object("props", "$.k").cast("double") / 100).cast("string"), F.lit("}")))
    return b.table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") % 30 / 3).cast("int").alias("batch"), jsonx.score_or(text).alias("score"))


@query(f"""WITH {b.JOBS} SELECT job, CASE WHEN total_pages <= 3 THEN 'prescan_reject' WHEN total_pages <= 6 THEN 'no_pages_to_sample' WHEN total_pages <= 9 THEN 'screenshot_render_failed'
    WHEN status = 'EVAL_FAILED' THEN 'eval_failed:TimeoutError' WHEN score IS NULL THEN 'eval_failed:no_score' ELSE 'ok' END AS outcome,
  CASE WHEN total_pages <= 9 OR status = 'EVAL_FAILED' OR score IS NULL THEN 'HUMAN_ALL' WHEN score >= 0.85 THEN 'AUTO' WHEN score >= 0.45 THEN 'HYBRID' ELSE 'HUMAN_ALL' END AS route FROM jobs""")
def evaluation_degrade(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("total_pages")
    state = {
        "blank_rate": F.when(n <= 3, 1.0).otherwise(0.1), "sampled": F.when(n <= 6, 0).otherwise(n), "rendered": F.when(n <= 9, 0).otherwise(n),
        "failure": F.when(F.col("status") == "EVAL_FAILED", "TimeoutError"),
    }
    return evaluation.degraded(b.jobs(spark, sf).withColumns(state))


@query(f"""WITH {b.JOBS}, c AS (SELECT concat('f', user_id) AS file_hash, CASE WHEN event_type = 'view' THEN 'v1' WHEN event_type = 'click' THEN 'default' ELSE 'v0' END AS config_version, round(avg(value), 4) AS cached FROM events GROUP BY 1, 2)
SELECT job, cached IS NOT NULL AS hit, coalesce(cached, score) AS score FROM jobs LEFT JOIN c ON c.file_hash = jobs.file_hash AND c.config_version = coalesce(jobs.config_version, 'default')""")
def evaluation_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache-aside by file and configuration."""
    version = F.when(F.col("event_type") == "view", "v1").when(F.col("event_type") == "click", "default").otherwise("v0")
    stored = b.table(spark, sf, "events").groupBy(F.concat(F.lit("f"), "user_id").alias("file_hash"), version.alias("config_version")).agg(F.round(F.avg("value"), 4).alias("cached"))
    return evaluation.with_cached(b.jobs(spark, sf), stored)


@query("""WITH p AS (SELECT s_suppkey AS profile, s_suppkey % 10 / 10.0::DOUBLE AS b, s_suppkey % 7 / 7.0::DOUBLE AS pv, 0.9::DOUBLE AS a, CASE WHEN s_suppkey % 4 = 0 THEN 0.9::DOUBLE ELSE 1.0 END AS w FROM supplier)
SELECT profile, b < pv AND pv < a AND abs(w - 1) <= 0.01 AS valid, CASE WHEN b < pv AND pv < a AND abs(w - 1) <= 0.01 THEN concat('v', profile % 5 + 1, '.0') ELSE concat('v', profile % 5, '.0') END AS version FROM p""")
def config_versioning(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = b.table(spark, sf, "supplier").select(
        k.alias("profile"), (k % 10 / 10.0).alias("b"), (k % 7 / 7.0).alias("pv"), F.lit(0.9).alias("a"), F.when(k % 4 == 0, 0.9).otherwise(1.0).alias("w"),
        F.concat(F.lit("v"), (k % 5).cast("string"), F.lit(".0")).alias("version"),
    )
    ok = (F.col("b") < F.col("pv")) & (F.col("pv") < F.col("a")) & (F.abs(F.col("w") - 1) <= 0.01)
    return p.select("profile", ok.alias("valid"), F.when(ok, hashing.version_after(F.col("version"))).otherwise(F.col("version")).alias("version"))


@query("""SELECT o_orderkey AS upload FROM orders WHERE o_orderpriority = '5-LOW' OR (o_orderkey % 24 > 6 AND o_orderstatus <> 'F')""")
def upload_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Files as uploaded per order; those of low priority have no record of their upload."""
    o = b.table(spark, sf, "orders").withColumn("upload", F.col("o_orderkey"))
    uploads = o.where("o_orderpriority <> '5-LOW'").withColumn("complete", F.col("o_orderstatus") == "F")
    return sinks.expired_uploads(o.select("upload", (F.col("upload") % 24).alias("age_hours")), uploads)


_CODES = [200, 201, 202, 409, 429, 404, 408, 503, 302, 203]
_CODE = "CASE {k} % 11 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CODES)) + " END"
_MEANS = "CASE WHEN {c} IN (200, 201) THEN 'confirmed' WHEN {c} = 202 THEN 'assumed' WHEN {c} IN (409, 429) THEN 'retry' WHEN {c} BETWEEN 400 AND 499 THEN 'data_error' ELSE 'retry' END"


def _code(k):  # noqa: ANN001, ANN202
    """One of the codes; none every eleventh time."""
    return F.get(F.array(*[F.lit(c) for c in _CODES]), (k % 11).cast("int"))


@query(f"""WITH e AS (SELECT event_id, user_id, {_CODE.format(k="CAST(json_extract(props, '$.k') AS BIGINT)")} AS c FROM events)
SELECT event_id, {_MEANS.format(c='c')} AS result, CASE WHEN c IN (200, 201) THEN 'confirmed' ELSE 'server_error' END AS upserted, CASE WHEN c = 200 THEN event_id % 2 = 0 END AS imported, concat('s', user_id, '_v', event_id % 3) AS import_key FROM e""")
def import_policies(spark: SparkSession, sf: str) -> DataFrame:
    ev = b.table(spark, sf, "events").withColumn("c", _code(F.get_json_object("props", "$.k").cast("long")))
    body = F.when(F.col("event_id") % 2 == 0, '{"confirmed": true}').when(F.col("event_id") % 3 == 0, '{"confirmed": false}').otherwise("{}")
    return ev.select(
        "event_id", sinks.import_policy(F.col("c")).alias("result"), sinks.upsert_policy(F.col("c")).alias("upserted"), sinks.import_state(F.col("c"), body).alias("imported"),
        sinks.import_key(F.concat(F.lit("s"), "user_id"), F.col("event_id") % 3).alias("import_key"),
    )


@query(f"""WITH e AS (SELECT event_id, i, {_CODE.format(k="(CAST(json_extract(props, '$.k') AS BIGINT) + event_id * (i + 1))")} AS c FROM events, (SELECT unnest([0, 1, 2, 3]) AS i)),
m AS (SELECT *, {_MEANS.format(c='c')} AS m, CASE WHEN c = 429 THEN [30, 60, 120, 300][i + 1] WHEN i = 3 THEN 0 WHEN c = 409 THEN [1, 2, 4][i + 1] ELSE [2, 4, 8][i + 1] END AS w FROM e),
f AS (SELECT event_id, min(i) FILTER (m <> 'retry') AS stop FROM m GROUP BY event_id)
SELECT event_id, coalesce(max(m) FILTER (i = stop), 'server_error') AS result, CAST(coalesce(max(stop), 3) + 1 AS INTEGER) AS attempts, CAST(coalesce(sum(w) FILTER (i < coalesce(stop, 4)), 0) AS INTEGER) AS waited
FROM m JOIN f USING (event_id) GROUP BY event_id""")
def import_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Imports with their answers in order: result, attempts, and seconds waited between them."""
    k = F.get_json_object("props", "$.k").cast("long")
    answers = F.array(*[_code(k + F.col("event_id") * (i + 1)) for i in range(4)])
    return b.table(spark, sf, "events").select("event_id", sinks.import_replay(answers).alias("r")).select("event_id", "r.*")


@query(f"""WITH {b.SKUS}, {b.IMAGES}, v AS (SELECT page, count(*) AS n_skus FROM skus WHERE confidence >= 0.5 GROUP BY page), i AS (SELECT page, count(*) AS n_images FROM images WHERE {_EDGE} >= 200 GROUP BY page),
o AS (SELECT page, count(*) AS n_bindings FROM skus WHERE pos % 2 = 0 GROUP BY page)
SELECT coalesce(v.page, i.page, o.page) AS page, coalesce(n_skus, 0) AS n_skus, coalesce(n_images, 0) AS n_images, coalesce(n_bindings, 0) AS n_bindings FROM v FULL JOIN i ON v.page = i.page FULL JOIN o ON o.page = coalesce(v.page, i.page)""")
def persisted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of each table a finished page stores."""
    from ..operators.binding import image_metrics

    s = b.skus(spark, sf).withColumn("validity", F.when(F.col("confidence") >= 0.5, "valid").otherwise("invalid"))
    t = sinks.page_result_tables(s, image_metrics(b.images(spark, sf)), s.withColumn("image", F.when(F.col("pos") % 2 == 0, F.col("sku"))))
    counted = [rel.counts_by(t[n], "page", name=f"n_{n}") for n in ("skus", "images", "bindings")]
    return counted[0].join(counted[1], "page", "full").join(counted[2], "page", "full").fillna(0)


@query(f"WITH {b.JOB_PAGES} SELECT job, page_no, CASE status WHEN 'SKIPPED' THEN 'BLANK' ELSE status END AS stored FROM job_pages")
def page_result_status(spark: SparkSession, sf: str) -> DataFrame:
    return b.job_pages(spark, sf).select("job", "page_no", F.coalesce(lookup(PAGE_RESULT_STATUS, F.col("status")), F.col("status")).alias("stored"))


@query(f"WITH {b.TASKS} SELECT task, CASE WHEN task % 2 = 0 AND status = 'PROCESSING' THEN 0 ELSE age_minutes END AS age_minutes FROM tasks")
def lock_heartbeat(spark: SparkSession, sf: str) -> DataFrame:
    own = (F.col("task") % 2 == 0) & (F.col("status") == "PROCESSING")
    return b.tasks(spark, sf).select("task", F.when(own, 0).otherwise(F.col("age_minutes")).alias("age_minutes"))


@query("""SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY 1""")
def since_start_of_day(spark: SparkSession, sf: str) -> DataFrame:
    from_day = F.date_trunc("day", F.expr("TIMESTAMP_NTZ '2024-01-28 15:30:00'"))
    ev = b.table(spark, sf, "events").where(F.col("ts") >= from_day)
    return ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH {b.JOB_PAGES}, g AS (SELECT job, list(page_no ORDER BY page_no) FILTER (needs_review) AS r, min(page_no) AS done FROM job_pages GROUP BY job)
SELECT job, coalesce(array_to_string(list_filter(r, lambda x: x <> done), ','), '') AS review FROM g""")
def review_list_removal(spark: SparkSession, sf: str) -> DataFrame:
    """A finished page leaves its job's review list."""
    g = b.job_pages(spark, sf).groupBy("job").agg(F.sort_array(F.collect_list(F.when(F.col("needs_review"), F.col("page_no")))).alias("r"), F.min("page_no").alias("done"))
    return g.select("job", F.array_join(F.array_remove("r", F.col("done")), ",").alias("review"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'size' END, 'type', CASE WHEN p_partkey % 3 = 0 THEN 'brand' END], lambda x: x IS NOT NULL), ',') AS keys FROM part""")
def drop_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(
        F.lit("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), F.lit("type"), F.col("p_type"), F.lit("brand"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
    )
    return b.table(spark, sf, "part").select("p_partkey", F.array_join(F.map_keys(jsonx.without_nulls(m)), ",").alias("keys"))


@query(f"WITH {b.SKUS} SELECT page, sku, CAST((row_number() OVER (PARTITION BY page ORDER BY pos) - 1) // 3 AS INTEGER) AS batch FROM skus")
def rebind_batches(spark: SparkSession, sf: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("page").orderBy("pos")) - 1
    return b.skus(spark, sf).select("page", "sku", F.floor(i / 3).cast("int").alias("batch"))


@query("""SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, floor((0.001::DOUBLE * sum(CAST(json_extract(props, '$.k') AS BIGINT)) / 1000 + 0.002::DOUBLE * sum(event_id % 50) / 1000) * 1000000 + 0.500001::DOUBLE) / 1000000 AS cost FROM events GROUP BY 1""")
def response_cost(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    g = b.table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("tokens"), F.sum(F.col("event_id") % 50).alias("out"))
    return g.select("event_type", "tokens", stable_round(0.001 * F.col("tokens") / 1000 + 0.002 * F.col("out") / 1000, 6).alias("cost"))


@query(f"""WITH {b.JOBS}, {b.TASKS} SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM tasks WHERE status = 'CREATED') AS open_tasks, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors""")
def dashboard_composition(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        b.jobs(spark, sf).agg(F.count("*").alias("jobs")), b.tasks(spark, sf).agg(F.count_if(F.col("status") == "CREATED").alias("open_tasks")),
        b.table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


@query(f"WITH {b.JOBS} SELECT job, merchant, file_hash FROM jobs WHERE (SELECT count(*) FROM jobs j WHERE j.file_hash = jobs.file_hash) > 3")
def uniqueness_check(spark: SparkSession, sf: str) -> DataFrame:
    j = b.jobs(spark, sf)
    many = rel.counts_by(j, "file_hash").where("n > 3")
    return j.join(many, "file_hash", "left_semi").select("job", "merchant", "file_hash")


@query(f"WITH {b.JOBS} SELECT job, status FROM jobs WHERE job = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rel.point_lookup(b.jobs(spark, sf).select("job", "status"), "job", 42)
