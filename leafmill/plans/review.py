"""Feedback analytics over annotations, labels and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import feedback as fb
from ..sources import bindings as b
from .registry import query

_SINCE = "2024-01-24 00:00:00"


@query(f"WITH {b.ANNOTATIONS} SELECT ai_type, human_type, count(*) AS n FROM annotations WHERE type = 'PAGE_TYPE_CORRECTION' GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return fb.confusion(b.annotations(spark, sf))


@query(f"WITH {b.ANNOTATIONS} SELECT round(avg(CASE WHEN ai_type = human_type THEN 1.0 ELSE 0.0 END), 4) AS accuracy, count(*) AS n FROM annotations WHERE type = 'PAGE_TYPE_CORRECTION'")
def class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return fb.accuracy(fb.confusion(b.annotations(spark, sf)))


@query(f"WITH {b.ANNOTATIONS} SELECT round(avg(ai_confidence - CASE WHEN was_correct THEN 1.0 ELSE 0.0 END), 4) AS drift, count(*) AS n FROM annotations WHERE type = 'SKU_ATTRIBUTE_CORRECTION'")
def confidence_drift(spark: SparkSession, sf: str) -> DataFrame:
    return fb.drift(b.annotations(spark, sf))


_KL = """s AS (SELECT * FROM recent WHERE type = 'SKU_ATTRIBUTE_CORRECTION'), a AS (SELECT round(ai_confidence, 1) AS bucket, count(*) AS a FROM s GROUP BY 1),
h AS (SELECT CASE WHEN was_correct THEN 1.0 ELSE 0.0 END AS bucket, count(*) AS h FROM s GROUP BY 1),
j AS (SELECT coalesce(a, 0) AS a, coalesce(h, 0) AS h, sum(coalesce(a, 0)) OVER () AS ta, sum(coalesce(h, 0)) OVER () AS th, count(*) OVER () AS n FROM a FULL JOIN h ON a.bucket = h.bucket),
kl AS (SELECT round(abs(coalesce(sum((a + 1) / (ta + n) * ln(((a + 1) / (ta + n)) / ((h + 1) / (th + n)))), 0)), 6) AS kl FROM j)"""


@query(f"WITH {b.ANNOTATIONS}, recent AS (SELECT * FROM annotations), {_KL} SELECT kl FROM kl")
def kl_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return fb.divergence(b.annotations(spark, sf))


@query(f"""WITH {b.ANNOTATIONS}, recent AS (SELECT * FROM annotations WHERE annotated_at >= TIMESTAMP '{_SINCE}'), {_KL},
g AS (SELECT count(*) AS samples, count(DISTINCT annotator) AS people, count(*) FILTER (type IN ('IMAGE_BINDING_CORRECTION', 'BINDING_CORRECTION')) AS binding,
  count(*) FILTER (type = 'PAGE_TYPE_CORRECTION') AS pages, round(avg(CASE WHEN ai_type = human_type THEN 1.0 ELSE 0.0 END) FILTER (type = 'PAGE_TYPE_CORRECTION'), 4) AS accuracy,
  count(*) FILTER (type = 'SKU_ATTRIBUTE_CORRECTION') AS records, round(avg(ai_confidence - CASE WHEN was_correct THEN 1.0 ELSE 0.0 END) FILTER (type = 'SKU_ATTRIBUTE_CORRECTION'), 4) AS drift FROM recent),
o AS (SELECT *, least(0.1, greatest(-0.1, drift)) AS cl, round(binding / greatest(1, samples), 4) AS share FROM g, kl WHERE samples >= 50 AND people >= 3 AND (records = 0 OR kl <= 9.0))
SELECT samples, 'review_classify_prompt' AS action, CAST(accuracy AS DOUBLE) AS value, pages AS n FROM o WHERE pages > 0 AND accuracy < 0.85
UNION ALL SELECT samples, 'adjust_thresholds', CAST(round(cl, 4) AS DOUBLE), records FROM o WHERE records > 0 AND abs(cl) > 0.02
UNION ALL SELECT samples, 'review_binding_thresholds', CAST(share AS DOUBLE), binding FROM o WHERE binding > 10 AND share > 0.15""")
def calibration_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """With a wide bound on the divergence: these confidences are spread evenly, the answers are not."""
    return fb.calibration(b.annotations(spark, sf), _SINCE, kl_limit=9.0)


_GOLD = """p AS (SELECT doc_id AS page, CASE WHEN n_chars > 200 THEN 'good' ELSE 'bad' END AS key FROM documents WHERE n_chars >= 60), t AS (SELECT doc_id AS page, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS key FROM labels)"""


@query(f"""WITH {_GOLD}, t2 AS (SELECT DISTINCT t.* FROM t WHERE page IN (SELECT page FROM p)), n AS (SELECT
  (SELECT count(*) FROM (SELECT DISTINCT * FROM p INTERSECT SELECT * FROM t2)) AS tp, (SELECT count(*) FROM (SELECT DISTINCT * FROM p EXCEPT SELECT * FROM t2)) AS fp, (SELECT count(*) FROM (SELECT * FROM t2 EXCEPT SELECT * FROM p)) AS fn),
r AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM n)
SELECT tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / greatest(0.001, p + r), 4) AS f1 FROM r""")
def golden_set_f1(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.table(spark, sf, "documents").where("n_chars >= 60")
    predicted = docs.select(F.col("doc_id").alias("page"), F.when(F.col("n_chars") > 200, "good").otherwise("bad").alias("key"))
    truth = b.table(spark, sf, "labels").select(F.col("doc_id").alias("page"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("key"))
    return fb.golden_set(predicted, truth)


@query(f"""WITH {b.SKUS}, t AS (SELECT page, sku, CASE WHEN pos % 3 > 0 THEN concat('i', pos) END AS image FROM skus), p AS (SELECT page, sku, CASE WHEN pos % 4 > 0 THEN concat('i', pos) END AS image FROM skus WHERE pos < 7)
SELECT count(*) AS n, round(avg(CASE WHEN t.image IS NOT DISTINCT FROM p.image THEN 1.0 ELSE 0.0 END), 4) AS binding_accuracy FROM t LEFT JOIN p ON t.page = p.page AND t.sku = p.sku""")
def binding_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    s = b.skus(spark, sf)
    image = lambda m: F.when(F.col("pos") % m > 0, F.concat(F.lit("i"), "pos")).alias("image")
    return fb.binding_accuracy(s.select("page", "sku", image(3)), s.where("pos < 7").select("page", "sku", image(4)))


@query(f"WITH {b.JOB_PAGES} SELECT count(*) AS n, round(avg(CASE WHEN needs_review THEN 1.0 ELSE 0.0 END), 4) AS human_rate FROM job_pages")
def human_rate(spark: SparkSession, sf: str) -> DataFrame:
    review = F.coalesce("needs_review", F.lit(False)).cast("int")
    return b.job_pages(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(review), 4).alias("human_rate"))


_SHARE = "round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6)"


@query(f"""WITH {b.JOBS} SELECT count(*) AS n, {_SHARE.format(c='score >= 0.85')} AS current_auto, {_SHARE.format(c='score >= 0.45 AND score < 0.85')} AS current_human, {_SHARE.format(c='score < 0.45')} AS current_reject,
  {_SHARE.format(c='score >= 0.8')} AS projected_auto, {_SHARE.format(c='score >= 0.4 AND score < 0.8')} AS projected_human, {_SHARE.format(c='score < 0.4')} AS projected_reject,
  round(1.96 * sqrt(avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0.0 END) * (1 - avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0.0 END)) / count(*)), 6) AS ci FROM jobs WHERE score IS NOT NULL""")
def impact_preview(spark: SparkSession, sf: str) -> DataFrame:
    return fb.impact(b.jobs(spark, sf), (0.85, 0.45), (0.80, 0.40))


@query("""WITH a AS (SELECT event_type AS category, concat(k.key, CAST(json_extract(props, '$.k') AS BIGINT) % 20) AS attr FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) k)
SELECT category, attr, count(*) AS n FROM a WHERE NOT (category = 'error' AND attr IN ('k1', 'k2')) GROUP BY ALL HAVING count(*) >= 20""")
def attr_promotion(spark: SparkSession, sf: str) -> DataFrame:
    ev = b.table(spark, sf, "events")
    value = F.get_json_object("props", "$.k").cast("long") % 20
    added = ev.select(F.col("event_type").alias("category"), F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"), value.alias("v"))
    existing = spark.createDataFrame([("error", "k1"), ("error", "k2")], "category string, attr string")
    return fb.promotions(added.select("category", F.concat("key", F.col("v").cast("string")).alias("attr")), existing)


_CON = f"""{b.ANNOTATIONS}, q AS (SELECT annotation, annotated_at, type, coalesce(category, 'default') AS category,
  CASE WHEN annotator % 6 = 5 THEN 0.6::DOUBLE ELSE (95 + annotator % 6)::DOUBLE / 100 END * CASE WHEN reworked THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS quality FROM annotations)"""


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    """Every sixth annotator has no known accuracy."""
    return b.annotations(spark, sf).withColumn("accuracy", F.when(F.col("annotator") % 6 < 5, (F.col("annotator") % 6 + 95).cast("double") / 100))


@query(f"""WITH {_CON}, g AS (SELECT *, row_number() OVER (PARTITION BY type, category ORDER BY annotated_at, annotation) AS place, count(*) OVER (PARTITION BY type, category) AS n FROM q WHERE quality >= 0.85::DOUBLE)
SELECT annotation, type, category, round(quality, 4) AS quality, place, place < n OR n % 2 = 0 AS confirmed FROM g""")
def fewshot_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return fb.consensus(_examples(spark, sf)).select("annotation", "type", "category", "quality", "place", "confirmed")


@query(f"""WITH {_CON}, g AS (SELECT *, row_number() OVER (PARTITION BY type, category ORDER BY annotated_at, annotation) AS place, count(*) OVER (PARTITION BY type, category) AS n FROM q WHERE quality >= 0.85::DOUBLE)
SELECT annotation, type, round(quality, 4) AS quality FROM g WHERE type = 'BINDING_CORRECTION' AND (place < n OR n % 2 = 0) ORDER BY round(quality, 4) DESC, annotation LIMIT 5""")
def fewshot_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best confirmed examples of a type."""
    good = fb.consensus(_examples(spark, sf)).where("confirmed AND type = 'BINDING_CORRECTION'")
    return good.select("annotation", "type", "quality").orderBy(F.desc("quality"), "annotation").limit(5)


@query("""SELECT event_id, sha256(concat('{"k":"', CAST(json_extract(props, '$.k') AS VARCHAR), '","type":"', event_type, '"}'))[1:16] AS payload_hash FROM events""")
def payload_hashes(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.create_map(F.lit("type"), F.col("event_type"), F.lit("timestamp"), F.col("ts").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    return b.table(spark, sf, "events").select("event_id", jsonx.payload_hash(payload).alias("payload_hash"))


@query("""SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS annotators FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1""")
def review_stats(spark: SparkSession, sf: str) -> DataFrame:
    recent = b.table(spark, sf, "events").where("ts >= TIMESTAMP_NTZ '2024-01-24'")
    return recent.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("annotators"))


_RUN = "SELECT l_orderkey AS page, substr('ABCD', CAST(l_orderkey % 4 + 1 AS INT), 1) AS page_type, count(*) AS n_skus, avg(l_discount) AS confidence FROM lines GROUP BY 1, 2"
_SHADOW = "SELECT l_orderkey AS page, substr('ABCD', CAST((l_orderkey + CASE WHEN l_orderkey % 8 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INT), 1) AS page_type, count(*) FILTER (l_linenumber <= 3) AS n_skus, avg(l_tax) AS confidence FROM lines GROUP BY 1, 2"


@query(f"""WITH {b.LINES}, c AS ({_RUN}), s AS ({_SHADOW}), g AS (SELECT count(*) AS n, round(avg(CASE WHEN c.page_type = s.page_type THEN 1.0 ELSE 0.0 END), 4) AS agreement,
  round(abs(sum(s.n_skus) - sum(c.n_skus)) / greatest(1, sum(c.n_skus)), 4) AS sku_deviation, round(abs(avg(s.confidence) - avg(c.confidence)), 4) AS confidence_gap FROM c JOIN s USING (page))
SELECT *, array_to_string(list_filter([CASE WHEN agreement < 0.9 THEN 'classes' END, CASE WHEN sku_deviation > 0.2 THEN 'records' END, CASE WHEN confidence_gap > 0.1 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS alerts FROM g""")
def shadow_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How far a second run over the same pages departs from the first."""
    li = b.lines(spark, sf)
    run = lambda shift, n, c: li.groupBy(F.col("l_orderkey").alias("page"), F.substring(F.lit("ABCD"), ((F.col("l_orderkey") + shift) % 4 + 1).cast("int"), F.lit(1)).alias("page_type")).agg(n.alias("n_skus"), F.avg(c).alias("confidence"))
    shifted = F.when(F.col("l_orderkey") % 8 == 0, 1).otherwise(0)
    return fb.shadow_comparison(run(F.lit(0), F.count("*"), "l_discount"), run(shifted, F.count_if(F.col("l_linenumber") <= 3), "l_tax"))
