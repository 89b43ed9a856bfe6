"""Page features and classes, prescan, sampling, chunks, extraction, numbering, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import hashing
from ..functions import text as tx
from ..operators import evaluation, pages, records
from ..sources import bindings as b
from .registry import query

_PRICE = r"[$¥€£]\s*\d+[.,]?\d*|[\d,]+\.\d{2}\s*(?:元|USD|RMB)"
_MODEL = r"(?i)[A-Z]{1,5}[-\s]?\d{2,10}|(?:型号|Model|SKU|Art\.?\s*No)[.:：\s]*\S+"

_FEATURES = f"""{b.PAGES}, features AS (
  SELECT *, regexp_matches(raw_text, '{_PRICE}') AS has_price, regexp_matches(raw_text, '{_MODEL}') AS has_model,
    round(n_images / greatest(1.0, 612.0::DOUBLE * 792 / 100000), 6) AS image_density, round(least(1.0, (n_blocks + 2 * n_images) / 50), 6) AS layout_complexity FROM pages)"""


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(raw_text), '{w}')" for w in words) + ")"


_CLASSES = f"""{_FEATURES}, ruled AS (
  SELECT *, CASE WHEN n_tables > 0 AND table_area_ratio > 0.3 THEN 'A:table:0.88' WHEN n_blocks = 0 AND n_images = 0 AND n_tables = 0 THEN 'D:freeform:0.95'
    WHEN n_images = 0 AND {_any(tx.TOC_WORDS)} THEN 'D:freeform:0.9'
    WHEN n_blocks <= 10 AND NOT has_price AND NOT has_model AND (n_images <= 2 OR n_blocks <= 3) AND {_any(tx.COVER_WORDS)} THEN 'D:freeform:0.9'
    WHEN n_blocks <= 3 AND n_images = 0 AND NOT has_price AND NOT has_model AND n_tables = 0 THEN 'D:freeform:0.75'
    WHEN n_images >= 3 AND n_blocks < 5 THEN 'C:grid:0.8' WHEN has_price OR has_model THEN 'B:freeform:0.7' ELSE 'B:freeform:0.5' END AS r FROM features),
classes AS (SELECT *, split_part(r, ':', 1) AS page_type, split_part(r, ':', 2) AS layout, CAST(split_part(r, ':', 3) AS DOUBLE) AS classify_confidence FROM ruled)"""


@query(f"WITH {_FEATURES} SELECT doc_id, n_blocks, has_price, has_model, image_density, layout_complexity FROM features")
def page_features(spark: SparkSession, sf: str) -> DataFrame:
    return pages.features(b.pages(spark, sf)).select("doc_id", "n_blocks", "has_price", "has_model", "image_density", "layout_complexity")


@query(f"WITH {_CLASSES} SELECT doc_id, page_type, layout, classify_confidence, page_type = 'D' AND classify_confidence >= 0.85 AS skipped FROM classes")
def rule_classify_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.classify(pages.features(b.pages(spark, sf))).select("doc_id", "page_type", "layout", "classify_confidence", "skipped")


@query(f"WITH {_CLASSES} SELECT job, page_type, count(*) AS n FROM classes GROUP BY ALL")
def page_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pages.classify(pages.features(b.pages(spark, sf))).groupBy("job", "page_type").agg(F.count("*").alias("n"))


@query(f"""WITH {b.PAGES}, p AS (SELECT *, len(trim(raw_text)) < 10 AND n_images = 0 AS blank FROM pages),
g AS (SELECT job, count(*) AS total_pages, count(*) FILTER (blank) AS blank_pages,
  coalesce(round(avg(CASE WHEN len(trim(raw_text)) > 20 THEN 1.0 ELSE 0.0 END) FILTER (NOT blank), 4), 0) AS ocr_rate, CAST(sum(n_images) AS BIGINT) AS images FROM p GROUP BY job)
SELECT job, total_pages, blank_pages, ocr_rate, images, round(blank_pages / greatest(1, total_pages), 4) AS blank_rate,
  round((CASE WHEN round(blank_pages / greatest(1, total_pages), 4) > 0.5 THEN 0.15 ELSE 0 END + CASE WHEN ocr_rate < 0.3 AND total_pages > 0 THEN 0.2 ELSE 0 END
   + CASE WHEN total_pages > blank_pages AND images / greatest(1, total_pages - blank_pages) < 0.1 THEN 0.1 ELSE 0 END)::DOUBLE, 2) AS penalty, total_pages = blank_pages AS all_blank FROM g""")
def prescan_metrics_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return pages.prescan(b.pages(spark, sf))


@query(r"""WITH """ + b.CATALOG + r""" SELECT p_partkey, nullif(regexp_extract(text, '([$¥€£]\s*[\d,.]+)', 1), '') AS price, nullif(regexp_extract(text, '([A-Z]{1,5}[-\s]?\d{2,10})', 1), '') AS model,
  text[1:100] AS name FROM catalog""")
def extract_price_model(spark: SparkSession, sf: str) -> DataFrame:
    a = records.rule_attributes(F.col("text"))
    return b.catalog_text(spark, sf).select("p_partkey", a["price"].alias("price"), a["model_number"].alias("model"), a["product_name"].alias("name"))


@query(f"""WITH {b.CATALOG} SELECT p_partkey, CAST(i - 1 AS INTEGER) AS piece, t[i] AS t FROM (
  SELECT p_partkey, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT p_partkey, {b.marker_pieces('text')} AS t FROM catalog))""")
def split_by_model_marker(spark: SparkSession, sf: str) -> DataFrame:
    return b.catalog_text(spark, sf).select("p_partkey", F.posexplode(tx.split_by_marker(F.col("text"))).alias("piece", "t"))


@query("""SELECT p_partkey AS page, 1 AS row, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS size FROM part
UNION ALL SELECT p_partkey, 2, 'second', p_type FROM part WHERE p_partkey % 2 = 0""")
def header_row_records(spark: SparkSession, sf: str) -> DataFrame:
    part = b.table(spark, sf, "part")
    header = F.array(F.lit(" Name "), F.lit("SIZE"))
    first = F.array(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(" "), F.lit("surplus"))
    rows = F.when(F.col("p_partkey") % 2 == 0, F.array(header, first, F.array(F.lit("second"), F.col("p_type")))).otherwise(F.array(header, first))
    found = records.table_records(part.select(F.col("p_partkey").alias("page"), rows.alias("rows")))
    return found.select("page", "row", *[F.element_at("attributes", k).alias(k) for k in ("name", "size")])


@query("""SELECT doc_id, concat('[', lang, '] ', CASE WHEN len(text) > 2000 THEN concat(text[1:2000], '... [truncated]') ELSE coalesce(text, '') END, ' from ', source, ' ') AS prompt,
  concat('***', source) AS tail, printf('C_doc=%.3f, A=%.2f, B=%.2f', (doc_id % 100)::DOUBLE / 100, 0.85, 0.45) AS reason FROM documents""")
def template_render(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scoring import route_reason

    docs = b.table(spark, sf, "documents")
    prompt = tx.render("[{lang}] {text} from {source} {missing}", {"lang": F.col("lang"), "text": F.col("text"), "source": F.col("source")})
    score = (F.col("doc_id") % 100).cast("double") / 100
    return docs.select("doc_id", prompt.alias("prompt"), F.concat(hashing.masked(F.col("source")), F.col("source")).alias("tail"), route_reason(score).alias("reason"))


@query("""SELECT doc_id, substr(md5(encode(coalesce(text, ''))[1:2048]), 1, 12) AS image_hash, sha256(coalesce(text, '')) AS file_hash, concat('v', doc_id % 7 + 1, '.0') AS next_version,
  concat_ws(':', source, doc_id, lang) AS dedup_key FROM documents""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    version = F.concat(F.lit("v"), (F.col("doc_id") % 7).cast("string"), F.lit(".0"))
    return b.table(spark, sf, "documents").select(
        "doc_id", hashing.image_hash(body).alias("image_hash"), hashing.file_hash(body).alias("file_hash"), hashing.version_after(version).alias("next_version"),
        hashing.dedup_key(F.col("source"), F.col("doc_id"), F.col("lang")).alias("dedup_key"),
    )


@query(f"""WITH {b.PAGES}, n AS (SELECT job, page_no, row_number() OVER (PARTITION BY job ORDER BY page_no) AS rn, count(*) OVER (PARTITION BY job) AS c FROM pages)
SELECT job, page_no, CAST(CASE WHEN c > 40 THEN (rn - 1) // 20 ELSE 0 END AS INTEGER) AS chunk FROM n""")
def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.chunks(b.pages(spark, sf), size=20, gate=40).select("job", "page_no", "chunk")


@query()
def table_aware_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential cuts: tested against a plain simulation."""
    return pages.table_aware_chunks(b.pages(spark, sf), size=8, most=3)


@query(f"""WITH {b.PAGES}, n AS (SELECT job, page_no, row_number() OVER (PARTITION BY job ORDER BY page_no) AS rn, count(*) OVER (PARTITION BY job) AS c FROM pages),
s AS (SELECT *, greatest(1, (c - 4) // 16) AS step FROM n)
SELECT job, page_no FROM s WHERE c <= 20 OR rn <= 2 OR rn > c - 2 OR (rn > 2 AND rn <= c - 2 AND (rn - 3) % step = 0 AND (rn - 3) // step < 16)""")
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return pages.systematic_sample(b.pages(spark, sf), size=20).select("job", "page_no")


@query(f"""WITH {b.PAGES}, e AS (SELECT * FROM pages WHERE NOT (len(trim(raw_text)) < 10 AND n_images = 0) AND NOT (n_images = 0 AND {_any(tx.SAMPLER_TOC_WORDS)})), n AS (
  SELECT *, row_number() OVER (PARTITION BY job ORDER BY page_no) AS rn, count(*) OVER (PARTITION BY job) AS c, (doc_id % 10)::DOUBLE / 10 AS ocr_rate FROM e),
m AS (SELECT *, CASE WHEN rn <= 2 OR rn > c - 2 THEN NULL WHEN n_images > 5 OR ocr_rate < 0.5 THEN 3 WHEN n_images > 2 OR ocr_rate < 0.8 THEN 2 ELSE 1 END AS band FROM n),
t AS (SELECT *, sum(coalesce(band, 0)) OVER (PARTITION BY job) AS total FROM m),
q AS (SELECT *, greatest(1, round(16 * count(*) OVER (PARTITION BY job, band) * band / total)) AS quota,
  row_number() OVER (PARTITION BY job, band ORDER BY md5(CAST(doc_id AS VARCHAR)), page_no) AS place FROM t),
p AS (SELECT job, page_no, band, row_number() OVER (PARTITION BY job ORDER BY page_no) AS f FROM q WHERE c <= 20 OR band IS NULL OR place <= quota)
SELECT job, page_no, CAST(band AS INTEGER) AS band FROM p WHERE f <= 20""")
def weighted_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Blank pages and tables of contents are no candidates."""
    p = pages.effective(b.pages(spark, sf)).withColumn("ocr_rate", (F.col("doc_id") % 10).cast("double") / 10)
    return pages.weighted_sample(p.drop("raw_text"), size=20)


@query("""WITH t AS (SELECT conv_id AS job, turn AS page_no, text, len(string_split(text, ' ')) % 3 + 1 AS width FROM conversations),
r AS (SELECT *, lag(width) OVER w AS before, lag(page_no) OVER w AS last FROM t WINDOW w AS (PARTITION BY job ORDER BY page_no)),
o AS (SELECT *, coalesce(last = page_no - 1 AND (before = width OR {_said}), false) AS goes FROM r),
g AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY page_no) AS g FROM o)
SELECT job, page_no, CASE WHEN goes THEN page_no - 1 END AS source_page, CAST(row_number() OVER (PARTITION BY job, g ORDER BY page_no) AS INTEGER) AS n_rows FROM g""".replace("{_said}", _any(tx.CONTINUATION_WORDS).replace("lower(raw_text)", "lower(text[1:100])")))
def continuation_merge(spark: SparkSession, sf: str) -> DataFrame:
    words = F.size(F.split("text", " "))
    row = F.transform(F.sequence(F.lit(0), words % 3), lambda i: F.concat(F.lit("cell"), i.cast("string")))
    turns = b.table(spark, sf, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("page_no"), F.col("text").alias("raw_text"), F.array(row).alias("rows"))
    return pages.continuation(turns).select("job", "page_no", "source_page", F.size("merged_rows").alias("n_rows"))


_VALID = "(CASE WHEN coalesce(product_name, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(model_number, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(size, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(price, '') <> '' THEN 1 ELSE 0 END)"


@query(f"WITH {b.SKUS} SELECT sku, CASE WHEN {_VALID} >= 2 THEN 'valid' ELSE 'invalid' END AS strict, CASE WHEN {_VALID} >= 1 OR coalesce(color, '') <> '' THEN 'valid' ELSE 'invalid' END AS relaxed FROM skus")
def sku_validity(spark: SparkSession, sf: str) -> DataFrame:
    return b.skus(spark, sf).select("sku", records.validity().alias("strict"), records.validity("relaxed", ("color",)).alias("relaxed"))


_KEY = "coalesce(product, ''), coalesce(product_name, ''), coalesce(model_number, ''), coalesce(size, ''), coalesce(color, ''), coalesce(material, '')"


@query(f"""WITH {b.SKUS}, k AS (SELECT *, row_number() OVER (PARTITION BY page, {_KEY} ORDER BY confidence DESC, pos) AS rn, min(pos) OVER (PARTITION BY page, {_KEY}) AS slot FROM skus)
SELECT page, sku, slot FROM k WHERE rn = 1""")
def dedup_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    return records.dedup_keep_best(b.skus(spark, sf)).select("page", "sku", "slot")


_NUMBERED = f"""{b.SKUS}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {b.rounded('y0 / 1600.0::DOUBLE', 2)}, {b.rounded('x0 / 1600.0::DOUBLE', 2)}, pos) AS number FROM skus),
f AS (SELECT *, CASE WHEN product IS NOT NULL THEN min(number) OVER (PARTITION BY page, product) END AS first FROM n),
d AS (SELECT *, CASE WHEN product IS NOT NULL THEN printf('abc12345_%03d_P%d', page, dense_rank() OVER (PARTITION BY page ORDER BY first NULLS LAST)) END AS product_no FROM f)"""


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return records.assign_ids(b.skus(spark, sf), F.lit(1600.0), F.lit("abc12345"), F.col("page"))


@query(f"WITH {_NUMBERED} SELECT sku, printf('abc12345_%03d_%03d', page, number) AS sku_id, CAST(number AS INTEGER) AS number FROM d")
def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf).select("sku", "sku_id", "number")


@query(f"WITH {_NUMBERED} SELECT sku, product, product_no FROM d")
def product_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf).select("sku", "product", "product_no")


_TYPED = "typed AS (SELECT o_orderkey AS page, substr('ABCD', CAST(o_orderkey % 4 + 1 AS INT), 1) AS page_type FROM orders)"


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.substring(F.lit("ABCD"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1)).alias("page_type"))


@query(f"""WITH {b.SKUS}, {b.IMAGES}, {_TYPED}
SELECT page, 'sku_without_image' AS rule, sku, 'warning' AS severity FROM skus JOIN typed USING (page) WHERE page_type <> 'A' AND NOT EXISTS (SELECT 1 FROM images i WHERE i.page = skus.page AND i.pos = skus.pos)
UNION ALL SELECT page, 'duplicate_model', sku, 'warning' FROM (SELECT *, row_number() OVER (PARTITION BY page, model_number ORDER BY pos) AS n FROM skus WHERE coalesce(model_number, '') <> '') WHERE n > 1
UNION ALL SELECT page, 'low_confidence', sku, 'warning' FROM skus WHERE confidence < 0.5
UNION ALL SELECT page, 'no_skus_found', NULL, 'error' FROM typed WHERE page_type <> 'D' AND page NOT IN (SELECT page FROM skus)""")
def validate_rules(spark: SparkSession, sf: str) -> DataFrame:
    s = b.skus(spark, sf)
    bound = s.join(b.images(spark, sf).select("page", "pos"), ["page", "pos"], "left_semi")
    return records.validate(s, bound, _typed(spark, sf))


@query(f"""WITH {b.SKUS}, {_TYPED}, b AS (SELECT page, sku, round(confidence * 0.9, 3) AS confidence, pos % 4 = 0 AS ambiguous FROM skus WHERE pos <= 5),
s AS (SELECT page, 0.3::DOUBLE * min(confidence) + 0.7::DOUBLE * avg(confidence) AS raw, count(*) AS n FROM skus GROUP BY page),
g AS (SELECT page, 0.3::DOUBLE * min(confidence) + 0.7::DOUBLE * avg(confidence) AS raw, avg(CAST(ambiguous AS INTEGER)) AS share, count(DISTINCT sku) AS n FROM b GROUP BY page),
c AS (SELECT t.page, coalesce(s.n, 0) AS n_skus, CASE WHEN s.n > 0 THEN s.raw WHEN page_type = 'D' THEN 1.0 ELSE 0.0 END AS e,
  CASE WHEN s.n > 0 THEN coalesce(g.raw * (1 - 0.3::DOUBLE * share) * least(1.0::DOUBLE, g.n / s.n), 0) ELSE 1.0 END AS d FROM typed t LEFT JOIN s USING (page) LEFT JOIN g USING (page)),
f AS (SELECT *, {b.rounded("least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(0.88::DOUBLE * e * d, 0.3333333333333333::DOUBLE) * CASE WHEN page % 5 = 0 THEN 0.9::DOUBLE ELSE 1.0 END * CASE WHEN page % 3 = 0 THEN 0.95::DOUBLE ELSE 1.0 END * CASE WHEN page % 7 = 0 THEN 0.8::DOUBLE ELSE 1.0 END))", 3)} AS confidence FROM c)
SELECT page, n_skus, floor(e * 1000000.0::DOUBLE + 0.500001::DOUBLE) / 1000000.0::DOUBLE AS c_extract, floor(d * 1000000.0::DOUBLE + 0.500001::DOUBLE) / 1000000.0::DOUBLE AS c_bind, confidence, confidence < 0.6::DOUBLE AS needs_review FROM f""")
def page_confidence(spark: SparkSession, sf: str) -> DataFrame:
    s = b.skus(spark, sf)
    bound = s.where("pos <= 5").select("page", "sku", F.round(F.col("confidence") * 0.9, 3).alias("confidence"), (F.col("pos") % 4 == 0).alias("ambiguous"))
    flags = {"retried": 5, "single_stage": 3, "has_errors": 7}
    state = _typed(spark, sf).withColumn("classify_confidence", F.lit(0.88)).withColumns({n: F.col("page") % m == 0 for n, m in flags.items()})
    return records.page_confidence(s, bound, state)


@query(f"""WITH {b.SKUS} SELECT page, count(*) AS n, count(*) FILTER ({_VALID} >= 2) AS n_valid, count(*) FILTER ({_VALID} >= 2) = 0 OR count(*) FILTER ({_VALID} >= 2) < 0.7 * 4 AS retry FROM skus GROUP BY page""")
def retry_gate(spark: SparkSession, sf: str) -> DataFrame:
    n = b.skus(spark, sf).withColumn("v", records.validity()).groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("v") == "valid").alias("n_valid"))
    return n.withColumn("retry", records.retry_wanted(F.col("n_valid"), F.lit(4)))


@query()
def nms_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Order-dependent: tested against a plain simulation."""
    wide = b.skus(spark, sf).where("x1 > 0").selectExpr("page", "pos", "x0 DIV 4 AS x0", "y0 DIV 4 AS y0", "x1 DIV 4 + 200 AS x1", "y1 DIV 4 + 200 AS y1", "confidence")
    return records.nms(wide, 0.3)


@query(f"WITH {b.SKUS} SELECT page, sku, CASE WHEN (x1 - x0) * (y1 - y0) > 0.8 * 100 * 60 THEN least(confidence, 0.3) ELSE confidence END AS confidence FROM skus WHERE x1 > 0")
def full_page_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return b.skus(spark, sf).where("x1 > 0").select("page", "sku", records.full_page_penalty(F.col("confidence"), geo.box(), 100, 60).alias("confidence"))


@query(f"WITH {b.SKUS} SELECT page, count(*) AS n FROM skus WHERE {_VALID} >= 2 GROUP BY page")
def export_valid(spark: SparkSession, sf: str) -> DataFrame:
    out = records.exported(b.skus(spark, sf).withColumn("validity", records.validity()))
    return out.groupBy("page").agg(F.count("record").alias("n"))


_DIMS = {"text_clarity": 10, "image_quality": 7, "layout_structure": 9, "table_regularity": 4, "sku_density": 6}
_DIM_SQL = ", ".join(f"(doc_id % {m})::DOUBLE / {m} AS {d}" for d, m in _DIMS.items())


@query(f"""WITH {b.PAGES}, p AS (SELECT job, CASE WHEN page_no % 9 = 0 THEN 0.1::DOUBLE ELSE (doc_id % 3)::DOUBLE / 4 END AS overall, {_DIM_SQL} FROM pages),
e AS (SELECT job, sum(c) AS n, -sum(c / t * log2(c / t)) / log2(10) AS h FROM (
  SELECT job, least(9, floor(overall * 10)) AS bin, count(*) AS c, sum(count(*)) OVER (PARTITION BY job) AS t FROM p GROUP BY 1, 2) GROUP BY job),
g AS (SELECT job, count(*) AS n, {", ".join(f"round(avg({d}), 4) AS {d}" for d in _DIMS)}, round(var_pop(overall), 6) AS v FROM p GROUP BY job),
f AS (SELECT g.*, CASE WHEN g.n < 3 THEN 0 ELSE v END AS variance, CASE WHEN g.n < 3 THEN 0 ELSE round(h, 6) END AS entropy,
  round(least(1.0, greatest(0.0, 0.25::DOUBLE * text_clarity + 0.2::DOUBLE * image_quality + 0.25::DOUBLE * layout_structure + 0.15::DOUBLE * table_regularity + 0.15::DOUBLE * sku_density - 0.05::DOUBLE)), 4) AS score FROM g JOIN e USING (job)),
r AS (SELECT *, n >= 3 AND (variance > 0.08 OR entropy > 0.7) AS forced FROM f)
SELECT job, n, {", ".join(_DIMS)}, variance, entropy, forced, score,
  CASE WHEN forced AND score >= 0.45 THEN 'HYBRID' WHEN score >= 0.85 THEN 'AUTO' WHEN score >= 0.45 THEN 'HYBRID' ELSE 'HUMAN_ALL' END AS route FROM r""")
def doc_score_route(spark: SparkSession, sf: str) -> DataFrame:
    overall = F.when(F.col("page_no") % 9 == 0, 0.1).otherwise((F.col("doc_id") % 3).cast("double") / 4)
    scored = b.pages(spark, sf).select("job", overall.alias("overall"), F.lit(0.05).alias("penalty"), *[((F.col("doc_id") % m).cast("double") / m).alias(d) for d, m in _DIMS.items()])
    return evaluation.document_scores(scored, list(_DIMS))


@query(f"WITH {b.PAGES} SELECT job, page_no FROM pages WHERE NOT (len(trim(raw_text)) < 10 AND n_images = 0)")
def human_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """A task for every page that is not blank."""
    return b.pages(spark, sf).where(~pages.is_blank(F.col("raw_text"), F.col("n_images"))).select("job", "page_no")


@query(f"""WITH {b.SKUS} SELECT page, coalesce(product, 'none') AS product, count(*) AS n, first(coalesce(product_name, '') ORDER BY pos) AS first_name
FROM skus GROUP BY page, coalesce(product, 'none')""")
def group_by_product(spark: SparkSession, sf: str) -> DataFrame:
    s = b.skus(spark, sf)
    first = F.min_by(F.coalesce("product_name", F.lit("")), "pos")
    return s.groupBy("page", F.coalesce("product", F.lit("none")).alias("product")).agg(F.count("*").alias("n"), first.alias("first_name"))
