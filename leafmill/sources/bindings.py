"""Catalogue entities derived from the star-schema tables, and the same views as SQL.

Boxes and scores come from integer arithmetic on keys, so that results are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: "Now" of age-based queries on events and on orders.
AS_OF_EVENTS = "2024-01-31 00:00:00"
AS_OF_ORDERS = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: str, digits: int) -> str:
    """SQL of :func:`functions.scoring.exact_round`."""
    scale = f"{10**digits}.0::DOUBLE"
    over = f"(s.p - floor(s.p) - 0.5::DOUBLE) + ((s.h * {scale} - s.p) + (v - s.h) * {scale})"
    up = f"CASE WHEN {over} > 0 OR ({over} = 0 AND CAST(floor(s.p) AS BIGINT) % 2 <> 0) THEN 1 ELSE 0 END"
    parts = f"{{'p': v * {scale}, 'h': 134217729.0::DOUBLE * v - (134217729.0::DOUBLE * v - v)}}"
    return f"list_transform([CAST({x} AS DOUBLE)], lambda v: list_transform([{parts}], lambda s: (floor(s.p) + {up}) / {scale})[1])[1]"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pages: a document is a page of a job, named by its source and its thousand of ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("raw_text"))
    return docs.select(
        F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("job"),
        (F.col("doc_id") % 1000 + 1).cast("int").alias("page_no"),
        "doc_id",
        "raw_text",
        F.size(F.split("raw_text", "\n")).alias("n_blocks"),
        (F.col("doc_id") % 7).cast("int").alias("n_images"),
        F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0).alias("n_tables"),
        ((F.col("doc_id") % 5).cast("double") / 10).alias("table_area_ratio"),
    )


PAGES = r"""pages AS (
  SELECT concat(coalesce(source, 'none'), '-', doc_id // 1000) AS job, CAST(doc_id % 1000 + 1 AS INTEGER) AS page_no, doc_id, coalesce(text, '') AS raw_text,
    CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS n_blocks, CAST(doc_id % 7 AS INTEGER) AS n_images,
    CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS n_tables, CAST(doc_id % 5 AS DOUBLE) / 10 AS table_area_ratio
  FROM documents)"""


def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with markers of several kinds, model codes and prices; some has words before its first marker."""
    part = table(spark, sf_dir, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    price = F.concat((F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    key = F.col("p_partkey")
    number = F.lpad(key.cast("string"), 3, "0")
    return part.select(
        "p_partkey",
        F.concat(
            F.when(key % 4 == 1, "Intro words ").when(key % 4 == 2, "see Nr# \n").otherwise(""), number, F.when(key % 5 == 0, "B# ").otherwise("# "),
            F.col("p_name"), F.lit(" Model "), F.left("p_brand", F.lit(2)), F.lit("X-"), number, F.lit(" $"), price,
            F.when(key % 3 == 0, F.concat(F.lit(" "), (key % 90).cast("string"), F.when(key % 2 == 0, "＃ ").otherwise("# "), F.col("p_type"), F.lit(" \n"))).otherwise(F.lit("")),
        ).alias("text"),
    )


_NUMBER = "lpad(CAST(p_partkey AS VARCHAR), greatest(3, len(CAST(p_partkey AS VARCHAR)))::INTEGER, '0')[1:3]"
CATALOG = rf"""catalog AS (
  SELECT p_partkey,
    concat(CASE p_partkey % 4 WHEN 1 THEN 'Intro words ' WHEN 2 THEN 'see Nr# ' || chr(10) ELSE '' END, {_NUMBER}, CASE WHEN p_partkey % 5 = 0 THEN 'B# ' ELSE '# ' END,
      p_name, ' Model ', p_brand[1:2], 'X-', {_NUMBER}, ' $',
      CAST(CAST(round(p_retailprice * 100) AS BIGINT) // 100 AS VARCHAR), '.', lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'),
      CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_partkey % 90, CASE WHEN p_partkey % 2 = 0 THEN '＃ ' ELSE '# ' END, p_type, ' ' || chr(10)) ELSE '' END) AS text
  FROM part)"""
#: SQL of a text ``t`` cut at its markers, as a list.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
MARKER = r"[A-Za-z0-9]*\d[A-Za-z0-9]*[#＃]"


def marker_pieces(t: str, limit: int = 2000) -> str:
    cut = rf"string_split(regexp_replace({t}, '(^|\s)({MARKER})', '\1' || chr(1) || '\2', 'g'), chr(1))"
    begun = f"list_filter({cut}, lambda p: regexp_matches(p, '^{MARKER}'))"
    tidy = f"list_filter(list_transform({begun}, lambda p: trim(p, {SPACES})[1:{limit}]), lambda p: len(p) > 0)"
    return f"CASE WHEN len({begun}) >= 2 THEN {tidy} ELSE [] END"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order and number: of several, the first by all other columns."""
    # Dealt by the order at once: what follows works within orders and needs no other exchange.
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rn = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order))
    return li.withColumn("rn", rn).where("rn = 1").drop("rn")


LINES = """lines AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1)"""

_SKUS_SPARK = """
  l_orderkey AS page, l_linenumber AS pos, concat('s', l_orderkey, '-', l_linenumber) AS sku,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('P', l_partkey % 3) END AS product,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE p_name END AS product_name,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat('MD-', l_partkey % 40) END AS model_number,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS size,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS STRING) END AS price,
  p_type AS color, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('mat', l_linenumber % 2) END AS material, round(l_quantity / 50, 2) AS confidence,
  CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE CAST((l_partkey * 37) % 1200 AS INT) END AS x0,
  CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE CAST((l_suppkey * 53) % 1600 AS INT) END AS y0,
  CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE CAST((l_partkey * 37) % 1200 + 40 + l_quantity AS INT) END AS x1,
  CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE CAST((l_suppkey * 53) % 1600 + 30 + l_linenumber * 5 AS INT) END AS y1
"""


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records; a page is an order.  Some boxes are zero, some attributes missing."""
    joined = lines(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr(*[c.strip() for c in _split_columns(_SKUS_SPARK)])


def _split_columns(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


SKUS = LINES + ",\nskus AS (\n  SELECT" + _SKUS_SPARK.replace("AS STRING", "AS VARCHAR") + "  FROM lines JOIN part ON l_partkey = p_partkey)"

_IMAGES_SPARK = """
  l_orderkey AS page, l_linenumber AS pos, concat('i', l_orderkey, '-', l_linenumber) AS image,
  CAST((l_suppkey * 37) % 1200 AS INT) AS x0, CAST((l_partkey * 53) % 1600 AS INT) AS y0,
  CAST((l_suppkey * 37) % 1200 + 20 + l_partkey % 300 AS INT) AS x1, CAST((l_partkey * 53) % 1600 + 20 + l_suppkey % 200 AS INT) AS y1,
  CAST(20 + l_partkey % 300 AS INT) AS width, CAST(20 + l_suppkey % 200 AS INT) AS height,
  CASE l_partkey % 6 WHEN 0 THEN 'product_main' WHEN 1 THEN 'product_detail' WHEN 2 THEN 'unknown' WHEN 3 THEN '' WHEN 4 THEN 'logo' ELSE 'decoration' END AS role,
  concat('h', l_partkey % 12) AS hash
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the same pages; pages of five lines or more have fewer images than records."""
    return lines(spark, sf_dir).where("l_linenumber <= 5").selectExpr(*[c.strip() for c in _split_columns(_IMAGES_SPARK)])


IMAGES = "images AS (\n  SELECT" + _IMAGES_SPARK + "  FROM lines WHERE l_linenumber <= 5)"

_TASKS = """
  o_orderkey AS task, o_custkey AS job, concat('u', o_custkey) AS assigned_to,
  CASE o_orderstatus WHEN 'O' THEN 'CREATED' WHEN 'P' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'URGENT' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'NORMAL' WHEN '4' THEN 'CRITICAL' ELSE 'AUTO_RESOLVE' END AS priority,
  CAST(o_orderkey % 7 AS INT) AS rework, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS ai_confidence, CAST(1 + o_orderkey % 240 AS INT) AS age_minutes,
  o_orderdate AS created_at
"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human tasks; ``age_minutes`` stands for the time since creation or locking."""
    return table(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _split_columns(_TASKS)])


TASKS = "tasks AS (\n  SELECT" + _TASKS + "  FROM orders)"

_OUTCOMES = """
  event_id, user_id AS k, ts, event_type <> 'error' AS ok, event_type AS kind, value, props
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of calls in order of time; time as TIMESTAMP_NTZ, as stored."""
    return table(spark, sf_dir, "events").selectExpr(*[c.strip() for c in _split_columns(_OUTCOMES)])


OUTCOMES = "outcomes AS (SELECT" + _OUTCOMES + "FROM events)"

_ANNOTATIONS = """
  event_id AS annotation, user_id AS annotator, ts AS annotated_at,
  CASE event_type WHEN 'signup' THEN 'PAGE_TYPE_CORRECTION' WHEN 'purchase' THEN 'SKU_ATTRIBUTE_CORRECTION' WHEN 'error' THEN 'IMAGE_BINDING_CORRECTION'
    WHEN 'view' THEN 'BINDING_CORRECTION' ELSE 'NEW_TYPE_REPORT' END AS type,
  substr('ABCD', CAST(event_id % 4 + 1 AS INT), 1) AS ai_type, substr('ABCD', CAST((event_id + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INT), 1) AS human_type,
  CAST(floor(value) AS INT) % 101 / 100.0D AS ai_confidence, event_id % 3 <> 0 AS was_correct, event_id % 11 = 0 AS reworked,
  CASE user_id % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'table' WHEN 2 THEN 'lamp' END AS category
"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review annotations with what the model said and what the reviewer corrected."""
    return table(spark, sf_dir, "events").selectExpr(*[c.strip() for c in _split_columns(_ANNOTATIONS)])


ANNOTATIONS = "annotations AS (SELECT" + _ANNOTATIONS.replace("100.0D", "100.0::DOUBLE") + "FROM events)"


def annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('u', s_suppkey) AS annotator", "round(CAST(s_suppkey % 50 AS DOUBLE) / 50, 2) AS accuracy", "CAST(s_suppkey * 3 % 100 AS INT) AS total_tasks"
    )


ANNOTATORS = """annotators AS (
  SELECT concat('u', s_suppkey) AS annotator, round(CAST(s_suppkey % 50 AS DOUBLE) / 50, 2) AS accuracy, CAST(s_suppkey * 3 % 100 AS INT) AS total_tasks FROM supplier)"""

_JOBS = """
  c_custkey AS job, concat('m', c_nationkey) AS merchant, concat('f', c_custkey % 400) AS file_hash, CASE WHEN c_custkey % 7 = 5 THEN NULL ELSE concat('w', c_custkey % 12) END AS worker,
  CASE c_custkey % 3 WHEN 0 THEN NULL ELSE concat('v', c_custkey % 2) END AS config_version,
  CASE c_custkey % 12 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'EVALUATING' WHEN 2 THEN 'EVAL_FAILED' WHEN 3 THEN 'EVALUATED' WHEN 4 THEN 'PROCESSING'
    WHEN 5 THEN 'PARTIAL_FAILED' WHEN 6 THEN 'PARTIAL_IMPORTED' WHEN 7 THEN 'DEGRADED_HUMAN' WHEN 8 THEN 'FULL_IMPORTED' WHEN 9 THEN 'REJECTED'
    WHEN 10 THEN 'ORPHANED' ELSE 'CANCELLED' END AS status,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE) / 100 END AS score, CAST(1 + c_custkey % 180 AS INT) AS total_pages
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[c.strip() for c in _split_columns(_JOBS)])


JOBS = "jobs AS (SELECT" + _JOBS + "FROM customer)"

_JOB_PAGES = """
  l_orderkey AS job, l_linenumber AS page_no,
  CASE (l_orderkey % 4) * 10 + l_partkey % 8 WHEN 0 THEN 'BLANK' WHEN 1 THEN 'IMPORTED_ASSUMED' WHEN 2 THEN 'AI_FAILED' WHEN 3 THEN 'HUMAN_QUEUED' WHEN 4 THEN 'AI_QUEUED'
    WHEN 10 THEN 'BLANK' WHEN 12 THEN 'IMPORTED_ASSUMED' WHEN 14 THEN 'SKIPPED' WHEN 22 THEN 'HUMAN_QUEUED' WHEN 24 THEN 'HUMAN_PROCESSING'
    WHEN 30 THEN 'AI_FAILED' WHEN 31 THEN 'AI_FAILED' WHEN 32 THEN 'AI_FAILED' WHEN 33 THEN 'AI_FAILED' WHEN 34 THEN 'AI_FAILED'
    ELSE 'IMPORTED_CONFIRMED' END AS status,
  CAST(l_suppkey % 6 AS INT) AS n_skus, CAST(l_suppkey % 40 AS INT) AS age_hours, l_partkey % 2 = 0 AS downstream, l_suppkey % 3 = 0 AS needs_review
"""


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(*[c.strip() for c in _split_columns(_JOB_PAGES)])


JOB_PAGES = LINES + ",\njob_pages AS (SELECT" + _JOB_PAGES + "FROM lines)"
