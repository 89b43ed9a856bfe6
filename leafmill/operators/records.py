"""Record extraction, validity, deduplication, numbering, validation and page confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..functions import hashing
from ..functions import text as tx
from ..functions.scoring import exact_round, stable_round

KEY = ("product", "product_name", "model_number", "size", "color", "material")


def truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def rule_attributes(text: Column) -> dict[str, Column]:
    """Name, price and model of a text block, by patterns."""
    return {
        "product_name": F.nullif(F.substring(text, 1, 100), F.lit("")),
        "price": tx.first_match(text, tx.PRICE_VALUE),
        "model_number": tx.first_match(text, tx.MODEL_VALUE),
    }


def stripped_cells(rows: Column) -> Column:
    """Table rows without white space around their cells; null cells are empty."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(tx.stripped(c), F.lit(""))))


def table_records(tables: DataFrame, *keep: str, confidence: float = 0.85, strip: bool = True) -> DataFrame:
    """(page, row, attributes, confidence) of tables with ``rows``, and the tables' columns ``keep``:
    the first row is the header."""
    rows = tables.where(F.size("rows") >= 2).select("page", *keep, F.get("rows", F.lit(0)).alias("__h"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row", "__c"))
    found = rows.select("page", *keep, (F.col("row") + 1).alias("row"), tx.header_records(F.col("__h"), F.col("__c"), strip).alias("attributes"))
    return found.where(F.size("attributes") > 0).withColumn("confidence", F.lit(confidence))


def validity(mode: str = "strict", others: tuple[str, ...] = ()) -> Column:
    """valid / invalid: two of name, model, size and price must be there; otherwise than ``strict``, one
    attribute of any kind, the columns ``others`` among them."""
    core = [truthy(F.col(c)) for c in ("product_name", "model_number", "size", "price")]
    if mode != "strict":
        some = F.lit(False)
        for c in [*core, *(truthy(F.col(o)) for o in others)]:
            some = some | c
        return F.when(some, "valid").otherwise("invalid")
    return F.when(sum((c.cast("int") for c in core), F.lit(0)) >= 2, "valid").otherwise("invalid")


def dedup_keep_best(skus: DataFrame) -> DataFrame:
    """Of records with equal keys on a page the most confident stays, the earliest of equals; it takes
    the place (``slot``) of the first.  Records with an all-empty key all stay."""
    empty = F.lit(True)
    for c in KEY:
        empty = empty & ~truthy(F.col(c))
    own = F.when(empty, F.col("pos")).otherwise(F.lit(-1))
    w = Window.partitionBy("page", *[F.coalesce(F.col(c), F.lit("")) for c in KEY], own)
    best = F.row_number().over(w.orderBy(F.desc("confidence"), "pos"))
    return skus.withColumn("slot", F.min("pos").over(w)).withColumn("__rn", best).where("__rn = 1").drop("__rn")


def assign_ids(skus: DataFrame, height: Column, prefix: Column, page_no: Column) -> DataFrame:
    """Numbers the records of a page from top left (coordinates rounded to hundredths of the page's
    height) and renumbers products by first appearance: ``number``, ``sku_id`` and ``product_no``."""
    tall = F.greatest(F.lit(1.0), height)
    y, x = exact_round(F.col("y0") / tall, 2), exact_round(F.col("x0") / tall, 2)
    w = Window.partitionBy("page")
    grouped = truthy(F.col("product"))
    n = skus.withColumns({"__y": y, "__x": x}).withColumn("number", F.row_number().over(w.orderBy("__y", "__x", "pos")))
    n = n.withColumn("__first", F.when(grouped, F.min("number").over(Window.partitionBy("page", "product"))))
    rank = F.dense_rank().over(w.orderBy(F.col("__first").asc_nulls_last()))
    product = F.when(grouped, hashing.product_id(prefix, page_no, rank))
    return n.withColumn("product_no", product).withColumn("sku_id", hashing.sku_id(prefix, page_no, F.col("number"))).drop("__first", "__y", "__x")


def validate(skus: DataFrame, bound: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues (page, rule, severity, sku) of the four rules: pages of other types than D without a record
    (an error); records without an image, but for pages of type A; models that an earlier record of the
    page has; low confidence.  ``bound`` holds (page, sku) with an image, ``pages`` (page, page_type)."""
    has = bound.select("page", "sku").distinct().withColumn("__bound", F.lit(True))
    typed = skus.join(has, ["page", "sku"], "left").join(pages.select("page", "page_type"), "page", "left")
    seen = F.row_number().over(Window.partitionBy("page", "model_number").orderBy("pos"))
    rules = F.array(
        F.when(F.col("__bound").isNull() & ~F.col("page_type").eqNullSafe("A"), "sku_without_image"),
        F.when(truthy(F.col("model_number")) & (F.col("__n") > 1), "duplicate_model"),
        F.when(F.col("confidence") < 0.5, "low_confidence"),
    )
    issues = typed.withColumn("__n", seen).select("page", F.explode(F.array_compact(rules)).alias("rule"), "sku")
    return issues.withColumn("severity", F.lit("warning")).unionByName(empty_pages(pages, skus).withColumn("sku", F.lit(None).cast("string")))


def empty_pages(pages: DataFrame, skus: DataFrame) -> DataFrame:
    """Rule 1: pages of other types than D without a record."""
    return pages.where("upper(page_type) <> 'D'").join(skus.select("page").distinct(), "page", "left_anti").select(
        "page", F.lit("no_skus_found").alias("rule"), F.lit("error").alias("severity")
    )


def page_confidence(skus: DataFrame, bindings: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page of ``pages`` (page, page_type, classify_confidence): the geometric mean of class,
    extraction and binding confidence, less what a retry (``retried``), extraction in one step
    (``single_stage``) and errors (``has_errors``) cost, boolean columns it may have.  Pages without
    records are sure of that if they are of type D; a binding is never in doubt there."""
    spread = lambda c: 0.3 * F.min(c) + 0.7 * F.avg(c)
    s = skus.groupBy("page").agg(spread("confidence").alias("s_raw"), F.count("*").alias("n_skus"))
    b = bindings.groupBy("page").agg(spread("confidence").alias("b_raw"), F.avg(F.col("ambiguous").cast("int")).alias("share"), F.count_distinct("sku").alias("n_bound"))
    joined = pages.join(s, "page", "left").join(b, "page", "left").withColumn("n_skus", F.coalesce("n_skus", F.lit(0)))
    some = F.col("n_skus") > 0
    bind = F.col("b_raw") * (1 - 0.3 * F.col("share")) * F.least(F.lit(1.0), F.col("n_bound") / F.col("n_skus"))
    joined = joined.withColumns({
        "c_extract": F.when(some, F.col("s_raw")).otherwise(F.when(F.col("page_type") == "D", 1.0).otherwise(0.0)),
        "c_bind": F.when(some, F.coalesce(bind, F.lit(0.0))).otherwise(1.0),
    })
    score = F.pow(F.col("classify_confidence") * F.col("c_extract") * F.col("c_bind"), F.lit(1.0 / 3.0))
    for name, cost in (("retried", 0.9), ("single_stage", 0.95), ("has_errors", 0.8)):
        if name in pages.columns:
            score = F.when(F.col(name), score * cost).otherwise(score)
    joined = joined.withColumn("confidence", exact_round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3))
    return joined.select(
        "page", "n_skus", stable_round(F.col("c_extract"), 6).alias("c_extract"), stable_round(F.col("c_bind"), 6).alias("c_bind"), "confidence", (F.col("confidence") < 0.6).alias("needs_review")
    )


def retry_wanted(n_valid: Column, n_images: Column) -> Column:
    return (n_valid == 0) | ((n_valid > 0) & (n_valid < 0.7 * n_images))


def full_page_penalty(confidence: Column, b: geo.Box, width: float, height: float) -> Column:
    return F.when(geo.area(b) > 0.8 * width * height, F.least(confidence, F.lit(0.3))).otherwise(confidence)


def nms(boxes: DataFrame, limit: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression per page: by confidence, a box stays unless one that stayed
    before overlaps it by more than ``limit`` (IoU).  Sequential within a page, so a fold over the
    page's boxes, of which there are few; adds the new number."""
    cols = ("pos", "x0", "y0", "x1", "y1", "confidence")
    entry = F.struct((-F.col("confidence")).alias("k"), *[F.col(c) for c in cols])
    grouped = boxes.groupBy("page").agg(F.sort_array(F.collect_list(entry)).alias("b"))
    kind = grouped.schema["b"].dataType.simpleString()
    of = lambda s: geo.Box(s["x0"], s["y0"], s["x1"], s["y1"])
    kept = F.aggregate("b", F.array().cast(kind), lambda keep, x: F.when(F.exists(keep, lambda y: geo.iou(of(x), of(y)) > limit), keep).otherwise(F.concat(keep, F.array(x))))
    return grouped.select("page", F.posexplode(kept).alias("i", "e")).select("page", (F.col("i") + 1).alias("number"), *[F.col(f"e.{c}").alias(c) for c in cols])


def variants(products: DataFrame) -> DataFrame:
    """Products with ``attrs`` (map) and ``variants`` (array of maps): a row per variant, its own
    attributes over the product's; a product without variants is one row."""
    from ..functions.jsonx import merged

    rows = products.select("*", F.posexplode_outer("variants").alias("n", "own"))
    return rows.withColumn("attributes", F.when(F.col("own").isNull(), F.col("attrs")).otherwise(merged(F.col("attrs"), F.col("own")))).drop("own", "variants", "attrs")


def exported(skus: DataFrame) -> DataFrame:
    """Valid records as downstream JSON; absent keys are left out."""
    body = F.to_json(F.struct("sku", "product", "product_name", "model_number", "size", "price"), {"ignoreNullFields": "true"})
    return skus.where("validity = 'valid'").select("page", "sku", body.alias("record"))
