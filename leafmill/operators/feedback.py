"""Feedback analytics: confusion, drift, divergence, calibration, golden sets, previews, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring
from .relational import numbered


def confusion(notes: DataFrame) -> DataFrame:
    return notes.where("type = 'PAGE_TYPE_CORRECTION'").groupBy("ai_type", "human_type").agg(F.count("*").alias("n"))


def accuracy(matrix: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("ai_type") == F.col("human_type"), F.col("n")).otherwise(0))
    return matrix.agg(F.round(F.coalesce(hit / F.sum("n"), F.lit(1.0)), 4).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def drift(notes: DataFrame) -> DataFrame:
    gap = F.col("ai_confidence") - F.when(F.col("was_correct"), 1.0).otherwise(0.0)
    return notes.where("type = 'SKU_ATTRIBUTE_CORRECTION'").agg(F.round(F.coalesce(F.avg(gap), F.lit(0.0)), 4).alias("drift"), F.count("*").alias("n"))


def divergence(notes: DataFrame) -> DataFrame:
    """Smoothed Kullback-Leibler divergence of the model's confidence buckets from the reviewers'."""
    s = notes.where("type = 'SKU_ATTRIBUTE_CORRECTION'")
    ai = s.groupBy(F.round("ai_confidence", 1).alias("bucket")).agg(F.count("*").alias("a"))
    human = s.groupBy(F.when(F.col("was_correct"), 1.0).otherwise(0.0).alias("bucket")).agg(F.count("*").alias("h"))
    both = ai.join(human, "bucket", "full").fillna(0, ["a", "h"])
    w = Window.partitionBy()
    n, ta, th = F.count("*").over(w), F.sum("a").over(w), F.sum("h").over(w)
    p, q = (F.col("a") + 1) / (ta + n), (F.col("h") + 1) / (th + n)
    terms = both.select((p * F.ln(p / q)).alias("t"))
    return terms.agg(F.round(F.abs(F.coalesce(F.sum("t"), F.lit(0.0))), 6).alias("kl"))


def calibration(notes: DataFrame, since: str, min_samples: int = 50, min_annotators: int = 3, kl_limit: float = 0.5) -> DataFrame:
    """One run of the calibration rules over notes from ``since`` on: the suggestions, if the gates
    are passed and the divergence is in bounds.  Two one-row aggregates are joined."""
    recent = notes.where(F.col("annotated_at") >= F.lit(since).cast("timestamp_ntz"))
    page, record = F.col("type") == "PAGE_TYPE_CORRECTION", F.col("type") == "SKU_ATTRIBUTE_CORRECTION"
    gap = F.col("ai_confidence") - F.when(F.col("was_correct"), 1.0).otherwise(0.0)
    gate = recent.agg(
        F.count("*").alias("samples"), F.count_distinct("annotator").alias("people"),
        F.count_if(F.col("type").isin("IMAGE_BINDING_CORRECTION", "BINDING_CORRECTION")).alias("binding"),
        F.count_if(page).alias("pages"), F.round(F.avg(F.when(page, (F.col("ai_type") == F.col("human_type")).cast("int"))), 4).alias("accuracy"),
        F.count_if(record).alias("records"), F.round(F.avg(F.when(record, gap)), 4).alias("drift"),
    )
    one = gate.join(F.broadcast(divergence(recent)))
    one = one.where((F.col("samples") >= min_samples) & (F.col("people") >= min_annotators) & ((F.col("records") == 0) | (F.col("kl") <= kl_limit)))
    clamped = scoring.clamp(F.col("drift"), -0.10, 0.10)
    share = F.round(F.col("binding") / F.greatest(F.lit(1), F.col("samples")), 4)
    rules = F.array(
        F.when((F.col("pages") > 0) & (F.col("accuracy") < 0.85), F.struct(F.lit("review_classify_prompt").alias("action"), F.col("accuracy").alias("value"), F.col("pages").alias("n"))),
        F.when((F.col("records") > 0) & (F.abs(clamped) > 0.02), F.struct(F.lit("adjust_thresholds").alias("action"), F.round(clamped, 4).alias("value"), F.col("records").alias("n"))),
        F.when((F.col("binding") > 10) & (share > 0.15), F.struct(F.lit("review_binding_thresholds").alias("action"), share.alias("value"), F.col("binding").alias("n"))),
    )
    return one.select("samples", F.inline(F.array_compact(rules)))


def golden_set(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of (page, key) sets.  Pages without predictions count no misses;
    empty keys do not count."""
    p = predicted.where(F.coalesce("key", F.lit("")) != "").select("page", "key").distinct()
    t = truth.where(F.coalesce("key", F.lit("")) != "").select("page", "key").distinct()
    t = t.join(predicted.select("page").distinct(), "page", "left_semi")
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["page", "key"], "full").fillna(0, ["p", "t"])
    n = both.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(a) for a, c in (("tp", (F.col("p") == 1) & (F.col("t") == 1)), ("fp", F.col("t") == 0), ("fn", F.col("p") == 0))])
    precision, recall, f = scoring.f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select("tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f, 4).alias("f1"))


def binding_accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of true bindings (page, sku, image) that are predicted; no image on both sides agrees."""
    p = predicted.select("page", "sku", F.col("image").alias("__p"))
    hit = F.col("image").eqNullSafe(F.col("__p")).cast("int")
    return truth.join(p, ["page", "sku"], "left").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 4).alias("binding_accuracy"))


def impact(jobs: DataFrame, current: tuple[float, float], proposed: tuple[float, float]) -> DataFrame:
    """Shares of automatic, human and rejected jobs under two pairs of thresholds."""
    scored = jobs.where(F.col("score").isNotNull())
    shares = []
    for name, (a, b) in (("current", current), ("projected", proposed)):
        s = F.col("score")
        kinds = {"auto": s >= a, "human": (s >= b) & (s < a), "reject": s < b}
        shares += [F.avg(c.cast("int")).alias(f"{name}_{k}") for k, c in kinds.items()]
    got = scored.agg(F.count("*").alias("n"), *shares)
    ci = F.round(scoring.wald_margin(F.col("projected_auto"), F.col("n")), 6).alias("ci")
    return got.select("n", *[F.round(c, 6).alias(c) for c in got.columns[1:]], ci)


def promotions(added: DataFrame, existing: DataFrame, least: int = 20) -> DataFrame:
    """Attributes (category, attr) added often enough and not promoted yet."""
    n = added.groupBy("category", "attr").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(existing, ["category", "attr"], "left_anti")


def consensus(examples: DataFrame, least: float = 0.85, unknown: float = 0.6) -> DataFrame:
    """Examples good enough, numbered per type and category in order of time (then annotation): one
    waits until the next confirms both, and the count starts anew, so the last of an odd number waits
    on.  Annotators without an accuracy have ``unknown``; rework costs three tenths; no category is
    ``default``.  Numbered by hours, so no task holds a whole category."""
    quality = F.coalesce("accuracy", F.lit(unknown)) * F.when(F.col("reworked"), 0.7).otherwise(1.0)
    good = examples.withColumn("quality", quality).where(F.col("quality") >= least).withColumn("category", F.coalesce("category", F.lit("default")))
    placed = numbered(good, ["type", "category"], [F.col("annotated_at"), F.col("annotation")], F.date_trunc("hour", "annotated_at"), "place", "__of")
    waits = (F.col("place") == F.col("__of")) & (F.col("__of") % 2 == 1)
    return placed.withColumn("confirmed", ~waits).withColumn("quality", F.round("quality", 4)).drop("__of")


def shadow_comparison(current: DataFrame, shadow: DataFrame) -> DataFrame:
    """One row on two runs over the same pages (page, page_type, n_skus, confidence): the share of equal
    classes, the deviation of the number of records, the difference of mean confidence, and which of
    them raises an alert.  Pages that only one run has are left out."""
    other = shadow.select("page", *[F.col(c).alias(f"s_{c}") for c in ("page_type", "n_skus", "confidence")])
    g = current.join(other, "page").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("page_type").eqNullSafe(F.col("s_page_type"))).cast("int")), 4).alias("agreement"),
        F.round(F.abs(F.sum("s_n_skus") - F.sum("n_skus")) / F.greatest(F.lit(1), F.sum("n_skus")), 4).alias("sku_deviation"),
        F.round(F.abs(F.avg("s_confidence") - F.avg("confidence")), 4).alias("confidence_gap"),
    )
    alerts = F.array(F.when(F.col("agreement") < 0.9, "classes"), F.when(F.col("sku_deviation") > 0.2, "records"), F.when(F.col("confidence_gap") > 0.1, "confidence"))
    return g.withColumn("alerts", F.array_join(F.array_compact(alerts), ","))
