"""Document evaluation: dimension means, score spread and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def document_scores(pages: DataFrame, dims: list[str], penalty: str = "penalty") -> DataFrame:
    """Per job: the mean of each dimension (missing values ignored), the weighted score less the
    penalty, spread of the page scores, and the route."""
    bins = F.least(F.lit(9), F.floor(F.col("overall") * 10)).cast("int")
    # Share of each of the ten bins from counts in one pass, instead of a second aggregation.
    counts = [F.count_if(bins == b).alias(f"__b{b}") for b in range(10)]
    got = pages.groupBy("job").agg(
        F.count("*").alias("n"), *[F.coalesce(F.round(F.avg(d), 4), F.lit(0.0)).alias(d) for d in dims],
        F.max(penalty).alias("penalty"), F.round(F.var_pop("overall"), 6).alias("var"), *counts,
    )
    p = [F.col(f"__b{b}") / F.col("n") for b in range(10)]
    entropy = sum((F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in p), F.lit(0.0)) / F.log2(F.lit(10.0))
    got = got.withColumn("variance", F.when(F.col("n") < 3, 0.0).otherwise(F.col("var"))).withColumn("entropy", F.when(F.col("n") < 3, 0.0).otherwise(F.round(entropy, 6)))
    forced = (F.col("n") >= 3) & ((F.col("variance") > scoring.VARIANCE_LIMIT) | (F.col("entropy") > scoring.ENTROPY_LIMIT))
    got = got.withColumn("forced", forced).withColumn("score", scoring.weighted_score({d: F.col(d) for d in dims}, F.col("penalty")))
    return got.select("job", "n", *dims, "variance", "entropy", "forced", "score", scoring.route(F.col("score"), F.col("forced")).alias("route"))


def same_file_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs for which another live job of the merchant has the same file."""
    live = jobs.where(~F.col("status").isin("CANCELLED", "REJECTED"))
    many = live.groupBy("merchant", "file_hash").agg(F.count("*").alias("n"), F.min("job").alias("first")).where("n > 1")
    return live.join(many, ["merchant", "file_hash"]).where("job > first").select("job", "merchant", "file_hash", "first")


def with_cached(jobs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Cache-aside by file and configuration: a stored evaluation (file_hash, config_version, cached)
    wins over a fresh one; ``hit`` tells.  Jobs without a version have the default one."""
    keyed = jobs.withColumn("config_version", F.coalesce("config_version", F.lit("default")))
    joined = keyed.join(evaluations.select("file_hash", "config_version", "cached"), ["file_hash", "config_version"], "left")
    return joined.select("job", F.col("cached").isNotNull().alias("hit"), F.coalesce("cached", "score").alias("score"))


def degraded(jobs: DataFrame) -> DataFrame:
    """Outcome and route of jobs (score, blank_rate, sampled, rendered, failure): what cannot be
    evaluated goes to people, with the first reason that applies."""
    reason = (
        F.when(F.col("blank_rate") == 1.0, "prescan_reject").when(F.col("sampled") == 0, "no_pages_to_sample").when(F.col("rendered") == 0, "screenshot_render_failed")
        .when(F.col("failure").isNotNull(), F.concat(F.lit("eval_failed:"), "failure")).when(F.col("score").isNull(), "eval_failed:no_score").otherwise("ok")
    )
    out = jobs.withColumn("outcome", reason)
    return out.select("job", "outcome", F.when(F.col("outcome") == "ok", scoring.route(F.col("score"), F.lit(False))).otherwise("HUMAN_ALL").alias("route"))
