"""Invariants of stored state: each check gives the violations as (rule, entity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import user_status

DONE = ("IMPORTED_CONFIRMED", "IMPORTED_ASSUMED", "BLANK", "SKIPPED")
ENDED = ("FULL_IMPORTED", "PARTIAL_IMPORTED")


def _rows(df: DataFrame, rule: str, entity: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(entity).cast("string").alias("entity"))


def small_eligible(images: DataFrame, least: int = 640) -> DataFrame:
    """INV-03: images fit for search have a short edge of ``least`` pixels."""
    return _rows(images.where(F.col("search_eligible") & (F.col("short_edge") < least)), "INV-03", "image")


def unfinished(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """INV-04: a job is finished only once every page is imported or has nothing to import."""
    left = pages.where(~F.col("status").isin(*DONE)).select("job")
    return _rows(jobs.where(F.col("status").isin(*ENDED)).join(left, "job", "left_semi"), "INV-04", "job")


def stale_user_status(jobs: DataFrame) -> DataFrame:
    """INV-10: the state shown to clients follows from the job's."""
    return _rows(jobs.where(F.col("user_status") != user_status(F.col("status"))), "INV-10", "job")


def double_claims(claims: DataFrame) -> DataFrame:
    """INV-11: nothing is claimed twice at a time.  ``claims``: a row (entity) per claim that is held."""
    return _rows(claims.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1"), "INV-11", "entity")


def violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
