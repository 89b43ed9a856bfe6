"""Sinks: page results as three tables, imports with keys and a retry policy, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_result_tables(skus: DataFrame, images: DataFrame, bindings: DataFrame) -> dict[str, DataFrame]:
    """What a finished page stores: valid records, eligible images, bindings that have an image."""
    return {"skus": skus.where("validity = 'valid'"), "images": images.where("search_eligible"), "bindings": bindings.where("image IS NOT NULL")}


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: str | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{name}")


def import_key(sku: Column, revision: Column) -> Column:
    return F.concat(sku, F.lit("_v"), revision.cast("string"))


# Seconds waited before the next attempt, and how many attempts follow the first.
WAITS_LIMITED = [30, 60, 120]
WAITS_OTHER = [2, 4, 8]
LONGEST_WAIT = 300
RETRIES = 3


def import_policy(http_status: Column) -> Column:
    """What one answer of the downstream to an import means.  Too many requests and version conflicts
    are tried again; other client errors are errors of the data and never are; everything else, no
    answer at all (null) among it, is tried again."""
    return (
        F.when(http_status.isin(200, 201), "confirmed")
        .when(http_status == 202, "assumed")
        .when(http_status.isin(409, 429), "retry")
        .when(http_status.between(400, 499), "data_error")
        .otherwise("retry")
    )


def upsert_policy(http_status: Column) -> Column:
    """What the answer to a correction of an imported record means: it is not tried again."""
    return F.when(http_status.isin(200, 201), "confirmed").otherwise("server_error")


def import_wait(http_status: Column, attempt: Column) -> Column:
    """Seconds to wait after an answer that asks for another try, by attempt (from 0); null where
    none follows.  Rate limits wait long, conflicts double from one second."""
    pick = lambda waits: F.get(F.array(*[F.lit(w) for w in waits]), attempt)
    doubled = F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2), attempt).cast("int"))
    more = attempt < RETRIES
    return F.when(import_policy(http_status) == "retry", (
        F.when(http_status == 429, F.coalesce(pick(WAITS_LIMITED), F.lit(LONGEST_WAIT)))
        .when((http_status == 409) & more, doubled)
        .when((http_status.isNull() | (http_status != 409)) & more, pick(WAITS_OTHER))
    ))


def import_replay(answers: Column) -> Column:
    """struct<result, attempts, waited>: an import whose attempts are answered by ``answers`` (an array
    of status codes, null for no answer; attempts beyond it have no answer).  It ends at the first
    answer that is not tried again; after ``RETRIES`` more attempts it has failed."""
    tried = F.transform(F.sequence(F.lit(0), F.lit(RETRIES)), lambda i: F.struct(F.get(answers, i).alias("code"), i.alias("i")))
    start = F.struct(F.lit(None).cast("string").alias("result"), F.lit(0).alias("attempts"), F.lit(0).alias("waited"))

    def step(acc: Column, t: Column) -> Column:
        meaning = import_policy(t["code"])
        then = F.struct(
            F.when(meaning != "retry", meaning).alias("result"), (acc["attempts"] + 1).alias("attempts"),
            (acc["waited"] + F.coalesce(import_wait(t["code"], t["i"]), F.lit(0))).alias("waited"),
        )
        return F.when(acc["result"].isNull(), then).otherwise(acc)

    return F.aggregate(tried, start, step, lambda acc: F.struct(F.coalesce(acc["result"], F.lit("server_error")).alias("result"), acc["attempts"].alias("attempts"), acc["waited"].alias("waited")))


def import_state(http_status: Column, body: Column) -> Column:
    """Whether the downstream says that a page is imported; null if it cannot be asked."""
    return F.when(http_status == 200, F.coalesce(F.get_json_object(body, "$.confirmed").try_cast("boolean"), F.lit(False)))


def expired_uploads(files: DataFrame, uploads: DataFrame, hours: int = 6) -> DataFrame:
    """Files to remove: older than ``hours`` and not complete, or without an upload record."""
    known = uploads.select("upload", "complete", F.lit(True).alias("__known"))
    joined = files.join(known, "upload", "left")
    return joined.where(F.col("__known").isNull() | ((F.col("age_hours") > hours) & ~F.col("complete"))).select("upload")
