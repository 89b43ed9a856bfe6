"""Tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_DIR = "/tmp/checkpoints"
#: Rows of a bucket, of which a task sorts some copies in memory.
BUCKET_ROWS = 250_000
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_DIR
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, where several later steps use it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deals(rows: DataFrame, each: int = BUCKET_ROWS) -> int:
    """Into how many buckets tables of about as many rows as ``rows`` are dealt."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def dealt(df: DataFrame, label: str, buckets: int, key: str = "page") -> DataFrame:
    """``df`` written once, in ``buckets`` by hash of ``key``, and read back: joins, groups and windows by the
    key need no exchange, nor do they with other tables dealt alike.  Rows that are dealt so already are
    written where they are.  The table is one of the session's, its files are in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    name = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    # Under another name, as Spark compares the table's name too where a union's sides are to lie alike.
    stored = f"__{key}"
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")  # joins by the key and another column need no exchange either
    try:
        moved = df.withColumnRenamed(key, stored).repartition(buckets, stored)
        moved.write.bucketBy(buckets, stored).sortBy(stored).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    finally:
        spark.conf.set(_ALL_KEYS, before)
    return spark.table(name).withColumnRenamed(stored, key)
