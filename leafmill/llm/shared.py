"""Tables kept in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, never on an executor's own
disk, so a lost executor costs at most the running stage.
"""

from __future__ import annotations

import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder, as in unit tests on one machine.
DEFAULT_DIR = "/tmp/checkpoints"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = DEFAULT_DIR
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def crc_of(value: int) -> int:
    """Python's form of :func:`id_crc`."""
    return zlib.crc32(str(value).encode())


def hash_sample(df: DataFrame, key: str, size: int, seed: int = 17) -> DataFrame:
    """The rows of the ``size`` keys that hash lowest; rows of one key stay together, and the sample is
    the same on every run.

    Only distinct hashes are sorted; the rows themselves are filtered by the cut-off in a second scan,
    so the sample never moves whole texts through a sort.  Null keys are left out.  Give rows of
    distinct keys where the number of rows must be bounded too.
    """
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    keyed = df.where(F.col(key).isNotNull())
    cut = keyed.select(hashed.alias("h")).distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    return keyed.where(hashed <= F.lit(cut if cut is not None else -(2**63)))


def aside(docs: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that clash with ``reserved`` names renamed, and their new names."""
    taken = {c.lower() for c in docs.columns} | set(reserved)
    moved: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in reserved:
            new = c + "_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            moved[c] = new
    return docs.withColumnsRenamed(moved), moved


def restored(docs: DataFrame, columns: list[str], moved: dict[str, str]) -> DataFrame:
    """``columns`` of ``docs`` under their first names."""
    return docs.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in columns])
