"""Trailers of files: the last one counts, and a file without one costs no more than another."""

import time

from pyspark.sql import functions as F

from leafmill.sources import readers


def test_the_last_trailer_counts(spark):
    files = {
        b"trailer << /Size 7 >>": 7, b"/Size 1 \n x /Size\n\t 500001 >> \n %%EOF": 500001, b"/Size12": None, b"": None, b"\xff\n/Size 3\xfe/Size x": 3,
        b"/Size 9 " + b"y" * 2040: 9, b"/Size 9 " + b"y" * 2041: None, b"/Size" + b" " * 2000: None, b"/Size 99999999999999999999": None,
    }
    df = spark.createDataFrame([(bytearray(f),) for f in files], "content binary")
    got = {bytes(r["content"]): r["n"] for r in df.select("content", readers.pdf_objects(F.col("content")).alias("n")).collect()}
    assert got == files


def test_files_without_a_trailer_take_one_pass(spark):
    df = spark.range(4000).select(F.concat(F.lit("%PDF-"), F.repeat(F.lit("some words "), 400), F.col("id").cast("string")).cast("binary").alias("content"))
    issues = readers.file_issues(F.col("content"), F.lit(1), F.lit(False))
    began = time.monotonic()
    assert df.where(F.size(issues) > 0).count() == 0
    assert time.monotonic() - began < 10
