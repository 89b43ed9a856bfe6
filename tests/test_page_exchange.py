"""What the page path exchanges: its tables lie in buckets by page, so that joins need no shuffle."""

from pyspark.sql import functions as F

from leafmill.operators import pages
from leafmill.plans import flagship
from leafmill.sources import catalogue
from leafmill.sources.store import dealt

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unbroadcast(spark, made):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan_of(made())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_records_of_a_page_meet_their_bindings_in_place(spark):
    assert "Exchange" not in unbroadcast(spark, lambda: flagship.page_records(spark, SF))


def test_parts_are_dealt_by_page_once(spark):
    parts = catalogue.parts(spark, SF)
    assert all("Exchange" not in unbroadcast(spark, lambda df=df: df.groupBy("page").agg(F.count("*"))) for df in parts)


def test_dealt_tables_keep_rows_and_settings(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    df = spark.sql("SELECT nullif(id % 7, 3) AS page, id, concat('t', id) AS t FROM range(200)")
    got = dealt(df, "some", 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect())) and spark.conf.get(key) == before


def test_the_first_of_equal_lines_has_the_least_part_and_supplier(spark, tmp_path):
    rows = [(1, 1, 7, 2), (1, 1, 7, 1), (1, 1, 9, 0), (1, 2, None, 5), (1, 2, 3, 4), (2, 1, 7, None), (2, 1, 7, 0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(3, "c", 1), (7, "a", 2)], "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = [(r["page"], r["n"], r["l_partkey"], r["l_suppkey"]) for r in catalogue.lines(spark, str(tmp_path), 2).collect()]
    assert sorted(got, key=str) == [(1, 1, 7, 1), (2, 1, 7, None)]  # line 2's first has no part: it goes, as before


def test_pages_without_tables_can_be_left_out_of_continuation(spark):
    table = [["a", "b"], ["1", "2"]]
    rows = [(1, table, ""), (2, table, ""), (3, None, ""), (4, table, "续"), (5, [["x"]], "续 on"), (7, table, "续")]
    df = spark.createDataFrame([("j", *r) for r in rows], "job string, page_no int, rows array<array<string>>, raw_text string")
    cut = df.where("rows IS NOT NULL").withColumn("said", pages.goes_on(F.col("raw_text"))).drop("raw_text")
    kept = lambda d: sorted(map(str, pages.continuation(d).where("source_page IS NOT NULL").select("page_no", "source_page", "merged_rows").collect()))
    assert kept(df) == kept(cut) and len(kept(cut)) == 2
