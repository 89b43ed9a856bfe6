"""Every query against its SQL on the same tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        return repr(v)

    return sorted(tuple(value(r[i]) for i in at) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert tidy([tuple(r) for r in df.collect()], df.columns) == tidy(want.fetchall(), want.columns)


def test_streams_equal_their_batch_forms(spark):
    for stream, batch in (("stream_circuit_breaker", "circuit_breaker_replay"), ("stream_admission", "admission_control")):
        got, want = QUERIES[stream](spark, SF), QUERIES[batch](spark, SF)
        assert tidy([tuple(r) for r in got.collect()], got.columns) == tidy([tuple(r) for r in want.collect()], want.columns)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_without_sql_is_tested_otherwise():
    own = {"table_aware_chunks", "nms_greedy", "overlap_dedup_greedy", "circuit_breaker_replay", "admission_control", "stream_circuit_breaker", "stream_admission"}
    assert {n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"} == own
