"""The registered queries over the whole of the smallest tables."""

import math
import os
import zlib

import pytest

import __spark_entry__ as entry
from leafmill.llm import licenses, tokens
from leafmill.llm.queries import QUERIES, SQL

from .test_exact import license_brute, op3_brute, viterbi

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return {r[0]: r for r in duck.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()}


def tidy(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in at) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert tidy([tuple(r) for r in df.collect()], df.columns) == tidy(want.fetchall(), want.columns)


def test_all_are_registered(spark):
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_simhash_query(spark, docs):
    got = sorted((tuple(r) for r in QUERIES["op3_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == op3_brute([(i, r[1]) for i, r in docs.items()])


def test_license_query(spark, docs):
    got = {(r["doc_id"], r["license"]) for r in QUERIES["op5_licenses"](spark, SF).collect()}
    want = {(i, name) for i, r in docs.items() for name, t in licenses.TEMPLATES.items() if license_brute(r[1], t) >= 0.8}
    assert got == want and got


def test_token_query(spark, docs):
    model = tokens.Unigram.load()
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in QUERIES["op9_tokens"](spark, SF).collect()}
    for i in docs:
        words = (docs[i][1] or "").encode().split()
        assert got[i][0] == len(words)
        if len(words) < 3000:
            assert got[i][1] == sum(viterbi(model, w.decode()) for w in words)


def test_classifier_queries(spark, duck, docs):
    labels = {r[0]: r for r in duck.sql("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    crc = lambda i: zlib.crc32(str(i).encode())
    lang = {r["doc_id"]: r for r in QUERIES["op7_language"](spark, SF).collect()}
    assert set(lang) == set(docs) and all(lang[i]["held_out"] == (crc(i) % 4 == 2) for i in docs)
    held = [lang[i]["lang_pred"] == docs[i][2] for i in docs if crc(i) % 4 == 2]
    assert sum(held) / len(held) > 0.9
    good = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, SF).collect()}
    assert all(good[i]["held_out"] == (crc(i) % 5 == 0) and good[i]["predicted"] == int(good[i]["score"] >= 0.3) for i in docs)
    clean = [good[i]["predicted"] for i in docs if i in labels and labels[i][1] == 1]
    assert sum(clean) / len(clean) > 0.95
    toxic = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    assert set(toxic) == set(docs) and all(0 <= r["p_toxic"] <= 1 and not math.isnan(r["p_toxic"]) for r in toxic.values())
    right = [toxic[i]["toxic"] == bool(v[2]) for i, v in labels.items() if i in toxic]
    assert sum(right) / len(right) > 0.95


def test_pipeline_query(spark, docs):
    got = entry.queries()["pipeline"](spark, SF).collect()
    assert got and {r["doc_id"] for r in got} <= set(docs) and all(r["copies"] in (1, 2, 3) for r in got)
