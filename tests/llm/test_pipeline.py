"""The pipeline's stages on a small planted corpus, each against what it must drop."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm.shared import shared_path


def test_stages(spark):
    rng = random.Random(5)
    syllables = ["the", "ing", "er", "on", "and", "ly", "th", "re", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    plain = lambda n: " ".join(word() for _ in range(n))
    item = plain(30)
    rows, labels, kinds = [], [], {}
    for i in range(700):
        t, kind = plain(rng.randint(60, 150)), "clean"
        if i % 10 == 0:
            t, kind = t + " " + rng.choice(["idiot", "scum", "trash"]) + " " + plain(5), "toxic"
        elif i % 10 == 1:
            t, kind = " | ".join(t.split()), "poor"
        elif i % 50 == 2:
            t, kind = plain(40) + ". " + item.upper() + " " + plain(20), "leak"
        elif i % 50 == 3 and i > 10:
            t, kind = rows[4][1], "copy"
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
        kinds[i] = kind
    rows += [(9000, None, None, None, None), (9001, "", "en", None, 0)]
    sf = shared_path(spark, "sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("items", F.lit("own"))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    drops = {"toxicity": "toxic", "quality": "poor", "near_duplicates": "copy", "decontamination": "leak"}
    left = dict(kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        path = shared_path(spark, name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        gone = {i for i in left if i not in ids}
        assert all(left[i] == drops[name] for i in gone if i < 9000), (name, {left[i] for i in gone})
        assert not [i for i in ids if left.get(i) == drops[name]], name
        left = {i: k for i, k in left.items() if i in ids}
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r["doc_id"] for r in mixed} <= set(left) and mixed
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(map(str, mixed))
