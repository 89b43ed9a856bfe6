"""Classifiers: held-out accuracy on small planted data, and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import language, quality, toxicity
from leafmill.llm import textwork as tw

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["the", "ing", "er", "on", "and"], "de": ["der", "sch", "ung", "ü", "ein"], "fr": ["le", "eau", "é", "que", "ai"], "es": ["ción", "el", "ñ", "os", "ado"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = []
    labels = []
    for i in range(900):
        lang = rng.choice(list(SYLLABLES))
        t = text(rng, lang, rng.randint(20, 120))
        toxic, good = i % 8 == 0, i % 5 != 0
        if toxic:
            at = t.split()
            at.insert(rng.randrange(len(at)), rng.choice(["idiot", "scum", "zorgy", "trash"]))
            t = " ".join(at)
        if not good:
            t = rng.choice([lambda t: " | ".join(t.split()), lambda t: "%%% ".join(t.split()), lambda t: " ".join(w for w in t.split()[:5] for _ in range(20))])(t)
        rows.append((i, t, lang, "s", 0))
        labels.append((i, int(good), int(toxic)))
    odd = [(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "123 ... !!", "de", "s", 0), (None, "the ing er", "en", "s", 0), (5003, text(rng, "de", 60_000), "de", "s", 0), (7, rows[7][1], rows[7][2], "s", 0)]
    labels += [(None, 1, 1), (5000, None, None), (7, 0, 0)]
    return spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def clashing(df):
    for c in ("p_toxic", "P_INSULT", "quality_score", "score", "y"):
        df = df.withColumn(c, F.lit("own"))
    return df


def test_toxicity(spark, corpus):
    docs, labels = corpus
    learn = labels.where("doc_id % 3 > 0 OR doc_id IS NULL")
    chain = toxicity.train(docs, learn)
    got = {(r["doc_id"], r["text"]): r["p_toxic"] for r in toxicity.score(docs, chain).collect()}
    assert len(got) == docs.distinct().count()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] is not None and r["toxic"] is not None}
    held = [(truth[i] == 1, p >= 0.5) for (i, _), p in got.items() if i in truth and i % 3 == 0 and i < 900]
    assert np.mean([a == b for a, b in held]) > 0.97
    kept = toxicity.drop_toxic(clashing(docs), learn)
    assert kept.columns == clashing(docs).columns and kept.where("p_toxic <> 'own'").count() == 0
    assert kept.count() == sum(1 for r in toxicity.score(docs, chain).collect() if r["p_toxic"] < 0.5)
    again = toxicity.train(docs.repartition(5), learn.repartition(3))
    assert np.array_equal(again.known, chain.known) and all(np.allclose(a.weight, b.weight) for a, b in zip(again.models, chain.models, strict=True))


def test_toxicity_without_use_of_labels(spark, corpus):
    docs, labels = corpus
    for few in (labels.where("false"), labels.where("toxic = 0")):
        assert toxicity.drop_toxic(docs, few).count() == docs.count()
    assert toxicity.score(docs.where("false"), toxicity.train(docs, labels)).count() == 0


def test_quality(spark, corpus):
    docs, labels = corpus
    vectors = quality.word_vectors(docs)
    assert np.array_equal(vectors, quality.word_vectors(docs.repartition(7)))
    network = quality.train(docs, labels, vectors, F.col("doc_id") % 3 > 0)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, vectors, network).collect()}
    held = [(i % 5 != 0, got[i] >= quality.THRESHOLD) for i in range(0, 900, 3)]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= p <= 1 for p in got.values()) and {5000, 5001, 5002, 5003, None} <= set(got)
    kept = quality.drop_poor(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and kept.where("quality_score <> 'own'").count() == 0


def test_quality_without_labels(spark, corpus):
    docs, labels = corpus
    for few, want in ((labels.where("false"), 0.5), (labels.where("quality = 1"), 1.0)):
        vectors = quality.word_vectors(docs)
        got = quality.score(docs, vectors, quality.train(docs, few, vectors)).select("quality_score").distinct().collect()
        assert [r[0] for r in got] == [want]
    assert quality.drop_poor(docs.where("false"), labels).count() == 0


def test_language(spark, corpus):
    docs, _ = corpus
    model = language.train(docs, F.col("doc_id") % 4 != 2)
    got = {r["id"]: r for r in language.identify(docs, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [got[i]["lang_pred"] == truth[i] for i in range(2, 900, 4)]
    assert np.mean(held) > 0.97
    for i in (5000, 5001, 5002):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[None]["lang_pred"] == "en" and got[5003]["lang_pred"] == "de"
    none = language.identify(docs, language.train(docs, F.lit(False))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    one = language.identify(docs, language.train(docs.where("lang = 'fr'"), F.lit(True))).where("id = 1").first()
    assert one["lang_pred"] == "fr"


def test_codewords_differ():
    for n in range(2, 40):
        code = language.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert code.shape[0] == n and min(gaps) >= max(1, code.shape[1] // 6)


def test_words_and_shingles_of_bytes():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB é9-\n\x00.Z") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "x"]
    words, _ = tw.tokenize(pa.array(texts))
    import re

    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]
    assert [(int(r), words.text(i, i + 1)) for i, r in enumerate(words.row)] == want
    for k in (1, 3):
        h, ok = tw.shingles(words, k)
        seen = {}
        for i in np.flatnonzero(ok):
            seen.setdefault(tuple(w for _, w in want[i : i + k]), set()).add(int(h[i]))
        assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
        assert ok.sum() == sum(1 for i in range(len(want) - k + 1) if want[i][0] == want[i + k - 1][0])
    pieces = list(tw.pieces(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), limit=20))
    assert [v for p in pieces for v in p.column(0).to_pylist()] == texts


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(11)
    texts = pa.array(["".join(rng.choice("abé, C") for _ in range(rng.randint(0, 90))) for _ in range(40)])
    whole = tw.tokenize(texts, prefixes=(4,)), language.gram_features(texts), tw.runs(texts)
    monkeypatch.setattr(tw, "PIECE_BYTES", 7)
    parts = tw.tokenize(texts, prefixes=(4,)), language.gram_features(texts), tw.runs(texts)
    assert np.array_equal(whole[0][0].hash, parts[0][0].hash) and np.array_equal(whole[0][1], parts[0][1])
    assert np.allclose(whole[1], parts[1]) and np.array_equal(whole[2].hash, parts[2].hash)


def plain_hash(data):
    """The library's hash of a run of bytes, in Python's integers."""
    base, mask = 0x9E3779B97F4A7C15, 2**64 - 1
    total = sum((b + 1) * pow(base, i, 2**64) for i, b in enumerate(data)) & mask
    return mixed(total)


def mixed(x):
    mask = 2**64 - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ (x >> 31)


def logistic(z):
    import math

    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_toxicity_scores_equal_a_plain_rescoring(spark, corpus):
    import re

    docs, labels = corpus
    chain = toxicity.train(docs, labels)
    at = {int(h): i for i, h in enumerate(chain.known)}
    base, mask = 0x9E3779B97F4A7C15, 2**64 - 1
    got = {r["doc_id"]: r for r in toxicity.score(docs.where("doc_id < 60 OR doc_id >= 5000"), chain).collect()}
    for r in got.values():
        found = set()
        for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "")[:20_000].encode().lower() if r["doc_id"] != 5003 else b""):
            found.add(plain_hash(w) >> 32)
            for k in toxicity.PREFIXES:
                if len(w) > k:
                    found.add(mixed((sum((b + 1) * pow(base, i, 2**64) for i, b in enumerate(w[:k])) + k) & mask) >> 32)
        if r["doc_id"] == 5003:
            continue
        seen = []
        for name, m in zip(chain.names, chain.models, strict=True):
            z = sum(m.weight[at[h]] for h in found if h in at) + sum(d * p for d, p in zip(m.dense, seen, strict=True)) + m.bias
            seen.append(logistic(z))
            assert abs(seen[-1] - r[f"p_{name}"]) < 1e-9
    assert len(got) > 60


def test_kinds_part_the_toxic_documents(spark, corpus):
    docs, labels = corpus
    chain = toxicity.train(docs, labels)
    assert chain.names == toxicity.CHAIN and len(chain.models) == toxicity.KINDS + 1
    bits = np.array([[1, 0, 1], [1, 0, 0], [0, 1, 0], [0, 1, 1], [0, 0, 1], [0, 0, 1]], np.uint8)
    toxic = np.array([True, True, True, True, False, False])
    groups = toxicity.kinds(bits, toxic, 2)
    assert groups[:4].sum(axis=1).tolist() == [1, 1, 1, 1] and not groups[4:].any()
    assert (groups[0] == groups[1]).all() and (groups[2] == groups[3]).all() and (groups[0] != groups[2]).any()
    assert not toxicity.kinds(bits, np.zeros(6, bool), 2).any()


def test_quality_scores_equal_a_plain_rescoring(spark, corpus):
    import re

    docs, labels = corpus
    vectors = quality.word_vectors(docs)
    net = quality.train(docs, labels, vectors)
    for r in quality.score(docs.where("doc_id < 40 OR doc_id IN (5000, 5001, 5002)"), vectors, net).collect():
        runs = re.findall(rb"[0-9a-zA-Z\x80-\xff]+|[^0-9a-zA-Z\x80-\xff \t\n\r\x0b\x0c]+", (r["text"] or "").encode())
        total, last = np.zeros(quality.DIMENSIONS), None
        for run in runs:
            word = re.match(rb"[0-9a-zA-Z\x80-\xff]", run) is not None
            bucket = plain_hash(run) % (quality.BUCKETS - 1) + 1
            total += vectors[0 if word and run == last else bucket]
            last = run if word else last
        x = total / (len(runs) + quality.SHRINK)
        h = np.tanh((x - net.mean) / net.scale @ net.layers[0] + net.layers[1])
        assert abs(logistic(float((h @ net.layers[2] + net.layers[3])[0]) / net.temperature) - r["quality_score"]) < 1e-4


def test_language_scores_equal_a_plain_decoding(spark, corpus):
    import math

    docs, _ = corpus
    model = language.train(docs, F.lit(True))
    for r in language.identify(docs.where("doc_id < 40"), model).join(docs.where("doc_id < 40").select(F.col("doc_id").alias("id"), "text").distinct(), "id").collect():
        flat = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0 for b in r["text"].encode()]
        counts = {}
        for n in language.GRAMS:
            for i in range(len(flat) - n + 1):
                code = 0
                for b in flat[i : i + n]:
                    code = code * 257 + b
                if code:
                    slot = mixed((code + (n << 40)) & (2**64 - 1)) % language.WIDTH
                    counts[slot] = counts.get(slot, 0) + 1
        total = max(1, sum(counts.values()))
        margin = [sum(math.sqrt(c / total) * model.weight[s, j] for s, c in counts.items()) + model.bias[j] for j in range(model.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margin, code, strict=True)) for code in model.code]
        shares = [math.exp(-(v - min(loss)) * model.code.shape[1]) for v in loss]
        assert r["lang_pred"] == model.langs[loss.index(min(loss))] and abs(r["score"] - max(shares) / sum(shares)) < 1e-3


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        own = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(3)]
        rows += [(k * 100 + i, " ".join(rng.choice(own) for _ in range(40)), f"l{k:03}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True), size=600)
    assert len(model.langs) == 300
    got = language.identify(docs, model).collect()
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([r["lang_pred"] == truth[r["id"]] for r in got]) > 0.9


def test_language_of_odd_tables(spark, corpus):
    docs, _ = corpus
    model = language.train(docs, F.lit(True))
    assert language.identify(docs.where("false"), model).count() == 0
    assert language.train(docs.where("false"), F.lit(True)).langs == []
    for c in ("id", "lang_pred", "score", "ambiguous", "n", "__lang", "x"):
        docs = docs.withColumn(c, F.lit("own"))
    again = language.train(docs, F.lit(True))
    assert np.array_equal(again.weight, model.weight)
    rows = language.identify(docs, model)
    assert rows.columns == ["id", "lang_pred", "score", "ambiguous"] and rows.count() == docs.count()
