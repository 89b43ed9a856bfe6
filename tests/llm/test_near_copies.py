"""Near copies by every kind of edit, against brute-force Jaccard of five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def plain(rng, n):
    return [f"u{int(rng.paretovariate(0.7))}" for _ in range(n)]


def edited(rng, kind, words):
    """A copy about 0.8 to 0.9 alike."""
    n = len(words)
    if kind == "appended":
        return words + plain(rng, int(n * rng.uniform(0.1, 0.24)))
    if kind == "truncated":
        return words[: int(n * rng.uniform(0.81, 0.9))]
    out = list(words)
    for i in rng.sample(range(n), int(n * rng.uniform(0.01, 0.024))):
        out[i] = f"new{rng.randint(0, 9999)}"
    return out


def copies(rng, kind, count):
    pairs = []
    while len(pairs) < count:
        words = plain(rng, rng.choice([120, 300, 700]))
        a, b = " ".join(words), " ".join(edited(rng, kind, words))
        if 0.8 <= jaccard(a, b) < 0.9:
            pairs.append((a, b))
    return pairs


@pytest.mark.parametrize("kind", ["appended", "truncated", "substituted"])
def test_near_copies_meet(kind):
    pairs = copies(random.Random(31), kind, 300)
    met = sum(bool((simhash.sketch(a.encode())[-simhash.BANDS :] == simhash.sketch(b.encode())[-simhash.BANDS :]).any()) for a, b in pairs)
    assert met >= 299


@pytest.mark.parametrize("small", [1000, 8, 0])
def test_no_pair_of_a_bucket_is_skipped(spark, small):
    # 3-45 and 17-31 lie among nodes like none; 50-59 are all alike; 60 joins 45 in another bucket only.
    alike = {(3, 45), (17, 31), (45, 60)} | {(a, b) for a in range(50, 60) for b in range(a + 1, 60)}
    met = spark.createDataFrame([(n, 9, 1) for n in range(60)] + [(n, 9, 2) for n in (40, 45, 60)] + [(70, 9, 3)] * 2, "node long, size long, bucket long")
    truth = spark.createDataFrame(sorted(alike), "a long, b long")

    def joined(crowd, one_each):
        a, b = crowd.select(F.col("node").alias("a")), crowd.select(F.col("node").alias("b"))
        return truth.join(a, "a", "left_semi").join(b, "b", "left_semi").select("a", "b")

    roots = simhash.grouped(met, lambda pairs: pairs.join(truth, ["a", "b"]), joined, small)
    want = {3: 3, 45: 3, 60: 3, 17: 17, 31: 17} | {n: 50 for n in range(50, 60)}
    assert {r["node"]: r["root"] for r in roots.collect()} == want


def test_prefixes_lose_no_pair_and_spare_what_is_common(spark):
    rng = random.Random(6)
    sets = []
    for _ in range(60):
        base = {rng.randrange(4000) for _ in range(rng.choice([4, 9, 30, 90]))}
        sets.append(base)
        for _ in range(3):
            own = set(base)
            for t in rng.sample(sorted(own), rng.randint(0, max(1, len(own) // 8))):
                own.discard(t)
            own |= {rng.randrange(4000) for _ in range(rng.randint(0, max(1, len(base) // 10)))}
            sets.append(own or {1})
    common = set(range(10_000, 10_060))
    crowd = [common | {20_000 + 30 * i + j for j in range(20)} for i in range(150)]  # 0.6 alike
    sets += crowd
    nodes = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "node long, size long, root long")
    held = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s], "node long, token long")
    placed = simhash.prefixes(nodes, held)
    got = {(r["a"], r["b"]) for r in simhash.prefix_pairs(placed, nodes).collect()}
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want <= got and not any(a >= len(sets) - 150 and b >= len(sets) - 150 for a, b in got)
    one_root = nodes.withColumn("root", F.lit(1).cast("long"))
    assert simhash.prefix_pairs(placed, one_root).count() == 0
    few = nodes.withColumn("root", F.col("node") % 5)
    one_each = {(r["a"], r["b"]) for r in simhash.prefix_pairs(placed, few, True).collect()}
    assert one_each <= got and len({tuple(sorted((a % 5, b % 5))) for a, b in one_each}) == len(one_each) <= 10


RECALL = {}


@pytest.mark.parametrize("band", [(0.8, 0.85), (0.85, 0.9), (0.9, 1.0)])
def test_recall_by_similarity(spark, band):
    """Pairs of every kind of edit, and of one set of words in another order, against brute force."""
    rng = random.Random(int(band[0] * 100))
    pairs = []
    while len(pairs) < 240:
        kind = ["appended", "truncated", "substituted", "reordered"][len(pairs) % 4]
        words = plain(rng, rng.choice([120, 300, 700]))
        n = len(words)
        share = rng.uniform(0.0, 0.25)
        out = list(words)
        if kind == "appended":
            out += plain(rng, max(1, int(n * share)))
        elif kind == "truncated":
            out = out[: n - max(1, int(n * share))]
        elif kind == "substituted":
            for i in rng.sample(range(n), max(1, int(n * share / 9))):
                out[i] = f"new{rng.randint(0, 9999)}"
        else:
            for i in rng.sample(range(n - 1), max(1, int(n * share / 11))):
                out[i], out[i + 1] = out[i + 1], out[i]
        a, b = " ".join(words), " ".join(out)
        if band[0] <= jaccard(a, b) < band[1]:
            pairs.append((a, b))
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    found = {r["id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = sum(found[2 * i + 1] == 2 * i for i in range(len(pairs)))
    RECALL[band] = linked / len(pairs)
    print(band, linked, len(pairs))
    assert linked >= 0.99 * len(pairs)


def test_texts_of_linked_fingerprints_meet(spark):
    """Pairs 0.8 alike that no MinHash band brings together, but the balls of their fingerprints do."""
    texts = []
    for times, words, bits in ((50, "w531873 w459645 w431943 w762731", 0), (6, "w914392 w5176 w984429 w286748", 2)):
        whole = " ".join(["a"] * times + words.split())
        a, b = whole.rsplit(" ", 1)[0], whole
        x, y = simhash.sketch(a.encode()), simhash.sketch(b.encode())
        assert jaccard(a, b) == 0.8 and not (x[-simhash.BANDS :] == y[-simhash.BANDS :]).any()
        assert bin(simhash.fingerprint(a.encode(), 3, 42) ^ simhash.fingerprint(b.encode(), 3, 42)).count("1") == bits
        texts += [a, b]
    texts += [" ".join(["a"] * 50 + [f"v{i}" for i in range(n)]) for n in (9, 20)]  # one fingerprint, less than half alike
    assert len({simhash.fingerprint(texts[i].encode(), 3, 42) for i in (0, 4)}) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["component"] for r in simhash.similar_groups(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == {0, 2, 4, 5}


def test_many_texts_around_one_passage(spark):
    """Texts that share most of their words but are not 0.8 alike, pairs of copies among them."""
    rng = random.Random(12)
    form = plain(rng, 200)
    texts = []
    for i in range(80):
        own = form + [f"own{i}x{j}" for j in range(60)]
        texts.append(" ".join(own))
        if i % 4 == 0:
            texts.append(" ".join([*own[:-1], "other"]))
    found = {r["id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: (i - 1 if t.endswith("other") else i) for i, t in enumerate(texts)}
    assert found == want


def test_odd_rows_of_the_stage(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(plain(rng, 80)) for _ in range(3))
    long = " ".join(f"l{i}" for i in range(120_000))
    rows = [(1, a), (1, b), (1, b), (2, a + " tail"), (3, c), (3, c), (None, a), (None, None), (4, None), (5, ""), (6, long), (7, long + " end"), (8, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("own")).withColumn("__key", F.lit(1)).withColumn("first", F.lit(2))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = sorted([(1, a), (1, b), (3, c), (None, a), (None, None), (4, None), (6, long), (8, "one")], key=str)
    assert got == want
    again = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df.repartition(5)).collect()), key=str)
    assert again == want
    assert simhash.drop_near_duplicates(df.where("false")).count() == 0


def test_groups_equal_brute_force(spark):
    """Edits from far below to far above 0.8, and templated texts that share most of their words."""
    rng = random.Random(8)
    texts = []
    for kind in ("appended", "truncated", "substituted"):
        for _ in range(30):
            words = plain(rng, rng.choice([80, 200, 500]))
            n = len(words)
            far = {"appended": words + plain(rng, int(n * rng.uniform(0.02, 0.6))), "truncated": words[: int(n * rng.uniform(0.6, 0.99))]}
            out = list(words)
            for i in rng.sample(range(n), int(n * rng.uniform(0.01, 0.08))):
                out[i] = f"new{rng.randint(0, 9999)}"
            texts += [" ".join(words), " ".join(far.get(kind, out))]
    form = plain(rng, 300)
    for _ in range(60):
        own = form + plain(rng, 45)
        texts += [" ".join(own), " ".join([*own[:-1], "last"])]
    texts += [texts[0].upper(), "  " + texts[1], "one", "One", "a b", "", None]
    found = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["id"]: r["component"] for r in found.collect()}
    root = list(range(len(texts)))
    sets = [shingles(t) if (t or "").split() else set() for t in texts]
    for b in range(len(texts)):
        for a in range(b):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
