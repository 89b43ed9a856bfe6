"""Unit vectors of the operators, and simulations of those that SQL cannot express."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry as geo
from leafmill.functions import hashing, jsonx, scoring, vocab
from leafmill.functions import text as tx
from leafmill.operators import binding, evaluation, feedback, pages, records, series, tasks
from leafmill.operators import relational as rel
from leafmill.sources import readers, sinks


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)


def value(df, *cols):
    return tuple(df.select(*cols).first())


def test_page_features(spark):
    pg = spark.createDataFrame([(1, "Product A $29.99 Model XZ-500", 612.0, 792.0), (2, "", 100.0, 100.0)], "page int, raw_text string, w double, h double")
    at = "page int, pos int, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([(1, 1, 10.0, 10.0, 200.0, 30.0, 9.0), (1, 2, 0.0, 0.0, 0.0, 0.0, 0.0)], at + ", font_size double")
    imgs, tabs = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 0.0, 0.0, 1.0, 1.0)], at), spark.createDataFrame([(1, 1, 0.0, 0.0, 306.0, 396.0)], at)
    a, b = pages.part_features(pg, blocks, imgs, tabs).orderBy("page").collect()
    assert (a["n_blocks"], a["n_images"], a["n_tables"], a["has_price"], a["has_model"], a["avg_font_size"], a["table_area_ratio"]) == (2, 2, 1, True, True, 9.0, 0.25)
    assert a["text_density"] == pytest.approx(3800 / (612 * 792), abs=1e-6) and (b["text_density"], b["n_images"]) == (0.0, 0)


@pytest.mark.parametrize(
    ("blocks", "images", "tables", "ratio", "text", "want", "confidence"),
    [
        (0, 0, 0, 0.0, "", "D", 0.95),
        (5, 0, 0, 0.0, "Table of Contents ...", "D", 0.9),
        (4, 0, 2, 0.5, "x", "A", 0.88),
        (2, 5, 0, 0.0, "x", "C", 0.8),
        (10, 2, 0, 0.0, "only $ 5.00", "B", 0.7),
        (2, 1, 0, 0.0, "Some text", "B", 0.5),
        (3, 1, 0, 0.0, "Spring CATALOG", "D", 0.9),
    ],
)
def test_rule_classes(spark, blocks, images, tables, ratio, text, want, confidence):
    df = one(spark, n_blocks=blocks, n_images=images, n_tables=tables, table_area_ratio=ratio, raw_text=text)
    df = df.withColumn("has_price", tx.has_price(F.col("raw_text"))).withColumn("has_model", tx.has_model(F.col("raw_text")))
    assert value(pages.classify(df), "page_type", "classify_confidence") == (want, confidence)


def test_price_model_and_splitting(spark):
    df = one(spark, t="x ￥ 12 $1,299.00 AB-123 886# red 887# blue", s="one 12# only", n=None or "")
    assert value(df, tx.first_match(F.col("t"), tx.PRICE_VALUE), tx.first_match(F.col("t"), tx.MODEL_VALUE), tx.first_match(F.col("n"), tx.MODEL_VALUE)) == ("$1,299.00", "AB-123", None)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Intro words 886# chair 887# table", ["886# chair", "887# table"]),
        ("858B# sofa\n09＃ bed \u30005# lamp", ["858B# sofa", "09＃ bed", "5# lamp"]),
        ("one 12# only", []), ("Nr# 12# a x34# b", ["12# a", "x34# b"]), ("12#34# a", []), ("", []), (None, []),
    ],
)
def test_marker_splitting(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert value(df, tx.split_by_marker(F.col("t"))) == (want,)


def test_marker_splitting_is_linear_in_long_words(spark):
    df = one(spark, t="9" * 300_000 + " 12# a 13# b")
    assert value(df, F.size(tx.split_by_marker(F.col("t")))) == (2,)


def test_render_marks_what_it_cuts(spark):
    got = value(one(spark, t="x" * 2001), tx.render("<{t}|{gone}>", {"t": F.col("t")}))[0]
    assert got == "<" + "x" * 2000 + "... [truncated]|>"


def test_exact_round_is_pythons(spark):
    rng = random.Random(2)
    xs = [rng.random() for _ in range(3000)] + [k / 1000 + 0.0005 for k in range(1000)] + [k / 8 for k in range(40)] + [99 / 792, 0.615, 2.675, 1.005, 0.0, 1.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [tuple(r) for r in df.select(scoring.exact_round(F.col("x"), 2), scoring.exact_round(F.col("x"), 3)).collect()]
    assert got == [(round(x, 2), round(x, 3)) for x in xs]


def test_header_records(spark):
    df = one(spark, h=[" Name ", "SIZE", "name"], r=["a", " ", "b ", "extra"])
    assert value(df, tx.header_records(F.col("h"), F.col("r")), tx.header_records(F.col("h"), F.col("r"), False)) == ({"name": "b"}, {"size": " ", "name": "b "})


@pytest.mark.parametrize(
    ("attrs", "mode", "want"),
    [(("n", None, None, "1"), "strict", "valid"), ((None, None, None, "1"), "strict", "invalid"), (("n", None, None, ""), "strict", "invalid"), ((None, None, None, "1"), "relaxed", "valid")],
)
def test_validity(spark, attrs, mode, want):
    df = spark.createDataFrame([attrs], "product_name string, model_number string, size string, price string")
    assert value(df, records.validity(mode)) == (want,)


def test_ids_follow_position(spark):
    rows = [(1234, 1, None, 10, 300), (1234, 2, "b", 10, 100), (1234, 3, "a", 10, 500)]
    df = spark.createDataFrame(rows, "page int, pos int, product string, x0 int, y0 int")
    got = records.assign_ids(df, F.lit(800.0), F.lit("abc"), F.col("page"))
    assert {r["pos"]: (r["sku_id"], r["product_no"]) for r in got.collect()} == {2: ("abc_1234_001", "abc_1234_P1"), 1: ("abc_1234_002", None), 3: ("abc_1234_003", "abc_1234_P2")}


def test_dedup_keeps_the_best_in_the_first_slot(spark):
    s = "page int, pos int, product string, product_name string, model_number string, size string, color string, material string, confidence double"
    rows = [(1, 1, None, "a", "m", None, None, None, 0.5), (1, 2, None, "a", "m", "", None, None, 0.9), (1, 3, None, "a", "m", None, None, "", 0.9), (1, 4, None, None, None, None, None, None, 0.1), (1, 5, None, "", None, None, None, None, 0.1), (1, 6, None, "a", "m", None, None, "oak", 0.2)]
    got = records.dedup_keep_best(spark.createDataFrame(rows, s)).collect()
    assert sorted((r["pos"], r["slot"]) for r in got) == [(2, 1), (4, 4), (5, 5), (6, 6)]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "page long, pos int, sku string, product string, layout string, x0 int, y0 int, x1 int, y1 int")


def images(spark, rows):
    return spark.createDataFrame(rows, "page long, pos int, image string, x0 int, y0 int, x1 int, y1 int")


def test_binding_branches(spark):
    skus = boxes(spark, [
        (1, 1, "s1", None, "list", 100, 100, 200, 200), (2, 1, "s2", None, "list", 0, 0, 0, 0), (2, 2, "s3", None, "list", 0, 0, 0, 0), (3, 1, "s4", None, "grid", 0, 0, 50, 50), (3, 2, "s5", None, "grid", 500, 500, 550, 550),
        (4, 1, "s6", None, "list", 1, 1, 2, 2), (5, 1, "s7", "P", "other", 0, 0, 10, 10), (5, 2, "s8", "P", "other", 2000, 2000, 2010, 2010),
    ])
    imgs = images(spark, [(1, 1, "i1", 100, 50, 200, 95), (2, 1, "i2", 0, 500, 10, 510), (2, 2, "i3", 0, 100, 90, 190), (3, 1, "i4", 0, 60, 50, 110), (3, 2, "i5", 500, 560, 550, 610), (5, 1, "i6", 0, 12, 10, 30), (5, 2, "i7", 300, 12, 310, 30)])
    got = {r["sku"]: (r["image"], r["method"], r["ambiguous"]) for r in binding.bind(skus, imgs).collect()}
    assert got == {
        "s1": ("i1", "single_sku_all_images", False), "s2": ("i3", "zero_bbox_positional", False), "s3": ("i2", "zero_bbox_positional", False), "s4": ("i4", "grid_alignment", False),
        "s5": ("i5", "grid_alignment", False), "s6": (None, "spatial_proximity", False), "s7": ("i6", "spatial_proximity", False), "s8": ("i6", "product_group", False),
    }


def random_boxes(rng, n_pages, most):
    return [(p, i, f"s{p}-{i}", None, "x", x, y, x + rng.randint(1, 60), y + rng.randint(1, 60)) for p in range(n_pages) for i in range(rng.randint(1, most)) for x, y in [(rng.randint(0, 150), rng.randint(0, 150))]]


def overlap(a, b):
    return max(0, min(a[7], b[7]) - max(a[5], b[5])) * max(0, min(a[8], b[8]) - max(a[6], b[6]))


def area(a):
    return (a[7] - a[5]) * (a[8] - a[6])


def test_greedy_suppression_and_overlap(spark):
    rng = random.Random(1)
    rows = random_boxes(rng, 30, 12)
    conf = {(r[0], r[1]): rng.randint(0, 5) / 5 for r in rows}
    df = boxes(spark, rows).join(spark.createDataFrame([(*k, v) for k, v in conf.items()], "page long, pos int, confidence double"), ["page", "pos"])
    kept = set()
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        stay = []
        for r in sorted(own, key=lambda r: (-conf[p, r[1]], r[1])):
            if all(overlap(r, s) / (area(r) + area(s) - overlap(r, s)) <= 0.3 for s in stay):
                stay.append(r)
        kept |= {(p, r[1]) for r in stay}
    assert {(r["page"], r["pos"]) for r in records.nms(df, 0.3).collect()} == kept


def test_overlap_goes_in_page_order(spark):
    rng = random.Random(8)
    rows = random_boxes(rng, 60, 12)
    pixels = {(r[0], r[1]): (rng.randint(1, 4) * 100, rng.randint(1, 3) * 100) for r in rows}
    sizes = spark.createDataFrame([(*k, *v) for k, v in pixels.items()], "page long, pos int, width int, height int")
    lost, again = set(), 0
    for p in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == p)
        size = {r[1]: pixels[p, r[1]][0] * pixels[p, r[1]][1] for r in own}
        gone = set()
        for i, a in enumerate(own):
            if a[1] in gone:
                continue
            for b in own[i + 1 :]:
                if b[1] not in gone and overlap(a, b) / max(1, min(area(a), area(b))) > 0.5:
                    again += a[1] in gone
                    gone.add(b[1] if size[a[1]] >= size[b[1]] else a[1])
        lost |= {(p, pos) for pos in gone}
    got = binding.overlap_dedup(boxes(spark, rows).join(sizes, ["page", "pos"]), 0.5)
    assert {(r["page"], r["pos"]) for r in got.collect()} == lost and again  # an image that lost goes on against later ones


def test_image_deduplication(spark):
    s = "page int, pos int, image string, x0 int, y0 int, x1 int, y1 int, width int, height int, hash string, role string"
    rows = [(1, 1, "a", 0, 0, 0, 0, 300, 300, "h", ""), (1, 2, "b", 0, 0, 0, 0, 400, 300, "h", ""), (1, 3, "c", 0, 0, 0, 0, 400, 300, "", ""), (1, 4, "d", 500, 0, 600, 90, 400, 400, None, ""), (1, 5, "e", 500, 0, 600, 90, 500, 400, None, ""), (1, 6, "f", 0, 0, 100, 100, 10, 10, None, "")]
    got = {r["image"]: (r["short_edge"], r["is_duplicate"], r["search_eligible"]) for r in binding.deduplicated(spark.createDataFrame(rows, s)).collect()}
    assert got == {"a": (300, True, False), "b": (300, False, True), "c": (300, False, True), "d": (400, True, False), "e": (400, False, True), "f": (208, False, True)}


def test_tile_gates_and_composites(spark):
    s = "page int, pos int, image string, x0 int, y0 int, x1 int, y1 int, width int, height int, hash string, role string"
    tile = lambda p, i, w, h, x, y: (p, i, f"t{p}-{i}", x, y, x + 40, y + 40, w, h, "", "")
    grid = lambda p, n, w, h: [tile(p, i, w, h, (i % 6) * 40, (i // 6) * 40) for i in range(n)]
    rows = grid(1, 29, 60, 60) + grid(2, 30, 60, 60) + grid(3, 31, 300, 300) + grid(4, 51, 225, 215) + [tile(4, 99, 225, 215, 2000, 2000)]
    rows += [tile(5, i, 200 + i, 300, (i % 6) * 40, (i // 6) * 40) for i in range(60)]
    got = binding.merge_tiles(binding.deduplicated(spark.createDataFrame(rows, s))).collect()
    made = {(r["page"], r["image"]): (r["x0"], r["y0"], r["x1"], r["y1"], r["short_edge"], r["search_eligible"]) for r in got if r["role"] == "unknown"}
    assert made == {(2, "p2_composite_0"): (0, 0, 240, 200, 416, True), (4, "p4_composite_0"): (0, 0, 240, 360, 500, True)}
    assert {r["page"] for r in got if r["is_fragmented"]} == {2, 4} and all(r["is_fragmented"] and not r["search_eligible"] for r in got if r["page"] == 4 and r["pos"] == 99)


def test_tile_components(spark):
    rng = random.Random(3)
    rows = random_boxes(rng, 12, 30) + [(99, i, "s", None, "x", i * 12, 0, i * 12 + 10, 10) for i in range(40)]
    label = {(r[0], r[1]): r[1] for r in rows}
    for _ in range(60):
        for a in rows:
            for b in rows:
                if a[0] == b[0] and max(a[5], b[5]) - min(a[7], b[7]) < 5 and max(a[6], b[6]) - min(a[8], b[8]) < 5:
                    label[a[0], a[1]] = label[b[0], b[1]] = min(label[a[0], a[1]], label[b[0], b[1]])
    assert {(r["page"], r["pos"]): r["component"] for r in binding.tile_components(boxes(spark, rows)).collect()} == label


def test_point_in_polygon(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0)], "x double, y double")
    assert [r[0] for r in df.select(geo.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, False, False]


def test_png_header(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    df = spark.createDataFrame([(png,), (b"GIF89a" + b"\0" * 30,)], "c binary")
    assert [tuple(r) for r in df.select(*geo.png_size(F.col("c"))).collect()] == [(640, 480), (None, None)]


def test_scores_and_routes(spark):
    df = spark.createDataFrame([(0.92, False), (0.65, False), (0.30, False), (0.92, True), (0.30, True), (0.85, False), (0.45, False)], "s double, f boolean")
    assert [r[0] for r in df.select(scoring.route(F.col("s"), F.col("f"))).collect()] == ["AUTO", "HYBRID", "HUMAN_ALL", "HYBRID", "HUMAN_ALL", "AUTO", "HYBRID"]
    dims = {d: F.lit(0.8) for d in scoring.WEIGHTS}
    assert value(spark.range(1), scoring.weighted_score(dims, F.lit(0.15)), scoring.weighted_score({"text_clarity": F.lit(1.0)}, F.lit(0.0), {"text_clarity": 1.0})) == (0.65, 1.0)


@pytest.mark.parametrize(("scores", "forced"), [([0.8, 0.82, 0.79, 0.81, 0.80], False), ([0.95, 0.1, 0.92, 0.05, 0.88], True), ([0.1, 0.9], False)])
def test_spread(spark, scores, forced):
    rows = [("j", s, 0.0, *[s] * 5) for s in scores]
    df = spark.createDataFrame(rows, ["job", "overall", "penalty", *scoring.WEIGHTS])
    assert value(evaluation.document_scores(df, list(scoring.WEIGHTS)), "forced") == (forced,)


def test_json_levels(spark):
    texts = ['[{"score":0.85}]', '```json\n{"a": 1}\n```', 'so: {"a": 1}.', "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    json, level = jsonx.parse_levels(F.col("t"))
    assert [tuple(r) for r in df.select(level, json).collect()] == [(1, texts[0]), (2, '{"a": 1}'), (3, '{"a": 1}'), (4, None), (0, None)]
    assert value(one(spark, t='{"score": "bad"}'), jsonx.score_or(F.col("t"))) == (0.5,)


def test_payload_hash_ignores_order_and_metadata(spark):
    df = one(spark, x=1)
    m = lambda *kv: F.create_map(*[F.lit(v) for v in kv])
    h = lambda c: jsonx.payload_hash(c)
    a, b, c = value(df, h(m("a", "1", "b", "2", "timestamp", "t")), h(m("b", "2", "a", "1")), h(m("a", "1", "b", "3")))
    assert a == b != c and len(a) == 16


def test_map_merge_and_diff(spark):
    df = one(spark, a={"x": "1", "y": "2"}, b={"y": "3", "z": "4"})
    assert value(df, jsonx.merged(F.col("a"), F.col("b"))) == ({"x": "1", "y": "3", "z": "4"},)
    assert set(value(df, jsonx.changed(F.col("a"), F.col("b")))[0]) == {"x", "y", "z"}


def test_versions_and_masks(spark):
    assert value(spark.range(1), hashing.version_after(F.lit("v1.0")), hashing.masked(F.lit("sk-1234567890")), hashing.sku_id(F.lit("h"), F.lit(1), F.lit(12))) == ("v2.0", "sk-1***7890", "h_001_012")


def test_status_tables(spark):
    for status, want in (("UPLOADED", "processing"), ("FULL_IMPORTED", "completed"), ("DEGRADED_HUMAN", "needs_manual"), ("CANCELLED", "failed"), ("new", "processing")):
        assert value(spark.range(1), vocab.user_status(F.lit(status))) == (want,)
    assert all(v is not None for v in value(spark.range(1), *[vocab.action_hint(F.lit(s)) for s in vocab.USER_STATUS]))


@pytest.mark.parametrize(("outcomes", "throttled", "rate"), [("1" * 20, False, 0.0), ("1" * 5 + "0" * 15, True, 0.75), ("1111111000", True, 0.3), ("000", False, 1.0)])
def test_back_pressure(spark, outcomes, throttled, rate):
    df = spark.createDataFrame([(i, 1, o == "1") for i, o in enumerate(outcomes)], "event_id long, k long, ok boolean")
    last = series.failure_rate(df).orderBy(F.desc("event_id")).first()
    assert (last["throttled"], last["failure_rate"]) == (throttled, rate)


def test_streaks(spark):
    df = spark.createDataFrame([(i, k, o == "1") for k, s in ((1, "000"), (2, "0010")) for i, o in enumerate(s)], "event_id long, k long, ok boolean")
    got = series.streaks(df)
    assert {r["k"] for r in got.where("suspend").collect()} == {1}


def timed(spark, rng, n):
    rows = []
    for k in range(5):
        at = 0.0
        for i in range(n):
            at += rng.choice([1, 5, 20, 70])
            rows.append((k * n + i, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), rng.random() < 0.5))
    return rows, spark.createDataFrame(rows, "event_id long, k long, ts timestamp_ntz, ok boolean")


def test_breaker_and_admission(spark):
    rng = random.Random(4)
    rows, df = timed(spark, rng, 120)
    state, admitted, size = {}, {}, {r[0]: rng.choice([0, 10, 40]) for r in rows}
    for k in range(5):
        mode, fails, opened, good, held, spent, last = "CLOSED", [], -1e9, 0, [], 0, -1e9
        for i, _, ts, ok in (r for r in rows if r[1] == k):
            at = ts.timestamp()
            held = [t for t in held if at - t < 60]
            if len(held) >= 3:
                admitted[i] = (False, "requests")
            else:
                held.append(at)
                spent = 0 if at - last >= 120 else spent
                if size[i] and spent + size[i] > 100:
                    admitted[i] = (False, "tokens")
                else:
                    admitted[i] = (True, None)
                    if size[i]:
                        spent, last = spent + size[i], at
            if mode == "OPEN" and at - opened > 60:
                mode, good = "HALF_OPEN", 0
            if ok and mode == "HALF_OPEN":
                good += 1
                if good == 2:
                    mode, fails = "CLOSED", []
            elif not ok:
                fails = (fails + [at])[-20:]
                if mode == "HALF_OPEN" or len([t for t in fails if at - t < 60]) >= 5:
                    mode, opened = "OPEN", at  # while it is open as well
            state[i] = mode
    assert {r["event_id"]: r["state"] for r in series.breaker(df).collect()} == state
    sized = df.join(spark.createDataFrame(list(size.items()), "event_id long, tokens int"), "event_id")
    assert {r["event_id"]: (r["admitted"], r["refused_by"]) for r in series.admission(sized, 3, tokens=100).collect()} == admitted
    assert set(state.values()) == {"CLOSED", "OPEN", "HALF_OPEN"} and {v[1] for v in admitted.values()} == {None, "requests", "tokens"}


def test_failures_at_the_edge_of_the_window(spark):
    at = lambda *s: [(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=x), False) for i, x in enumerate(s)]
    schema = "event_id long, k long, ts timestamp_ntz, ok boolean"
    last = lambda rows: series.breaker(spark.createDataFrame(rows, schema)).orderBy(F.desc("event_id")).first()["state"]
    assert last(at(0, 1, 2, 3, 60)) == "CLOSED" and last(at(0, 1, 2, 3, 59)) == "OPEN"


def test_long_keys_are_numbered_and_summed_in_slices(spark):
    rows = [(k, i, i % 7) for k, n in (("a", 1000), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = rel.numbered(df, ["k"], [F.col("i")], F.floor(F.col("i") / 64), "n", "of")
    got = rel.running_sum(got, ["k"], [F.col("i")], F.floor(F.col("i") / 64), F.col("v"), "s")
    want = {(k, i): (i + 1, 1000 if k == "a" else 3, sum(j % 7 for j in range(i + 1))) for k, i, _ in rows}
    assert {(r["k"], r["i"]): (r["n"], r["of"], r["s"]) for r in got.collect()} == want


def test_point_lookup_wants_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert [tuple(r) for r in rel.point_lookup(df, "k", 1).collect()] == [(1, "a")]
    for k in (2, 3):
        with pytest.raises(Exception, match="rows found"):
            rel.point_lookup(df, "k", k).collect()


def test_corrected_bindings_reuse_rows(spark):
    df = spark.createDataFrame([("s", i, n) for n, i in enumerate(["x", "y", "x", "z", "y"])] + [("t", "x", 0)], "sku string, image string, n int")
    got = {(r["sku"], r["image"]): (r["revision"], r["is_latest"]) for r in rel.replaced_bindings(df, "sku", "image", [F.col("n")]).collect()}
    assert got == {("s", "x"): (3, False), ("s", "z"): (4, False), ("s", "y"): (5, True), ("t", "x"): (1, True)}


def test_consensus_confirms_pairs(spark):
    s = "annotation int, annotated_at timestamp_ntz, type string, category string, accuracy double, reworked boolean"
    when = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=40 * i)
    rows = [(i, when(i), "T", None if i < 5 else "chair", 0.95, False) for i in range(7)] + [(7, when(7), "T", None, None, False), (8, when(8), "T", None, 0.95, True)]
    got = {r["annotation"]: (r["category"], r["confirmed"]) for r in feedback.consensus(spark.createDataFrame(rows, s)).collect()}
    assert got == {0: ("default", True), 1: ("default", True), 2: ("default", True), 3: ("default", True), 4: ("default", False), 5: ("chair", True), 6: ("chair", True)}


def test_orphans_and_imports(spark):
    jobs = spark.createDataFrame([(i, "w1", s) for i, s in enumerate(["UPLOADED", "EVALUATING", "EVALUATED", "PROCESSING"])] + [(9, None, "UPLOADED"), (10, "w2", "UPLOADED")], "job int, worker string, status string")
    alive = spark.createDataFrame([("w2",)], "worker string")
    got = {r["job"]: (r["old_status"], r["status"], r["requeue"], r["after_s"]) for r in tasks.orphans(jobs, alive, F.col("job")).collect()}
    assert got == {0: ("UPLOADED", "ORPHANED", True, 300), 1: ("EVALUATING", "ORPHANED", True, 300), 3: ("PROCESSING", "ORPHANED", False, None)}
    assert tasks.orphans(jobs, alive.where("false"), F.lit(0)).count() == 0


def test_model_rebinding_needs_coverage(spark):
    skus = boxes(spark, [(p, i, f"s{p}-{i}", None, "x", 0, 0, 1, 1) for p in (1, 2, 3) for i in range(4)])
    imgs = images(spark, [(p, i, f"i{p}-{i}", 0, 0, 1, 1) for p in (1, 2, 3) for i in range(3)])
    answers = spark.createDataFrame([(1, 0, "[[0,2],[1,1],[9,0]]"), (2, 0, "so [[0,1]]"), (3, 0, '[{"sku_index": 3, "image_index": 0}, {"sku_index": 2, "image_index": 2}, {"image_index": 1}]')], "page int, batch int, text string")
    old = skus.select("page", "pos", "sku", "product", F.lit("old").alias("image"), F.lit(0.5).alias("confidence"), F.lit("grid_alignment").alias("method"), F.lit(True).alias("ambiguous"))
    got = {r["sku"]: r["image"] for r in binding.model_rebind(skus, imgs, answers, old).collect()}
    want = {f"s{p}-{i}": "old" for p in (1, 2, 3) for i in range(4)} | {"s1-0": "i1-2", "s1-1": "i1-1", "s3-3": "i3-0", "s3-2": "i3-2"}
    assert got == want


def test_chunks(spark):
    job = lambda n: spark.createDataFrame([("j", p, 1 if p % 9 in (7, 8, 0) else 0) for p in range(1, n + 1)], "job string, page_no int, n_tables int")
    count = lambda df: {r["chunk"]: r["n"] for r in df.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    assert count(pages.chunks(job(100))) == {0: 100} and count(pages.chunks(job(101))) == {0: 50, 1: 50, 2: 1}
    tables = {p for p in range(1, 131) if p % 9 in (7, 8, 0)}
    got = {r["page_no"]: r["chunk"] for r in pages.table_aware_chunks(job(130), size=8, most=3).collect()}
    start, n, want = 0, 0, {}
    while start < 130:
        end, moved = min(start + 8, 130), 0
        while moved < 3 and end + moved < 130 and end + moved in tables:
            moved += 1
        want |= {p + 1: n for p in range(start, min(end + moved, 130))}
        start, n = min(end + moved, 130), n + 1
    assert got == want


def test_samples(spark):
    job = lambda n: spark.createDataFrame([("j", p, p, p % 9, 1.0) for p in range(1, n + 1)], "job string, page_no int, doc_id long, n_images int, ocr_rate double")
    assert pages.systematic_sample(job(40)).count() == 40 and pages.systematic_sample(job(1)).count() == 1
    got = sorted(r["page_no"] for r in pages.systematic_sample(job(100)).collect())
    assert len(got) <= 40 and got[:2] == [1, 2] and got[-2:] == [99, 100]
    weighted = pages.weighted_sample(job(100)).collect()
    assert len(weighted) <= 40 and sum(r["band"] == 3 for r in weighted) >= 3


def test_prescan(spark):
    df = spark.createDataFrame([("a", "a page with enough text on it", 1), ("a", "another page with enough text", 0), ("b", "", 0), ("b", " ", 0)], "job string, raw_text string, n_images int")
    got = {r["job"]: r for r in pages.prescan(df).collect()}
    assert (got["a"]["ocr_rate"], got["a"]["all_blank"], got["a"]["penalty"]) == (1.0, False, 0.0)
    assert got["b"]["all_blank"] and got["b"]["penalty"] > 0


def test_continuation(spark):
    s = "job string, page_no int, raw_text string, rows array<array<string>>, last_rows array<array<string>>"
    rows = [
        ("j", 1, "", [["a", "b"], ["c", "d"]], None), ("j", 2, "", [["e", "f"]], None), ("j", 3, "", [["g", "h"]], None), ("j", 5, "", [["i", "k"]], None),
        ("k", 1, "", [["x"]], None), ("k", 2, "(Continued) ...", [["y", "z"]], [["last"]]), ("k", 3, "", [["w"]], None), ("k", 4, "", None, None), ("k", 5, "", [["v"]], None), ("l", 1, "", [["x"]], None), ("l", 2, "plain", [["continued", "y"]], None),
    ]
    got = {(r["job"], r["page_no"]): (r["source_page"], r["merged_rows"]) for r in pages.continuation(spark.createDataFrame(rows, s)).collect()}
    assert got == {
        ("j", 1): (None, [["a", "b"], ["c", "d"]]), ("j", 2): (1, [["a", "b"], ["c", "d"], ["e", "f"]]), ("j", 3): (2, [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"]]), ("j", 5): (None, [["i", "k"]]),
        ("k", 1): (None, [["x"]]), ("k", 2): (1, [["x"], ["y", "z"]]), ("k", 3): (2, [["last"], ["w"]]), ("k", 4): (None, None), ("k", 5): (None, [["v"]]), ("l", 1): (None, [["x"]]), ("l", 2): (None, [["continued", "y"]]),
    }


def test_model_regions_come_first(spark):
    from leafmill.operators import pipeline

    blocks = spark.createDataFrame([(p, i, f"b{p}-{i}", 0, 100 * i, 50, 100 * i + 10) for p in (1, 2) for i in range(3)], "page long, pos int, content string, x0 int, y0 int, x1 int, y1 int")
    none = spark.createDataFrame([], "page long, pos int, image string, x0 int, y0 int, x1 int, y1 int, search_eligible boolean, is_duplicate boolean")
    model = spark.createDataFrame([(1, 0, "whole", 0, 0, 100, 100, 0.9), (1, 1, "same", 0, 0, 100, 90, 0.8), (1, 2, "other", 200, 0, 300, 90, 0.7)], "page long, pos int, text string, x0 int, y0 int, x1 int, y1 int, confidence double")
    got = {(r["page"], r["boundary"]): r["text"] for r in pipeline.boundaries(blocks, none, model, 400, 400).collect()}
    assert got == {(1, 1): "whole", (1, 2): "other", (2, 1): "b2-0", (2, 2): "b2-1", (2, 3): "b2-2"}


def test_golden_set(spark):
    frame = lambda rows: spark.createDataFrame(rows, "page int, key string")
    got = feedback.golden_set(frame([(1, "A1"), (1, "A3"), (1, "")]), frame([(1, "A1"), (1, "A2"), (9, "Z")])).first()
    assert tuple(got) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert feedback.golden_set(frame([]), frame([])).first()["f1"] == 0.0


def test_drift_confusion_and_divergence(spark):
    s = "type string, ai_type string, human_type string, ai_confidence double, was_correct boolean"
    notes = spark.createDataFrame([("SKU_ATTRIBUTE_CORRECTION", None, None, 0.95, True)] * 10, s)
    assert feedback.drift(notes).first()["drift"] == pytest.approx(-0.05) and feedback.divergence(notes).first()["kl"] >= 0
    types = spark.createDataFrame([("PAGE_TYPE_CORRECTION", a, b, 0.0, True) for a, b, n in (("A", "A", 3), ("A", "B", 2), ("B", "B", 5)) for _ in range(n)], s)
    assert feedback.accuracy(feedback.confusion(types)).first()["accuracy"] == 0.8
    assert feedback.accuracy(feedback.confusion(notes)).first()["accuracy"] == 1.0


def test_impact(spark):
    jobs = spark.createDataFrame([(s,) for s in (0.90, 0.85, 0.80, 0.50, 0.40, 0.30, None)], "score double")
    r = feedback.impact(jobs, (0.85, 0.45), (0.80, 0.40)).first()
    assert r["n"] == 6 and (r["current_auto"], r["projected_auto"]) == (pytest.approx(2 / 6, abs=1e-6), 0.5) and r["projected_reject"] == pytest.approx(1 / 6, abs=1e-6)


def test_transitions(spark):
    log = spark.createDataFrame([(1, 1, "CREATED"), (1, 2, "PROCESSING"), (1, 3, "COMPLETED"), (1, 4, "CREATED"), (1, 5, "COMPLETED"), (1, 6, "PROCESSING")], "entity int, seq int, status string")
    got = tasks.audit(log, tasks.transitions(spark)).orderBy("seq").collect()
    assert [r["allowed"] for r in got] == [True, True, True, False, False]


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = {tuple(r) for r in rel.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()}
    assert got == {(1, "a", "keep"), (2, "c", "update"), (3, "d", "insert")}


def test_nested_children_default_to_none(spark):
    got = rel.nested(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string"), "k", ["v"], "c")
    assert {r["k"]: len(r["c"]) for r in got.collect()} == {1: 1, 2: 0}


def test_file_checks(spark):
    df = spark.createDataFrame([(b"%PDF-1.7 x", 3), (b"PK", 3), (b"", 0), (b"%PDF-1 /JavaScript", 2000), (b"%PDF-1 /JS", 3), (b"%PDF-1 trailer << /Size 12 >> x /Size 500001", 3)], "c binary, n int")
    got = [r[0] for r in df.select(readers.file_issues(F.col("c"), F.col("n"))).collect()]
    assert got == [[], ["not_pdf"], ["empty_file", "not_pdf", "no_pages"], ["too_many_pages", "javascript_embedded"], ["javascript_embedded"], ["object_count_exceeded"]]


def test_import_policy(spark):
    codes = [200, 201, 202, 203, 302, 404, 408, 409, 429, 500, 503, None]
    df = spark.createDataFrame([(c,) for c in codes], "c int")
    got = [r[0] for r in df.select(sinks.import_policy(F.col("c"))).collect()]
    assert got == ["confirmed", "confirmed", "assumed", "retry", "retry", "data_error", "data_error", "retry", "retry", "retry", "retry", "retry"]


@pytest.mark.parametrize(
    ("answers", "want"),
    [
        ([200], ("confirmed", 1, 0)), ([503, 202], ("assumed", 2, 2)), ([409, 409, 409, 409], ("server_error", 4, 7)), ([429, 429, 429, 429], ("server_error", 4, 510)),
        ([None, 404], ("data_error", 2, 2)), ([500, 429, 201], ("confirmed", 3, 62)), ([], ("server_error", 4, 14)),
    ],
)
def test_import_retries(spark, answers, want):
    df = spark.createDataFrame([(answers,)], "a array<int>")
    assert tuple(df.select(sinks.import_replay(F.col("a")).alias("r")).first()["r"]) == want


def test_providers_in_order(spark):
    df = spark.createDataFrame([({"a": 1},), ({"b": 0},), ({"a": 3, "b": 2},), ({},)], "answers map<string,int>")
    got = [tuple(r) for r in series.provider_chain(df, ["a", "b"]).select("provider", "attempts", "waited").collect()]
    assert got == [("a", 2, 3), ("b", 4, 9), ("b", 6, 18), (None, 6, 18)]


class FakeRect:
    width, height, x0, y0, x1, y1 = 100.0, 200.0, 1.0, 2.0, 3.0, 4.0


def fake_libraries(monkeypatch, words, images, text):
    import sys
    import types

    class Page:
        width, height, rect = 100.0, 200.0, FakeRect()

        def extract_words(self):
            return words

        def extract_tables(self):
            return [[["Name", None], ["a", "b"]], []]

        def extract_text(self):
            return " ".join(w["text"] for w in words)

        def get_images(self, full):
            return [(7, 0)] * len(images)

        def get_image_rects(self, xref):
            return [FakeRect()]

        def get_text(self, kind, **_):
            return text if kind == "text" else {"blocks": [{"type": 0, "lines": [{"spans": [{"text": text, "bbox": (0, 0, 9, 9), "size": 8}]}]}, {"type": 1}]}

    class Doc(list):
        page_count = property(len)
        pages = property(lambda self: self)

        def extract_image(self, xref):
            return {"width": 640, "height": 480, "image": b"png"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    Page.images = images
    opened = Doc([Page()])
    for name in ("fitz", "pdfplumber"):
        module = types.ModuleType(name)
        module.open = lambda *a, **k: opened
        monkeypatch.setitem(sys.modules, name, module)


def test_pages_are_read_by_the_first_backend_that_suffices(monkeypatch):
    word = {"text": "w" * 3000, "x0": 1, "top": 2, "x1": 3, "bottom": 4}
    fake_libraries(monkeypatch, [word], [{"x0": 0, "top": 0, "x1": 50, "bottom": 60}], "t")
    got = readers.scan_page(b"x", 1)
    assert (got["backend"], got["text_coverage"], got["tables"]) == ("words", 0.15, [{"rows": [["Name", ""], ["a", "b"]]}])
    assert (got["images"][0]["width"], got["images"][0]["x1"], len(got["images"][0]["hash"])) == (640, 50.0, 12)
    fake_libraries(monkeypatch, [], [], "t" * 5000)
    assert readers.scan_page(b"x", 1)["backend"] == "spans" and readers.scan_page(b"x", 1)["blocks"][0]["font_size"] == 8.0
    fake_libraries(monkeypatch, [], [], "little")
    got = readers.scan_page(b"x", 1)
    assert (got["backend"], got["blocks"][0]["x1"], got["blocks"][0]["content"]) == ("text", 100.0, "little")
    assert readers.scan_page(b"x", 2)["error"].startswith("IndexError")


def test_files_without_a_parser_give_their_error(spark):
    got = readers.scan_pdf(spark.createDataFrame([("a.pdf", b"%PDF-1.7")], "path string, content binary")).collect()
    assert len(got) == 1 and "No module" in got[0]["error"]


def test_files_and_tables_round_trip(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 abc")
    got = readers.files(spark, str(tmp_path / "a.pdf")).select(hashing.file_hash(F.col("content"))).first()[0]
    import hashlib

    assert got == hashlib.sha256(b"%PDF-1.7 abc").hexdigest()
    sinks.write_tables({"t": spark.range(5)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/t")).count() == 5


def test_fan_out_isolates_failures(spark, tmp_path):
    from leafmill.streaming.jobs import fan_out

    spark.range(7).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    seen = []

    def bad(batch, epoch):
        raise ValueError("broken handler")

    errors = fan_out(stream, {"bad": bad, "good": lambda batch, epoch: seen.append(batch.count())}, str(tmp_path / "cp"))
    assert sum(seen) == 7 and "broken handler" in errors["bad"]
