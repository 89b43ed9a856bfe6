"""Images and their binding to records: deduplication, tiles, spatial joins, the binding cascade.

Joins between boxes are equi-joins on the page with a residual predicate, so they shuffle by page and
compare only boxes of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..functions import jsonx
from ..functions.scoring import exact_round
from ..functions.vocab import DELIVERABLE_ROLES

# Distance limits by layout; 150 for others.
LIMITS = {"grid": 300.0, "table": 400.0, "list": 500.0, "freeform": 500.0, "single_product": 800.0}
OTHER_LIMIT = 150.0
GAP = 0.2
TOP = 3
# Fixed value: the method of records that no image was found for.
UNBOUND = "spatial_proximity"


def image_metrics(images: DataFrame, minimum: int = 200) -> DataFrame:
    """Adds ``short_edge``, the larger of the file's short side and that of the box as displayed, and
    whether it suffices for search.  A file without width or height counts 0; a zero box is not displayed."""
    native = F.when((F.col("width") != 0) & (F.col("height") != 0), F.least("width", "height")).otherwise(0)
    shown = F.floor(geo.to_pixels(F.least(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))))
    edge = F.greatest(F.coalesce(native, F.lit(0)), F.when(geo.is_zero(geo.box()), 0).otherwise(shown)).cast("int")
    return images.withColumn("short_edge", edge).withColumn("search_eligible", F.col("short_edge") >= minimum)


def hash_dedup(images: DataFrame) -> DataFrame:
    """Per page and hash the image of most pixels stays, the first of equals; adds is_duplicate.
    Images without a hash are nobody's duplicates."""
    w = Window.partitionBy("page", "hash").orderBy(F.desc(F.col("width") * F.col("height")), "pos")
    hashed = F.coalesce("hash", F.lit("")) != ""
    return images.withColumn("is_duplicate", hashed & (F.row_number().over(w) > 1))


def deliverable(images: DataFrame) -> DataFrame:
    return images.where(F.coalesce("role", F.lit("")).isin(*DELIVERABLE_ROLES) & ~F.col("is_duplicate"))


def box_pairs(boxes: DataFrame, key: str = "pos", extra: Column | None = None) -> DataFrame:
    """Pairs of one page's boxes, a before b, with IoU and overlap of the smaller box."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = (F.col("a.page") == F.col("b.page")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    if extra is not None:
        on = on & extra
    ba, bb = geo.box(of="a"), geo.box(of="b")
    return a.join(b, on).select(
        F.col("a.page").alias("page"), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"),
        F.round(geo.iou(ba, bb), 6).alias("iou"), F.round(geo.overlap_of_smaller(ba, bb), 6).alias("share"),
    )


def drop_containers(boxes: DataFrame, limit: float = 0.8) -> DataFrame:
    """Boxes that hold over ``limit`` of some smaller box of the page go (ties: the later one goes)."""
    a, b = boxes.alias("a"), boxes.alias("b")
    ba, bb = geo.box(of="a"), geo.box(of="b")
    bigger = (geo.area(ba) > geo.area(bb)) | ((geo.area(ba) == geo.area(bb)) & (F.col("a.pos") > F.col("b.pos")))
    on = (F.col("a.page") == F.col("b.page")) & (F.col("a.pos") != F.col("b.pos")) & bigger & (geo.overlap_of(ba, bb) > limit)
    return a.join(b, on, "left_anti")


def overlap_dedup(images: DataFrame, limit: float = 0.7) -> DataFrame:
    """``pos`` of the images of each page that others replace: in page order, each image that is still
    there is held against the later ones that are; of two that share over ``limit`` of the smaller box
    the one of fewer pixels goes, the later of equals.  Each step depends on those before, so a fold
    over one page's images."""
    cols = ("pos", "x0", "y0", "x1", "y1", "width", "height")
    grouped = images.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("b"))
    of = lambda s: geo.Box(s["x0"], s["y0"], s["x1"], s["y1"])
    pixels = lambda s: s["width"].cast("long") * s["height"]
    entry = lambda i: F.get(F.col("b"), i)

    def step(gone: Column, i: Column) -> Column:
        me = entry(i)
        near = lambda j: (j > i) & ~F.get(gone, j) & (geo.overlap_of_smaller(of(me), of(entry(j))) > limit)
        beaten = F.exists(F.sequence(F.lit(0), F.size("b") - 1), lambda j: near(j) & (pixels(entry(j)) > pixels(me)))
        after = F.transform(gone, lambda g, j: g | (near(j) & (pixels(entry(j)) <= pixels(me))) | ((j == i) & beaten))
        return F.when(F.get(gone, i), gone).otherwise(after)

    none = F.transform("b", lambda _: F.lit(False))
    gone = F.aggregate(F.sequence(F.lit(0), F.size("b") - 1), none, step)
    lost = F.filter(F.transform(gone, lambda g, i: F.when(g, entry(i)["pos"])), lambda v: v.isNotNull())
    return grouped.select("page", F.explode(lost).alias("pos"))


def deduplicated(images: DataFrame) -> DataFrame:
    """All images with metrics, ``is_duplicate`` and ``search_eligible`` after both deduplications; only
    images fit for search take part in the second."""
    first = hash_dedup(image_metrics(images)).withColumn("search_eligible", F.col("search_eligible") & ~F.col("is_duplicate"))
    lost = overlap_dedup(first.where("search_eligible")).withColumn("__lost", F.lit(True))
    out = first.join(lost, ["page", "pos"], "left").withColumn("__lost", F.coalesce("__lost", F.lit(False)))
    return out.withColumns({"is_duplicate": F.col("is_duplicate") | F.col("__lost"), "search_eligible": F.col("search_eligible") & ~F.col("__lost")}).drop("__lost")


def tile_components(boxes: DataFrame, gap: int = 5, gate: int = 1) -> DataFrame:
    """Components of a page's tiles that lie within ``gap`` of each other on both axes, as the least
    ``pos``; pages of fewer than ``gate`` boxes are left out.

    Labels are merged over the page's adjacent pairs, as a fold of the page's own arrays: pages are
    independent, nothing is shuffled per round, and only a pair that joins two components costs more
    than a comparison.
    """
    cols = ("pos", "x0", "y0", "x1", "y1")
    grouped = boxes.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("b")).where(F.size("b") >= gate)

    def near(p: Column, q: Column) -> Column:
        dx = F.greatest(p["x0"], q["x0"]) - F.least(p["x1"], q["x1"])
        dy = F.greatest(p["y0"], q["y0"]) - F.least(p["y1"], q["y1"])
        return (dx < gap) & (dy < gap)

    later = lambda p, i: F.filter(F.transform("b", lambda q, j: F.when((j > i) & near(p, q), j)), lambda j: j.isNotNull())
    adjacent = F.flatten(F.transform("b", lambda p, i: F.transform(later(p, i), lambda j: F.struct(i.alias("i"), j.alias("j")))))

    def merge(labels: Column, pair: Column) -> Column:
        a, b = F.get(labels, pair["i"]), F.get(labels, pair["j"])
        joined = F.transform(labels, lambda v: F.when(v == F.greatest(a, b), F.least(a, b)).otherwise(v))
        return F.when(a == b, labels).otherwise(joined)

    labels = F.aggregate(adjacent, F.transform("b", lambda _, i: i), merge)
    rows = grouped.select("page", "b", F.posexplode(labels).alias("i", "label"))
    return rows.select("page", F.get("b", F.col("i"))["pos"].alias("pos"), F.get("b", F.col("label"))["pos"].alias("component"))


def tile_pages(images: DataFrame, gate: int = 30, small: float = 0.7, many: int = 50, alike: float = 0.5) -> DataFrame:
    """``page`` of the pages made of tiles: ``gate`` images at least, of which a share of ``small`` has a
    short side below 200; or over ``many``, of which a share of ``alike`` has one and the same size."""
    tiny = F.count_if((F.least("width", "height") < 200) & (F.col("width") > 0))
    sized = (F.col("width") != 0) & (F.col("height") != 0)
    sizes = images.groupBy("page", F.when(sized, F.struct("width", "height")).alias("dims")).agg(F.count("*").alias("n"), tiny.alias("tiny"))
    known = F.col("dims").isNotNull()
    g = sizes.groupBy("page").agg(F.sum("n").alias("n"), F.sum("tiny").alias("tiny"), F.max(F.when(known, F.col("n"))).alias("most"), F.sum(F.when(known, F.col("n"))).alias("sized"))
    uniform = (F.col("n") > many) & (F.col("most") >= alike * F.col("sized"))
    return g.where((F.col("n") >= gate) & ((F.col("tiny") >= small * F.col("n")) | F.coalesce(uniform, F.lit(False)))).select("page")


def merge_tiles(images: DataFrame, gap: int = 5, minimum: int = 200) -> DataFrame:
    """``images`` (as from :func:`deduplicated`) with the tiles of tile pages joined: every component of
    several adjacent tiles gives a composite image of their union box, numbered from 0 within the page
    by its first tile; the tiles themselves, single ones too, are marked ``is_fragmented`` and are no
    longer fit for search.  Composites come after the page's images (``pos``)."""
    tiled = images.join(tile_pages(images), "page", "left_semi")
    parts = tiled.join(tile_components(tiled, gap), ["page", "pos"])
    scale = lambda d: d * 150 / 72
    union = union_boxes(parts, "page", "component").where("n > 1")
    w = Window.partitionBy("page")
    union = union.withColumn("k", F.row_number().over(w.orderBy("component")) - 1)
    wide, high = F.floor(scale(F.col("x1") - F.col("x0"))).cast("int"), F.floor(scale(F.col("y1") - F.col("y0"))).cast("int")
    made = union.select(
        "page", (F.lit(1_000_000) + F.col("k")).cast("int").alias("pos"), F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_composite_"), F.col("k").cast("string")).alias("image"),
        "x0", "y0", "x1", "y1", wide.alias("width"), high.alias("height"), F.lit("").alias("hash"), F.lit("unknown").alias("role"), F.least(wide, high).alias("short_edge"),
        (F.least(wide, high) >= minimum).alias("search_eligible"), F.lit(False).alias("is_duplicate"), F.lit(False).alias("is_fragmented"),
    )
    flagged = images.join(parts.select("page", "pos", F.lit(True).alias("__f")), ["page", "pos"], "left").withColumn("is_fragmented", F.coalesce("__f", F.lit(False)))
    flagged = flagged.withColumn("search_eligible", F.col("search_eligible") & ~F.col("is_fragmented"))
    return flagged.select(*made.columns).unionByName(made)


def composites(boxes: DataFrame, components: DataFrame) -> DataFrame:
    """The union box of each component."""
    return boxes.join(components, ["page", "pos"]).groupBy("page", "component").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n")
    )


def method(layout: Column, a: geo.Box, b: geo.Box) -> Column:
    dx, dy = geo.centre_gap(a, b)
    dx, dy = F.abs(dx), F.abs(dy)
    return (
        F.when(layout == "grid", "grid_alignment")
        .when((dx < 50) & (dy > 100), "vertical_stack")
        .when((dy < 50) & (dx > 100), "reading_order")
        .otherwise("spatial_proximity")
    )


def distance_limit(layout: Column) -> Column:
    out = F.lit(OTHER_LIMIT)
    for name, value in LIMITS.items():
        out = F.when(layout == name, value).otherwise(out)
    return out


def pairs(skus: DataFrame, images: DataFrame) -> DataFrame:
    """Every record of a page with every image of the page, with what the choice depends on.  Both
    sides are ranked within their page first, so all that follows stays partitioned by the page.
    Records of pages without images have one row, without an image."""
    page = Window.partitionBy("page")
    zero = geo.is_zero(geo.box())
    s = skus.select(
        "page", "pos", "sku", "product", "layout", *[F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")], zero.alias("zero"),
        F.count("*").over(page).alias("n_skus"), F.sum(zero.cast("int")).over(page).alias("n_zero"), F.row_number().over(page.orderBy("pos")).alias("place"),
    )
    i = images.select(
        "page", "image", F.col("pos").alias("i_pos"), *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")],
        F.count("*").over(page).alias("images_here"), F.max(geo.area(geo.box())).over(page).alias("max_area"),
        F.row_number().over(page.orderBy(F.col("y0") + F.col("y1"), "pos")).alias("i_place"),
        F.row_number().over(page.orderBy(F.desc(geo.area(geo.box())), "pos")).alias("size_rank"),
        ((F.max("x1").over(page) - F.min("x0").over(page)) * (F.max("y1").over(page) - F.min("y0").over(page))).alias("span"),
    )
    sb, ib = geo.box("s_"), geo.box("i_")
    return s.join(i, "page", "left").withColumns(
        {
            "n_images": F.coalesce("images_here", F.lit(0)), "d": geo.distance(sb, ib), "limit": distance_limit(F.col("layout")), "s_area": geo.area(sb),
            "i_area": geo.area(ib), "inside": geo.overlap_of(sb, ib), "way": method(F.col("layout"), sb, ib),
        }
    )


def _scored(p: DataFrame) -> DataFrame:
    """Adds the confidence of near images (within the layout's limit) and of far ones (thrice that)."""
    conf = F.greatest(F.lit(0.01), 1 - F.col("d") / F.col("limit"))
    conf = F.when(F.col("inside") > 0.5, F.least(F.lit(1.0), conf + 0.3)).otherwise(conf)
    conf = exact_round(F.least(F.lit(1.0), conf + F.col("i_area") / F.greatest(F.lit(1), F.col("max_area")) * 0.15), 3)
    weak = exact_round(F.greatest(F.lit(0.01), 1 - F.col("d") / (F.col("limit") * 3)) * 0.5, 3)
    near = F.coalesce(F.col("d") <= F.col("limit"), F.lit(False))
    far = F.coalesce(F.col("d") <= 3 * F.col("limit"), F.lit(False)) & ~near
    return p.withColumns({"near": near, "far": far, "confidence": F.when(near, conf).otherwise(weak)})


def candidates(skus: DataFrame, images: DataFrame) -> DataFrame:
    """Each record's candidate images in order: those within the limit by confidence, or else the
    nearest one within three times the limit."""
    own = Window.partitionBy("page", "sku")
    p = _scored(pairs(skus, images)).withColumn("any_near", F.max("near").over(own))
    kept = p.where(F.col("near") | (F.col("far") & ~F.col("any_near")))
    rank = F.row_number().over(own.orderBy(F.when(F.col("near"), -F.col("confidence")).otherwise(F.col("d")), "i_pos"))
    kept = kept.withColumn("rank", rank).where(F.col("near") | (F.col("rank") == 1))
    return kept.select("page", "sku", "image", "confidence", F.when(F.col("near"), F.col("way")).otherwise("fallback_nearest").alias("method"), "rank")


def positional(skus: DataFrame, images: DataFrame) -> DataFrame:
    """Records without boxes take the images of their page in order (images from the top down);
    records left over take the largest image."""
    s = skus.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("pos")))
    top = Window.partitionBy("page")
    i = images.select(
        "page", "image",
        F.row_number().over(top.orderBy(F.col("y0") + F.col("y1"), "pos")).alias("n"),
        F.count("*").over(top).alias("n_images"),
        F.row_number().over(top.orderBy(F.desc(geo.area(geo.box())), "pos")).alias("size_rank"),
    )
    counted = s.withColumn("n_skus", F.count("*").over(Window.partitionBy("page")))
    largest = i.where("size_rank = 1").select("page", F.col("image").alias("largest"), F.col("n_images").alias("total"))
    joined = counted.join(i.select("page", "n", "image"), ["page", "n"], "left").join(largest, "page", "left")
    own = F.col("image").isNotNull()
    return joined.select(
        "page", "pos", "sku", "product",
        F.coalesce("image", "largest").alias("image"),
        F.when(own, 0.55).when(F.col("largest").isNotNull(), 0.35).otherwise(0.0).alias("confidence"),
        F.when(own, "zero_bbox_positional").when(F.col("largest").isNotNull(), "zero_bbox_largest").otherwise(UNBOUND).alias("method"),
        F.when(F.col("largest").isNull(), False).when(own, F.col("total") != F.col("n_skus")).otherwise(True).alias("ambiguous"),
    )


def inherit(bound: DataFrame) -> DataFrame:
    """Records of a product without an image take the best image of the product, at 0.9 of its
    confidence."""
    w = Window.partitionBy("page", "product").orderBy(F.col("image").isNull(), F.desc("confidence"), "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heir = F.col("image").isNull() & (F.coalesce("product", F.lit("")) != "")
    out = bound.withColumn("b_image", F.first("image").over(w)).withColumn("b_conf", F.first("confidence").over(w))
    takes = heir & F.col("b_image").isNotNull()
    return out.select(
        "page", "pos", "sku", "product",
        F.when(takes, F.col("b_image")).otherwise(F.col("image")).alias("image"),
        F.when(takes, F.col("b_conf") * 0.9).otherwise(F.col("confidence")).alias("confidence"),
        F.when(takes, "product_group").otherwise(F.col("method")).alias("method"),
        (F.col("ambiguous") & ~takes).alias("ambiguous"),
    )


def bind(skus: DataFrame, images: DataFrame) -> DataFrame:
    """The cascade, the first branch that applies to a page or record: a single record takes all
    images; a single image goes to all records; pages whose records all lack boxes bind by position;
    records without a box take the largest image; records that span the page take the largest image
    in them; else by distance, else nothing.  ``skus`` have a layout.

    One join by page; every branch marks its rows among the pairs and one rank per record picks.
    """
    p = _scored(pairs(skus, images))
    branch = (
        F.when((F.col("n_skus") == 1) & (F.col("n_images") >= 1), "single_sku")
        .when(F.col("n_images") == 1, "single_image")
        .when(F.col("n_skus") == F.col("n_zero"), "positional")
        .when(F.col("n_images") == 0, "none")
        .when(F.col("zero"), "largest")
        .when((F.col("span") > 0) & (F.col("s_area") > 0.85 * F.col("span")), "containment")
        .otherwise("distance")
    )
    p = p.withColumn("branch", branch)
    at = lambda *names: F.col("branch").isin(*names)
    own = Window.partitionBy("page", "sku")
    by_place = at("positional") & ((F.col("place") == F.col("i_place")) | ((F.col("place") > F.col("n_images")) & (F.col("size_rank") == 1)))
    held = at("containment") & (F.col("inside") > 0.5)
    # The lowest tier among a record's rows counts; rows of tier 9 stand for nothing found.
    tier = (
        F.when(at("single_sku", "single_image"), 1).when(by_place, 1).when(at("largest") & (F.col("size_rank") == 1), 1)
        .when(held, 1).when(at("containment", "distance") & F.col("near"), 2).when(at("containment", "distance") & F.col("far"), 3).otherwise(9)
    )
    p = p.withColumn("tier", tier).withColumn("best", F.min("tier").over(own)).where("tier = best")
    key = F.when(F.col("tier") == 1, -F.col("i_area").cast("double")).when(F.col("tier") == 2, -F.col("confidence")).otherwise(F.col("d"))
    order = own.orderBy(key, "i_pos")
    p = p.withColumns({"rank": F.row_number().over(order), "next": F.lead("confidence").over(order)}).where((F.col("rank") == 1) | at("single_sku"))
    one, two, nothing = F.col("tier") == 1, F.col("tier") == 2, F.col("tier") == 9
    close = two & F.coalesce(F.col("confidence") - F.col("next") < GAP, F.lit(False))
    left_over = F.col("place") > F.col("n_images")
    conf = (
        F.when(nothing, 0.0).when(at("single_sku"), 0.7).when(at("single_image"), 0.6).when(at("positional"), F.when(left_over, 0.35).otherwise(0.55)).when(at("largest"), 0.4)
        .when(one, 0.6).when(close, exact_round(F.col("confidence") * 0.7, 3)).otherwise(F.col("confidence"))
    )
    way = (
        F.when(nothing, UNBOUND).when(at("positional"), F.when(left_over, "zero_bbox_largest").otherwise("zero_bbox_positional")).when(at("single_sku"), "single_sku_all_images")
        .when(at("single_image"), "single_image_page").when(at("largest"), "zero_bbox_largest").when(one, "containment").when(two, F.col("way")).otherwise("fallback_nearest")
    )
    unsure = F.when(nothing, False).when(at("positional"), left_over | (F.col("n_images") != F.col("n_skus"))).otherwise(at("largest") | close)
    found = p.select("page", "pos", "sku", "product", F.when(~nothing, F.col("image")).alias("image"), conf.alias("confidence"), way.alias("method"), unsure.alias("ambiguous"))
    # Only pages bound by distance can have records without an image beside records with one.
    return inherit(found)


def anchors(blocks: DataFrame, images: DataFrame, limit: float = 300.0) -> DataFrame:
    """Each text block goes to its nearest image, the first of equally near ones; blocks below an image's
    top that it overlaps sideways count as much nearer.  Beyond ``limit`` a block is an orphan (null image)."""
    b = blocks.select("page", F.col("pos").alias("block"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    i = images.select("page", "image", F.col("pos").alias("i_pos"), *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")])
    bb, ib = geo.box("b_"), geo.box("i_")
    sideways = F.greatest(F.lit(0), F.least(bb.x1, ib.x1) - F.greatest(bb.x0, ib.x0)) / F.greatest(F.lit(1), bb.x1 - bb.x0)
    d = geo.distance(bb, ib)
    scored = b.join(i, "page", "left").withColumn("score", F.when((sideways > 0.3) & (bb.y0 >= ib.y0), d * 0.3).otherwise(d))
    first = F.row_number().over(Window.partitionBy("page", "block").orderBy(F.col("score").asc_nulls_last(), "i_pos"))
    best = scored.withColumn("n", first).where("n = 1")
    near = F.col("score") <= limit
    return best.select("page", "block", F.when(near, F.col("image")).alias("image"), F.when(near, F.col("i_pos")).alias("image_pos"), F.round("score", 4).alias("score"))


def gap_groups(blocks: DataFrame, gap: int = 30, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Blocks of a page in order: a new group begins where the vertical gap to the one before exceeds
    ``gap``.  Adds the group's number."""
    w = Window.partitionBy("page").orderBy(*order)
    jump = F.when(F.col("y0") - F.lag("y1").over(w) > gap, 1).otherwise(0)
    return blocks.withColumn("__j", jump).withColumn("grp", F.sum("__j").over(w)).drop("__j")


def union_boxes(grouped: DataFrame, *keys: str) -> DataFrame:
    return grouped.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n")
    )


def refine_boxes(skus: DataFrame, blocks: DataFrame) -> DataFrame:
    """The union of the boxes of those text blocks of the page that contain one of a record's
    ``keywords``; records without such a block have no row."""
    words = skus.select("page", "sku", F.filter("keywords", lambda k: F.length(k) > 0).alias("__k")).where(F.size("__k") > 0)
    joined = words.join(blocks, "page").where(F.exists("__k", lambda k: F.contains(F.col("content"), k)))
    return union_boxes(joined, "page", "sku")


def model_rebind(skus: DataFrame, images: DataFrame, answers: DataFrame, bindings: DataFrame, batch: int = 15, share: float = 0.5) -> DataFrame:
    """``bindings`` with those of a model's answers instead, where it gave enough of them.

    Records of a page (by ``pos``) are asked for in batches; ``answers`` (page, batch from 0, text) hold
    pairs of indices into the batch's records and the page's ``images`` (by ``pos``).  A batch counts if it
    binds ``share`` of its records at least, and a page of several batches if all of them together do.
    Records that the model left out keep their bindings.
    """
    page = Window.partitionBy("page")
    s = skus.select("page", "pos", "sku", "product", (F.row_number().over(page.orderBy("pos")) - 1).alias("__i"), F.count("*").over(page).alias("__n"))
    s = s.withColumns({"batch": F.floor(F.col("__i") / batch).cast("int"), "sku_index": F.col("__i") % batch})
    s = s.withColumn("__held", F.count("*").over(Window.partitionBy("page", "batch")))
    i = images.select("page", "image", (F.row_number().over(page.orderBy("pos")) - 1).alias("image_index"))
    said = answers.select("page", "batch", F.posexplode(jsonx.index_pairs(F.col("text"))).alias("__at", "__p")).select("page", "batch", "__at", "__p.*")
    found = said.join(s, ["page", "batch", "sku_index"]).join(i, ["page", "image_index"])
    found = found.withColumn("__got", F.count("*").over(Window.partitionBy("page", "batch"))).where(F.col("__got") >= share * F.col("__held"))
    found = found.withColumn("__all", F.count("*").over(page)).where((F.col("__n") <= batch) | (F.col("__all") >= share * F.col("__n")))
    new = found.select("page", "pos", "sku", "product", "image", F.lit(0.85).alias("confidence"), F.lit("vlm_rebind").alias("method"), F.lit(False).alias("ambiguous"))
    kept = bindings.join(new.select("page", "sku").distinct(), ["page", "sku"], "left_anti")
    return new.unionByName(kept.select(*new.columns))
