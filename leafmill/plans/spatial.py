"""Boxes: pairs, components, bindings, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import binding as bd
from ..sources import bindings as b
from .flagship import bind_sql
from .registry import query

_IOU = """CASE WHEN (a.x1-a.x0)*(a.y1-a.y0) + (c.x1-c.x0)*(c.y1-c.y0) - i > 0 THEN i / ((a.x1-a.x0)*(a.y1-a.y0) + (c.x1-c.x0)*(c.y1-c.y0) - i) ELSE 0 END"""
_MEET = "greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0))"
_PAIRS = f"""pairs AS (SELECT a.page, a.pos AS a, c.pos AS b, round({_IOU.replace(' i', ' ' + _MEET)}, 6) AS iou,
  round({_MEET} / greatest(1, least((a.x1-a.x0)*(a.y1-a.y0), (c.x1-c.x0)*(c.y1-c.y0))), 6) AS share FROM images a JOIN images c ON a.page = c.page AND a.pos < c.pos)"""


@query(f"WITH {b.LINES}, {b.IMAGES}, {_PAIRS} SELECT page, a, b, iou FROM pairs WHERE iou > 0")
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return bd.box_pairs(b.images(spark, sf)).where("iou > 0").select("page", "a", "b", "iou")


@query(f"WITH {b.LINES}, {b.IMAGES}, {_PAIRS} SELECT page, a, b, share FROM pairs WHERE share > 0.5")
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return bd.box_pairs(b.images(spark, sf)).where("share > 0.5").select("page", "a", "b", "share")


@query(f"""WITH {b.LINES}, {b.IMAGES} SELECT page, pos FROM images a WHERE NOT EXISTS (SELECT 1 FROM images c WHERE a.page = c.page AND a.pos <> c.pos
  AND ((a.x1-a.x0)*(a.y1-a.y0) > (c.x1-c.x0)*(c.y1-c.y0) OR ((a.x1-a.x0)*(a.y1-a.y0) = (c.x1-c.x0)*(c.y1-c.y0) AND a.pos > c.pos))
  AND {_MEET} / ((c.x1-c.x0)*(c.y1-c.y0)) > 0.8)""")
def containment_drop(spark: SparkSession, sf: str) -> DataFrame:
    return bd.drop_containers(b.images(spark, sf)).select("page", "pos")


_EDGE = "greatest(CASE WHEN width <> 0 AND height <> 0 THEN least(width, height) ELSE 0 END, CAST(floor(least(x1 - x0, y1 - y0) * 150 / 72) AS INTEGER))"


@query(f"""WITH {b.LINES}, {b.IMAGES} SELECT image, hash <> '' AND row_number() OVER (PARTITION BY page, hash ORDER BY width * height DESC, pos) > 1 AS is_duplicate, {_EDGE} AS short_edge FROM images""")
def hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return bd.hash_dedup(bd.image_metrics(b.images(spark, sf))).select("image", "is_duplicate", "short_edge")


@query()
def overlap_dedup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Order-dependent: tested against a plain simulation, and in SQL as part of ``page_results``."""
    return bd.overlap_dedup(b.images(spark, sf), 0.5)


_NEAR = "greatest(a.x0, c.x0) - least(a.x1, c.x1) < 60 AND greatest(a.y0, c.y0) - least(a.y1, c.y1) < 60"


@query(f"""WITH RECURSIVE {b.LINES}, {b.IMAGES}, e AS (SELECT a.page, a.pos AS p, c.pos AS q FROM images a JOIN images c ON a.page = c.page AND {_NEAR}),
reach AS (SELECT page, pos AS p, pos AS q FROM images UNION SELECT reach.page, reach.p, e.q FROM reach JOIN e ON reach.page = e.page AND reach.q = e.p)
SELECT page, p AS pos, min(q) AS component FROM reach GROUP BY page, p""")
def tile_components(spark: SparkSession, sf: str) -> DataFrame:
    return bd.tile_components(b.images(spark, sf), gap=60)


@query(f"""WITH RECURSIVE {b.LINES}, {b.IMAGES}, e AS (SELECT a.page, a.pos AS p, c.pos AS q FROM images a JOIN images c ON a.page = c.page AND {_NEAR}),
reach AS (SELECT page, pos AS p, pos AS q FROM images UNION SELECT reach.page, reach.p, e.q FROM reach JOIN e ON reach.page = e.page AND reach.q = e.p),
k AS (SELECT page, p AS pos, min(q) AS component FROM reach GROUP BY page, p)
SELECT page, component, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM images JOIN k USING (page, pos) GROUP BY page, component""")
def tile_composites(spark: SparkSession, sf: str) -> DataFrame:
    i = b.images(spark, sf)
    return bd.composites(i, bd.tile_components(i, gap=60))


_SHAPED = "shaped AS (SELECT *, CASE page % 4 WHEN 0 THEN 'grid' WHEN 1 THEN 'table' WHEN 2 THEN 'freeform' ELSE 'other' END AS layout FROM skus)"


def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page") % 4
    return b.skus(spark, sf).withColumn("layout", F.when(p == 0, "grid").when(p == 1, "table").when(p == 2, "freeform").otherwise("other"))


def _cand(s: str) -> str:
    """Distance candidates and choice of the records in the relation ``s``."""
    return f"""
pr AS (SELECT s.page, s.pos, s.sku, s.product, i.image, i.pos AS i_pos, s.layout,
    sqrt(((s.x0+s.x1)/2 - (i.x0+i.x1)/2) * ((s.x0+s.x1)/2 - (i.x0+i.x1)/2) + ((s.y0+s.y1)/2 - (i.y0+i.y1)/2) * ((s.y0+s.y1)/2 - (i.y0+i.y1)/2)) AS d,
    abs((s.x0+s.x1)/2 - (i.x0+i.x1)/2) AS dx, abs((s.y0+s.y1)/2 - (i.y0+i.y1)/2) AS dy,
    CASE layout WHEN 'grid' THEN 300.0::DOUBLE WHEN 'table' THEN 400.0 WHEN 'freeform' THEN 500.0 ELSE 150.0 END AS lim,
    (i.x1-i.x0)*(i.y1-i.y0) AS ia, max((i.x1-i.x0)*(i.y1-i.y0)) OVER (PARTITION BY s.page) AS ma,
    greatest(0, least(s.x1, i.x1) - greatest(s.x0, i.x0)) * greatest(0, least(s.y1, i.y1) - greatest(s.y0, i.y0)) / ((i.x1-i.x0)*(i.y1-i.y0)) AS ins
  FROM {s} s JOIN images i ON s.page = i.page),
nr AS (SELECT page, pos, sku, product, image, i_pos, {b.rounded("least(1.0::DOUBLE, (CASE WHEN ins > 0.5 THEN least(1.0::DOUBLE, greatest(0.01::DOUBLE, 1 - d / lim) + 0.3::DOUBLE) ELSE greatest(0.01::DOUBLE, 1 - d / lim) END) + ia / greatest(1, ma) * 0.15::DOUBLE)", 3)} AS confidence,
    CASE WHEN layout = 'grid' THEN 'grid_alignment' WHEN dx < 50 AND dy > 100 THEN 'vertical_stack' WHEN dy < 50 AND dx > 100 THEN 'reading_order' ELSE 'spatial_proximity' END AS method
  FROM pr WHERE d <= lim),
fr AS (SELECT page, pos, sku, product, image, i_pos, {b.rounded("greatest(0.01::DOUBLE, 1 - d / (lim * 3)) * 0.5::DOUBLE", 3)} AS confidence, 'fallback_nearest' AS method FROM pr
  WHERE d <= 3 * lim AND NOT EXISTS (SELECT 1 FROM nr WHERE nr.page = pr.page AND nr.sku = pr.sku) QUALIFY row_number() OVER (PARTITION BY page, sku ORDER BY d, i_pos) = 1),
cd AS (SELECT * FROM nr UNION ALL SELECT * FROM fr)"""


@query(f"""WITH {b.SKUS}, {b.IMAGES}, {_SHAPED}, nz AS (SELECT * FROM shaped WHERE x1 > 0), {_cand("nz")}
SELECT page, sku, image, confidence, method, CAST(row_number() OVER (PARTITION BY page, sku ORDER BY confidence DESC, i_pos) AS INTEGER) AS rank FROM cd
QUALIFY row_number() OVER (PARTITION BY page, sku ORDER BY confidence DESC, i_pos) <= 3""")
def nearest_binding_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = bd.candidates(_shaped(spark, sf).where("x1 > 0"), b.images(spark, sf))
    return found.where("rank <= 3").select("page", "sku", "image", "confidence", "method", "rank")


def _positional(s: str) -> str:
    return f"""ps AS (SELECT page, pos, sku, product, row_number() OVER (PARTITION BY page ORDER BY pos) AS n, count(*) OVER (PARTITION BY page) AS n_skus FROM {s}),
pi AS (SELECT page, image, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, pos) AS n, count(*) OVER (PARTITION BY page) AS total, row_number() OVER (PARTITION BY page ORDER BY (x1-x0)*(y1-y0) DESC, pos) AS k FROM images),
po AS (SELECT ps.page, pos, sku, product, coalesce(o.image, l.image) AS image, CASE WHEN o.image IS NOT NULL THEN 0.55 WHEN l.image IS NOT NULL THEN 0.35 ELSE 0 END AS confidence,
  CASE WHEN o.image IS NOT NULL THEN 'zero_bbox_positional' WHEN l.image IS NOT NULL THEN 'zero_bbox_largest' ELSE 'spatial_proximity' END AS method,
  CASE WHEN l.image IS NULL THEN false WHEN o.image IS NOT NULL THEN l.total <> n_skus ELSE true END AS ambiguous
  FROM ps LEFT JOIN pi o ON ps.page = o.page AND ps.n = o.n LEFT JOIN pi l ON ps.page = l.page AND l.k = 1)"""


@query(f"WITH {b.SKUS}, {b.IMAGES}, z AS (SELECT * FROM skus WHERE x1 = 0), {_positional('z')} SELECT sku, image, CAST(confidence AS DOUBLE) AS confidence, method, ambiguous FROM po")
def zero_bbox_positional(spark: SparkSession, sf: str) -> DataFrame:
    return bd.positional(b.skus(spark, sf).where("x1 = 0"), b.images(spark, sf)).select("sku", "image", "confidence", "method", "ambiguous")


_INHERIT = """SELECT sku, CASE WHEN takes THEN bi ELSE image END AS image, CASE WHEN takes THEN bc * 0.9::DOUBLE ELSE confidence END AS confidence, CASE WHEN takes THEN 'product_group' ELSE method END AS method
FROM (SELECT *, image IS NULL AND product IS NOT NULL AND bi IS NOT NULL AS takes FROM (
  SELECT *, first(image) OVER w AS bi, first(confidence) OVER w AS bc FROM {0}
  WINDOW w AS (PARTITION BY page, product ORDER BY image IS NULL, confidence DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""


@query(f"WITH {b.SKUS}, s AS (SELECT page, pos, sku, product, CASE WHEN pos % 3 = 0 THEN NULL ELSE concat('i', page, '-', pos) END AS image, CASE WHEN pos % 3 = 0 THEN 0 ELSE confidence END AS confidence, 'x' AS method FROM skus) " + _INHERIT.format("s"))
def product_group_inherit(spark: SparkSession, sf: str) -> DataFrame:
    free = F.col("pos") % 3 == 0
    bound = b.skus(spark, sf).select(
        "page", "pos", "sku", "product", F.when(~free, F.concat(F.lit("i"), "page", F.lit("-"), "pos")).alias("image"),
        F.when(free, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.lit("x").alias("method"), F.lit(False).alias("ambiguous"),
    )
    return bd.inherit(bound).select("sku", "image", "confidence", "method")


@query(f"WITH {b.SKUS}, {b.IMAGES}, {_SHAPED}, {bind_sql('shaped', 'images')} SELECT sku, image, confidence, method, ambiguous FROM bound")
def bind_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return bd.bind(_shaped(spark, sf), b.images(spark, sf)).select("sku", "image", "confidence", "method", "ambiguous")


@query(f"""WITH {b.SKUS}, {b.IMAGES}, sc AS (SELECT s.page, s.pos AS block, i.image, i.pos AS ip, sqrt(((s.x0+s.x1)/2 - (i.x0+i.x1)/2) ** 2 + ((s.y0+s.y1)/2 - (i.y0+i.y1)/2) ** 2) AS d,
  greatest(0, least(s.x1, i.x1) - greatest(s.x0, i.x0)) / greatest(1, s.x1 - s.x0) > 0.3 AND s.y0 >= i.y0 AS below FROM skus s LEFT JOIN images i ON s.page = i.page WHERE s.x1 > 0),
r AS (SELECT *, CASE WHEN below THEN d * 0.3::DOUBLE ELSE d END AS raw FROM sc)
SELECT page, block, CASE WHEN raw <= 300 THEN image END AS image, round(raw, 4) AS score FROM r QUALIFY row_number() OVER (PARTITION BY page, block ORDER BY raw NULLS LAST, ip) = 1""")
def anchor_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return bd.anchors(b.skus(spark, sf).where("x1 > 0"), b.images(spark, sf)).select("page", "block", "image", "score")


@query(f"""WITH {b.SKUS}, k AS (SELECT page, sku, split_part(product_name, ' ', 1) AS kw FROM skus WHERE product_name IS NOT NULL),
t AS (SELECT page, product_name AS content, x0, y0, x1, y1 FROM skus WHERE product_name IS NOT NULL AND x1 > 0)
SELECT k.page, sku, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM k JOIN t ON k.page = t.page AND contains(content, kw) GROUP BY k.page, sku""")
def keyword_bbox_refine(spark: SparkSession, sf: str) -> DataFrame:
    s = b.skus(spark, sf).where(F.col("product_name").isNotNull())
    keyed = s.select("page", "sku", F.array(F.split_part("product_name", F.lit(" "), F.lit(1))).alias("keywords"))
    blocks = s.where("x1 > 0").select("page", F.col("product_name").alias("content"), "x0", "y0", "x1", "y1")
    return bd.refine_boxes(keyed, blocks)


@query(f"""WITH {b.SKUS}, j AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w > 30 THEN 1 ELSE 0 END AS j FROM skus WINDOW w AS (PARTITION BY page ORDER BY pos))
SELECT page, pos, CAST(sum(j) OVER (PARTITION BY page ORDER BY pos) AS BIGINT) AS grp FROM j""")
def ygap_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return bd.gap_groups(b.skus(spark, sf)).select("page", "pos", "grp")


_LASSO = [(100.0, 100.0), (900.0, 200.0), (700.0, 1200.0), (300.0, 700.0), (50.0, 1100.0)]


def _lasso_sql() -> str:
    terms = []
    for (xi, yi), (xj, yj) in zip(_LASSO, [_LASSO[-1], *_LASSO[:-1]], strict=True):
        terms.append(f"CASE WHEN ({yi} > y0) <> ({yj} > y0) AND x0 < ({xj} - {xi})::DOUBLE * (y0 - {yi}) / ({yj} - {yi}) + {xi} THEN 1 ELSE 0 END")
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query(f"WITH {b.SKUS} SELECT sku FROM skus WHERE {_lasso_sql()}")
def lasso_select(spark: SparkSession, sf: str) -> DataFrame:
    return b.skus(spark, sf).where(geo.in_polygon(F.col("x0"), F.col("y0"), _LASSO)).select("sku")


@query(f"WITH {b.SKUS}, {b.IMAGES} SELECT page, pos FROM skus WHERE (page, pos) NOT IN (SELECT page, pos FROM images)")
def ungrouped_elements(spark: SparkSession, sf: str) -> DataFrame:
    return b.skus(spark, sf).join(b.images(spark, sf), ["page", "pos"], "left_anti").select("page", "pos")


@query(f"""WITH {b.LINES}, {b.IMAGES}, s AS (SELECT page, width, height, count(*) AS n, sum(count(*)) OVER (PARTITION BY page) AS t FROM images GROUP BY 1, 2, 3)
SELECT page, width, height, round(n / t, 4) AS share, n / t >= 0.5 AS dominant FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, width, height) = 1""")
def dominant_tile(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent image size of each page, and whether half of its images have it."""
    from pyspark.sql.window import Window

    from ..operators.relational import latest

    n = b.images(spark, sf).groupBy("page", "width", "height").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("page"))
    n = n.withColumns({"share": F.round(share, 4), "dominant": share >= 0.5})
    return latest(n, ["page"], [F.desc("n"), F.col("width"), F.col("height")]).select("page", "width", "height", "share", "dominant")
