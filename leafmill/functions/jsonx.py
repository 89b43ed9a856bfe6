"""JSON: tolerant parsing, canonical forms and key access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_levels(text: Column) -> tuple[Column, Column]:
    """(json, level): 1 the text itself, 2 a fenced block, 3 the outermost brackets, 4 nothing; null
    and 0 for blank text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1)
    listed = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    nested = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # Any JSON value counts, a plain number or string too; no text at all is none.
    ok = lambda c: F.when((F.length(F.trim(c)) > 0) & F.try_parse_json(c).isNotNull(), F.trim(c))
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    found = F.coalesce(ok(text), ok(fenced), ok(listed), ok(nested))
    level = F.when(blank, 0).when(ok(text).isNotNull(), 1).when(ok(fenced).isNotNull(), 2).when(ok(listed).isNotNull() | ok(nested).isNotNull(), 3).otherwise(4)
    return found, level


def score_or(text: Column, default: float = 0.5) -> Column:
    return F.coalesce(F.get_json_object(text, "$.score").try_cast("double"), F.lit(default))


def canonical(payload: Column, without: tuple[str, ...] = ()) -> Column:
    """A map as JSON with sorted keys, some left out."""
    kept = F.map_filter(payload, lambda k, v: ~k.isin(*without)) if without else payload
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def payload_hash(payload: Column, without: tuple[str, ...] = ("timestamp", "annotator_id")) -> Column:
    return F.substring(F.sha2(canonical(payload, without).cast("binary"), 256), 1, 16)


def merged(*maps: Column) -> Column:
    """Maps merged so that later ones win, whatever the session's policy on repeated keys."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_except(out, m), m)
    return out


def _except(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))


def changed(old: Column, new: Column) -> Column:
    """{key: {old, new}} of the keys whose values differ."""
    both = F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(both, lambda _, v: ~v["old"].eqNullSafe(v["new"]))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def index_pairs(text: Column) -> Column:
    """array<struct<sku_index, image_index>> of an answer that holds ``[[i, j], ...]`` or a list of objects
    with these keys, text around it or not; null if it cannot be read.  Entries of another kind, or of
    one number, are left out; a missing index is -1."""
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    pairs = F.from_json(body, "array<array<bigint>>", {"mode": "PERMISSIVE"})
    objects = F.from_json(body, "array<struct<sku_index:bigint,image_index:bigint>>", {"mode": "PERMISSIVE"})
    entry = lambda i, j: F.struct(i.alias("sku_index"), j.alias("image_index"))
    lists = F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: entry(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    named = F.transform(F.filter(objects, lambda o: o.isNotNull()), lambda o: entry(F.coalesce(o["sku_index"], F.lit(-1)), F.coalesce(o["image_index"], F.lit(-1))))
    return F.when(body.rlike(r"^\[\s*\["), lists).when(body.rlike(r"^\[\s*\{"), named)


def projected(df: DataFrame, fields: list[str]) -> Column:
    """The whitelisted fields that the frame has as JSON, nulls kept, in the order given."""
    return F.to_json(F.struct(*[F.col(f) for f in fields if f in df.columns]), {"ignoreNullFields": "false"})
