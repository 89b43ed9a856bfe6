"""General relational operators: optional filters, paging, latest versions, nesting, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def where_given(df: DataFrame, **equals: object) -> DataFrame:
    """A conjunction of equalities; those that are None are left out.  Lists mean membership."""
    for name, value in equals.items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(*value))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df


def one_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """Rows of one page, with the total number of rows and of pages.

    The total is a one-row aggregate of its own, joined to at most ``size`` rows.
    """
    total = df.agg(F.count("*").alias("total")).withColumn("n_pages", F.ceil(F.col("total") / size).cast("long"))
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.join(F.broadcast(total))


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The one row of a key; an error when there is none or more than one."""
    found = df.where(F.col(key) == value).limit(2).agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    wrong = F.raise_error(F.concat(F.lit(f"{key} {value}: rows found: "), F.col("n").cast("string")))
    kind = df.schema.simpleString()
    return found.select(F.when(F.col("n") == 1, F.col("row")).otherwise(wrong.cast(kind)).alias("row")).select("row.*")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def top_per(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def _by_slices(df: DataFrame, key: Sequence[str], slice_of: Column, measure: Column) -> DataFrame:
    """``df`` with ``__slice``, ``__before`` (``measure`` summed over the key's earlier slices) and
    ``__all`` (over all of them)."""
    cut = df.withColumn("__slice", slice_of)
    w = Window.partitionBy(*key)
    earlier = w.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*key, "__slice").agg(measure.alias("__m"))
    sums = sums.select(*key, "__slice", F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__before"), F.sum("__m").over(w).alias("__all"))
    return cut.join(sums, [*key, "__slice"])


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[Column], slice_of: Column, name: str = "place", total: str | None = None) -> DataFrame:
    """Row numbers within each key in a total ``order``, and on request the key's number of rows, for
    keys of any size: only the rows of one slice meet in a task.  Slices must not fall as the order
    goes on; neither they nor the key columns hold nulls."""
    got = _by_slices(df, key, slice_of, F.count("*"))
    own = F.row_number().over(Window.partitionBy(*key, "__slice").orderBy(*order))
    got = got.withColumn(name, own + F.col("__before"))
    return (got.withColumn(total, F.col("__all")) if total else got).drop("__slice", "__before", "__all")


def running_sum(df: DataFrame, key: Sequence[str], order: Sequence[Column], slice_of: Column, value: Column, name: str) -> DataFrame:
    """The sum of ``value`` up to each row, for keys of any size, as in :func:`numbered`."""
    got = _by_slices(df.withColumn(name, value), key, slice_of, F.sum(name))
    own = Window.partitionBy(*key, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn(name, F.sum(name).over(own) + F.col("__before")).drop("__slice", "__before", "__all")


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def nested(parent: DataFrame, child: DataFrame, key: str, fields: Sequence[str], name: str) -> DataFrame:
    """``parent`` with its children as a sorted array of structs, empty if there are none."""
    grouped = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = grouped.schema[name].dataType.simpleString()
    return parent.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MERGE: rows of ``new`` replace or join those of ``old``; ``action`` tells which."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__new"))
    o = old.withColumn("__old", F.lit(True))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "keep").otherwise("update")
    return o.join(n, list(keys), "full").select(*keys, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in cols], action.alias("action"))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Delete: rows whose key is not among those of ``gone``."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def versions(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """SCD-2: revision numbers and whether a row is its key's latest."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("revision", F.row_number().over(w)).withColumn("is_latest", F.lead(F.lit(1)).over(w).isNull())


def replaced_bindings(updates: DataFrame, parent: str, child: str, order: Sequence[Column]) -> DataFrame:
    """The table of bindings after all ``updates`` in order: every update takes the parent's next
    revision and becomes its latest; one to a child that the parent had before takes over that row."""
    w = Window.partitionBy(parent)
    n = updates.select(parent, child, F.row_number().over(w.orderBy(*order)).alias("n"), F.count("*").over(w).alias("last"))
    rows = n.groupBy(parent, child).agg(F.max("n").alias("revision"), F.max("last").alias("last"))
    return rows.select(parent, child, "revision", (F.col("revision") == F.col("last")).alias("is_latest"))


def merged_config(new: DataFrame, old: DataFrame, key: str, overrides: Sequence[str]) -> DataFrame:
    """Entries of ``new``; what ``old`` set for the same key wins; entries only in ``old`` go."""
    o = old.select(key, *[F.col(c).alias(f"__{c}") for c in overrides])
    return new.join(o, key, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in overrides}).drop(*[f"__{c}" for c in overrides])


def reordered(entries: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """Entries in the order of ``names``; those not named follow by key.  Adds ``position``."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(key))
    order = F.when(place > 0, place)
    return entries.withColumn("position", F.row_number().over(Window.orderBy(order.asc_nulls_last(), key)))
