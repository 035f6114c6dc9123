"""Scans, keyed writes, joins, sets and sorts."""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matching(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows equal to each filter: a list means membership, None means null. Unknown columns raise."""
    for name, value in filters.items():
        if name not in df.columns:
            raise KeyError(name)
        c = df[name]
        if value is None:
            df = df.where(c.isNull())
        elif isinstance(value, (list, tuple, set)):
            df = df.where(c.isin(list(value)))
        else:
            df = df.where(c == F.lit(value))
    return df


def page_of(df: DataFrame, order: Sequence[Column | str], skip: int = 0, limit: int = 200, filters: Mapping[str, object] | None = None) -> DataFrame:
    """A page of the matching rows in a total order; a bounded top-k, not a sort of all rows."""
    return matching(df, filters or {}).orderBy(*order).offset(skip).limit(limit)


def only(df: DataFrame) -> DataFrame:
    """``df``, with an error when it is evaluated with more than one row."""
    n = F.count("*").over(Window.partitionBy())
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.lit("more than one row"))).otherwise(n)).where("_n >= 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """``base`` with rows of ``changes`` put in by key; the highest ``version`` of a key's changes wins.

    Base rows without a change pass through a left anti join; they are neither sorted nor grouped.
    """
    if version:
        top = F.max_by(F.struct(*changes.columns), version).alias("_r")
        changes = changes.groupBy(*keys).agg(top).select("_r.*")
    return base.join(changes, list(keys), "left_anti").unionByName(changes.select(*base.columns))


def update_by_key(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the non-null values of the other columns of ``changes`` (one row a key)."""
    sent = [c for c in changes.columns if c not in keys]
    named = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in sent))
    out = base.join(named, list(keys), "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in sent else F.col(c) for c in base.columns))


def insert_missing(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and those rows of ``new`` whose key it lacks; first by all columns when ``new`` repeats a key."""
    fresh = new.join(base, list(keys), "left_anti")
    fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    return base.unionByName(fresh.select(*base.columns))


def replace_where(base: DataFrame, condition: Column, rows: DataFrame) -> DataFrame:
    """Deletes what the condition holds for, then inserts: running it again changes nothing."""
    return base.where(~F.coalesce(condition, F.lit(False))).unionByName(rows.select(*base.columns))


def without_keys(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone, list(keys), "left_anti")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as a sorted array of structs, empty where there are none."""
    fields = [*order, *(c for c in children.columns if c not in order and c != key)]
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = parents.join(nested, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def first_lookup(df: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str], str]], name: str) -> DataFrame:
    """The value of the first lookup (frame, key columns, value column) that has one for a row's keys."""
    found = []
    for i, (table, keys, value) in enumerate(lookups):
        side = table.select(*keys, F.col(value).alias(f"_v{i}"))
        df = df.join(side, list(keys), "left")
        found.append(F.col(f"_v{i}"))
    return df.withColumn(name, F.coalesce(*found)).drop(*(f"_v{i}" for i in range(len(found))))


def unpivoted(df: DataFrame, keys: Sequence[str], fields: Iterable[str]) -> DataFrame:
    """(keys, path, value as text) rows; a null value keeps its row."""
    pairs = F.array(*(F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.path", "_p.value")


def field_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields that were added, removed or changed between two snapshots, by key and path."""
    a = unpivoted(old, keys, fields).withColumnRenamed("value", "old")
    b = unpivoted(new, keys, fields).withColumnRenamed("value", "new")
    out = a.join(b, [*keys, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return out.withColumn("change", kind)


def zipped(df: DataFrame, keys: Sequence[str], one: str, two: str) -> DataFrame:
    """Elements of two array columns paired by position, the shorter padded with null."""
    pairs = F.posexplode(F.arrays_zip(F.col(one).alias("a"), F.col(two).alias("b")))
    return df.select(*keys, pairs.alias("pos", "_z")).select(*keys, "pos", F.col("_z.a").alias(one), F.col("_z.b").alias(two))


def missing_required(df: DataFrame, key: str, value: str, required: Sequence[str]) -> DataFrame:
    """For each key, the required values that it has no row for."""
    need = F.array(*(F.lit(x) for x in required))
    return df.groupBy(key).agg(F.array_sort(F.array_except(need, F.collect_set(value))).alias("missing")).where(F.size("missing") > 0)


def in_intervals(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined to all spans of their key with start <= at <= end.

    Bins are ``width`` wide, or that doubled until a span lies in two at most, so long spans take no more rows than short ones. The
    join is an equi-join on key, doublings and bin; points look at the doublings only that spans of their key have.
    """
    length = (F.col(end) - F.col(start)).cast("double")
    doubled = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0)) / width))).cast("int").alias("_doubled")
    bin_of = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), "_doubled")))
    binned = spans.where(F.col(start) <= F.col(end)).select("*", doubled).withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    scales = spans.where(F.col(start) <= F.col(end)).select(key, doubled).groupBy(key).agg(F.collect_set("_doubled").alias("_scales"))
    dealt = points.join(scales, key).withColumn("_doubled", F.explode("_scales")).drop("_scales").withColumn("_bin", bin_of(at))
    return dealt.join(binned, [key, "_doubled", "_bin"]).where(
        (F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))
    ).drop("_doubled", "_bin")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def merged_rankings(one: DataFrame, two: DataFrame, key: str, score: str, bonus: float = 0.1) -> DataFrame:
    """Union of two scored sets by key; a key in both has the higher score and a bonus, and source ``both``."""
    a = one.select(key, F.col(score).alias("_a"))
    b = two.select(key, F.col(score).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = a.join(b, key, "full_outer")
    source = F.when(both, "both").when(F.col("_a").isNotNull(), "one").otherwise("two")
    return out.select(key, source.alias("source"), (F.greatest("_a", "_b") + F.when(both, bonus).otherwise(0.0)).alias(score))
