"""Row-order operators: runs, islands, carried values, merged intervals."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def forward_filled(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last non-null value so far within a key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def runs(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: key, run (from 1), value, first and last of the first order column, n."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w))
    return numbered.groupBy(key, "run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def runs_absorbing(df: DataFrame, key: str, order: Sequence[str], value: str, trivial: Sequence[str]) -> DataFrame:
    """Runs in which trivial values lengthen the run before them, without joining equal neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    plain = ~F.col(value).isin(*trivial)
    starts = ((plain & ~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)).cast("int")
    numbered = df.withColumn("_c", starts).withColumn("run", F.sum("_c").over(w))
    return numbered.groupBy(key, "run").agg(F.min_by(value, order[0]).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def islands(df: DataFrame, key: str, at: str, gap: int = 1) -> DataFrame:
    """Islands of distinct values with steps of ``gap`` at most: key, island, first, last, n."""
    rows = df.select(key, at).distinct()
    w = Window.partitionBy(key).orderBy(at)
    numbered = rows.withColumn("_c", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))).withColumn("island", F.sum("_c").over(w))
    return numbered.groupBy(key, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def merged_intervals(df: DataFrame, key: str, start: str, end: str, gap: int = 1) -> DataFrame:
    """Overlapping or adjacent intervals joined: a new one starts beyond the highest end so far plus ``gap``."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    numbered = df.withColumn("_c", new).withColumn("part", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def label_sequence(df: DataFrame, key: str, order: Sequence[str], label: str, reach: int = 10) -> DataFrame:
    """Whether a row's letter follows the one before it by 1 to ``reach``."""
    step = F.ascii(F.col(label)) - F.ascii(F.lag(label).over(Window.partitionBy(key).orderBy(*order)))
    return df.withColumn("continues", F.coalesce(step.between(1, reach), F.lit(False)))


def dense_first_numbers(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Numbers for distinct values in the order of their first rows."""
    w = Window.partitionBy(key)
    first = F.row_number().over(Window.partitionBy(key, value).orderBy(*order)) == 1
    flagged = df.withColumn("_f", first.cast("int"))
    flagged = flagged.withColumn("_s", F.sum("_f").over(w.orderBy(*order)))
    number = F.min(F.when(F.col("_f") == 1, F.col("_s"))).over(Window.partitionBy(key, value))
    return flagged.withColumn("number", number).drop("_f", "_s")
