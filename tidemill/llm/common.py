"""Helpers shared by the training-data operators."""
from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import ship as ship


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first columns of ``df`` with exactly these names, and nothing else.

    Selection is by position, so other columns whose names differ only in case, or repeat
    one of ``names``, neither make it ambiguous nor leak into a result.
    """
    at = [df.columns.index(name) for name in names]
    plain = df.toDF(*(f"_p{i}" for i in range(len(df.columns))))
    return plain.select(*(plain[f"_p{i}"].alias(name) for i, name in zip(at, names)))


def pin(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Where that is unset, a
    temporary one is made if the session runs in one process, as in tests; on a cluster, whose executors
    would each write to a folder of their own, it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not one_process(context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tidemill-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def one_process(master: str) -> bool:
    """Whether driver and executors of this master are one process."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit(seed: int, *parts: Column) -> Column:
    """A seeded random key: 32 hexadecimal digits that depend on the parts only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts)))


def bucket_of(key: Column, bits: int) -> Column:
    """The leading ``bits`` (a multiple of four) of a key of :func:`unit` as a number."""
    return F.conv(F.substring(key, 1, bits // 4), 16, 10).cast("bigint")


def words_in(text: Column) -> Column:
    """How many runs of characters other than space, tab, LF, VT, FF and CR a text has; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


#: Rows of a bucket, on average, at most, and the fewest buckets (as a power of two).
BUCKET, LEAST_BITS = 100_000, 12


def bits_for(rows: int) -> int:
    """How many leading bits make buckets of :data:`BUCKET` rows."""
    return max(LEAST_BITS, math.ceil(math.log2(max(1, rows) / BUCKET)))


def seat(seed: int, *parts: Column) -> Column:
    """A seeded random 60-bit place in a shuffle, from what tells rows apart."""
    return F.conv(F.substring(unit(seed, *parts), 1, 15), 16, 10).cast("bigint")


def seat_bucket(place: Column, bits: int) -> Column:
    return F.shiftright(place, 60 - bits)


#: Copies of a row that one task makes at a time.
COPIES = 1 << 13


def copied(groups: DataFrame, n: str, k: str) -> DataFrame:
    """Each row as often as its column ``n`` says, numbered from 1 in ``k``; runs of :data:`COPIES` copies are dealt over all tasks."""
    runs = groups.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1, F.lit(COPIES).cast("bigint"))))
    dealt = runs.repartition(width(groups.sparkSession), "_run", n)
    numbers = F.sequence(F.col("_run") + 1, F.least(F.col("_run") + COPIES, F.col(n).cast("bigint")))
    return dealt.withColumn(k, F.explode(numbers)).drop("_run")


def repeated(groups: DataFrame, n: str, k: str) -> DataFrame:
    """Like :func:`copied`, but rows with at most :data:`COPIES` copies stay where they are. ``groups`` is read twice."""
    few = groups.where(F.col(n) <= COPIES).withColumn(k, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n).cast("bigint"))))
    return few.unionByName(copied(groups.where(F.col(n) > COPIES), n, k))


def stratum(source: Column) -> Column:
    """A source as a key that is never null: no two sources share one, and null has its own after all others."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def shelved(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return their input's columns: hides all but the first doc_id, text, lang, source and n_chars.

    The others get names that nothing uses while the operator runs, whatever they were called, and have
    their own names again in its result.
    """

    @wraps(operator)
    def around(docs: DataFrame, *args: object, **named: object) -> DataFrame:
        own, inside = docs.columns, []
        for i, name in enumerate(own):
            inside.append(name if name in _KNOWN and name not in inside else f"other {i}")
        out = operator(docs.toDF(*inside), *args, **named)
        return out.select(*(f"`{name}`" for name in inside)).toDF(*own)

    return around


_KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
