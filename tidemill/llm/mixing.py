"""Mixing sources to target weights by weighted fair queueing.

A source's documents are shuffled by a seed and queued up to ``epochs`` times, each pass in the same
order. A document's virtual finish time is the source's tokens up to and with it, divided by the
source's target. All entries sorted by finish time, ties by source and shuffle, are taken until the
total budget is reached, so every source stops about where its tokens equal its target.

Sources in the order of code points, null last, have the given weights, repeated in turn. They share
``share`` of all tokens by weight; a source's target stops at ``epochs`` times its size, and the
excess goes to the others by weight. That fixed point is min(cap, level * weight) for the one level
that spends the budget, found by a cumulative sum over the sources sorted by cap / weight.

Sums run over buckets of the shuffle and then within them, so that a source with a third of all rows
is split; buckets hold 100,000 rows on average at most. Copies of a row (equal in doc_id, source and size)
are counted before they move, queue one after the other, and are told apart again in runs of 8192, so a
doc_id that very many rows share, or null, costs no more than others. Targets take one task, with one
narrow row for each source. The place where the budget ends is found by three histograms of 4096 bins each, each of
one bin of the one before. What is left in the last one, which may be very many entries that tie, is dealt by ranges of about 100,000
of the full order, and the range where the budget ends is summed entry by entry. Only bins, ranges' sums and the cut reach the driver.

A null text has size 0, as the empty one, and takes nothing. Null sources form a source. Repeated
rows count each. Runs with the same rows agree. An empty table gives no rows. Long texts are only counted.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import BUCKET, bits_for, copied, pick, pin, repeated, seat, seat_bucket, shelved, stratum, words_in

BINS, LEVELS = 1 << 12, 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """g and target for rows of g (a key of :func:`stratum`) and source_size. One row a source."""
    nth = F.row_number().over(Window.orderBy((F.col("g") == "~").cast("int"), "g")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    at = sizes.select("g", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * float(epochs))
    at = at.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "g")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    at = at.withColumn("level", (F.sum("source_size").over(every) * share - capped) / left)
    # The first source, by ratio, that its share does not fill sets the level for itself and those after it.
    free = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "g", "level"))
    at = at.withColumn("level", F.min(free).over(every)["level"])
    return at.select("g", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, seed: int = 9, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row."""
    rows = queued(pick(docs, "doc_id", "text", "source").withColumn("digest", F.lit(0)), seed, share, epochs)
    return taken(rows, share, epochs).select("doc_id", "size", "source_size", "target", "taken")


@shelved
def mixed_documents(docs: DataFrame, seed: int = 9, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: rows not taken go, rows taken twice come twice.

    Rows are joined with what was taken of their like: those equal in all columns. Where the copies of a
    row are not all taken equally often (at the end of a source's share only), one of them comes that often.
    """
    digest = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in docs.columns))
    rows = queued(docs.select("doc_id", "text", "source", digest.alias("digest")), seed, share, epochs)
    times = taken(rows, share, epochs).groupBy(
        F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("g").alias("_g"),
        F.col("size").alias("_size"), F.col("digest").alias("_digest"),
    ).agg(F.sum(F.expr("taken div greatest(size, 1)")).alias("_times"), F.count("*").alias("_n")).where("_times > 0")
    marked = docs.select(
        "*", F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
        stratum(F.col("source")).alias("_g"), words_in(F.col("text")).alias("_size"), digest.alias("_digest"),
    )
    keys = ["_id", "_none", "_g", "_size", "_digest"]
    found = marked.join(times, keys)
    even = found.where("_times % _n = 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("_times div _n"))))
    odd = copied(found.where("_times % _n <> 0").dropDuplicates(keys), "_times", "_copy")
    names = [f"`{c}`" for c in docs.columns]
    return even.select(*names).unionByName(odd.select(*names))


def queued(docs: DataFrame, seed: int, share: float, epochs: int) -> DataFrame:
    """Narrow rows with the tokens of the source up to and with each row in one pass (``upto``), written down.

    ``docs``: doc_id, text, source and digest. Rows equal in doc_id, source, size and digest are counted first,
    and each of these copies has tokens of its own in the queue.
    """
    groups = docs.select("doc_id", words_in(F.col("text")).alias("size"), stratum(F.col("source")).alias("g"), "digest")
    groups = pin(groups.groupBy("doc_id", "size", "g", "digest").agg(F.count("*").alias("n")))
    groups = groups.withColumn("place", seat(seed, F.col("doc_id"), F.col("size")))
    groups = groups.withColumn("b", seat_bucket(F.col("place"), bits_for(groups.count())))
    tokens = F.sum(F.col("size") * F.col("n"))
    sums = groups.groupBy("g", "b").agg(tokens.alias("tokens"))
    sizes = sums.groupBy("g").agg(F.sum("tokens").alias("source_size"))
    below = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "b", F.coalesce(F.sum("tokens").over(below), F.lit(0)).alias("low"))
    sums = sums.join(sizes.join(targets(sizes, share=share, epochs=epochs), "g"), "g")
    here = Window.partitionBy("g", "b").orderBy("place", F.coalesce("doc_id", F.lit(-1)), "size", F.col("doc_id").isNull(), "digest")
    before = F.col("low") + F.coalesce(tokens.over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = pin(groups.join(sums, ["g", "b"]).select("doc_id", "size", "g", "digest", "n", "place", "source_size", "target", before.alias("before")))
    rows = repeated(groups, "n", "k").withColumn("upto", F.col("before") + F.col("k") * F.col("size"))
    return pin(rows.select("doc_id", "size", "g", "digest", "place", "source_size", "target", "upto"))


def _finish(epoch: Column) -> Column:
    return F.try_divide(epoch * F.col("source_size") + F.col("upto"), F.col("target"))


def taken(rows: DataFrame, share: float, epochs: int) -> DataFrame:
    """``rows`` of :func:`queued` with the tokens that the mix takes of each."""
    able = rows.where((F.col("size") > 0) & (F.col("target") > 0))
    entries = able.select("size", "g", "place", _id().alias("doc_id"), F.explode(F.array(*(
        F.struct(F.lit(e).alias("epoch"), _finish(F.lit(e)).alias("finish")) for e in range(epochs)
    ))).alias("e")).select("size", "g", "place", "doc_id", "e.*")
    budget = (rows.agg(F.sum("size")).first()[0] or 0) * share
    # Finish times as y in [0, 1), in order.
    y = F.col("finish") / (F.col("finish") + 1)
    before, last, left = 0, None, 0
    for level in range(1, LEVELS + 1):
        bins = entries.groupBy(F.floor(y * float(BINS**level)).alias("bin")).agg(F.sum("size").alias("n"), F.count("*").alias("entries")).orderBy("bin").collect()
        cut = None
        for r in bins:
            if before + r["n"] > budget:
                cut, left = r["bin"], r["entries"]
                break
            before += r["n"]
        if cut is None:  # the budget holds all that is left
            return rows.withColumn("taken", _times(able_column(), rows, epochs, None))
        entries = entries.where(F.floor(y * float(BINS**level)) == cut)
        last = cut / float(BINS**level)
    return rows.withColumn("taken", _times(able_column(), rows, epochs, (last, _edge(entries, left, before, budget))))


#: What decides between entries, in turn.
_ORDER = ("finish", "g", "place", "doc_id", "size", "epoch")


def _edge(entries: DataFrame, count: int, before: int, budget: float) -> Row | None:
    """The last of ``entries``, in order, that the budget holds past the ``before`` tokens taken; None if it holds none.

    All of them may tie in finish time, so they are dealt by ranges of the order, and only the range in which the
    budget ends is summed entry by entry.
    """
    ranged = pin(entries.repartitionByRange(math.ceil(count / BUCKET), *_ORDER).withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    part = -1
    for part in sorted(sums):
        if before + sums[part] > budget:
            break
        before += sums[part]
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*_ORDER)) + F.lit(before)
    within = ranged.where(F.col("part") == part).withColumn("sum", running).where(F.col("sum") <= budget)
    found = within.agg(F.max(F.struct(*_ORDER)).alias("edge")).first()["edge"]
    return found or ranged.where(F.col("part") < part).agg(F.max(F.struct(*_ORDER)).alias("edge")).first()["edge"]


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1).cast("bigint"))


def able_column() -> Column:
    return (F.col("size") > 0) & (F.col("target") > 0)


def _times(able: Column, rows: DataFrame, epochs: int, cut: tuple | None) -> Column:
    """Tokens taken: size for each pass whose entry comes before the cut."""
    if cut is None:
        return F.when(able, F.col("size") * epochs).otherwise(F.lit(0)).cast("bigint")
    low, edge = cut
    total = F.lit(0)
    for e in range(epochs):
        finish = _finish(F.lit(e))
        if edge is None:
            got = finish / (finish + 1) < F.lit(low)
        else:
            mine = {"finish": finish, "g": F.col("g"), "place": F.col("place"), "doc_id": _id(), "size": F.col("size"), "epoch": F.lit(e)}
            kinds = {"finish": "double", "g": "string", "place": "bigint", "doc_id": "bigint", "size": "bigint", "epoch": "int"}
            at = F.struct(*(F.lit(edge[name]).cast(kinds[name]).alias(name) for name in _ORDER))
            got = F.struct(*(mine[name].cast(kinds[name]).alias(name) for name in _ORDER)) <= at
        total = total + F.when(able & got, F.col("size")).otherwise(F.lit(0))
    return total.cast("bigint")
