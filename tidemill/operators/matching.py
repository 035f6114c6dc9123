"""Pairing of records, sections and names."""
from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from tidemill.functions import text as X
from tidemill.functions.text import same_but_for_signs
from tidemill.session import written


def section_partition(counts: DataFrame, key: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(part, value): pairs whose two sections exist, with their sum, then the sections in no such pair."""
    spark = counts.sparkSession
    plan = spark.createDataFrame([(i, f"{a}+{b}", s) for i, (a, b) in enumerate(pairs) for s in (a, b)], "i int, part string, section string")
    got = counts.join(F.broadcast(plan), F.col(key) == F.col("section"))  # a fixed plan of a few rows
    whole = got.groupBy("part").agg(F.sum(value).alias(value), F.count("*").alias("_n")).where("_n = 2").drop("_n")
    used = plan.join(whole.select("part"), "part").select(F.col("section").alias(key))
    rest = counts.join(used, key, "left_anti").select(F.col(key).alias("part"), value)
    return whole.unionByName(rest)


#: What names of records are freed of, in this order, before they are compared.
PREFIXES = ("physical damage -", "hired auto physical damage -", "additional insured -")
SUFFIXES = (" - increased limit", " - reduced limit", " coverage", " - modified", " modification")


def name_matched(old: DataFrame, new: DataFrame, key: str, name: str, canonical: str | None = None, endorsement: bool = False) -> DataFrame:
    """Records of two sets paired one to one in passes: equal canonical id, then equal key (1.0), equal normal name
    (0.9), contained name (0.85); the rest alone.

    Names are compared in lower case without :data:`PREFIXES` and :data:`SUFFIXES`. Each pass joins what the
    passes before it left. Of several with one canonical id the one with the smallest key counts. Among equal
    names the n-th of one side goes with the n-th of the other, by key. A contained name (over 8 characters, with a
    word in common) pairs the first of each side that is free, by key; rows: old_key, new_key, how, confidence (0
    for added and removed). With ``endorsement`` the new set only modifies, so what it lacks is unchanged (1.0).
    """
    normal = X.affix_stripped(F.col(name), PREFIXES, SUFFIXES)
    ids = (lambda df: F.col(canonical)) if canonical else (lambda df: F.lit(None).cast("string"))
    a = old.select(F.col(key).alias("old_key"), normal.alias("n"), ids(old).alias("c"))
    b = new.select(F.col(key).alias("new_key"), normal.alias("n"), ids(new).alias("c"))
    passes = []
    if canonical:
        one = a.where("c IS NOT NULL AND c <> ''").groupBy("c").agg(F.min("old_key").alias("old_key"))
        two = b.where("c IS NOT NULL AND c <> ''").groupBy("c").agg(F.min("new_key").alias("new_key"))
        passes.append(("canonical", 1.0, one.join(two, "c").select("old_key", "new_key")))
        a, b = a.join(passes[-1][2], "old_key", "left_anti"), b.join(passes[-1][2], "new_key", "left_anti")
    by_key = a.join(b.select("new_key"), F.col("old_key") == F.col("new_key")).select("old_key", "new_key")
    passes.append(("key", 1.0, by_key))
    a, b = a.join(by_key, "old_key", "left_anti"), b.join(by_key, "new_key", "left_anti")
    nth = lambda k: F.row_number().over(Window.partitionBy("n").orderBy(k))
    named = lambda df, k: df.where("n <> ''").select(k, "n").withColumn("i", nth(k))
    by_name = named(a, "old_key").join(named(b, "new_key"), ["n", "i"]).select("old_key", "new_key")
    passes.append(("name", 0.9, by_name))
    a, b = a.join(by_name, "old_key", "left_anti"), b.join(by_name, "new_key", "left_anti")
    # All records of a name meet the same names, so names are paired, each with its first key.
    first = lambda df, k: written(df.where(F.length("n") > 8).groupBy("n").agg(F.min(k).alias(k)))
    pairs = written(_contained_names(first(a, "old_key"), first(b, "new_key")))
    first_new = pairs.groupBy("n").agg(F.min("new_key").alias("new_key"), F.min("old_key").alias("old_key"))
    passes.append(("contained", 0.85, first_new.groupBy("new_key").agg(F.min("old_key").alias("old_key")).select("old_key", "new_key")))
    a, b = a.join(passes[-1][2], "old_key", "left_anti"), b.join(passes[-1][2], "new_key", "left_anti")
    passes.append(("unchanged" if endorsement else "removed", 1.0 if endorsement else 0.0, a.select("old_key", F.lit(None).cast(b.schema["new_key"].dataType).alias("new_key"))))
    passes.append(("added", 0.0, b.select(F.lit(None).cast(a.schema["old_key"].dataType).alias("old_key"), "new_key")))
    tagged = [df.select("old_key", "new_key", F.lit(how).alias("how"), F.lit(sure).alias("confidence")) for how, sure, df in passes]
    return reduce(DataFrame.unionByName, tagged)


def _contained_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, old_key and new_key for names n of ``a`` and m of ``b`` of which one contains the other and that share a word.

    What is contained has all its words but the first and the last whole in the other name, so it is looked up by these two and by the
    rarest of the rest: three words at most, whatever its length, and none that all names have unless it stands at an end.
    """
    split = lambda c: F.filter(F.split(c, r"\W+"), lambda w: w != "")
    names = a.select("n").unionByName(b.select("n"))
    rarity = names.select(F.explode(F.array_distinct(split(F.col("n")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def looked_up(df: DataFrame) -> DataFrame:
        words = df.select("*", F.posexplode(split(F.col("n"))).alias("at", "w"), (F.size(split(F.col("n"))) - 1).alias("end"))
        inner = words.where((F.col("at") > 0) & (F.col("at") < F.col("end"))).join(rarity, "w")
        inner = inner.groupBy("n").agg(F.min_by("w", F.struct("df", "w")).alias("w")).join(df, "n")
        return words.where((F.col("at") == 0) | (F.col("at") == F.col("end"))).select(*df.columns, "w").unionByName(inner.select(*df.columns, "w")).distinct()

    whole = lambda df: df.select("*", F.explode(F.array_distinct(split(F.col("n")))).alias("w"))
    small = lambda df: looked_up(df).withColumnRenamed("n", "m")
    down = whole(a).join(small(b), "w").where(F.col("n").contains(F.col("m"))).select("n", "old_key", "new_key")
    up = small(a).join(whole(b), "w").where(F.col("n").contains(F.col("m"))).select(F.col("m").alias("n"), "old_key", "new_key")
    return down.unionByName(up).distinct()


def dictionary_match(df: DataFrame, text: str, entries: DataFrame) -> DataFrame:
    """``df`` with value and how for the first entry (priority, term, value) equal to the text, else contained in it or it in the entry.

    The dictionary is a fixed table of rules, at most 10000 entries; more is an error.
    """
    limited = entries.withColumn("_n", F.count("*").over(Window.partitionBy()))
    limited = limited.where(F.when(F.col("_n") > 10_000, F.raise_error(F.lit("more than 10000 entries")).isNull()).otherwise(True)).drop("_n")
    low = F.lower(F.trim(text))
    names = df.select(low.alias("_x")).distinct()
    hit = names.join(F.broadcast(limited), (F.col("_x") == F.col("term")) | F.col("_x").contains(F.col("term")) | ((F.col("_x") != "") & F.col("term").contains(F.col("_x"))))
    how = F.when(F.col("_x") == F.col("term"), "exact").otherwise("partial")
    best = hit.groupBy("_x").agg(F.min_by(F.struct("value", how.alias("how")), F.struct(how.alias("h"), "priority")).alias("_b"))
    return df.withColumn("_x", low).join(best, "_x", "left").select(*df.columns, F.col("_b.value").alias("value"), F.col("_b.how").alias("how"))


def reference_cascade(refs: DataFrame, ref: str, candidates: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """References resolved by the first step (name, table, column with the reference's text) that knows them: ref, id, step."""
    found = None
    for i, (step, table, column) in enumerate(candidates):
        one = refs.select(ref).distinct().join(table.select(F.col(column).alias(ref), "id").groupBy(ref).agg(F.min("id").alias("id")), ref)
        one = one.select(ref, "id", F.lit(i).alias("_i"), F.lit(step).alias("step"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(ref).agg(F.min_by(F.struct("id", "step"), "_i").alias("_b")).select(ref, "_b.id", "_b.step")
    return refs.join(best, ref, "left")


def containments(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) for each text of one set that is part of a text of the other; both have one column of that name.

    An equi-join on grams: a text of up to 3 characters is its own key, a longer one is looked up by that of its
    4-character parts that fewest outer texts hold. Nulls and empty texts have no partner.
    """
    grams = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))
    a, b = inner.select("inner").where("inner <> ''").distinct(), outer.select("outer").where("outer <> ''").distinct()
    held = b.select("outer", F.explode(F.array_distinct(F.concat(*(grams(F.col("outer"), n) for n in (1, 2, 3, 4))))).alias("gram"))
    long = a.where(F.length("inner") > 3).select("inner", F.explode(F.array_distinct(grams(F.col("inner"), 4))).alias("gram"))
    known = held.where(F.length("gram") == 4).groupBy("gram").agg(F.count("*").alias("texts"))
    rare = long.join(known, "gram", "left").groupBy("inner").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    keyed = rare.unionByName(a.where(F.length("inner") <= 3).select("inner", F.col("inner").alias("gram")))
    return keyed.join(held, "gram").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


#: The steps of :func:`resolved_references` in order.
REFERENCE_STEPS = ("key", "attribute", "typed", "value", "part", "temporary")


def resolved_references(refs: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """ref, key and step: each distinct reference with the entity that the first of six steps finds, nulls where none does.

    ``refs``: ref; ``entities``: seq, key, kind, value, ids (array); ``mentions``: chunk, pos, kind, value. A reference is
    an entity's key, one of its ids, ``kind:value``, its value, over 3 characters that are part of the value or hold it
    (case and outer spaces don't count from the third step on), or ``temp_chunk_kind_...`` for a mention in that chunk
    whose kind and value are an entity's. Several entities in one step: the lowest ``seq``. Each step's keys are
    reduced to one entity before the join, so a value that very many entities share is no hot key.
    """
    r = refs.select("ref").where("ref IS NOT NULL").distinct()
    plain = lambda c: F.lower(F.trim(c))
    least = F.min(F.struct("seq", "key")).alias("e")
    by = lambda k: entities.select(k.alias("k"), "seq", "key").where("k IS NOT NULL").groupBy("k").agg(least)
    values = entities.select(plain("value").alias("k"), "seq", "key").where("k <> ''").groupBy("k").agg(least)
    typed = F.when(~F.contains("kind", F.lit(":")), F.concat(F.lower("kind"), F.lit(":"), F.lower(F.coalesce("value", F.lit("")))))
    long = r.select("ref", plain("ref").alias("p")).where(F.length("p") > 3)
    texts, names = long.select("p").distinct(), values.select("k")
    within = containments(texts.withColumnRenamed("p", "inner"), names.withColumnRenamed("k", "outer")).select(F.col("inner").alias("p"), F.col("outer").alias("k"))
    around = containments(names.withColumnRenamed("k", "inner"), texts.withColumnRenamed("p", "outer")).select(F.col("outer").alias("p"), F.col("inner").alias("k"))
    part = within.unionByName(around).join(values, "k").groupBy("p").agg(F.min("e").alias("e"))
    meant = mentions.select("chunk", "pos", "kind", plain("value").alias("v")).where("v <> ''")
    same = entities.select("kind", plain("value").alias("v"), "seq", "key").groupBy("kind", "v").agg(least)
    there = meant.join(same, ["kind", "v"]).groupBy("chunk", "kind").agg(F.min_by("e", F.struct("pos", "e")).alias("e"))
    bits = F.split("ref", "_")
    temporary = r.where(F.startswith("ref", F.lit("temp_")) & (F.size(bits) >= 3)).select("ref", bits[1].alias("chunk"), bits[2].alias("kind"))
    found = [
        r.join(by(F.col("key")), F.col("ref") == F.col("k")), r.join(by(F.explode("ids")), F.col("ref") == F.col("k")), r.join(by(typed), F.lower("ref") == F.col("k")),
        r.join(values, plain("ref") == F.col("k")), long.join(part, "p"), temporary.join(there, ["chunk", "kind"]),
    ]
    tagged = reduce(DataFrame.unionByName, (df.select("ref", F.lit(i).alias("i"), "e") for i, df in enumerate(found)))
    best = tagged.groupBy("ref").agg(F.min(F.struct("i", "e")).alias("b"))
    steps = F.array(*map(F.lit, REFERENCE_STEPS))
    return r.join(best, "ref", "left").select("ref", F.col("b.e.key").alias("key"), F.get(steps, F.col("b.i")).alias("step"))


def json_leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value) for every leaf of a JSON text, at any depth; arrays by position."""

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[document], strict=True):
                try:
                    stack = [("", json.loads(text))] if text is not None else []
                except ValueError:
                    stack = []
                while stack:
                    path, value = stack.pop()
                    if isinstance(value, dict) and value:
                        stack += [(f"{path}.{name}" if path else name, x) for name, x in value.items()]
                    elif isinstance(value, list) and value:
                        stack += [(f"{path}[{i}]", x) for i, x in enumerate(value)]
                    else:
                        rows.append((k, path, value if isinstance(value, str) else json.dumps(value)))
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, document).mapInPandas(leaves, f"{key} {kind}, path string, value string")


def json_diff(old: DataFrame, new: DataFrame, key: str, document: str) -> DataFrame:
    """Leaves that were added, removed or changed, with the kind of change for texts and numbers."""
    a = json_leaves(old, key, document).withColumnRenamed("value", "old")
    b = json_leaves(new, key, document).withColumnRenamed("value", "new")
    both = a.join(b, [key, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    x, y = F.col("old").try_cast("double"), F.col("new").try_cast("double")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(same_but_for_signs(F.col("old"), F.col("new")), "formatting")
    change = change.when(y > x, "increase").when(y < x, "decrease").otherwise("modified")
    return both.withColumn("change", change).withColumn("delta", y - x)


@F.pandas_udf(StringType())
def deep_merged(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two JSON texts as one: objects overlaid, arrays joined, scalars from the second."""

    def merged(a: object, b: object) -> object:
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: merged(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in [*a, *(k for k in b if k not in a)]}
        return a + b if isinstance(a, list) and isinstance(b, list) else b

    for one, two in pairs:
        yield pd.Series([y if x is None else x if y is None else json.dumps(merged(json.loads(x), json.loads(y))) for x, y in zip(one, two, strict=True)], dtype=object)


def words_in_boxes(words: DataFrame, boxes: DataFrame, page: Sequence[str], slack: float = 5, cell: float = 100) -> DataFrame:
    """Words (x0, y0, x1, y1) inside boxes (bx0, by0, bx1, by1) of their page, give or take ``slack``; an equi-join on a grid."""
    span = lambda low, high: F.sequence(F.floor((F.col(low) - slack) / cell), F.floor((F.col(high) + slack) / cell))
    gridded = boxes.withColumn("_gx", F.explode(span("bx0", "bx1"))).withColumn("_gy", F.explode(span("by0", "by1")))
    at = words.withColumn("_gx", F.floor(F.col("x0") / cell)).withColumn("_gy", F.floor(F.col("y0") / cell))
    inside = (F.col("x0") >= F.col("bx0") - slack) & (F.col("y0") >= F.col("by0") - slack) & (F.col("x1") <= F.col("bx1") + slack) & (F.col("y1") <= F.col("by1") + slack)
    return at.join(gridded, [*page, "_gx", "_gy"]).where(inside).drop("_gx", "_gy")


def split_words(df: DataFrame, text: str) -> DataFrame:
    """A run of several words with one box as words with boxes in proportion to their characters."""
    parts = F.filter(F.split(text, " "), lambda w: w != "")
    out = df.select("*", F.posexplode(parts).alias("i", "word")).withColumn("_p", parts)
    total = F.aggregate("_p", F.lit(0), lambda s, w: s + F.length(w)) + F.size("_p") - 1
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("i")), F.lit(0), lambda s, w: s + F.length(w) + 1)
    wide = (F.col("x1") - F.col("x0")) / total
    left = F.col("x0") + wide * before
    return out.withColumn("_l", left).withColumn("_r", left + wide * F.length("word")).withColumn("x0", F.col("_l")).withColumn("x1", F.col("_r")).drop("_l", "_r", "_p")
