"""Roll-ups, histograms, rules over sets of values, and validation summaries."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_total(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Counts by key and one row (key null) for all."""
    return df.rollup(key).agg(F.count("*").alias(name))


def section_summary(df: DataFrame, section: Column, tokens: str, page: Column) -> DataFrame:
    """Per section (null: unknown) its rows, tokens and sorted distinct pages, and a row of totals."""
    rows = df.select(F.coalesce(section, F.lit("unknown")).alias("section"), F.col(tokens).alias("_t"), page.alias("_p"))
    out = rows.rollup("section").agg(
        F.count("*").alias("chunks"), F.sum("_t").alias("tokens"), F.array_sort(F.collect_set("_p")).alias("pages"), F.grouping("section").alias("_all")
    )
    return out.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("section")).alias("section"), "chunks", "tokens", "pages")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """One row: a map from value to its count."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("histogram"))


def dominant(df: DataFrame, key: str, value: str, trivial: Sequence[str] = ()) -> DataFrame:
    """The most frequent value of each key, trivial values aside, ties to the smallest value."""
    counts = df.where(~F.col(value).isin(*trivial)).groupBy(key, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value)))
    return ranked.where("_r = 1").select(key, value, "n")


def first_rule(df: DataFrame, key: str, value: str, rules: Sequence[tuple[Sequence[str], str, float]]) -> DataFrame:
    """The first rule (required values, label, confidence) all of whose values a key has.

    Confidence is scaled by 1/2 + 1/2 of the share of the key's rows with a required value.
    """
    have = df.groupBy(key).agg(F.collect_set(value).alias("_have"), F.count("*").alias("_n"), *(
        F.count_if(F.col(value).isin(*need)).alias(f"_m{i}") for i, (need, _, _) in enumerate(rules)
    ))
    label, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (need, name, sure) in reversed(list(enumerate(rules))):
        holds = F.size(F.array_except(F.array(*map(F.lit, need)), "_have")) == 0
        label = F.when(holds, name).otherwise(label)
        confidence = F.when(holds, sure * (F.lit(0.5) + 0.5 * F.col(f"_m{i}") / F.col("_n"))).otherwise(confidence)
    return have.select(key, label.alias("label"), confidence.alias("confidence"))


def stage_rollup(df: DataFrame, key: str, status: str, total: int, done: str, failed: str) -> DataFrame:
    """completed when ``total`` are done, partial when some failed and all have ended, else running."""
    out = df.groupBy(key).agg(F.count_if(F.col(status) == done).alias("done"), F.count_if(F.col(status) == failed).alias("failed"))
    state = F.when(F.col("done") >= total, "completed").when((F.col("failed") > 0) & (F.col("done") + F.col("failed") >= total), "partial")
    return out.withColumn("status", state.otherwise("running"))


def best_of_group(df: DataFrame, key: str, score: str, seq: str, source: str) -> DataFrame:
    """Of each key the row with the highest score, the first on ties, and all its distinct sources."""
    best = F.max_by(F.struct(seq, score), F.struct(F.col(score), -F.col(seq))).alias("_b")
    return df.groupBy(key).agg(best, F.array_sort(F.collect_set(source)).alias("sources")).select(key, "_b.*", "sources")


def merged_edges(df: DataFrame, src: str, dst: str, kind: str, evidence: str, score: str) -> DataFrame:
    """Edges by ends and upper-cased kind: evidence united in order of value, the highest score."""
    return df.groupBy(src, dst, F.upper(kind).alias(kind)).agg(F.array_sort(F.collect_set(evidence)).alias("evidence"), F.max(score).alias(score))


def lattice_state(df: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    """The strongest state of each key; ``order`` goes from weak to strong."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(state))
    return df.groupBy(key).agg(F.get(F.array(*map(F.lit, order)), (F.max(rank) - 1).cast("int")).alias(state))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean, or the plain mean where the weights sum to nothing."""
    return F.coalesce(F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0)), F.avg(value))


def duplicates_after_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A flag on second and later rows of a key."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)
