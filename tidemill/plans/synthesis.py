"""Endorsements to effective coverages: what holds of each coverage of a document after all that changed it.

A coverage's terms are merged key by key, the last change of a key counting, in two aggregations: first of each term, then
of each coverage. Both combine before they shuffle, so a coverage that very many endorsements change is no hot group; what is
gathered of it are its terms, pages, sources and three texts, never its changes. Blank texts count as absent.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.text import COVERAGES, coverage_name, first_contained, slug, term_key
from tidemill.session import written

#: Effects on a coverage and the status of a term under them.
STATUS = {"adds_coverage": "Covered", "expands_coverage": "Expanded", "limits_coverage": "Restricted", "restores_coverage": "Restored"}
#: Types of endorsements, their effects, and the status of the term that is named after one.
TYPE_EFFECT = {"Add": "adds_coverage", "Expand": "expands_coverage", "Modify": "expands_coverage", "Restrict": "limits_coverage", "Delete": "limits_coverage"}
TYPE_STATUS = {"Add": "Added", "Modify": "Modified", "Restrict": "Restricted", "Delete": "Removed", "Expand": "Expanded"}
#: Confidence to begin with; what texts, several sources, and effects of all changes add; and the most.
SURE, SURE_TEXT, SURE_SOURCES, SURE_EFFECTS, MOST = 0.7, 0.1, 0.05, 0.1, 0.98
TEXTS = 3


def _some(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in table.items()), default)


def references(text: Column) -> Column:
    """The coverages that a text names: pieces that end in the word FORM, and what follows the last of them."""
    pieces = F.regexp_extract_all(F.regexp_replace(F.trim(text), r"\s+", " "), F.lit(r"(?i)(\S.*?(?<!\S)FORM(?!\S)|\S.*$)"), F.lit(1))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def projected(endorsements: DataFrame) -> DataFrame:
    """Changes from endorsements with ``modifications``: impacted_coverage, coverage_effect, effect_category, scope_modification, limit_modification,
    deductible_modification, condition_modification, verbatim_language, page_numbers and source_text. The rest of the columns: doc_id, seq (any
    type that sorts, unique in a document), endorsement_number and endorsement_name.
    """
    source = F.coalesce(_some(F.col("endorsement_number")), _some(F.col("endorsement_name")), F.lit("Unknown"))
    rows = endorsements.select("doc_id", "seq", source.alias("source"), F.posexplode("modifications").alias("nth", "m"))
    text = lambda n: _some(F.col(f"m.{n}"))
    status = _lookup(F.col("m.effect_category"), STATUS, F.coalesce(text("coverage_effect"), F.lit("Modified")))
    return rows.where(text("impacted_coverage").isNotNull()).select(
        "doc_id", F.struct("seq", "nth").alias("seq"), "source", coverage_name(F.col("m.impacted_coverage")).alias("coverage"),
        F.when(text("scope_modification").isNotNull(), term_key(F.col("m.scope_modification"))).alias("term"), status.alias("status"),
        text("scope_modification").alias("details"), text("condition_modification").alias("condition"),
        text("limit_modification").alias("limit"), text("deductible_modification").alias("deductible"), F.col("m.page_numbers").alias("pages"),
        F.coalesce(text("source_text"), text("verbatim_language"), text("scope_modification")).alias("text"),
        F.coalesce(text("scope_modification"), text("verbatim_language")).isNotNull().alias("worded"), text("effect_category").isNotNull().alias("categorised"),
    )


def basic(endorsements: DataFrame) -> DataFrame:
    """Changes from endorsements of which only endorsement_type, impacted_coverage (one or several forms), page_numbers and source_text are known."""
    name = _some(F.col("endorsement_name"))
    source = F.coalesce(_some(F.col("endorsement_number")), name, F.lit("Unknown"))
    kind = F.coalesce(F.col("endorsement_type"), F.lit("Modify"))
    rows = endorsements.select("*", source.alias("source"), F.posexplode(references(F.col("impacted_coverage"))).alias("nth", "form"))
    none = F.lit(None).cast("string")
    return rows.select(
        "doc_id", F.struct("seq", "nth").alias("seq"), "source", coverage_name(F.col("form")).alias("coverage"), name.alias("term"),
        _lookup(kind, TYPE_STATUS, F.lit("Modified")).alias("status"), none.alias("details"), none.alias("condition"), none.alias("limit"), none.alias("deductible"),
        F.col("page_numbers").alias("pages"), _some(F.col("source_text")).alias("text"), F.lit(False).alias("worded"), F.lit(True).alias("categorised"),
    )


def detailed_terms(changes: DataFrame) -> DataFrame:
    """A row for each change of a term that is described."""
    return changes.where(F.col("details").isNotNull()).select("doc_id", "coverage", "seq", "term", "status", "details", "condition", "source")


def effective_coverages(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """doc_id, coverage, kind, canonical_id, terms, limit, deductible, sources, pages, text, confidence and modified.

    ``base``: doc_id, coverage_name, limit_amount, deductible_amount, confidence, pages and text of coverages before any change; they count
    for documents without changes. Terms is a map in order of keys; text joins the first three texts.
    """
    key = ["doc_id", "coverage"]
    changes = written(changes)  # read once for each thing that is gathered
    terms = changes.where(F.col("term").isNotNull()).groupBy(*key, "term").agg(F.max_by("status", "seq").alias("status"))
    terms = terms.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "status")))).alias("terms"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    texts = changes.where(F.col("text").isNotNull()).select(*key, "seq", "text").withColumn("_r", first).where(F.col("_r") <= TEXTS)
    texts = texts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]), " | ").alias("text"))
    pages = changes.select(*key, F.explode("pages").alias("p")).where("p IS NOT NULL").groupBy(*key).agg(F.array_sort(F.collect_set("p")).alias("pages"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = changes.groupBy(*key).agg(
        last("limit").alias("limit"), last("deductible").alias("deductible"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.bool_or("worded").alias("_worded"), F.bool_and("categorised").alias("_all"),
    )
    sure = SURE + F.when(F.col("_worded"), SURE_TEXT).otherwise(0.0) + F.when(F.size("sources") > 1, SURE_SOURCES).otherwise(0.0) + F.when(F.col("_all"), SURE_EFFECTS).otherwise(0.0)
    out = out.withColumn("confidence", F.least(sure, F.lit(MOST))).join(terms, key, "left").join(texts, key, "left").join(pages, key, "left")
    out = out.withColumn("modified", F.lit(True)).withColumn("terms", F.coalesce("terms", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    if base is not None:
        plain = base.join(changes.select("doc_id").distinct(), "doc_id", "left_anti").select(
            "doc_id", F.coalesce(_some(F.col("coverage_name")), F.lit("Unknown Coverage")).alias("coverage"), F.col("limit_amount").cast("string").alias("limit"),
            F.col("deductible_amount").cast("string").alias("deductible"), F.array(F.lit("Base Form")).alias("sources"),
            F.coalesce("confidence", F.lit(0.95)).alias("confidence"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("terms"),
            "text", "pages", F.lit(False).alias("modified"),
        )
        out = out.drop("_worded", "_all").unionByName(plain)
    kind = first_contained(F.col("coverage"), COVERAGES)
    name = F.left(F.concat_ws("_", F.lit("cov"), F.coalesce(slug(kind), F.lit("unknown")), slug(F.col("coverage"))), F.lit(50))
    return out.select(*key, kind.alias("kind"), name.alias("canonical_id"), "terms", "limit", "deductible", "sources", "pages", "text", "confidence", "modified")


def synthesis_summary(coverages: DataFrame) -> DataFrame:
    """doc_id, coverages, confidence (their mean) and method for each document."""
    method = F.when(F.bool_or("modified"), "endorsement_only").otherwise("base_coverage_merge")
    return coverages.groupBy("doc_id").agg(F.count("*").alias("coverages"), F.avg("confidence").alias("confidence"), method.alias("method"))
