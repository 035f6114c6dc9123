"""Half-structured text as rows: pipe tables, tolerant JSON, page footers."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemill.functions.text import without_fences


def markdown_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of pipe tables: key, table (from 0), row (from 0), cells as a map by header.

    A table is a header line, a line of dashes, and lines of cells; short lines are padded with null,
    long ones cut to the header's width.
    """
    found = F.regexp_extract_all(text, F.lit(r"(?m)((?:^[ \t]*\|.*\|[ \t]*(?:\n|\z)){2,})"), F.lit(1))
    tables = df.select(key, F.posexplode(found).alias("table", "_t"))
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = tables.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.trim(x) != "")).where(F.get("_l", F.lit(1)).rlike(r"^[\s|:\-]+$"))
    lines = lines.withColumn("_h", cells(F.get("_l", F.lit(0))))
    rows = lines.select(key, "table", "_h", F.posexplode(F.slice("_l", F.lit(3), F.size("_l"))).alias("row", "_r")).withColumn("_c", cells(F.col("_r")))
    padded = F.transform(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.get(F.col("_c"), i))
    names = F.transform(F.col("_h"), lambda h, i: F.when(h == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(h))
    pairs = F.arrays_zip(names.alias("k"), padded.alias("v"))
    first = F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1))
    return rows.select(key, "table", "row", first.alias("cells"))


def tolerant_json(text: Column) -> Column:
    """A JSON value as text: as it is, without code fences, or the first object or array that can be read; else null."""
    plain = without_fences(text)
    return F.coalesce(F.when(F.try_parse_json(plain).isNotNull(), plain), _salvaged(text))


@F.pandas_udf(StringType())
def _salvaged(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    decoder = json.JSONDecoder()

    def first(text: str | None) -> str | None:
        for m in re.finditer(r"[\[{]", text or ""):
            try:
                return json.dumps(decoder.raw_decode(text, m.start())[0])
            except ValueError:
                continue
        return None

    for batch in texts:
        yield batch.map(first)


def broken_field(text: Column, name: str) -> Column:
    """A string field of JSON that need not be whole, with its escapes."""
    return F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))


def footer_forms(pages: DataFrame, key: str, page: str, text: str, pattern: str) -> DataFrame:
    """Pages by the form number in their last lines: key, form, pages."""
    tail = F.array_join(F.slice(F.split(text, "\n"), -3, 3), "\n")
    form = F.nullif(F.regexp_extract(tail, pattern, 0), F.lit(""))
    return pages.select(key, page, form.alias("form")).where("form IS NOT NULL").groupBy(key, "form").agg(F.array_sort(F.collect_list(page)).alias("pages"))
