"""Tables as cells and headers: addressing, header names, kinds, confidence, entity rows."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Weights of the five statistics in a table's confidence.
CONFIDENCE_WEIGHTS = {"completeness": 0.2, "consistency": 0.25, "spans": 0.2, "numbers": 0.2, "header": 0.15}


def covered(cells: DataFrame, table: str) -> DataFrame:
    """Grid positions (r, c) that each cell (row, col, rowspan, colspan, text) covers."""
    at = lambda low, n: F.explode(F.sequence(F.col(low), F.col(low) + F.greatest(F.col(n), F.lit(1)) - 1))
    return cells.withColumn("r", at("row", "rowspan")).withColumn("c", at("col", "colspan")).select(table, "r", "c", "row", "col", "text")


def rebuilt_headers(cells: DataFrame, table: str, header_rows: int = 1) -> DataFrame:
    """One name for each column: the texts of the header cells that cover it, from top to bottom, each once."""
    top = covered(cells, table).where((F.col("r") < header_rows) & (F.col("r") == F.col("row")))
    parts = F.array_sort(F.collect_list(F.struct("r", "text")))
    return top.groupBy(table, "c").agg(F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), " ")).alias("header"))


def grid_confidence(cells: DataFrame, table: str) -> DataFrame:
    """Five statistics of each table's grid between 0 and 1, and their weighted mean ``overall``.

    Filled share of the grid; share of rows as wide as the widest; 0.8 for each position covered twice;
    least share of numbers among columns that are mostly numbers; how far the first row reads as a header.
    """
    grid = covered(cells, table)
    shape = grid.groupBy(table).agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    filled = cells.groupBy(table).agg(F.count_if(F.trim("text") != "").alias("filled"))
    widths = cells.withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest("colspan", F.lit(1)) - 1)))
    widths = widths.groupBy(table, "row").agg(F.countDistinct("c").alias("w"))
    widest = widths.groupBy(table).agg(F.max("w").alias("top"), F.collect_list("w").alias("ws"))
    consistent = widest.select(table, (F.size(F.filter("ws", lambda w: w == F.col("top"))) / F.size("ws")).alias("consistency"))
    twice = grid.groupBy(table, "r", "c").agg((F.count("*") - 1).alias("extra")).groupBy(table).agg(F.sum("extra").alias("extra"))
    number = F.col("text").rlike(r"^\s*[$(]?[\d,.]+%?\)?\s*$")
    body = cells.where("row > 0").groupBy(table, "col").agg(F.count_if(number).alias("n"), F.count("*").alias("of"))
    numbers = body.groupBy(table).agg(F.min(F.when(F.col("n") > F.col("of") / 2, F.col("n") / F.col("of"))).alias("numbers"))
    head = cells.where("row = 0").groupBy(table).agg((F.least(F.lit(1.0), F.avg(F.length("text")) / 10) * (1 - F.avg(number.cast("double")))).alias("header"))
    out = shape.join(filled, table).join(consistent, table).join(twice, table).join(numbers, table, "left").join(head, table, "left")
    out = out.select(
        table, (F.col("filled") / (F.col("rows") * F.col("cols"))).alias("completeness"), "consistency", F.pow(F.lit(0.8), "extra").alias("spans"),
        F.coalesce("numbers", F.lit(1.0)).alias("numbers"), F.coalesce("header", F.lit(1.0)).alias("header"),
    )
    return out.withColumn("overall", sum((F.col(k) * w for k, w in CONFIDENCE_WEIGHTS.items()), F.lit(0.0)))


def canonical_header(header: Column, synonyms: Sequence[tuple[str, Sequence[str]]], abbreviations: Sequence[tuple[str, str]] = ()) -> Column:
    """Struct of name and confidence for a header text, the first that holds of:

    a synonym as it is (1.0), a synonym in it or it in a synonym (0.8), a word that it shares with a
    synonym (0.6), an abbreviation (0.6); else ``unknown_`` and the header's words (0). Empty is unknown.
    """
    h = F.trim(F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    words = F.split(h, " ")
    pick = lambda test, sure: F.coalesce(*(F.when(test(s), F.struct(F.lit(name).alias("name"), F.lit(sure).alias("confidence"))) for name, ss in synonyms for s in ss))
    exact = pick(lambda s: h == s, 1.0)
    part = pick(lambda s: (h != "") & (h.contains(s) | F.lit(s).contains(h)), 0.8)
    word = pick(lambda s: F.exists(F.array(*map(F.lit, s.split())), lambda w: (F.length(w) > 3) & F.array_contains(words, w)), 0.6)
    known = [F.when(h == a, F.struct(F.lit(name).alias("name"), F.lit(0.6).alias("confidence"))) for a, name in abbreviations]
    rest = F.struct(F.concat(F.lit("unknown_"), F.replace(h, F.lit(" "), F.lit("_"))).alias("name"), F.lit(0.0).alias("confidence"))
    return F.coalesce(exact, part, word, *known, rest)


def table_kind_score(headers: Column, context: Column, words: Sequence[str], context_words: Sequence[str], least: int = 2) -> Column:
    """0.35 for words of the context, 0.45 for the share of up to five expected header words, 0.1 for enough of both; halved otherwise."""
    h, c = F.lower(headers), F.lower(context)
    count = lambda text, ws: sum((text.contains(w).cast("int") for w in ws), F.lit(0))
    near, own = count(c, context_words), count(h, words)
    expected = min(5, len(words))
    score = 0.35 * F.least(near, F.lit(2)) / 2 + 0.45 * F.least(own, F.lit(expected)) / float(expected)
    return F.least(F.lit(1.0), F.when(near + own < least, score * 0.5).otherwise(score + 0.1))


@udtf(returnType="entity_id string, kind string, name string, confidence double")
class EntityRows:
    """Rows for the items of a section's JSON list: id from the name, the first alias that is present, confidence or 0.8."""

    def eval(self, kind: str, items: str) -> Iterator[tuple]:
        import json
        import re

        try:
            found = json.loads(items or "[]")
        except ValueError:
            return
        for item in found if isinstance(found, list) else []:
            name = next((item[k] for k in ("name", "title", "coverage_name") if isinstance(item, dict) and item.get(k)), None)
            if name:
                slug = re.sub(r"[\W_]+", "_", str(name).lower()).strip("_")
                yield f"{kind}_{slug}", kind, str(name), float(item.get("confidence") or 0.8)
