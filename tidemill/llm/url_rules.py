"""URL filters by a sort-merge range join with a stack of nested rules.

A host with its labels reversed and each followed by a dot (``com.example.www.``) is a canonical key
under which a host and all its subdomains are one interval: the keys that start with the host's. A
rule is the interval of its host, with a path prefix to be checked. Intervals nest or are disjoint,
so one sweep over sorted keys with a stack of open rules sees, at each URL, exactly the rules whose
host fits. Of those whose path starts the URL's path the longest wins: by characters of host and
path together, then of the host.

URLs are spread by ranges of (key, path, id) whose bounds come from a sample of about ``SAMPLE`` rows, or
``EACH`` for a range of ``RANGE`` rows where that is more; the sample steers balance only. A rule goes to every range that its interval
touches, which for all but the broadest rules is one. A host with very many URLs is split by path
and id. Each range is sorted and swept in one pass.

Null URLs, and those without ``://``, have an empty host and path, fit no rule, and get the default
verdict. Repeated rows each give a row; other columns are ignored. Rules repeated or differing in
the verdict only: the first by (rule, verdict) counts.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pick, ship, width

SAMPLE, EACH = 20_000, 10
#: URLs of a range, on average, at most.
RANGE = 250_000
#: Sorts after every character of a key.
_LAST = "\U0010ffff"


def key_of(host: str) -> str:
    """``www.example.com`` as ``com.example.www.``; the empty host is the key of all."""
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


def split_urls(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns in ``keep``, host, path and key for column url."""
    m = F.instr("url", "://")
    rest = F.when(m > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    out = pages.select(*keep, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return out.withColumn("key", F.when(F.col("host") == "", "").otherwise(key))


def _sweep(urls: pd.DataFrame, rules: list[tuple[str, str, str, str]], default: str) -> pd.DataFrame:
    """``rules``: key, host, path, verdict, sorted by key. ``urls``: any order."""
    urls = urls.sort_values(["key"], kind="stable")
    found, verdicts = [], []
    stack: list[tuple[str, str, str, str]] = []
    at = 0
    for key, path in zip(urls["key"], urls["path"], strict=True):
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = max((r for r in stack if path.startswith(r[2])), key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), default=None) if key else None
        found.append(best and best[1] + best[2])
        verdicts.append(best[3] if best else default)
    return pd.DataFrame({"page_id": urls["page_id"], "host": urls["host"], "path": urls["path"], "rule": pd.Series(found, index=urls.index, dtype=object), "verdict": pd.Series(verdicts, index=urls.index, dtype=object)})


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, or null) and verdict for each row.

    ``rules``: rows of host, path and verdict.
    """
    spark = pages.sparkSession
    ship(spark)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    urls = split_urls(pick(pages, "page_id", "url"), "page_id")
    order = F.concat("key", F.lit("\x00"), "path", F.lit("\x00"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    count = pages.count()
    ranges = max(1, width(spark), count // RANGE)
    wanted = max(SAMPLE, EACH * ranges)
    sample = sorted(r[0] for r in urls.select(order.alias("o")).sample(min(1.0, wanted / max(1, count)), seed=1).limit(2 * wanted).collect())
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    @F.pandas_udf("int")
    def cell(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(bounds, k)).astype("int32")

    @F.pandas_udf("array<int>")
    def cells(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: list(range(bisect_right(bounds, k), bisect_left(bounds, k + _LAST) + 1)))

    reverse = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    kept = rules.withColumn("key", F.when(F.col("host") == "", "").otherwise(reverse)).groupBy("key", "host", "path").agg(F.min("verdict").alias("verdict"))
    kept = kept.withColumn("cell", F.explode(cells("key")))

    def swept(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        own = sorted(b[["key", "host", "path", "verdict"]].itertuples(index=False, name=None))
        return _sweep(a, own, default)

    return urls.withColumn("cell", cell(order)).groupBy("cell").cogroup(kept.groupBy("cell")).applyInPandas(
        swept, "page_id bigint, host string, path string, rule string, verdict string"
    )
