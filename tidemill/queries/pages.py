"""Page classification. Documents, each after fixed lines in turn, stand for pages; 20 of them in a row for a paged document."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import pages as P
from tidemill.operators import similarity
from tidemill.queries import Tables, query
from tidemill.queries.questions import _quoted
from tidemill.queries.similarity import _SETS, _top_words

HEADS = (
    "COMMON POLICY DECLARATIONS\nNamed Insured and Policy Period", "SECTION I - COVERAGES\nInsuring Agreement\nWe will pay for loss", "## Exclusions\nThis insurance does not apply to war",
    "THIS ENDORSEMENT CHANGES THE POLICY. PLEASE READ IT CAREFULLY.\nIt is amended to include an additional insured", "Conditions\nDuties in the event of loss\nThis endorsement modifies coverage",
    "Statement of Values\nSchedule of Locations", "Loss run and claims history", "Copyright ISO Properties, all rights reserved", "Vehicle identification\nCoverages\nInsuring agreement",
    "ACORD 25 certificate of liability insurance", "Definitions\nA word means the following\nLimits of insurance", "plain page\nExclusion b. does not apply, coverage is limited to it; it restores coverage",
    "Declarations\n1. Limits of insurance\nsome line\nB. Coverage extensions\nother line", "Table of contents",
)
KINDS = ("unknown", "policy", "endorsement", "bundle")
_CYCLE = len(HEADS)


def _page() -> Column:
    head = F.get(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % _CYCLE).cast("int"))
    return F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))


def _kind() -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS)).cast("int"))


_TEXTS = "[" + ", ".join(" || chr(10) || ".join(_quoted(line) for line in head.split("\n")) for head in HEADS) + "]"
_PAGES = f"""pg AS (SELECT doc_id, n_chars, lower(({_TEXTS})[doc_id % {_CYCLE} + 1] || chr(10) || coalesce(text, '')) AS x, ({_TEXTS})[doc_id % {_CYCLE} + 1] || chr(10) || coalesce(text, '') AS raw,
({[*KINDS]})[doc_id % {len(KINDS)} + 1] AS doc FROM documents)"""


def _any(patterns, x: str = "x") -> str:
    return "(" + (" OR ".join(f"regexp_matches({x}, {_quoted(p)})" for p in patterns) or "false") + ")"


def _types_sql() -> str:
    """CTEs pg to ty (doc_id, doc, x, raw, page_type, score)."""
    r = P.RULES
    names = list(r.types)
    counts = ", ".join(" + ".join(f"regexp_matches(x, {_quoted(p)})::INT" for p in r.types[t]) + f" AS n_{t}" for t in names)
    scores = ", ".join(f"CASE WHEN n_{t} > 0 THEN least(0.6::DOUBLE + n_{t} * 0.1::DOUBLE, 0.95::DOUBLE) ELSE 0.0::DOUBLE END AS s_{t}" for t in names)
    best = "CASE WHEN s = 0 THEN 'unknown' " + " ".join(f"WHEN s_{t} = s THEN '{t}'" for t in names) + " END"
    granular = "t IN (" + ", ".join(f"'{t}'" for t in r.granular) + ")"
    general = [f"WHEN {granular} AND n_{t} >= 2 THEN" for t in r.general]
    up = "(n_endorsement > 0 AND (t IN ('coverages', 'exclusions') OR (doc IN ('endorsement', 'bundle', 'policy') AND t = 'conditions' AND (n_endorsement >= 2 OR s_endorsement >= s))))"
    close = [f"WHEN t <> 'unknown' AND n_{t} > 0 AND (s_{t} >= 0.8 OR s_{t} > s - 0.2::DOUBLE) THEN" for t in r.first]
    heads = [
        (_any(r.certificate), "certificate_of_insurance", 0.98), (_any(r.endorsement_header), "endorsement", 0.95),
        ("doc IN ('policy', 'unknown') AND " + _any(r.exclusion_headers), "exclusions", 0.95), ("doc IN ('policy', 'unknown') AND " + _any(r.context_headers), "coverages_context", 0.9),
    ]
    return f"""{_PAGES}, t1 AS (SELECT *, {counts} FROM pg), t2 AS (SELECT *, {scores} FROM t1), t3 AS (SELECT *, greatest({", ".join("s_" + t for t in names)}) AS s FROM t2),
t4 AS (SELECT *, {best} AS t FROM t3),
t5 AS (SELECT * EXCLUDE (t, s), CASE {" ".join(f"{g} '{t}'" for g, t in zip(general, r.general))} ELSE t END AS t, CASE {" ".join(f"{g} s_{t}" for g, t in zip(general, r.general))} ELSE s END AS s FROM t4),
t6 AS (SELECT * EXCLUDE (t, s), CASE WHEN {up} THEN 'endorsement' ELSE t END AS t, CASE WHEN {up} THEN greatest(s, s_endorsement) ELSE s END AS s FROM t5),
t7 AS (SELECT * EXCLUDE (t, s), CASE {" ".join(f"{c} '{t}'" for c, t in zip(close, r.first))} ELSE t END AS t, CASE {" ".join(f"{c} greatest(s, s_{t})" for c, t in zip(close, r.first))} ELSE s END AS s FROM t6),
ty AS (SELECT doc_id, doc, x, raw, n_chars, CASE {" ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in heads)} ELSE t END AS page_type, CASE {" ".join(f"WHEN {c} THEN {v}::DOUBLE" for c, _, v in heads)} ELSE s END AS score FROM t7)"""


@query("f20_page_types", f"WITH {_types_sql()} SELECT doc_id, page_type, round(score, 6)::DOUBLE AS score FROM ty")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", _page().alias("x"), _kind().alias("doc"))
    return P.page_types(rows, "x", "doc").select("doc_id", "page_type", F.round("score", 6).alias("score"))


_ADJUSTED = """a AS (SELECT *, doc_id % 20 + 1 AS page, least(1.0, length(raw) / 4000.0::DOUBLE) AS density, contains(raw, '|') AS tables FROM ty),
b AS (SELECT *, least(1.0, score + CASE WHEN page <= 3 AND page_type = 'declarations' THEN 0.4::DOUBLE WHEN page = 1 THEN 0.25 WHEN page <= 5 THEN 0.1 ELSE 0 END + CASE WHEN density > 0.7 THEN 0.15::DOUBLE ELSE 0 END
+ CASE WHEN tables AND page_type IN ('sov', 'loss_run') THEN 0.15::DOUBLE ELSE 0 END) AS c, density < 0.15 AND page_type = 'unknown' AS bare FROM a),
d AS (SELECT doc_id, page, raw, CASE WHEN bare THEN 'boilerplate' ELSE page_type END AS page_type, round(CASE WHEN bare THEN 0.6 ELSE c END, 3)::DOUBLE AS confidence FROM b)"""


def _signals(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", _page().alias("x"), _kind().alias("doc"))
    rows = P.page_types(rows, "x", "doc").withColumn("page", F.col("doc_id") % 20 + 1)
    density = F.least(F.lit(1.0), F.length("x") / 4000.0)
    found = P.adjusted(F.col("page_type"), F.col("score"), F.col("page"), density, F.contains("x", F.lit("|")))
    return rows.select("doc_id", "page", "x", found.alias("f")).select("doc_id", "page", "x", "f.page_type", "f.confidence")


@query("f21_page_confidence", f"WITH {_types_sql()}, {_ADJUSTED} SELECT doc_id, page_type, confidence, page_type NOT IN ('duplicate', 'boilerplate', 'table_of_contents') AND (page = 1 OR confidence >= 0.7) AS process FROM d")
def _(t: Tables) -> DataFrame:
    return _signals(t).select("doc_id", "page_type", "confidence", P.should_process(F.col("page_type"), F.col("confidence"), F.col("page")).alias("process"))


def _held(table) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(p)} THEN '{name}' END" for name, p in table.items()) + "], lambda v: v IS NOT NULL)"


@query("f22_page_effects", f"""WITH {_PAGES}, e AS (SELECT doc_id, x, {_held(P.RULES.coverage_effects)} AS c, {_held(P.RULES.exclusion_effects)} AS e, {_any(P.RULES.structural)} AS st, {_any(P.RULES.carve_backs)} AS cb FROM pg)
SELECT doc_id, CASE WHEN len(c) > 0 AND (len(e) > 0 OR st) AND cb THEN 'exclusion_modifier' WHEN len(c) > 0 AND (len(e) > 0 OR st) THEN 'both' WHEN len(c) > 0 THEN 'coverage_modifier' WHEN len(e) > 0 OR st THEN 'exclusion_modifier'
{" ".join(f"WHEN {_any(p)} THEN '{name}'" for name, p in P.RULES.roles.items())} ELSE 'unknown' END AS role, array_to_string(c, ',') AS coverage_effects, array_to_string(e, ',') AS exclusion_effects FROM e""")
def _(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", P.effects(_page()).alias("e"))
    return found.select("doc_id", "e.role", F.array_join("e.coverage_effects", ",").alias("coverage_effects"), F.array_join("e.exclusion_effects", ",").alias("exclusion_effects"))


_PREFIX = r"^\s*#*\s*(?:[a-z\d]{1,2}[\.\)]\s+)*"
_SECTION = f"CASE WHEN {_any(P.RULES.exclusion_headers, 'l')} THEN 'exclusions' WHEN {_any(P.RULES.context_headers, 'l')} THEN 'coverages_context' " + " ".join(
    f"WHEN {_any([_PREFIX + p for p in P.RULES.types[name]], 'l')} THEN '{name}'" for name in P.RULES.spans
) + " END"


@query("f23_section_spans", f"""WITH {_PAGES}, l AS (SELECT doc_id, lower(trim(unnest(string_split(raw, chr(10))), ' ')) AS l, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM pg),
m AS (SELECT doc_id, i, CASE WHEN length(l) >= 5 THEN {_SECTION} END AS s FROM l), n AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM m),
o AS (SELECT *, section IS DISTINCT FROM lag(section) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM n WHERE section IS NOT NULL), p AS (SELECT *, sum(c::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o)
SELECT doc_id, span::BIGINT AS span, min(section) AS section, min(i)::INT AS start, max(i)::INT AS "end" FROM p GROUP BY doc_id, span""")
def _(t: Tables) -> DataFrame:
    return P.section_spans(t.documents.select("doc_id", _page().alias("x")), "doc_id", "x")


_KEPT = """o AS (SELECT doc_id // 20 AS k, doc_id AS p, t, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS i FROM w),
f AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS p, NULL::BIGINT AS dup, []::STRUCT(p BIGINT, t VARCHAR[])[] AS kept FROM o WHERE i = 1 UNION ALL
SELECT k, i, p, dup, CASE WHEN dup IS NULL THEN list_append(kept, {'p': p, 't': t}) ELSE kept END FROM (SELECT o.k, o.i, o.p, o.t, f.kept,
list_filter(f.kept, lambda x: len(o.t) > 0 AND len(list_intersect(x.t, o.t)) >= len(list_distinct(list_concat(x.t, o.t))) * 0.8)[1].p AS dup FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1))"""


@query("c2_page_analysis", f"""WITH RECURSIVE {_SETS}, {_KEPT}, {_types_sql()}, {_ADJUSTED},
g AS (SELECT d.doc_id // 20 AS document, d.doc_id, page, CASE WHEN dup IS NOT NULL THEN 'duplicate' ELSE page_type END AS kind, confidence FROM d JOIN f ON f.p = d.doc_id AND f.i > 0),
h AS (SELECT *, kind NOT IN ('duplicate', 'boilerplate', 'table_of_contents') AND (page = 1 OR confidence >= 0.7) AS go, last_value(CASE WHEN kind NOT IN ('unknown', 'duplicate', 'boilerplate') THEN kind END IGNORE NULLS) OVER (PARTITION BY document ORDER BY page) AS section FROM g),
r AS (SELECT *, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY document ORDER BY page) OR row_number() OVER (PARTITION BY document ORDER BY page) = 1 THEN 1 ELSE 0 END AS c FROM h)
SELECT document, count(*) AS pages, count(*) FILTER (WHERE go) AS process, count(*) FILTER (WHERE kind = 'duplicate') AS duplicates, avg(CASE WHEN go THEN 1.0::DOUBLE ELSE 0 END) AS ratio,
sum(c)::BIGINT AS runs, count(DISTINCT section) AS sections, arg_min(kind, page) AS first_kind FROM r GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    words = t.documents.select(F.floor(F.col("doc_id") / 20).alias("document"), "doc_id", _top_words().alias("w"))
    kept = similarity.kept_pages(words, "document", "doc_id", "w")
    pages = kept.join(_signals(t).drop("x"), "doc_id").withColumn("kind", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("page_type")))
    order = Window.partitionBy("document").orderBy("page")
    named = F.when(~F.col("kind").isin("unknown", "duplicate", "boilerplate"), F.col("kind"))
    pages = pages.withColumn("go", P.should_process(F.col("kind"), F.col("confidence"), F.col("page")))
    pages = pages.withColumn("section", F.last(named, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    changed = ~F.col("section").eqNullSafe(F.lag("section").over(order)) | (F.row_number().over(order) == 1)
    return pages.withColumn("c", changed.cast("int")).groupBy("document").agg(
        F.count("*").alias("pages"), F.count_if("go").alias("process"), F.count_if(F.col("kind") == "duplicate").alias("duplicates"), F.avg(F.col("go").cast("double")).alias("ratio"),
        F.sum("c").alias("runs"), F.count_distinct("section").alias("sections"), F.min_by("kind", "page").alias("first_kind"),
    )


@query("f24_page_signals", f"""WITH {_PAGES} SELECT doc_id, len(list_filter(string_split(raw, chr(10)), lambda l: regexp_matches(l, '^#{{1,6}} ')))::BIGINT AS headings, array_to_string(list_filter(string_split(raw, chr(10)), lambda l: trim(l) <> '')[1:2], '|') AS top_lines,
regexp_matches(raw, '\\|.*\\|') AS has_table, regexp_matches(x, 'policy\\s+(?:number|no\\.?)') AS names_policy, regexp_extract(raw, '\\b[A-Z]{{2}} \\d{{2}} \\d{{2}}\\b', 0) AS form, regexp_matches(raw, '^\\s*[a-z]') AS mid_sentence,
least(1.0::DOUBLE, length(raw) / 4000.0::DOUBLE) AS density FROM pg""")
def _(t: Tables) -> DataFrame:
    lines = F.split("x", "\n")
    return t.documents.select("doc_id", _page().alias("x")).select(
        "doc_id", F.size(F.filter(lines, lambda v: v.rlike("^#{1,6} "))).cast("bigint").alias("headings"),
        F.array_join(F.slice(F.filter(lines, lambda v: F.trim(v) != ""), 1, 2), "|").alias("top_lines"), F.col("x").rlike(r"\|.*\|").alias("has_table"),
        F.lower("x").rlike(r"policy\s+(?:number|no\.?)").alias("names_policy"), F.regexp_extract("x", r"\b[A-Z]{2} \d{2} \d{2}\b", 0).alias("form"),
        F.col("x").rlike(r"^\s*[a-z]").alias("mid_sentence"), X.text_density(F.col("x")).alias("density"),
    )
