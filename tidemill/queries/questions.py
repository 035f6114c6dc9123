"""Questions: entities, expansion, terms and filters. Messages of conversations, each after a fixed question, stand for questions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import questions as Q
from tidemill.functions import text as X
from tidemill.queries import Tables, query

#: Asked in turn, so that every pattern comes up.
ASKED = (
    "What is policy POL-12345 and CA-001-2024?", "Compare policy number GL123456 with 12345-POL and POL-A", "Show me WC limits and the E&O deductible",
    "Is Acme Steel Corporation or The Big Policy insured at 123 Main Street, Springfield, IL?", "Effective date 01/15/2024 or 2024-12-31, expiring March 1, 2025",
    "A limit of $1,000,000 or $5000, 2,500,000 dollars and 1.5 million", "Which endorsement modifies the umbrella exclusion in New York, New Jersey?",
    "list", "Does the BPP cover a data breach claim per occurrence, broker Jane Van Doe?", "BI and PD loss",
)


def _text() -> Column:
    asked = F.array(*map(F.lit, ASKED))
    return F.concat(F.get(asked, F.pmod(F.col("turn") + F.col("conv_id"), F.lit(len(ASKED))).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]::VARCHAR[]"


_SOURCE = f"q AS (SELECT conv_id, turn, ({_list(ASKED)})[(turn + conv_id) % {len(ASKED)} + 1] || ' ' || coalesce(text, '') AS x FROM conversations)"


def _all(patterns, any_case: bool = True) -> str:
    """SQL: distinct trimmed matches. RE2 has no lookahead; a character that is no digit, or the end, does here."""
    every = ", ".join(f"regexp_extract_all(x, {_quoted('(?i)' * any_case + p.replace('(?!' + chr(92) + 'd)', '(?:[^0-9]|$)'))}, {g})" for p, g in patterns)
    return f"list_sort(list_distinct(list_filter(list_transform(flatten([{every}]), lambda v: trim(v)), lambda v: v <> '')))"


def _longest(values: str) -> str:
    return f"list_filter({values}, lambda v: len(list_filter({values}, lambda w: w <> v AND contains(w, v))) = 0)"


def _words(rules) -> str:
    return "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN contains(lower(x), {_quoted(w)}) THEN {_list(v)} ELSE []::VARCHAR[] END" for w, v in rules) + "])))"


_COVERAGES = "list_filter([" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(x), {_quoted(w.lower())})" for w in words) + f" THEN {_quoted(name)} END" for name, words in Q.COVERAGES
) + "], lambda v: v IS NOT NULL)"
_NAMES = f"list_filter({_all([(Q.NAMES, 1)], False)}, lambda v: len(list_filter({_list(Q.NO_NAMES)}, lambda w: contains(v, w))) = 0)[1:10]"
_ENTITIES = {
    "policy_numbers": _longest(_all(Q.POLICY_NUMBERS)), "coverage_types": _COVERAGES, "entity_names": _NAMES, "dates": _all(Q.DATES),
    "amounts": _longest(_all(Q.AMOUNTS)), "locations": _all(Q.PLACES, False), "section_hints": _words(Q.SECTION_HINTS),
}


@query("f31_question_entities", f"WITH {_SOURCE} SELECT conv_id, turn, " + ", ".join(f"array_to_string({v}, '|') AS {k}" for k, v in _ENTITIES.items()) + " FROM q")
def _(t: Tables) -> DataFrame:
    found = t.conversations.select("conv_id", "turn", Q.entities(_text()).alias("e"))
    return found.select("conv_id", "turn", *(F.array_join(f"e.{k}", "|").alias(k) for k in _ENTITIES))


#: Begin or end of a text, or a character that is in no word of any script; RE2's word border knows ASCII only.
_EDGE = r"(?:{}|[^\p{{L}}\p{{N}}_])"


def _versions() -> str:
    parts = []
    for term, others in Q.EXPANSIONS:
        others = [o for o in others if o.lower() != term.lower()][:3]
        at = f"strpos(lower(x), {_quoted(term.lower())})"
        made = ", ".join(f"substr(x, 1, {at} - 1) || {_quoted(o)} || substr(x, {at} + {len(term)})" for o in others)
        parts.append(f"CASE WHEN regexp_matches(lower(x), {_quoted(_EDGE.format('^') + term.lower() + _EDGE.format('$'))}) THEN [{made}] ELSE []::VARCHAR[] END")
    return "flatten([[x], " + ", ".join(parts) + "])"


@query("f32_question_expansion", f"""WITH {_SOURCE}, v AS (SELECT conv_id, turn, {_versions()} AS every FROM q)
SELECT conv_id, turn, array_to_string(list_filter(every, lambda w, i: list_position(list_transform(every, lambda u: lower(u)), lower(w)) = i)[1:5], '|') AS versions FROM v""")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(Q.expanded(_text()), "|").alias("versions"))


#: Terms to look up, known and unknown, in any case.
TERMS = ("BI", "bodily injury", "cgl", "Umbrella", "excess liability", "deductible", "sir", "unknown term", "claim", "Addendum", "wc")


@query("f33_term_lookup", "SELECT p_partkey, (" + _list(("bodily injury", "personal injury", "general liability", "excess liability", "umbrella", "self-insured retention",
       "deductible", "unknown term", "incident", "endorsement", "workers compensation")) + f")[p_partkey % {len(TERMS)} + 1] AS term FROM part")
def _(t: Tables) -> DataFrame:
    term = F.get(F.array(*map(F.lit, TERMS)), (F.col("p_partkey") % len(TERMS)).cast("int"))
    return t.part.select("p_partkey", Q.canonical_term(term).alias("term"))


def _defaults(values) -> str:
    return "CASE intent " + " ".join(f"WHEN {_quoted(k)} THEN {_list(v)}" for k, v in values.items()) + " ELSE []::VARCHAR[] END"


@query("f35_question_filters", f"""WITH {_SOURCE}, i AS (SELECT *, CASE (turn + conv_id) % 4 WHEN 0 THEN 'QA' WHEN 1 THEN 'ANALYSIS' WHEN 2 THEN 'AUDIT' ELSE 'GENERAL' END AS intent,
{_ENTITIES["section_hints"]} AS hints, {_COVERAGES} AS coverages FROM q)
SELECT conv_id, turn, array_to_string(list_sort(list_intersect(CASE WHEN len(hints) > 0 THEN hints ELSE {_defaults(Q.INTENT_SECTIONS)} END, {_list(Q.SECTIONS)})), '|') AS sections,
array_to_string(list_sort(CASE WHEN len(coverages) > 0 THEN ['coverage'] ELSE {_defaults(Q.INTENT_ENTITIES)} END), '|') AS kinds FROM i""")
def _(t: Tables) -> DataFrame:
    n = (F.col("turn") + F.col("conv_id")) % 4
    intent = F.when(n == 0, "QA").when(n == 1, "ANALYSIS").when(n == 2, "AUDIT").otherwise("GENERAL")
    asked = t.conversations.select("conv_id", "turn", _text().alias("x"), intent.alias("intent"))
    return asked.select(
        "conv_id", "turn", F.array_join(Q.section_filters(Q.section_hints(F.col("x")), F.col("intent")), "|").alias("sections"),
        F.array_join(Q.entity_filters(Q.coverage_types(F.col("x")), F.col("intent")), "|").alias("kinds"),
    )


_KEYWORDS = (("limit", "amounts"), ("deductible", "amounts"), ("exclusion", "gaps"), ("endorsement", "gaps"), ("claim", "losses"), ("loss", "losses"))
_SECTIONS = {"amounts": ("coverages", "declarations"), "gaps": ("endorsements", "exclusions"), "losses": ("claims", "loss_run", "declarations")}


@query("f30_question_sections", f"WITH {_SOURCE} SELECT conv_id, turn, array_to_string({_words([(w, _SECTIONS[i]) for w, i in _KEYWORDS])}, '|') AS sections FROM q")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(Q.keyword_sections(_text(), _KEYWORDS, _SECTIONS), "|").alias("sections"))


@query("f34_question_meanings", f"""WITH {_SOURCE} SELECT conv_id, turn, array_to_string(list_filter([x, CASE WHEN regexp_matches(lower(x), '\\bbi\\b') THEN 'bodily injury' END,
CASE WHEN regexp_matches(lower(x), '\\bpd\\b') THEN 'property damage' END, CASE WHEN regexp_matches(lower(x), '\\bwc\\b') THEN 'workers compensation' END], lambda v: v IS NOT NULL), ' ') AS t FROM q""")
def _(t: Tables) -> DataFrame:
    meanings = [("BI", "bodily injury"), ("PD", "property damage"), ("WC", "workers compensation")]
    return t.conversations.select("conv_id", "turn", X.with_abbreviations(_text(), meanings).alias("t"))
