"""What a question asks for: policy numbers, coverages, names, dates, amounts, places, sections, and the filters that follow.

All are ``Column`` expressions over a text column, in the JVM. A null text gives null or empty arrays.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import as_re2, longest_only

# Patterns and word lists that results depend on. --------------------------------------

#: (pattern, group), any case.
POLICY_NUMBERS = (
    (r"\bpolicy\s+(?:number\s+)?([A-Z0-9\-_]{3,15})\b", 1),
    (r"\b[A-Z]{2,5}[-_]\d{3,10}(?:[-_]\d{2,4})?\b", 0),
    (r"\b[A-Z]{2,5}\d{5,10}\b", 0),
    (r"\b\d{3,10}[-_][A-Z]{2,5}\b", 0),
    (r"\b[A-Z]{3,5}[-_][A-Z]\b", 0),
)
DATES = (
    (r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", 1),
    (r"\b(\d{4}[/-]\d{1,2}[/-]\d{1,2})\b", 1),
    (r"\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{2,4})\b", 1),
)
AMOUNTS = (
    (r"\$\s*(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?)", 1),
    (r"\b(\d{1,3}(?:,\d{3})+)\s*(?:dollars?|USD)\b", 1),
    (r"\$\s*(\d{1,4})(?!\d)", 1),
    (r"\b(\d+(?:\.\d+)?)\s*(?:million|M)\b", 1),
)
#: (pattern, group), case as given.
PLACES = (
    (r"\b(\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln))\b", 1),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z]{2})\b", 1),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z]{2})\b", 2),
    (r"\b((?:[A-Z][a-z]+\s*)+),\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 1),
    (r"\b((?:[A-Z][a-z]+\s*)+),\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 2),
)
NAMES = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b"
NO_NAMES = (
    "What", "When", "Where", "Who", "How", "Why", "Which", "The", "This", "That", "These", "Those",
    "Policy", "Coverage", "Endorsement", "Exclusion",
)
COVERAGES = (
    ("general liability", ("general liability", "GL", "CGL", "commercial general liability")),
    ("auto liability", ("auto liability", "AL", "automobile liability", "commercial auto")),
    ("workers compensation", ("workers compensation", "workers comp", "WC")),
    ("professional liability", ("professional liability", "PL", "E&O", "errors and omissions")),
    ("property", ("property", "building", "BPP", "business personal property")),
    ("umbrella", ("umbrella", "excess liability", "excess")),
    ("cyber", ("cyber", "cyber liability", "data breach")),
    ("directors and officers", ("D&O", "directors and officers", "management liability")),
)
SECTION_HINTS = (
    ("deductible", ("coverages", "declarations", "limits_deductibles")),
    ("limit", ("coverages", "declarations", "limits_deductibles")),
    ("coverage", ("coverages", "schedule")),
    ("exclusion", ("exclusions",)),
    ("exclude", ("exclusions",)),
    ("endorsement", ("endorsements",)),
    ("modification", ("endorsements",)),
    ("insured", ("insured_info", "declarations")),
    ("carrier", ("policy_info", "declarations")),
    ("broker", ("policy_info",)),
    ("location", ("locations", "schedule")),
    ("premium", ("declarations", "policy_info")),
    ("effective date", ("declarations", "policy_info")),
    ("expiration", ("declarations", "policy_info")),
    ("claim", ("claims", "loss_run")),
    ("loss", ("claims", "loss_run")),
    ("declaration", ("declarations",)),
)
#: A term, and what may stand for it.
EXPANSIONS = (
    ("deductible", ("deductible", "self-insured retention", "SIR", "retention")),
    ("SIR", ("SIR", "self-insured retention", "retention", "deductible")),
    ("BI", ("BI", "bodily injury", "personal injury")),
    ("PD", ("PD", "property damage", "physical damage")),
    ("BIPD", ("BIPD", "bodily injury and property damage", "BI/PD")),
    ("GL", ("GL", "general liability", "CGL", "commercial general liability")),
    ("CGL", ("CGL", "commercial general liability", "GL", "general liability")),
    ("AL", ("AL", "auto liability", "automobile liability")),
    ("PL", ("PL", "professional liability", "E&O", "errors and omissions")),
    ("E&O", ("E&O", "errors and omissions", "professional liability")),
    ("BPP", ("BPP", "business personal property")),
    ("building", ("building", "structure", "premises")),
    ("WC", ("WC", "workers compensation", "workers comp")),
    ("EL", ("EL", "employers liability")),
    ("umbrella", ("umbrella", "excess liability", "excess")),
    ("excess", ("excess", "umbrella", "excess liability")),
    ("per occurrence", ("per occurrence", "each occurrence", "per claim")),
    ("aggregate", ("aggregate", "general aggregate", "total limit")),
    ("CSL", ("CSL", "combined single limit")),
    ("split limit", ("split limit", "split limits", "separate limits")),
    ("COI", ("COI", "certificate of insurance", "certificate")),
    ("COB", ("COB", "certificate of occupancy")),
    ("dec page", ("dec page", "declarations", "declaration page")),
    ("endorsement", ("endorsement", "rider", "addendum", "modification")),
    ("rider", ("rider", "endorsement", "addendum")),
    ("loss", ("loss", "claim", "incident")),
    ("claim", ("claim", "loss", "incident")),
    ("AI", ("AI", "additional insured", "additional named insured")),
    ("additional insured", ("additional insured", "AI", "named insured")),
    ("NI", ("NI", "named insured")),
    ("CMP", ("CMP", "commercial multi-peril", "package policy")),
    ("BOP", ("BOP", "business owners policy", "businessowners")),
    ("exclusion", ("exclusion", "excluded", "not covered")),
    ("condition", ("condition", "requirement", "provision")),
)
SECTIONS = (
    "coverages", "exclusions", "conditions", "endorsements", "declarations", "schedule", "locations", "claims", "loss_run",
    "policy_info", "insured_info", "additional_insureds", "limits_deductibles", "forms", "definitions", "evidence",
)
#: Sections and kinds of entity that an intent looks in where the question names none.
INTENT_SECTIONS = {
    "QA": ("declarations", "coverages", "schedule"),
    "ANALYSIS": ("coverages", "endorsements", "exclusions", "conditions"),
    "AUDIT": ("endorsements", "loss_run", "claims", "conditions"),
}
INTENT_ENTITIES = {
    "QA": ("policy", "organization", "coverage", "exclusion"),
    "ANALYSIS": ("coverage", "endorsement", "exclusion", "condition"),
    "AUDIT": ("endorsement", "claim", "coverage"),
}
#: What a section's boost is in ranking, by intent.
SECTION_BOOSTS = {
    "QA": {"declarations": 0.15, "coverages": 0.12, "exclusions": 0.10, "schedule": 0.10, "policy_info": 0.08, "insured_info": 0.08,
           "conditions": 0.06, "definitions": 0.06},
    "ANALYSIS": {"coverages": 0.15, "endorsements": 0.12, "exclusions": 0.10, "conditions": 0.08, "limits_deductibles": 0.08},
    "AUDIT": {"endorsements": 0.15, "loss_run": 0.12, "claims": 0.10, "conditions": 0.08, "evidence": 0.08},
}

# Expressions ------------------------------------------------------------------------------------------

def _strings(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def _found(text: Column, patterns: Sequence[tuple[str, int]], any_case: bool = True) -> Column:
    """Distinct trimmed matches of all patterns, sorted. A word's border is one of ASCII, as RE2 has it."""
    every = [F.regexp_extract_all(text, F.lit(as_re2(p, any_case)), F.lit(group)) for p, group in patterns]
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(*every), lambda x: F.trim(x)), lambda x: x != "")))


def _by_words(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Values of all rules whose word the lower-cased text contains; distinct, sorted."""
    low = F.lower(text)
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*(F.when(low.contains(word), _strings(*values)).otherwise(none) for word, values in rules))))


def policy_numbers(text: Column) -> Column:
    return longest_only(_found(text, POLICY_NUMBERS))


def dates(text: Column) -> Column:
    return _found(text, DATES)


def amounts(text: Column) -> Column:
    return longest_only(_found(text, AMOUNTS))


def places(text: Column) -> Column:
    return _found(text, PLACES, any_case=False)


def coverage_types(text: Column) -> Column:
    """Coverages one of whose names the text contains, in any case, in the order of the list."""
    low = F.lower(text)
    held = [F.when(reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in words)), name) for name, words in COVERAGES]
    return F.filter(F.array(*held), lambda x: x.isNotNull())


def entity_names(text: Column, most: int = 10) -> Column:
    """Runs of two to four capitalised words that hold none of ``NO_NAMES``; sorted, the first ``most``."""
    clean = F.filter(_found(text, [(NAMES, 1)], any_case=False), lambda x: ~F.exists(_strings(*NO_NAMES), lambda w: x.contains(w)))
    return F.slice(clean, 1, most)


def section_hints(text: Column) -> Column:
    return _by_words(text, SECTION_HINTS)


def keyword_sections(text: Column, keywords: Sequence[tuple[str, str]], sections: dict[str, Sequence[str]]) -> Column:
    """Union of the sections of all intents one of whose keywords the text contains."""
    return _by_words(text, [(word, sections[intent]) for word, intent in keywords])


def entities(text: Column) -> Column:
    """All of these as one struct."""
    return F.struct(
        policy_numbers(text).alias("policy_numbers"), coverage_types(text).alias("coverage_types"), entity_names(text).alias("entity_names"),
        dates(text).alias("dates"), amounts(text).alias("amounts"), places(text).alias("locations"), section_hints(text).alias("section_hints"),
    )


#: A character of a word, in any script.
_WORD = r"[\p{L}\p{N}_]"


def _literal(term: str) -> str:
    return r"\Q" + term + r"\E"


def expanded(text: Column, terms: Sequence[tuple[str, Sequence[str]]] = EXPANSIONS, per_term: int = 3, total: int = 5) -> Column:
    """The text, then versions of it with the first stand of a term replaced; at most ``total``, distinct in lower case.

    A term counts where it stands as a word, in any case; its own alternatives follow in order, ``per_term`` of them.
    """
    none = F.array().cast("array<string>")
    found = [F.array(text)]
    for term, others in terms:
        others = [o for o in others if o.lower() != term.lower()][:per_term]
        at = F.instr(F.lower(text), term.lower())
        versions = F.array(*(F.concat(F.substring(text, F.lit(1), at - 1), F.lit(o), F.substring(text, at + len(term), F.length(text))) for o in others))
        found.append(F.when(F.lower(text).rlike(rf"(?<!{_WORD}){_literal(term.lower())}(?!{_WORD})"), versions).otherwise(none))
    every = F.concat(*found)
    lows = F.transform(every, F.lower)
    first = F.filter(every, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)
    return F.slice(first, 1, total)


def term_forms(term: Column, terms: Sequence[tuple[str, Sequence[str]]] = EXPANSIONS) -> Column:
    """All forms of a term: those listed under it (in lower case), else of the first list that holds it, else itself."""
    low = F.lower(term)
    out = F.array(term)
    for _, forms in reversed(terms):
        out = F.when(low.isin(*(f.lower() for f in forms)), _strings(*forms)).otherwise(out)
    for key, forms in terms:
        out = F.when(low == key, _strings(*forms)).otherwise(out)
    return out


def canonical_term(term: Column, terms: Sequence[tuple[str, Sequence[str]]] = EXPANSIONS) -> Column:
    """The first form of a term that is longer than it, else its first form."""
    forms = term_forms(term, terms)
    return F.coalesce(F.get(F.filter(forms, lambda x: F.length(x) > F.length(term)), F.lit(0)), F.get(forms, F.lit(0)), term)


def _by_intent(intent: Column, values: dict[str, Sequence[str]]) -> Column:
    out = F.array().cast("array<string>")
    for name, some in values.items():
        out = F.when(intent == name, _strings(*some)).otherwise(out)
    return out


def section_filters(hints: Column, intent: Column) -> Column:
    """Valid hints, or the intent's own sections where there are no hints at all; sorted."""
    return F.array_sort(F.array_intersect(F.when(F.size(hints) > 0, hints).otherwise(_by_intent(intent, INTENT_SECTIONS)), _strings(*SECTIONS)))


def entity_filters(coverages: Column, intent: Column) -> Column:
    """Coverages where the question names one, or else the intent's own kinds of entity; sorted."""
    return F.array_sort(F.when(F.size(coverages) > 0, _strings("coverage")).otherwise(_by_intent(intent, INTENT_ENTITIES)))
