"""Page classification by pattern counts with overrides, semantic effects, and spans of sections.

Rules are parameters; :data:`RULES` is a small set to start from. Everything is ``Column`` work on one row
a page, but for spans, which are a window over a page's lines.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Patterns = tuple[str, ...]


@dataclass(frozen=True)
class PageRules:
    """Patterns (of lower-cased text) by page type, in the order in which ties are decided, and the overrides."""

    types: dict[str, Patterns]
    certificate: Patterns = ()
    endorsement_header: Patterns = ()
    exclusion_headers: Patterns = ()
    context_headers: Patterns = ()
    #: Types that give way to one of ``general`` with two patterns or more.
    granular: tuple[str, ...] = ("vehicle_details", "insured_declared_value", "liability_coverages")
    general: tuple[str, ...] = ("declarations", "coverages", "endorsement")
    #: Types that win over others whose score is close.
    first: tuple[str, ...] = ("definitions", "exclusions", "conditions", "limits", "coverage_extension", "coverage_grant", "coverages")
    spans: tuple[str, ...] = ("declarations", "coverages", "exclusions", "endorsement", "definitions", "coverage_grant", "coverage_extension", "limits")
    coverage_effects: dict[str, Patterns] = field(default_factory=dict)
    exclusion_effects: dict[str, Patterns] = field(default_factory=dict)
    roles: dict[str, Patterns] = field(default_factory=dict)
    structural: Patterns = ()
    carve_backs: Patterns = ()


# A few patterns of each kind, on which results depend.
RULES = PageRules(
    types={
        "declarations": (r"declarations", r"policy\s+period", r"named\s+insured", r"policy\s+number"),
        "coverages": (r"coverages?\b", r"insuring\s+agreement", r"what\s+is\s+covered"),
        "coverage_grant": (r"we\s+will\s+pay", r"covered\s+causes\s+of\s+loss"),
        "coverage_extension": (r"coverage\s+extensions?", r"additional\s+coverages?"),
        "limits": (r"limits?\s+of\s+(insurance|liability)",),
        "conditions": (r"conditions", r"duties\s+in\s+the\s+event\s+of", r"cancellation"),
        "exclusions": (r"exclusions", r"what\s+is\s+not\s+covered", r"does\s+not\s+apply\s+to"),
        "endorsement": (r"endorsement", r"this\s+endorsement\s+(changes|modifies)", r"attached\s+to\s+and\s+forms"),
        "definitions": (r"definitions", r"means\s+the\s+following"),
        "vehicle_details": (r"vehicle\s+identification", r"registration\s+number"),
        "liability_coverages": (r"bodily\s+injury\s+liability",),
        "insured_declared_value": (r"insured\s+declared\s+value",),
        "sov": (r"statement\s+of\s+values", r"schedule\s+of\s+locations", r"property\s+schedule"),
        "loss_run": (r"loss\s+run", r"claims\s+history", r"loss\s+history"),
        "boilerplate": (r"iso\s+properties", r"all\s+rights\s+reserved", r"copyright"),
        "table_of_contents": (r"table\s+of\s+contents",),
    },
    certificate=(
        r"this\s+certificate\s+is\s+issued\s+as\s+a\s+matter\s+of\s+information", r"acord\s+2[45]",
        r"certificate\s+of\s+liability\s+insurance", r"certificate\s+of\s+property\s+insurance",
    ),
    endorsement_header=(r"this\s+endorsement\s+changes\s+the\s+policy\.?\s*please\s+read\s+it\s+carefully",),
    exclusion_headers=(r"^##?\s*b\.\s*exclusions?\s*$", r"^##?\s*exclusions?\s*$", r"^##?\s*\d+\.\s*exclusions?\s*$", r"section\s+[ivx]+\s*[-–—]\s*exclusions?"),
    context_headers=(r"covered\s+auto\s+designation\s+symbols?",),
    coverage_effects={
        "adds_coverage": (r"adds?\s+coverage", r"is\s+amended\s+to\s+include", r"additional\s+insured"),
        "expands_coverage": (r"expands?\s+coverage", r"extension\s+of\s+coverage"),
        "limits_coverage": (r"limits?\s+coverage", r"limited\s+to", r"not\s+exceed"),
        "restores_coverage": (r"restores?\s+coverage",),
    },
    exclusion_effects={
        "introduces_exclusion": (r"introduces?\s+exclusion", r"excludes?\b", r"this\s+insurance\s+does\s+not\s+apply\s+to"),
        "narrows_exclusion": (r"narrows?\s+exclusion", r"exclusion\s+[a-z0-9\.\(\)]+\s+does\s+not\s+apply"),
        "removes_exclusion": (r"removes?\s+exclusion", r"deletion\s+of\s+exclusion"),
    },
    roles={
        "coverage_modifier": (r"changes\s+the\s+policy", r"modifies\s+coverage"),
        "exclusion_modifier": (r"removes?\s+coverage", r"limitation\s+of"),
        "administrative_only": (r"administrative\s+change", r"notice\s+of\s+cancellation", r"mailing\s+address"),
    },
    structural=(r"section\s+iii.*exclusions?", r"paragraph\s+b\.3\.,\s+exclusions"),
    carve_backs=(r"exclusion\s+[a-z0-9\.\(\)]+\s+does\s+not\s+apply", r"does\s+not\s+apply\s+to\s+one\s+or\s+more"),
)


def _any(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def _count(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(p).cast("int")
    return out


def page_types(df: DataFrame, text: str, document: str | None = None, rules: PageRules = RULES) -> DataFrame:
    """``df`` with page_type and score: the type with most patterns (score 0.6 + 0.1 each, at most 0.95), then the overrides.

    ``document``: a column with the kind of the whole document (policy, bundle, endorsement, or unknown for null).
    Without any pattern the type is unknown (0).
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    kind = F.coalesce(F.col(document), F.lit("unknown")) if document else F.lit("unknown")
    names = list(rules.types)
    out = df.withColumn("_n", F.array(*(_count(low, p) for p in rules.types.values())))
    n = {name: F.get("_n", F.lit(i)) for i, name in enumerate(names)}
    s = {name: F.when(n[name] > 0, F.least(0.6 + n[name] * F.lit(0.1), F.lit(0.95))).otherwise(0.0) for name in names}
    out = out.withColumn("_s", F.array_max(F.array(*s.values())))
    best = F.lit("unknown")
    for name in reversed(names):
        best = F.when((F.col("_s") > 0) & (s[name] == F.col("_s")), name).otherwise(best)
    out = out.withColumn("_t", best)
    # Granular types give way.
    step, score = F.col("_t"), F.col("_s")
    for name in reversed(rules.general):
        up = F.col("_t").isin(*rules.granular) & (n[name] >= 2)
        step, score = F.when(up, name).otherwise(step), F.when(up, s[name]).otherwise(score)
    out = out.withColumns({"_t": step, "_s": score})
    # An endorsement shows itself.
    t, top = F.col("_t"), F.col("_s")
    mine = s["endorsement"]
    up = (n["endorsement"] > 0) & (t.isin("coverages", "exclusions") | (
        kind.isin("endorsement", "bundle", "policy") & (t == "conditions") & ((n["endorsement"] >= 2) | (mine >= top))
    ))
    out = out.withColumns({"_t": F.when(up, "endorsement").otherwise(t), "_s": F.when(up, F.greatest(top, mine)).otherwise(top)})
    # The fixed order of types, where scores are close.
    step, score = t, top
    for name in reversed(rules.first):
        up = (t != "unknown") & (n[name] > 0) & ((s[name] >= 0.8) | (s[name] > top - 0.2))
        step, score = F.when(up, name).otherwise(step), F.when(up, F.greatest(top, s[name])).otherwise(score)
    out = out.withColumns({"_t": step, "_s": score})
    plain = kind.isin("policy", "unknown")
    heads = [
        (_any(low, rules.certificate), "certificate_of_insurance", 0.98), (_any(low, rules.endorsement_header), "endorsement", 0.95),
        (plain & _any(low, rules.exclusion_headers), "exclusions", 0.95), (plain & _any(low, rules.context_headers), "coverages_context", 0.90),
    ]
    step, score = t, top
    for held, name, sure in reversed(heads):
        step, score = F.when(held, name).otherwise(step), F.when(held, sure).otherwise(score)
    return out.withColumns({"page_type": step, "score": score}).drop("_n", "_s", "_t")


def adjusted(page_type: Column, score: Column, page: Column, density: Column, tables: Column, font: Column | None = None) -> Column:
    """Struct of page_type and confidence after what the page looks like; additive, at most 1, three digits."""
    points = F.when((page <= 3) & (page_type == "declarations"), 0.40).when(page == 1, 0.25).when(page <= 5, 0.10).otherwise(0.0)
    points = points + F.when(density > 0.7, 0.15).otherwise(0.0)
    if font is not None:
        points = points + F.when(font > 18, 0.10).otherwise(0.0)
    points = points + F.when(tables & page_type.isin("sov", "loss_run"), 0.15).otherwise(0.0)
    bare = (density < 0.15) & (page_type == "unknown")
    confidence = F.when(bare, 0.6).otherwise(F.least(F.lit(1.0), score + points))
    return F.struct(F.when(bare, "boilerplate").otherwise(page_type).alias("page_type"), F.round(confidence, 3).alias("confidence"))


def should_process(page_type: Column, confidence: Column, page: Column, least: float = 0.7) -> Column:
    """Never duplicates, boilerplate or contents; the first page always; others from a confidence on."""
    return ~page_type.isin("duplicate", "boilerplate", "table_of_contents") & ((page == 1) | (confidence >= least))


def effects(text: Column, rules: PageRules = RULES) -> Column:
    """Struct of role and the effects on coverages and exclusions that a text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = lambda table: F.filter(F.array(*(F.when(_any(low, p), name) for name, p in table.items())), lambda x: x.isNotNull())
    covers, excludes = held(rules.coverage_effects), held(rules.exclusion_effects)
    some, not_ = F.size(covers) > 0, F.size(excludes) > 0
    structural, carved = _any(low, rules.structural), _any(low, rules.carve_backs)
    direct = F.lit("unknown")
    for name, patterns in reversed(rules.roles.items()):
        direct = F.when(_any(low, patterns), name).otherwise(direct)
    both = some & (not_ | structural)
    role = F.when(both & carved, "exclusion_modifier").when(both, "both").when(some, "coverage_modifier")
    role = role.when(not_ | structural, "exclusion_modifier").otherwise(direct)
    return F.struct(role.alias("role"), covers.alias("coverage_effects"), excludes.alias("exclusion_effects"))


def section_spans(df: DataFrame, key: str, text: str, rules: PageRules = RULES) -> DataFrame:
    """key, section, start and end (lines from 1): a section goes on until a line starts with another one's pattern.

    The pattern may follow marks of a heading and a number. Lines before the first section belong to none.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_line"))
    low = F.lower(F.trim("_line"))
    section = F.lit(None).cast("string")
    for name in reversed(rules.spans):
        section = F.when(_any(low, [r"^\s*#*\s*(?:[a-z\d]{1,2}[\.\)]\s+)*" + p for p in rules.types[name]]), name).otherwise(section)
    section = F.when(_any(low, rules.exclusion_headers), "exclusions").when(_any(low, rules.context_headers), "coverages_context").otherwise(section)
    order = Window.partitionBy(key).orderBy("_i")
    at = lines.select(key, (F.col("_i") + 1).alias("_i"), F.when(F.length(low) >= 5, section).alias("_s"))
    at = at.withColumn("section", F.last("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.where(F.col("section").isNotNull())
    new = (~F.col("section").eqNullSafe(F.lag("section").over(order))).cast("int")
    at = at.withColumn("_new", new).withColumn("span", F.sum("_new").over(order))
    return at.groupBy(key, "span").agg(F.first("section").alias("section"), F.min("_i").alias("start"), F.max("_i").alias("end"))


#: Names that say nothing, and how references to sections begin.
GENERIC_NAMES = (
    "the policy", "policy", "this policy", "the insured", "insured", "coverage", "exclusion", "endorsement", "schedule",
    "declarations", "form", "section", "paragraph", "item", "part", "provision",
)
SECTION_REFERENCES = (r"^SECTION\s+[IVX\d]+", r"^PART\s+[A-Z\d]+", r"^PARAGRAPH\s+[A-Z\d\.]+", r"^\d+\.\s+[A-Z]", r"^[A-Z]\.\d+")


def reject_reason(kind: Column, name: Column, confidence: Column) -> Column:
    """Why a coverage or exclusion is of low quality, null for one that isn't, for other kinds and without a name.

    The first of: confidence (0.8 where missing) under 0.85, a generic name, a reference to a section, a name of under 5
    characters without its article.
    """
    low = F.lower(F.trim(name))
    reason = F.when(F.coalesce(confidence, F.lit(0.8)) < 0.85, "low_confidence").when(low.isin(*GENERIC_NAMES), "generic_names")
    reason = reason.when(name.rlike("(?i)" + "|".join(SECTION_REFERENCES)), "section_references")
    reason = reason.when(F.length(F.trim(F.regexp_replace(low, r"^(the|a|an)\s+", ""))) < 5, "short_names")
    return F.when(F.lower(kind).isin("coverage", "exclusion") & (name != ""), reason)
