"""Sections' extracted data (JSON) to entities, by rules that are registered for each kind of section.

Rules are rows, joined to the sections by their kind, so one plan serves all kinds, those that a user registers too. Everything runs in the JVM.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import slug

#: The most kinds of section that a registry may hold, as its rows are broadcast.
MOST = 1000
_RULES = "section string, kind string, prefix string, inside boolean, items array<string>, names array<string>, numbered string, sure double, whole boolean, fields array<struct<name: string, sources: array<string>>>"


@dataclass(frozen=True)
class Rules:
    """How the items of a section become entities.

    ``items``: keys under which the list may be; ``names``: keys of an item that may name it; an item without a name is left out, or
    called by ``numbered`` and its number. ``fields``: attributes and the keys they come from, none for the whole item. ``inside``: whether the data may
    stand under extracted_data, fields or attributes.
    """

    kind: str
    prefix: str
    items: tuple[str, ...]
    names: tuple[str, ...]
    fields: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    numbered: str | None = None
    inside: bool = False
    sure: float = 0.9


def _same(*names: str) -> dict[str, tuple[str, ...]]:
    return {n: (n,) for n in names}


def _schedule(kind: str, prefix: str, *names: str) -> Rules:
    return Rules(kind, prefix, ("items", f"{kind.lower()}s"), names, numbered="item")


_COVERAGE = ("coverage_name", "coverage_label", "name")
_SOV = Rules("Location", "loc", ("locations", "properties", "items"), ("address", "location_description", "description", "location_id", "location_number", "bldg", "building_number"),
             {"location_id": ("location_id", "location_number", "bldg", "building_number"), "address": ("address", "location_description", "description"), **_same("construction_type")},
             numbered="location", inside=True)
#: Keys and attributes of the kinds of section that documents have.
BUILT_IN: dict[str, Rules] = {
    "coverages": Rules("Coverage", "cov", ("coverages", "items"), _COVERAGE, {"name": _COVERAGE, **_same(
        "coverage_type", "coverage_part", "description", "per_occurrence_limit", "aggregate_limit", "deductible_amount", "deductible_type")}, inside=True),
    "limits": Rules("Limit", "lim", ("limits", "items"), ("limit_name", "coverage_name", "name"), {
        "limit_name": ("limit_name", "coverage_name", "name"), "limit_amount": ("limit_amount", "amount"), **_same("limit_type", "per_occurrence", "aggregate", "applies_to")}),
    "deductibles": Rules("Deductible", "ded", ("deductibles", "items"), ("deductible_name", "coverage_name", "name"), {
        "deductible_name": ("deductible_name", "coverage_name", "name"), "deductible_amount": ("deductible_amount", "amount"), **_same("deductible_type", "per_occurrence", "applies_to", "description")}),
    "definitions": Rules("Definition", "def", ("definitions", "items"), ("term", "definition_term"), {
        "term": ("term", "definition_term"), "definition_text": ("definition_text", "definition")}, inside=True),
    "conditions": Rules("Condition", "cond", ("conditions", "items"), ("title", "condition_title", "name"), {
        "title": ("title", "condition_title", "name"), **_same("condition_type", "description", "applies_to", "requirements", "consequences")}, inside=True),
    "exclusions": Rules("Exclusion", "excl", ("exclusions", "items"), ("title", "exclusion_title", "name"), {
        "title": ("title", "exclusion_title", "name"), **_same("exclusion_type", "description", "applies_to", "exceptions", "reference")}),
    "endorsements": Rules("Endorsement", "end", ("endorsements", "items"), ("form_number", "endorsement_number", "number", "title", "endorsement_title", "name"), {
        "endorsement_number": ("form_number", "endorsement_number", "number"), "title": ("title", "endorsement_title", "name", "form_number", "endorsement_number", "number"),
        **_same("description", "effective_date")}, inside=True),
    "sov": _SOV, "schedule_of_values": _SOV, "statement_of_values": _SOV,
    "loss_runs": Rules("Claim", "clm", ("claims", "losses", "items"), ("claim_number", "loss_number"), {
        "claim_number": ("claim_number", "loss_number"), "cause_of_loss": ("loss_type", "cause_of_loss"), "loss_date": ("loss_date", "date_of_loss"),
        "reported_date": ("reported_date", "report_date")}, inside=True),
    "premium_schedule": _schedule("Premium", "prem", "coverage_name", "name"),
    "rate_schedule": _schedule("Rate", "rate", "coverage_name", "name"),
    "vehicle_schedule": _schedule("Vehicle", "veh", "vin", "vehicle_number", "unit"),
    "driver_schedule": _schedule("Driver", "drv", "license_number", "driver_name", "name"),
}


class Registry:
    """Rules by kind of section."""

    def __init__(self, rules: Mapping[str, Rules] = BUILT_IN) -> None:
        self._rules = dict(rules)

    def __iter__(self) -> Iterator[str]:
        return iter(self._rules)

    def register(self, section: str, rules: Rules) -> None:
        """Adds rules for a kind of section, or puts them in the place of those it had."""
        if section not in self._rules and len(self._rules) >= MOST:
            raise ValueError(f"more than {MOST} kinds of section")
        self._rules[section] = rules

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (s, r.kind, r.prefix, r.inside, list(r.items), list(r.names), r.numbered, r.sure, not r.fields, [(n, list(k)) for n, k in r.fields.items()])
            for s, r in self._rules.items()
        ]
        return spark.createDataFrame(rows, _RULES)


def _first(data: Column, keys: Column) -> Column:
    """The first value of a map under one of the keys that isn't blank, or the one under the last key."""
    values = F.transform(keys, lambda k: F.try_element_at(data, k))
    some = F.filter(values, lambda v: ~F.coalesce(v.isin("", "[]", "{}"), F.lit(True)))
    return F.coalesce(F.get(some, F.lit(0)), F.try_element_at(values, F.lit(-1)))


def entities(sections: DataFrame, registry: Registry, key: str = "doc_id") -> DataFrame:
    """key, section, place, kind, entity_id, name, confidence and attributes (texts; nested values as JSON) of the items of sections.

    ``sections``: key, section (a kind) and data (JSON). Sections of a kind without rules, broken JSON, and items that are no objects give
    nothing. A list may be one object. An item's own attributes object counts as the item for its names and fields.
    """
    rules = registry.table(sections.sparkSession)
    rows = sections.select(key, "section", F.from_json("data", "map<string,string>").alias("_d")).join(F.broadcast(rules), "section")
    block = _first(F.col("_d"), F.array(*map(F.lit, ("extracted_data", "fields", "attributes"))))
    inner = F.from_json(F.when(F.col("inside"), block), "map<string,string>")
    rows = rows.withColumn("_d", F.coalesce(F.when(F.size(inner) > 0, inner), F.col("_d")))
    found = _first(F.col("_d"), F.col("items"))
    rows = rows.withColumn("_i", F.from_json(F.when(F.startswith(found, F.lit("[")), found).otherwise(F.concat(F.lit("["), found, F.lit("]"))), "array<string>"))
    rows = rows.select("*", F.posexplode("_i").alias("place", "_item")).where(F.startswith("_item", F.lit("{")))
    rows = rows.withColumn("_item", F.from_json("_item", "map<string,string>"))
    own = F.from_json(F.try_element_at("_item", F.lit("attributes")), "map<string,string>")
    rows = rows.withColumn("_own", F.coalesce(F.when(F.size(own) > 0, own), F.col("_item")))
    name = F.nullif(_first(F.col("_own"), F.col("names")), F.lit(""))
    name = F.coalesce(name, F.concat("numbered", F.lit("_"), (F.col("place") + 1).cast("string")))
    listed = F.filter(F.transform("fields", lambda f: F.struct(f["name"].alias("k"), _first(F.col("_own"), f["sources"]).alias("v"))), lambda x: x["v"].isNotNull())
    attributes = F.when(F.col("whole"), F.map_filter("_own", lambda _, v: v.isNotNull())).otherwise(F.map_from_entries(listed))
    return rows.withColumn("name", name).where("name IS NOT NULL").select(
        key, "section", "place", "kind", F.concat_ws("_", "prefix", slug(F.col("name"))).alias("entity_id"), "name",
        F.coalesce(F.try_element_at("_item", F.lit("confidence")).try_cast("double"), F.col("sure")).alias("confidence"), attributes.alias("attributes"),
    )
