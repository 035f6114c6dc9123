"""Texts of sections for search: one line for each field that a kind of section has, and its keywords."""
from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.records import MISSING
from tidemill.functions.text import title_case

#: Keys under which a field may be, first match first.
FIELDS = {
    "policy_number": ("policy_number", "policy_no", "policy_id", "policy_number_value", "pol_no"),
    "named_insured": ("named_insured", "insured_name", "client_name", "entity_name", "policyholder"),
    "mailing_address": ("mailing_address", "insured_address", "address", "mailing_addr", "addr"),
    "policy_period_start": ("policy_period_start", "effective_date", "inception_date", "start_date", "eff_date"),
    "policy_period_end": ("policy_period_end", "expiration_date", "expiry_date", "end_date", "exp_date"),
    "producer_name": ("producer_name", "broker_name", "agent_name", "agency_name", "producer"),
    "premium_total": ("premium_total", "total_premium", "premium_amount", "amount_due", "total_amount"),
    "limit_occurrence": ("limit_occurrence", "per_occurrence", "occurrence_limit", "limit_amount", "limit"),
    "limit_aggregate": ("limit_aggregate", "aggregate_limit", "aggregate_amount", "aggregate"),
    "deductible_amount": ("deductible_amount", "deductible", "ded_amount", "deductible_value", "ded"),
    "vin": ("vin", "vehicle_identification_number", "serial_number"),
    "vehicle_id": ("vehicle_id", "id", "unit_number", "unit_no"),
    "driver_id": ("driver_id", "id", "driver_number"),
    "license_number": ("license_number", "driver_license", "dl_number"),
}
#: Words that go below the text of a kind of section.
KEYWORDS = {
    "declarations": "policy, insured, coverage, effective, premium, terms, named insured, policy number",
    "coverages": "limit, coverage, protection, sublimit, deductible",
    "exclusions": "exclusion, not covered, excluded, exception, limitation",
    "endorsements": "amendment, change, endorsement, modification, rider, addendum",
    "schedule_of_values": "location, property, TIV, total insured value, address, occupancy",
    "sov": "location, property, TIV, total insured value, address, occupancy",
    "loss_run": "claim, loss, incident, damage, paid, reserved, incurred, claims history, past losses",
    "premium_summary": "premium, payment, cost, charge, fee, amount, commission, taxes",
    "conditions": "condition, requirement, obligation, provision, clause",
    "locations": "location, address, physical address, premises, site",
    "notice_of_claim": "claim, loss, incident, notice, fnol, report",
    "fnol": "claim, loss, incident, notice, fnol, report",
    "vehicle_schedule": "vehicle, vin, auto, car, truck, make, model",
    "driver_schedule": "driver, license, full name, violations, accidents",
    "definitions": "definition, defined, meaning, terminology, glossary, terms",
}
#: Other names of kinds of section.
ALIASES = {
    "sov": "schedule_of_values", "premium": "premium_summary", "dec": "declarations", "fnol": "notice_of_claim", "first_notice_of_loss": "notice_of_claim",
    "location": "locations", "driver": "driver_schedule", "vehicle": "vehicle_schedule",
}
UNSET, NESTED = "Not specified", ("entities", "coverages", "claims", "locations", "endorsements", "exclusions")
IMPORTANT = ("id", "number", "name", "date", "amount", "value")


def money(amount: Column, currency: Column | None = None) -> Column:
    """An amount with its sign and two decimals; a text that is no amount as it is."""
    number = F.regexp_replace(amount, "[,$₹]", "").try_cast("double")
    text = F.format_number(number, 2)
    code = F.coalesce(currency, F.lit("USD")) if currency is not None else F.lit("USD")
    shown = F.when(code == "USD", F.concat(F.lit("$"), text)).when(code == "INR", F.concat(F.lit("₹"), text)).otherwise(F.concat_ws(" ", text, code))
    return F.when(amount.isNull(), UNSET).when(number.isNull(), amount).otherwise(shown)


def _piece(*keys: str, known: str = "", paid: bool = False, before: str = "", after: str = "", unset: str = "", counts: bool = True, currency: bool = False) -> dict:
    """A part of a line: the first value under these keys that isn't empty, or under those of a field that isn't a text for "missing"."""
    return {"keys": list(FIELDS[known] if known else keys), "strict": bool(known), "paid": paid, "before": before, "after": after, "unset": unset, "counts": counts, "currency": currency}


def _line(label: str, *pieces: dict, always: bool = False, every: bool = False) -> dict:
    """Shown if one of its pieces that count has a value (``every``: all of them)."""
    return {"label": label, "pieces": list(pieces), "always": always, "every": every}


def _plain(label: str, *keys: str) -> dict:
    return _line(label, _piece(*keys))


def _paid(label: str, *keys: str) -> dict:
    return _line(label, _piece(*keys, paid=True))


def _known(label: str, field: str, paid: bool = False) -> dict:
    return _line(label, _piece(known=field, paid=paid))


#: Title and lines of each kind of section.
TEMPLATES: dict[str, tuple[str, list[dict]]] = {
    "declarations": ("Declarations", [
        _known("Policy Number", "policy_number"), _known("Named Insured", "named_insured"), _known("Mailing Address", "mailing_address"),
        _line("Policy Period", _piece(known="policy_period_start", unset=UNSET), _piece(known="policy_period_end", before=" to ", unset=UNSET)), _known("Producer", "producer_name"),
        _plain("Forms", "form_numbers", "forms"), _line("Total Premium", _piece(known="premium_total", paid=True, currency=True)),
    ]),
    "coverages": ("Coverage", [
        _plain("Coverage Name", "coverage_name", "name"), _line("Included", _piece("included", unset="Yes"), always=True),
        _known("Per Occurrence Limit", "limit_occurrence", paid=True), _known("Aggregate Limit", "limit_aggregate", paid=True),
        _line("Deductible", _piece(known="deductible_amount", paid=True), _piece("deductible_type", before=" (", after=")", counts=False)),
        _line("Sublimit", _piece("sublimit_name"), _piece("sublimit_amount", paid=True, before=" ")),
    ]),
    "exclusions": ("Exclusion", [
        _plain("Exclusion Name", "exclusion_name", "name"), _line("Manuscript", _piece("manuscript", unset="No"), always=True), _plain("Clause Summary", "exclusion_clause", "description"),
        _plain("Source Page", "page_reference", "source_page"),
    ]),
    "endorsements": ("Endorsement", [
        _plain("Endorsement Number", "endorsement_number"), _plain("Title", "endorsement_title", "title"), _plain("Effective Date", "endorsement_date", "effective_date"),
        _plain("Summary of Changes", "changes_summary", "summary"),
    ]),
    "premium_summary": ("Premium Summary", [
        _paid("Base Premium", "base_premium"), _paid("Brokerage Commission", "brokerage_commission"), _paid("Taxes and Fees", "taxes_fees", "tax_amount"),
        _known("Total Premium", "premium_total", paid=True), _plain("Payment Plan", "payment_plan"), _plain("Rate per 100", "rate_per_100"),
    ]),
    "conditions": ("Condition", [_plain("Condition Name", "condition_name", "name"), _plain("Clause Summary", "condition_clause", "description")]),
    "schedule_of_values": ("Schedule of Values", [
        _plain("Location ID", "location_id", "loc_no"), _plain("Address", "full_address", "address"), _line("Coordinates", _piece("latitude"), _piece("longitude", before=", "), every=True),
        _paid("Building Value", "building_value"), _paid("Contents Value", "contents_value"), _paid("Business Income Value", "business_income", "bi_value"),
        _paid("Total Insured Value", "tiv", "total_insured_value"), _plain("Construction", "construction_type"), _plain("Occupancy", "occupancy_class", "occupancy"),
        _plain("Year Built", "year_built"), _plain("Stories", "stories", "number_of_stories"), _line("Area", _piece("area_sqft", "square_footage", after=" sqft")),
        _plain("Protection Class", "protection_class"), _plain("Sprinklers", "sprinklers"), _plain("Alarms", "alarms"),
    ]),
    "loss_run": ("Loss Run", [
        _plain("Claim Number", "claim_number"), _known("Policy Number", "policy_number"), _plain("Date of Loss", "date_of_loss"), _plain("Cause of Loss", "cause_of_loss"),
        _plain("Status", "status", "claim_status"), _paid("Paid Indemnity", "paid_indemnity"), _paid("Paid Expense", "paid_expense"), _paid("Reserves", "reserves", "reserved_amount"),
        _paid("Total Incurred", "incurred_total"),
    ]),
    "locations": ("Location", [
        _plain("Location Number", "location_number", "loc_no"), _plain("Physical Address", "physical_address", "address"), _plain("Mailing Address", "mailing_address"),
        _plain("Interest", "interest"), _plain("Year Built", "year_built"), _plain("Square Footage", "square_footage"),
    ]),
    "notice_of_claim": ("First Notice of Loss", [
        _known("Policy Number", "policy_number"), _known("Named Insured", "named_insured"), _plain("Claimant", "claimant_name"),
        _line("Date of Loss", _piece("date_of_loss", unset=UNSET), _piece("time_of_loss", before=" ")), _plain("Loss Location", "loss_location"),
        _plain("Cause Description", "cause_description", "description"), _paid("Claimed Amount", "claimed_amount"), _plain("Police Report", "police_report_number"), _plain("Witnesses", "witnesses"),
    ]),
    "vehicle_schedule": ("Vehicle Schedule", [
        _known("Vehicle ID", "vehicle_id"), _known("VIN", "vin"), _plain("Year", "year"), _plain("Make", "make"), _plain("Model", "model"), _plain("Vehicle Type", "vehicle_type"),
        _plain("Garaging Address", "garaging_address"), _plain("Primary Use", "primary_use"), _plain("Operating Radius", "radius_operation"),
    ]),
    "driver_schedule": ("Driver Schedule", [
        _known("Driver ID", "driver_id"), _plain("Name", "full_name", "name"), _plain("Date of Birth", "date_of_birth"),
        _line("License", _piece(known="license_number"), _piece("license_state", before=" (", after=")", unset="Unknown State", counts=False)),
        _plain("Years of Experience", "years_experience"), _plain("Violations", "violations_count"), _plain("Accidents", "accidents_count"),
    ]),
    "definitions": ("Definitions", [_plain("Term", "term", "defined_term"), _plain("Definition", "definition", "meaning", "description"), _plain("Context", "context", "applied_to")]),
}
_PIECE = "struct<keys: array<string>, strict: boolean, paid: boolean, before: string, after: string, unset: string, counts: boolean, currency: boolean>"
_LINES = f"map<string, struct<title: string, lines: array<struct<label: string, pieces: array<{_PIECE}>, always: boolean, every: boolean>>>>"


def _constant(value: object, kind: str) -> Column:
    """A nested value as one literal, parsed once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _lines(template_of: Column, data: Column) -> Column:
    """The lines of a template that have something to show."""

    def value(p: Column) -> Column:
        values = F.transform(p["keys"], lambda k: F.try_element_at(data, k))
        some = F.filter(values, lambda v: v.isNotNull() & (v != "") & (~p["strict"] | ~F.trim(v).isin(*MISSING)))
        return F.get(some, F.lit(0))

    def shown(p: Column, v: Column) -> Column:
        return F.concat(p["before"], F.coalesce(F.when(p["paid"] & v.isNotNull(), money(v, F.when(p["currency"], F.try_element_at(data, F.lit("currency"))))).otherwise(v), p["unset"]), p["after"])

    def line(x: Column) -> Column:
        parts = F.transform(x["pieces"], lambda p: F.struct(p.alias("p"), value(p).alias("v")))
        there = F.transform(F.filter(parts, lambda y: y["p"]["counts"]), lambda y: y["v"].isNotNull())
        show = x["always"] | F.when(x["every"], F.forall(there, lambda y: y)).otherwise(F.exists(there, lambda y: y))
        return F.when(show, F.concat(x["label"], F.lit(": "), F.array_join(F.transform(parts, lambda y: shown(y["p"], y["v"])), "")))

    return F.filter(F.transform(template_of["lines"], line), lambda x: x.isNotNull())


def _any_section(section: Column, data: Column) -> Column:
    """A line for each field: first those whose keys tell of something that matters, the last of them first, then the others below a blank line."""
    entries = F.filter(F.map_entries(data), lambda e: ~e["key"].isin(*NESTED) & ~F.coalesce(e["value"].isin("", "N/A", "null", "None"), F.lit(True)))
    heavy = lambda e: F.lower(e["key"]).rlike("|".join(IMPORTANT))
    amount = lambda e: F.lower(e["key"]).contains("amount") & e["value"].try_cast("double").isNotNull()
    shown = lambda e: F.concat(title_case(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), F.when(amount(e), money(e["value"])).otherwise(e["value"]))
    first, rest = F.reverse(F.transform(F.filter(entries, heavy), shown)), F.transform(F.filter(entries, lambda e: ~heavy(e)), shown)
    head = F.concat(F.lit("Document Section: "), title_case(F.replace(section, F.lit("_"), F.lit(" "))))
    return F.concat_ws("\n", F.concat(F.array(head, F.lit("")), first, F.when(F.size(rest) > 0, F.concat(F.array(F.lit("")), rest)).otherwise(F.array().cast("array<string>"))))


def section_text(section: Column, data: Column) -> Column:
    """The text of a section (its kind, in any case) with these fields (a map of texts), and its keywords. Kinds without a template have a line for every field."""
    name = F.trim(F.replace(F.lower(section), F.lit(" "), F.lit("_")))
    kind = F.coalesce(F.try_element_at(_constant(ALIASES, "map<string,string>"), name), name)
    found = F.try_element_at(_constant({k: {"title": t, "lines": ls} for k, (t, ls) in TEMPLATES.items()}, _LINES), kind)
    made = F.when(found.isNotNull(), F.concat_ws("\n", F.concat(F.lit("Section: "), found["title"]), _lines(found, data))).otherwise(_any_section(section, data))
    words = F.try_element_at(_constant(KEYWORDS, "map<string,string>"), name)
    return F.concat(made, F.coalesce(F.concat(F.lit("\nContext keywords: "), words), F.lit("")))
