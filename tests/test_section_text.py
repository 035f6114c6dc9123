"""Texts of sections, each kind by hand."""
import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions.section_text import KEYWORDS, money, section_text

CASES = [
    ("Declarations", {"pol_no": "P1", "policy_number": " N/A ", "named_insured": "Ann", "expiry_date": "2025-01-01", "forms": "F1, F2", "amount_due": "1,234.5", "currency": "INR"},
     "Section: Declarations\nPolicy Number: P1\nNamed Insured: Ann\nPolicy Period: Not specified to 2025-01-01\nForms: F1, F2\nTotal Premium: ₹1,234.50"),
    ("coverages", {"name": "Fire", "coverage_name": "", "limit": "$5000", "ded": "n.a.", "deductible_type": "flat", "sublimit_amount": "10"},
     "Section: Coverage\nCoverage Name: Fire\nIncluded: Yes\nPer Occurrence Limit: $5,000.00\nDeductible: n.a. (flat)\nSublimit:  $10.00"),
    ("exclusions", {"exclusion_name": "War", "manuscript": "Yes", "source_page": "7"}, "Section: Exclusion\nExclusion Name: War\nManuscript: Yes\nSource Page: 7"),
    ("endorsements", {"title": "T", "effective_date": "2024"}, "Section: Endorsement\nTitle: T\nEffective Date: 2024"),
    ("premium", {"base_premium": "10", "currency": "INR", "tax_amount": "1", "rate_per_100": "0.2"}, "Section: Premium Summary\nBase Premium: $10.00\nTaxes and Fees: $1.00\nRate per 100: 0.2"),
    ("conditions", {"name": "Notice", "description": "Tell us."}, "Section: Condition\nCondition Name: Notice\nClause Summary: Tell us."),
    ("SOV", {"loc_no": "3", "latitude": "1", "longitude": "2", "tiv": "9e3", "square_footage": "50"}, "Section: Schedule of Values\nLocation ID: 3\nCoordinates: 1, 2\nTotal Insured Value: $9,000.00\nArea: 50 sqft"),
    ("loss_run", {"claim_number": "C", "claim_status": "open", "reserved_amount": "5"}, "Section: Loss Run\nClaim Number: C\nStatus: open\nReserves: $5.00"),
    ("location", {"address": "A", "interest": "owner"}, "Section: Location\nPhysical Address: A\nInterest: owner"),
    ("FNOL", {"policyholder": "B", "time_of_loss": "noon", "claimed_amount": "x"}, "Section: First Notice of Loss\nNamed Insured: B\nDate of Loss: Not specified noon\nClaimed Amount: x"),
    ("vehicle", {"unit_no": "4", "serial_number": "S", "make": "M"}, "Section: Vehicle Schedule\nVehicle ID: 4\nVIN: S\nMake: M"),
    ("driver_schedule", {"name": "D", "dl_number": "L"}, "Section: Driver Schedule\nName: D\nLicense: L (Unknown State)"),
    ("definitions", {"defined_term": "Auto", "meaning": "A car"}, "Section: Definitions\nTerm: Auto\nDefinition: A car"),
    ("umbrella_terms", {"claim_id": "1", "colour": "red", "paid_amount": "5", "loss_date": "d", "claims": "[]", "blank": "", "size": "8"},
     "Document Section: Umbrella Terms\n\nLoss Date: d\nPaid Amount: $5.00\nClaim Id: 1\n\nColour: red\nSize: 8"),
    ("empty", {}, "Document Section: Empty\n\n"),
]


@pytest.fixture(scope="module")
def texts(spark):
    # A map keeps the order of its JSON.
    df = spark.createDataFrame([(i, s, json.dumps(d)) for i, (s, d, _) in enumerate(CASES)], "i int, s string, d string").withColumn("d", F.from_json("d", "map<string,string>"))
    return {r["i"]: r["t"] for r in df.select("i", section_text(F.col("s"), F.col("d")).alias("t")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_each_kind(texts, i):
    section, _, want = CASES[i]
    words = KEYWORDS.get(section.lower().replace(" ", "_"))
    got = texts[i].rstrip("\n") if section == "empty" else texts[i]
    assert got == (want.rstrip("\n") if section == "empty" else want) + (f"\nContext keywords: {words}" if words else "")


def test_money(spark):
    df = spark.createDataFrame([("1", None), (None, None), ("abc", "USD"), ("2000000", "EUR")], "a string, c string")
    assert [r[0] for r in df.select(money(F.col("a"), F.col("c"))).collect()] == ["$1.00", "Not specified", "abc", "2,000,000.00 EUR"]
