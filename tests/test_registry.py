"""Entities of sections by registered rules."""
import json

import pytest

from tidemill.operators import registry as R


def got(spark, rows, registry=None):
    df = spark.createDataFrame([(i, s, d if isinstance(d, str) or d is None else json.dumps(d)) for i, (s, d) in enumerate(rows)], "doc_id int, section string, data string")
    out = {}
    for r in R.entities(df, registry or R.Registry()).orderBy("doc_id", "place").collect():
        out.setdefault(r["doc_id"], []).append((r["kind"], r["entity_id"], r["name"], r["confidence"], r["attributes"]))
    return out


def test_kinds_of_section(spark):
    rows = [
        ("coverages", {"fields": {"coverages": [{"coverage_label": "Fire & Theft", "coverage_type": None, "aggregate_limit": 5.5, "other": 1}, {"description": "no name"}, "text", 7]}}),
        ("limits", {"limits": {"name": "Each", "amount": 10, "limit_amount": "", "confidence": "0.25"}}),
        ("conditions", {"items": [{"title": "", "condition_title": "Notice", "requirements": ["a", "b"], "confidence": None}]}),
        ("endorsements", {"endorsements": [{"attributes": {"number": "CG 1", "title": None}, "confidence": 0.4}, {"name": "Plain"}]}),
        ("driver_schedule", {"items": [{"age": 3}, {"driver_name": "Ann"}]}), ("vehicle_schedule", {"vehicles": [{"vin": "X1"}]}),
        ("sov", {"properties": [{"bldg": 4, "construction_type": "Frame"}, {"address": "1 Main St"}, {}]}),
        ("loss_runs", {"extracted_data": {}, "losses": [{"loss_number": 8, "loss_type": "wind", "report_date": "d"}]}),
        ("definitions", {"definitions": [{"term": "Auto", "definition": "A car."}]}),
        ("unheard_of", {"items": [{"name": "x"}]}), ("limits", "{broken"), ("limits", None), ("limits", {}), ("limits", {"limits": []}), ("exclusions", {"exclusions": [{"name": "War"}] * 2}),
    ]
    out = got(spark, rows)
    assert out == {
        0: [("Coverage", "cov_fire_theft", "Fire & Theft", 0.9, {"name": "Fire & Theft", "aggregate_limit": "5.5"})],
        1: [("Limit", "lim_each", "Each", 0.25, {"limit_name": "Each", "limit_amount": "10"})],
        2: [("Condition", "cond_notice", "Notice", 0.9, {"title": "Notice", "requirements": '["a","b"]'})],
        3: [("Endorsement", "end_cg_1", "CG 1", 0.4, {"endorsement_number": "CG 1", "title": "CG 1"}), ("Endorsement", "end_plain", "Plain", 0.9, {"title": "Plain"})],
        4: [("Driver", "drv_item_1", "item_1", 0.9, {"age": "3"}), ("Driver", "drv_ann", "Ann", 0.9, {"driver_name": "Ann"})],
        5: [("Vehicle", "veh_x1", "X1", 0.9, {"vin": "X1"})],
        6: [("Location", "loc_4", "4", 0.9, {"location_id": "4", "construction_type": "Frame"}), ("Location", "loc_1_main_st", "1 Main St", 0.9, {"address": "1 Main St"}), ("Location", "loc_location_3", "location_3", 0.9, {})],
        7: [("Claim", "clm_8", "8", 0.9, {"claim_number": "8", "cause_of_loss": "wind", "reported_date": "d"})],
        8: [("Definition", "def_auto", "Auto", 0.9, {"term": "Auto", "definition_text": "A car."})],
        14: [("Exclusion", "excl_war", "War", 0.9, {"title": "War"})] * 2,
    }


def test_rules_can_be_registered(spark, monkeypatch):
    registry = R.Registry({})
    registry.register("mine", R.Rules("Thing", "th", ("things",), ("id",), {"size": ("big", "small")}, sure=0.1))
    registry.register("mine", R.Rules("Thing", "thing", ("things",), ("id",), {"size": ("big", "small")}, sure=0.2))
    assert got(spark, [("mine", {"things": [{"id": 1, "small": 2}]}), ("limits", {"limits": [{"name": "x"}]})], registry) == {0: [("Thing", "thing_1", "1", 0.2, {"size": "2"})]}
    assert list(registry) == ["mine"] and "coverages" in set(R.Registry())
    monkeypatch.setattr(R, "MOST", 1)
    with pytest.raises(ValueError):
        registry.register("another", R.BUILT_IN["limits"])
