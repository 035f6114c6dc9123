"""Cells of tables from files in three layouts, and coverages rolled up from endorsements, on hand-made rows."""
import json

import pytest
from pyspark.sql import functions as F

from tidemill.plans import synthesis as S
from tidemill.sources.cells import cell_rows, read_tables, records


def cell(r, c, text, **more):
    return {"start_row": r, "end_row": r + 1, "start_col": c, "end_col": c + 1, "text": text} | more


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    lines = [
        {"doc_id": 1, "page": 3, "number": 0, "bbox": [0, 1, 2, 3], "cells": [
            cell(0, 0, "Limits", col_span=2, end_col=2, header=True), cell(0, 2, "Note", row_span=2, header=True), cell(1, 0, "Each"), cell(1, 1, "All"),
            cell(2, 0, "10"), cell(2, 1, "20"), cell(2, 2, "both", row_span=2, end_row=4), cell(3, 0, None), cell(3, 1, "40", row_span=0), cell(-1, 0, "off"), cell(3, 3, "extra"),
        ]},
        {"doc_id": 1, "page": 4, "number": 0, "rows": [["a", "b", "a"], ["1", "2", "3"], [], None, ["4"]], "cells": []},
        {"doc_id": 2, "page": 4, "number": 1, "markdown": "text\n| x | y |\n|:--|--:|\n| 1 | |\n  |3|4|\nend"},
        {"doc_id": 2, "page": 5, "number": 0, "rows": [], "markdown": None}, {"doc_id": 3, "page": None, "number": 0, "rows": [["h"], ["v"]], "other": 1},
    ]
    (path / "one.json").write_text("\n".join(json.dumps(x) for x in lines[:2]) + "\nnot json\n")
    (path / "two.json").write_text("\n".join(json.dumps(x) for x in lines[2:]))
    return str(path)


def test_tables_in_three_layouts(spark, folder):
    got = {(r["doc_id"], r["table_id"]): r for r in read_tables(spark, folder).collect()}
    assert {k: (r["source"], r["confidence"], len(r["cells"])) for k, r in got.items()} == {
        (1, "tbl_3_0"): ("cells", 0.95, 10), (1, "tbl_4_0"): ("rows", 0.95, 7), (2, "tbl_4_1"): ("markdown", 0.85, 6), (3, "tbl_0"): ("rows", 0.95, 2)}
    assert got[1, "tbl_3_0"]["bbox"] == [0, 1, 2, 3] and [x["colspan"] for x in got[1, "tbl_3_0"]["cells"]][:2] == [2, 1]


def test_pages_are_asked_of_the_reader(spark, folder):
    df = read_tables(spark, folder, [4])
    assert {r["doc_id"] for r in df.collect()} == {1, 2}
    assert "PushedFilters: [In(page, [4])]" in df._jdf.queryExecution().toString() or "PushedFilters: [IsNotNull(page), EqualTo(page,4)]" in df._jdf.queryExecution().toString()


def test_records_of_spans_and_headers(spark, folder):
    rows = cell_rows(read_tables(spark, folder))
    two = {r["row"]: r["record"] for r in records(rows.where("table = '1/tbl_3_0'"), 2).collect()}
    assert two == {2: {"Limits Each": "10", "Limits All": "20", "Note": "both"}, 3: {"Limits Each": "", "Limits All": "40", "Note": "both", "col_3": "extra"}}
    one = {(r["table"], r["row"]): r["record"] for r in records(rows.where("page = 4")).collect()}
    assert one == {("1/tbl_4_0", 1): {"b": "2", "a": "3"}, ("1/tbl_4_0", 4): {"a": "4"}, ("2/tbl_4_1", 1): {"x": "1", "y": ""}, ("2/tbl_4_1", 2): {"x": "3", "y": "4"}}


MOD = "impacted_coverage string, coverage_effect string, effect_category string, scope_modification string, limit_modification string, deductible_modification string, condition_modification string, verbatim_language string, page_numbers array<int>, source_text string"


def test_changes_merge_by_term_and_the_last_counts(spark):
    m = lambda name, effect=None, category=None, scope=None, limit=None, ded=None, cond=None, verb=None, pages=None, text=None: (name, effect, category, scope, limit, ded, cond, verb, pages, text)
    rows = [
        (1, 1, "CA 1", "x", [m("Auto Coverage Form", None, "adds_coverage", "Hired auto use", "1M", None, "if any", None, [3, 1], None), m("business AUTO form", "Odd", None, "some new words come here", None, "500")]),
        (1, 2, "", "Named", [m("auto coverage", None, "limits_coverage", "hired autos", "2M", "", None, "verb", [2, None], "said"), m(None), m("  ")]),
        (1, 3, "CA 1", "x", [m("Auto", None, "restores_coverage", None, "", None, None, "third", None, None), m("AUTO", None, "expands_coverage", None, None, None, None, "fourth", [1], None)]),
        (2, 1, None, None, [m("Workers Compensation", "Changed", "adds_coverage")]), (3, 1, "E", "F", []),
    ]
    df = spark.createDataFrame(rows, f"doc_id int, seq int, endorsement_number string, endorsement_name string, modifications array<struct<{', '.join(f.replace(' ', ': ', 1) for f in MOD.split(', '))}>>")
    changes = S.projected(df)
    base = spark.createDataFrame([(1, "Kept out", 5, 6, None, [1], "t"), (9, "Liability part", 100, None, None, [7], "words"), (9, " ", None, 3, 0.5, None, None)],
                                 "doc_id int, coverage_name string, limit_amount bigint, deductible_amount bigint, confidence double, pages array<int>, text string")
    got = {(r["doc_id"], r["coverage"]): r for r in S.effective_coverages(changes, base).collect()}
    assert set(got) == {(1, "Auto"), (1, "Business Auto"), (2, "Workers Compensation"), (9, "Liability part"), (9, "Unknown Coverage")}
    auto = got[1, "Auto"]
    assert (auto["terms"], auto["limit"], auto["deductible"], auto["sources"], auto["pages"]) == ({"hired_auto": "Restricted"}, "2M", None, ["CA 1", "Named"], [1, 2, 3])
    assert auto["text"] == "Hired auto use | said | third" and round(auto["confidence"], 9) == 0.95 and auto["kind"] == "Auto" and auto["canonical_id"] == "cov_auto_auto"
    other = got[1, "Business Auto"]
    assert other["terms"] == {"some_new_words_come": "Odd"} and other["deductible"] == "500" and round(other["confidence"], 9) == 0.8 and other["pages"] is None
    plain = got[2, "Workers Compensation"]
    assert plain["sources"] == ["Unknown"] and plain["terms"] == {} and plain["text"] is None and round(plain["confidence"], 9) == 0.8 and plain["kind"] == "Workers Comp"
    assert (got[9, "Liability part"]["limit"], got[9, "Liability part"]["confidence"], got[9, "Liability part"]["modified"], got[9, "Liability part"]["kind"]) == ("100", 0.95, False, "Liability")
    details = S.detailed_terms(changes).collect()
    assert len(details) == 3 and {r["condition"] for r in details} == {"if any", None}
    summary = {r["doc_id"]: (r["coverages"], r["method"]) for r in S.synthesis_summary(S.effective_coverages(changes, base)).collect()}
    assert summary == {1: (2, "endorsement_only"), 2: (1, "endorsement_only"), 9: (2, "base_coverage_merge")}


def test_basic_endorsements_name_several_forms(spark):
    rows = [
        (1, 1, "E1", "Broad Form", "Add", "AUTO DEALERS COVERAGE FORM  BUSINESS AUTO COVERAGE FORM garage", [1], "t"), (1, 2, None, "Cut", "Restrict", "garage", None, None),
        (1, 3, None, "Broad Form", None, "garage", [4], " "), (1, 4, "E4", None, "Delete", None, None, None), (1, 5, "E5", "Z", "Strange", "FORMS of life", None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, seq int, endorsement_number string, endorsement_name string, endorsement_type string, impacted_coverage string, page_numbers array<int>, source_text string")
    got = {r["coverage"]: r for r in S.effective_coverages(S.basic(df)).collect()}
    assert set(got) == {"Auto Dealers", "Business Auto", "Garage", "Forms Of Life"}
    assert got["Garage"]["terms"] == {"Broad Form": "Modified", "Cut": "Restricted"} and got["Garage"]["sources"] == ["Broad Form", "Cut", "E1"]
    assert got["Auto Dealers"]["terms"] == {"Broad Form": "Added"} and got["Forms Of Life"]["terms"] == {"Z": "Modified"}
    assert round(got["Garage"]["confidence"], 9) == 0.85 and round(got["Auto Dealers"]["confidence"], 9) == 0.8


def test_no_changes_give_nothing(spark):
    df = spark.createDataFrame([], "doc_id int, seq int, endorsement_number string, endorsement_name string, endorsement_type string, impacted_coverage string, page_numbers array<int>, source_text string")
    assert S.effective_coverages(S.basic(df)).collect() == []
    assert S.references(F.lit(" ")) is not None
