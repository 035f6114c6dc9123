"""Section chunks on hand-made pages: transitions, boundaries, covers, tables, long paragraphs; super-chunks."""
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemill.plans import sections as S
from tidemill.plans.chunking import split_with_overlap, tokens_in

WORDS = " ".join(["covered"] * 30)


def chunks(spark, pages, boundaries=None, most=400, least=200, overlap=20, **more):
    schema = "doc_id bigint, page int, text string" + "".join(f", {k} {v}" for k, v in more.items())
    df = spark.createDataFrame(pages, schema).repartition(3)
    if boundaries is not None:
        df = S.with_boundaries(df, spark.createDataFrame(boundaries, f"doc_id bigint, seq int, start_page int, end_page int, {S.BOUNDARY}"))
    return sorted(S.section_chunks(df, most, least, overlap).collect(), key=lambda r: (r["doc_id"], r["chunk"]))


@pytest.mark.parametrize("text,want", [
    ("EXCLUSIONS", "exclusions"), ("\n  ## general conditions \nx", "conditions"), ("Coverage B - property", "coverages"), ("COVERAGE FORM", "coverages"),
    ("a\nb\nDEFINITIONS", "definitions"), ("a\nb\nc\nDEFINITIONS", None), ("The exclusions apply", None), ("", None), (None, None), ("Endorsement no 7 adds", "endorsements"),
    ("who is an insured", "insured_definition"), ("x" * 201 + "\nSOV", "sov"), ("Section IV: Definitions", "definitions"), ("covered automobiles", "vehicle_details"),
])
def test_headings(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.section_of(F.col("t"))).first()[0] == want


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, 1, "a\n\n\n b \n## c\nd\n#### e\n\n   \n\n"), (1, 2, None), (1, 3, " \n\n ")], "doc_id int, page int, text string")
    assert [(r["para"], r["text"]) for r in S.paragraphs(df).orderBy("page", "para").collect()] == [(0, "a"), (1, "b"), (2, "## c\nd\n#### e")]


def test_sections_end_chunks_and_carry_over_pages(spark):
    got = chunks(spark, [(1, 1, f"EXCLUSIONS\n{WORDS}\n\n{WORDS}"), (1, 2, WORDS), (1, 3, f"{WORDS}\na\nb\n\nVEHICLE DETAILS\n{WORDS}"), (2, 1, None)])
    assert [(r["section"], r["subsection"], r["pages"]) for r in got] == [("exclusions", None, [1, 2, 3]), ("coverages", "vehicle_details", [3])]
    assert got[0]["tokens"] == tokens_in(f"EXCLUSIONS\n{WORDS}") + 2 * tokens_in(WORDS) + tokens_in(f"{WORDS}\na\nb")
    # A heading in the first three lines of a page holds for its first paragraph, as it stands.
    got = chunks(spark, [(1, 1, f"{WORDS}\n\nVEHICLE DETAILS\n{WORDS}")])
    assert [(r["section"], r["subsection"]) for r in got] == [("vehicle_details", None)]


def test_full_chunks_overlap_by_sentences(spark):
    text = "\n\n".join(f"{WORDS} number {i}. Last {i}." for i in range(12))
    got = chunks(spark, [(1, 1, text)])
    assert len(got) > 1 and all(200 <= r["tokens"] <= 400 for r in got[:-1])
    for one, two in zip(got, got[1:]):
        tail = one["text"].split(". ")[-1]
        assert two["text"].startswith(tail + "\n\n")


def test_boundaries_and_roles(spark):
    pages = [(1, p, "\n\n".join([WORDS] * 2)) for p in range(1, 7)]
    marks = [(1, 0, 2, 3, None, "endorsements", "CG 20", "both", ["adds_coverage"], ["limits_exclusion"]), (1, 1, 4, 4, None, "endorsements", None, "exclusion_modifier", None, [])]
    got = chunks(spark, pages, marks, most=900)
    assert [(r["section"], r["effective"], r["role"], r["subsection"]) for r in got] == [
        ("unknown", "unknown", None, None), ("endorsements", "coverages", "both", "CG 20"), ("endorsements", "exclusions", "both", "CG 20"),
        ("endorsements", "exclusions", "exclusion_modifier", "projected_from_endorsements"),
    ]
    assert got[1]["text"] == got[2]["text"] and got[1]["coverage_effects"] == ["adds_coverage"] and got[1]["exclusion_effects"] == ["limits_exclusion"]
    assert got[1]["pages"] == [2, 3] and got[3]["pages"] == [4, 5, 6]
    # A boundary further down counts lines from the page's top. Until then the page has the role of what covers it.
    got = chunks(spark, [(1, 1, "\n\n".join([WORDS] * 4))], [(1, 0, 1, 1, 5, "conditions", None, None, None, [])])
    assert [(r["section"], r["text"].count("\n\n")) for r in got] == [("unknown", 1), ("conditions", 1)]


def test_certificates_have_no_role_and_grants_their_own(spark):
    marks = [(1, 0, 1, 1, None, "certificate_of_insurance", None, "both", ["adds_coverage"], []), (1, 1, 2, 2, None, "limits", None, None, [], [])]
    got = chunks(spark, [(1, 1, WORDS), (1, 2, WORDS)], marks)
    assert [(r["section"], r["role"], r["coverage_effects"]) for r in got] == [("certificate_of_insurance", None, []), ("limits", "limits", [])]


def test_tables_of_symbols_are_context(spark):
    rows = "| symbol | 1 |\n| 2 | 3 |"
    got = chunks(spark, [(1, 1, f"COVERAGES\n\n{rows}\n\n{rows}\n\n{rows}\n\n{WORDS}")])
    assert [r["section"] for r in got] == ["coverages_context"]
    got = chunks(spark, [(1, 1, "the symbol 1 applies\n\nand more", 4), (1, 2, WORDS, None)], table_count="int")
    assert [(r["section"], r["has_tables"], r["table_count"]) for r in got] == [("coverages_context", True, 4)]


def test_long_paragraphs_are_cut(spark):
    long = ". ".join([WORDS] * 25) + "."
    got = chunks(spark, [(1, 1, f"{WORDS}\na\nb\n\nCONDITIONS\n{long}\n\n{WORDS}")])
    assert got[0]["section"] == "unknown" and {r["section"] for r in got[1:]} == {"conditions"}
    assert len(got) > 4 and all(r["tokens"] <= 480 for r in got)
    assert sum(r["text"].count("covered") for r in got) == 30 * 27


def test_pieces_with_overlap():
    assert split_with_overlap("short", 10, 5) == ["short"]
    lines = [f"line {i} of ten words that are here to fill it" for i in range(20)]
    got = split_with_overlap("\n".join(lines), 60, 20)
    assert all(sum(map(tokens_in, p.split("\n"))) <= 60 for p in got)
    assert all(b.split("\n")[0] == a.split("\n")[-1] for a, b in zip(got, got[1:]))
    assert [x for i, p in enumerate(got) for x in p.split("\n")[i > 0:]] == lines
    assert "".join(split_with_overlap("A b c. " * 200, 20, 10)) == "A b c. " * 200


def test_a_document_needs_no_more_memory_than_a_chunk():
    one = S.Chunker(1, 400, 200, 20)
    most = 0
    for i in range(5000):
        p = SimpleNamespace(page=i // 5, para=i % 5, text=WORDS, tokens=tokens_in(WORDS), detected=None, heading=None, manifest=None, starts=[], covers=None, table_count=None)
        list(one.add(p))
        most = max(most, len(one.filling.parts))
    assert most < 10 and one.made > 500


def test_super_chunks_and_batches(spark):
    rows = [(1, i, "declarations", "declarations", None, [1], 1500) for i in range(5)] + [(1, 5, "sov", "sov", None, [2], 100)]
    rows += [(1, 6 + k, "endorsements", e, r, [p], 50) for k, (e, r, p) in enumerate([("coverages", "both", 3), ("exclusions", "both", 3), ("coverages", "both", 4), ("exclusions", None, 7), ("other", "x", 9)])]
    rows += [(2, 0, "coverages", "coverages", None, [1], 7000)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk int, section string, effective string, role string, pages array<int>, tokens bigint")
    out = S.section_super_chunks(df)
    got = [tuple(r) for r in out.orderBy("doc_id", "place").collect()]
    assert got == [
        (1, 0, "declarations", 0, 1, True, False, 2, 3000), (1, 1, "declarations", 1, 1, True, False, 2, 3000), (1, 2, "declarations", 2, 1, True, False, 1, 1500),
        (1, 3, "sov", 0, 2, False, True, 1, 100), (1, 4, "coverages", 0, 2, True, False, 3, 150), (1, 5, "exclusions", 1, 3, True, False, 1, 50),
        (1, 6, "other", 2, 10, True, False, 1, 50), (2, 0, "coverages", 0, 2, True, False, 1, 7000),
    ]
    bins = {(r["doc_id"], r["place"]): r["bin"] for r in S.model_batches(out, 6000).collect()}
    assert bins == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 4): 1, (1, 5): 1, (1, 6): 1, (2, 0): 0}


def test_nothing_from_nothing(spark):
    assert chunks(spark, []) == [] and chunks(spark, [(1, 1, None), (1, 2, " ")]) == []
