"""Operators on small rows made by hand, against plain Python where SQL is no match."""
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import numbers as N
from tidemill.functions import records as R
from tidemill.functions import questions as Q
from tidemill.functions import text as X
from tidemill.operators import matching, packing, relational, similarity, windows
from tidemill.plans import chunking, retrieval
from tidemill.queries import Tables
from tidemill.sources import sinks, text_tables
from tidemill.streaming import events


@pytest.fixture(autouse=True)
def shipped(spark, data):
    Tables(spark, data)


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    c = F.col
    assert one(spark, X.title_case(c("a")), a="ii-b o'neill éa") == "Ii-B O'Neill Éa"
    assert one(spark, X.coverage_name(c("a")), a="auto liability COVERAGE FORM") == "Auto Liability"
    assert one(spark, X.slug(c("a"), "cov"), a="  Hired/Auto -- été ") == "cov_hired_auto_été"
    assert one(spark, X.same_but_for_signs(c("a"), c("b")), a="A-B c", b="ab C") is True
    assert one(spark, X.same_but_for_punctuation(c("a"), c("b")), a="A, b.", b="a b") is True
    assert one(spark, X.form_references(c("a")), a="x FORM y FORM z") == ["x FORM", "y FORM"]
    assert one(spark, X.quoted_form(c("a")), a="1. “Hi”  – There\n- x") == '"hi" - there x'
    assert one(spark, X.overlap_tail(c("a"), 8), a="One two three. Four five six. Seven.") == "Four five six. Seven."
    assert one(spark, X.intent(c("a")), a="Compare and explain why")["intent"] == "ANALYSIS"
    assert one(spark, X.intent(c("a")), a="hello there")["intent"] == "GENERAL"
    assert one(spark, X.intent(c("a")), a="zzz")["confidence"] == 0.5
    assert one(spark, X.intent(c("a")), a=None)["confidence"] == 0.0
    assert one(spark, X.longest_only(F.array(c("a"), c("b"))), a="auto", b="hired auto") == ["hired auto"]
    assert one(spark, X.without_fences(c("a")), a="```json\n{}\n```") == "{}"


@pytest.mark.parametrize("text,want", [("$1,234.50", 1234.5), ("(1,000)", 1000), ("1.5M", 1.5), ("N/A", None), ("-3", -3), ("", None), (None, None), ("1-2", None)])
def test_decimals(spark, text, want):
    got = one(spark, N.parsed_decimal(F.col("a")), a=text)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("text,want", [("2024-1-5", "2024-01-05"), ("2/3/2024", "2024-02-03"), ("25/3/2024", "2024-03-25"), ("2024/12/01", "2024-12-01"), ("x", None), (None, None)])
def test_dates(spark, text, want):
    got = one(spark, N.parsed_date(F.col("a")), a=text)
    assert (None if got is None else str(got)) == want


def test_truthiness_and_sentinels(spark):
    c = F.col
    assert one(spark, R.first_truthy(c("a"), c("b"), c("d")), a="", b="0", d="x") == "x"
    assert one(spark, R.first_present(c("a"), c("b")), a="None", b="0") == "0"
    assert one(spark, R.first_present(c("a")), a=None) is None


def test_changes_of_zero(spark):
    row = spark.range(1).select(
        N.change_of_magnitude(F.lit(0.0), F.lit(5.0)).alias("a"), N.change_of_magnitude(F.lit(-10.0), F.lit(5.0)).alias("b"),
        N.change_signed(F.lit(0.0), F.lit(5.0)).alias("c"), N.change_signed(F.lit(-10.0), F.lit(5.0)).alias("d"), N.change_of_magnitude(F.lit(0.0), F.lit(0.0)).alias("e"),
    ).first()
    assert tuple(row) == (100.0, 150.0, None, -150.0, 0.0)


def test_packing_keeps_order_and_limits(spark):
    r = random.Random(1)
    rows = [(k, i, r.randint(1, 40)) for k in range(20) for i in range(r.randint(1, 30))]
    out = packing.packed(spark.createDataFrame(rows, "k int, i int, s int"), "k", ["i"], F.col("s"), 60, 4).collect()
    want = []
    for k in range(20):
        number, total, n = -1, 0, 0
        for _, i, s in [x for x in rows if x[0] == k]:
            if number < 0 or total + s > 60 or n >= 4:
                number, total, n = number + 1, 0, 0
            total, n = total + s, n + 1
            want.append((k, i, number))
    assert sorted((x["k"], x["i"], x["bin"]) for x in out) == want


def test_lines_by_anchor(spark):
    words = spark.createDataFrame([(1, 0, 10.0), (1, 1, 14.0), (1, 2, 16.0), (1, 3, 30.0)], "page int, i int, y double")
    out = packing.lines_by_anchor(words, "page", ["i"], F.col("y")).orderBy("i").collect()
    assert [x["line"] for x in out] == [0, 0, 1, 2]


def test_merged_intervals_and_islands(spark):
    rows = spark.createDataFrame([(1, 1, 9), (1, 2, 3), (1, 10, 11), (1, 13, 14), (2, 5, 5)], "k int, s int, e int")
    out = windows.merged_intervals(rows, "k", "s", "e").orderBy("k", "s").collect()
    assert [(x["k"], x["s"], x["e"], x["n"]) for x in out] == [(1, 1, 11, 3), (1, 13, 14, 1), (2, 5, 5, 1)]
    got = windows.islands(rows, "k", "s").orderBy("k", "first").collect()
    assert [(x["k"], x["first"], x["last"]) for x in got] == [(1, 1, 2), (1, 10, 10), (1, 13, 13), (2, 5, 5)]


def test_runs_with_nulls(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, "a", "a", "b", None])], "k int, i int, v string")
    assert [x["n"] for x in windows.runs(rows, "k", ["i"], "v").orderBy("run").collect()] == [2, 2, 1, 1]


def test_upsert_and_inserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    more = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    got = relational.upsert(base.withColumn("n", F.lit(0)), more, ["k"], "n").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    assert sorted(map(tuple, relational.insert_missing(base, spark.createDataFrame([(2, "x"), (4, "z"), (4, "y")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "b"), (4, "y")]
    with pytest.raises(KeyError):
        relational.matching(base, {"nope": 1})
    with pytest.raises(Exception, match="more than one row"):
        relational.only(base).collect()


def test_partition_replacement_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, scope string")
    sinks.replace_partitions(rows, path, "scope")
    for _ in range(2):
        sinks.replace_partitions(spark.createDataFrame([(9, "a")], "k int, scope string"), path, "scope")
    assert sorted((x["k"], x["scope"]) for x in spark.read.parquet(path).collect()) == [(2, "b"), (9, "a")]


def test_jaccard_pairs_by_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.sample("abcdefghij", r.randint(0, 6))) for i in range(120)]
    first = {}
    for i, t in rows:
        if t:
            first.setdefault(frozenset(t), i)
    want = {(min(i, j), max(i, j)): len(a & b) / len(a | b) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) / len(a | b) >= 0.6}
    out = similarity.jaccard_pairs(spark.createDataFrame(rows, "k int, t array<string>"), "k", "t", 0.6).collect()
    assert {(x["a"], x["b"]): x["jaccard"] for x in out} == want


def test_kept_pages(spark):
    rows = [(1, 1, list("abcde")), (1, 2, list("abcde")), (1, 3, list("xyz")), (1, 4, list("abcdef")), (1, 5, [])]
    out = similarity.kept_pages(spark.createDataFrame(rows, "d int, p bigint, t array<string>"), "d", "p", "t").orderBy("p").collect()
    assert [x["duplicate_of"] for x in out] == [None, 1, None, 1, None]


def test_fuzzy_best_by_brute_force(spark):
    r = random.Random(3)
    name = lambda: "".join(r.choice("abc") for _ in range(r.randint(4, 9)))
    a, b = [(1, name()) for _ in range(40)], [(1, name()) for _ in range(40)]
    out = similarity.fuzzy_best(spark.createDataFrame(a, "g int, n string"), spark.createDataFrame(b, "g int, n string"), "g", "n", 0.8).collect()
    want = {}
    for _, x in a:
        best = max(((similarity._indel(x, y), [-ord(c) for c in y], y) for _, y in b), default=None)
        top = [y for _, y in b if similarity._indel(x, y) == best[0]]
        if best[0] >= 0.8:
            want[x] = min(top)
    assert {x["a"]: x["b"] for x in out} == want


def test_name_matching_is_one_to_one(spark):
    old = spark.createDataFrame([(1, "Auto"), (2, "Fire"), (3, "Fire"), (4, "Hired auto liability"), (5, "Gone"), (6, None)], "k int, n string")
    new = spark.createDataFrame([(1, "Auto 2"), (12, "fire"), (14, "Hired auto liability plus"), (15, "New")], "k int, n string")
    out = {(x["old_key"], x["new_key"], x["how"]) for x in matching.name_matched(old, new, "k", "n").collect()}
    assert out == {(1, 1, "key"), (2, 12, "name"), (4, 14, "contained"), (3, None, "removed"), (5, None, "removed"), (6, None, "removed"), (None, 15, "added")}


def test_json_leaves_diff_and_merge(spark):
    old = spark.createDataFrame([(1, json.dumps({"a": {"b": [1, 2]}, "c": "X-Y", "d": 5}))], "k int, doc string")
    new = spark.createDataFrame([(1, json.dumps({"a": {"b": [1, 3]}, "c": "x y", "e": True}))], "k int, doc string")
    out = {(x["path"], x["change"]) for x in matching.json_diff(old, new, "k", "doc").collect()}
    assert out == {("a.b[1]", "increase"), ("c", "formatting"), ("d", "removed"), ("e", "added")}
    got = old.join(new.withColumnRenamed("doc", "b"), "k").select(matching.deep_merged("doc", "b").alias("m")).first()["m"]
    assert json.loads(got) == {"a": {"b": [1, 2, 1, 3]}, "c": "x y", "d": 5, "e": True}
    broken = spark.createDataFrame([(1, "{"), (2, None)], "k int, doc string")
    assert matching.json_leaves(broken, "k", "doc").collect() == []


def test_boxes(spark):
    words = spark.createDataFrame([(1, 10.0, 10.0, 20.0, 12.0, "in"), (1, 300.0, 10.0, 310.0, 12.0, "out"), (2, 10.0, 10.0, 20.0, 12.0, "page")], "page int, x0 double, y0 double, x1 double, y1 double, w string")
    boxes = spark.createDataFrame([(1, 12.0, 8.0, 250.0, 40.0)], "page int, bx0 double, by0 double, bx1 double, by1 double")
    assert [x["w"] for x in matching.words_in_boxes(words, boxes, ["page"]).collect()] == ["in"]
    run = spark.createDataFrame([("ab cde", 0.0, 60.0)], "t string, x0 double, x1 double")
    assert [(x["word"], x["x0"], x["x1"]) for x in matching.split_words(run, "t").orderBy("i").collect()] == [("ab", 0.0, 20.0), ("cde", 30.0, 60.0)]


def test_markdown_tables(spark):
    text = "x\n| a | b |\n|---|:--|\n| 1 | 2 |\n| 3 |\n\n| not a table\n\n| c |\n|---|\n| 4 | 5 |\n"
    out = text_tables.markdown_tables(spark.createDataFrame([(1, text), (2, None), (3, "none")], "k int, t string"), "k", "t").orderBy("table", "row").collect()
    assert [(x["table"], x["row"], x["cells"]) for x in out] == [(0, 0, {"a": "1", "b": "2"}), (0, 1, {"a": "3", "b": None}), (1, 0, {"c": "4"})]


@pytest.mark.parametrize("text,want", [('{"a": 1}', {"a": 1}), ("```json\n[1]\n```", [1]), ('Sure: {"a": {"b": 2}} bye {"c": 3}', {"a": {"b": 2}}), ("none", None), (None, None), ("{broken [1, 2] x", [1, 2])])
def test_tolerant_json(spark, text, want):
    got = one(spark, text_tables.tolerant_json(F.col("a")), a=text)
    assert (None if got is None else json.loads(got)) == want


def test_graph_sinks(spark):
    nodes = "scope string, id int, label string, props map<string,string>"
    base, new = spark.createDataFrame([("w", 1, "A", {"x": "1", "y": "2"})], nodes), spark.createDataFrame([("w", 1, "B", {"y": "3"}), ("w", 2, "C", None)], nodes)
    out = {x["id"]: (x["label"], x["props"]) for x in sinks.merge_nodes(base, new).collect()}
    assert out == {1: ("B", {"x": "1", "y": "3"}), 2: ("C", {})}


def test_chunks_keep_words_and_limits():
    r = random.Random(4)
    for _ in range(30):
        text = "\n\n".join(("# Head\n" if r.random() < 0.2 else "") + " ".join("w" * r.randint(1, 9) + r.choice(["", "", "."]) for _ in range(r.randint(1, 120))) for _ in range(r.randint(1, 12)))
        chunks = chunking.chunks_of(text, 120, 30, 0)
        assert " ".join(c for _, c, _ in chunks).split() == text.split()
        assert all(n <= 130 for _, _, n in chunks)
    assert chunking.chunks_of(" \n ", 120, 30, 10) == []


def test_continuation(spark):
    kind = "doc_id bigint, page bigint, form string, policy string, header boolean, explicit boolean, mid_sentence boolean, follows boolean, continuity boolean, strong_header boolean"
    rows = [(1, 1, "CG 1", "P", True, *[False] * 5), (1, 2, None, None, *[False] * 6), (1, 4, None, None, *[False] * 6), (1, 5, "CG 1", None, True, *[False] * 5), (1, 6, "CG 2", None, True, *[False] * 5), (1, 9, None, None, False, True, *[False] * 4)]
    rows = [(*r[:4], *r[4:10]) for r in rows]
    out = events.continued(spark.createDataFrame(rows, kind)).orderBy("page").collect()
    assert [x["continues"] for x in out] == [False, True, False, True, False, True]
    assert [round(x["confidence"], 2) for x in out] == [0.0, 0.5, 0.0, 0.95, 0.0, 0.9]
    assert out[5]["parent"] == "CG 2"


def test_citation_tiers(spark):
    quote = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "x " + quote + " y"), (2, quote), (3, "one two three four five six seven eight zzz")]
    got = retrieval.cited(spark.createDataFrame([(1, quote), (2, "absent words"), (3, "one two three four five six seven eight aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr")], "item_id int, quote string"), spark.createDataFrame(docs, "doc_id int, text string"))
    assert {x["item_id"]: (x["doc_id"], x["tier"]) for x in got.collect()} == {1: (1, 1), 2: (None, 4), 3: (1, 3)}


def test_citation_tiers_of_short_quotes_by_brute_force(spark):
    r = random.Random(8)
    text = lambda n: [r.choice("abcdefgh") * 2 for _ in range(n)]
    docs = [(k, text(r.choice([1, 3, 12, 40]))) for k in range(12)]
    quotes = []
    for k in range(60):
        w = r.choice(docs)[1]
        at, n = r.randrange(len(w)), r.randint(1, 36)
        quotes.append((k, w[at : at + n] + text(r.choice([0, 0, 2, 9]))))
    want = {}
    for k, q in quotes:
        best = (4, None)
        for tier, n in ((3, -(-len(q) // 4)), (2, -(-len(q) // 2)), (1, len(q))):
            held = [i for i, w in docs if any(w[j : j + n] == q[:n] for j in range(len(w) - n + 1))]
            best = (tier, min(held)) if held else best
        want[k] = best
    got = retrieval.cited(
        spark.createDataFrame([(k, " ".join(q)) for k, q in quotes] + [(60, ""), (61, None)], "item_id int, quote string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in docs] + [(90, ""), (91, None)], "doc_id int, text string"),
    )
    assert {x["item_id"]: (x["tier"], x["doc_id"]) for x in got.collect()} == want | {60: (4, None), 61: (4, None)}


@pytest.mark.parametrize("field,text,want", [
    ("policy_numbers", "What is policy POL-12345?", ["POL-12345"]), ("policy_numbers", "Check policy CA-001-2024", ["CA-001-2024"]),
    ("policy_numbers", "Compare policy POL-12345 with CA-001-2024 and GL123456", ["CA-001-2024", "GL123456", "POL-12345"]), ("policy_numbers", "Find 12345-POL", ["12345-POL"]),
    ("coverage_types", "Show me WC limits", ["workers compensation"]), ("coverage_types", "Find E&O coverage", ["professional liability"]),
    ("dates", "Effective date is 01/15/2024", ["01/15/2024"]), ("dates", "Renewal date: March 1, 2025", ["March 1, 2025"]),
    ("amounts", "A limit of $1,000,000 or 1.5 million", ["1,000,000", "1.5"]), ("amounts", "$5000", ["5000"]), ("amounts", "$25000", []),
    ("locations", "in Springfield, IL", ["IL", "Springfield"]), ("entity_names", "is Acme Steel Corporation insured? What Policy Coverage", ["Acme Steel Corporation"]),
    ("section_hints", "which exclusions", ["exclusions"]), ("section_hints", "", []),
])
def test_question_entities(spark, field, text, want):
    assert one(spark, Q.entities(F.col("a"))[field], a=text) == want


def test_question_terms_and_filters(spark):
    c = F.col
    assert one(spark, Q.expanded(c("a")), a="Is BI covered?") == ["Is BI covered?", "Is bodily injury covered?", "Is personal injury covered?"]
    assert one(spark, Q.expanded(c("a")), a="nothing here") == ["nothing here"]
    assert len(one(spark, Q.expanded(c("a")), a="deductible, claim and loss under the umbrella")) == 5
    assert one(spark, Q.canonical_term(c("a")), a="wc") == "workers compensation"
    assert one(spark, Q.canonical_term(c("a")), a="no such term") == "no such term"
    assert one(spark, Q.section_filters(Q.section_hints(c("a")), F.lit("AUDIT")), a="an exclusion") == ["exclusions"]
    assert one(spark, Q.section_filters(Q.section_hints(c("a")), F.lit("QA")), a="hm") == ["coverages", "declarations", "schedule"]
    plan = retrieval.planned("compare the limit and explain why", spark)
    assert (plan.intent, plan.sections, plan.depth) == ("ANALYSIS", ("coverages", "declarations", "limits_deductibles"), 2)


@pytest.mark.parametrize("text,kind,want", [
    ("COMMON POLICY DECLARATIONS\nNamed Insured", None, "declarations"), ("What is not covered\nExclusions", "policy", "exclusions"), ("Statement of values", None, "sov"),
    ("THIS ENDORSEMENT CHANGES THE POLICY. PLEASE READ IT CAREFULLY.", None, "endorsement"), ("ACORD 25", None, "certificate_of_insurance"),
    ("Loss run", None, "loss_run"), ("nothing of the kind", None, "unknown"), ("Conditions. This endorsement modifies it", "bundle", "conditions"), (None, None, "unknown"),
])
def test_page_types(spark, text, kind, want):
    from tidemill.operators import pages

    rows = spark.createDataFrame([(text, kind)], "x string, doc string")
    assert pages.page_types(rows, "x", "doc").first()["page_type"] == want


def test_a_rerun_after_a_failure_changes_nothing(spark, tmp_path):
    """Partitions are replaced as a whole, so a run that died half way and its repetition leave what one run leaves."""
    path = str(tmp_path / "out")
    rows = spark.range(100).selectExpr("id", "id % 4 AS part")
    sinks.replace_partitions(rows.where("part <> 3"), path, "part")
    broken = rows.where("part < 2").withColumn("id", F.when(F.col("id") == 97, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        sinks.replace_partitions(broken, path, "part")
    for _ in range(2):
        sinks.replace_partitions(rows, path, "part")
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(100))
    sinks.append(spark.createDataFrame([(1000, 1)], "id bigint, part int").select("id"), str(tmp_path / "rows"))
    sinks.append(spark.createDataFrame([(1001,)], "id bigint"), str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2


def test_name_matching_passes(spark):
    old = spark.createDataFrame([(1, "Auto Liability", "c1"), (2, "Physical Damage - Hail", None), (3, "General Property Cover", None), (4, "Alone", None)], "k int, n string, c string")
    new = spark.createDataFrame([(9, "Other name", "c1"), (8, "hail - modified", None), (7, "General Property Cover plus flood", None), (6, "Unpaired", None)], "k int, n string, c string")
    out = {(r["old_key"], r["new_key"], r["how"]) for r in matching.name_matched(old, new, "k", "n", "c").collect()}
    assert out == {(1, 9, "canonical"), (2, 8, "name"), (3, 7, "contained"), (4, None, "removed"), (None, 6, "added")}
    kept = {r["how"] for r in matching.name_matched(old, new, "k", "n", "c", endorsement=True).collect()}
    assert "unchanged" in kept and "removed" not in kept


def test_containments_by_brute_force(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abé ") for _ in range(n))
    inner, outer = [text(r.randint(0, 7)) for _ in range(150)] + [None], [text(r.randint(0, 25)) for _ in range(60)] + [None, "same", "same"]
    got = matching.containments(spark.createDataFrame([(x,) for x in inner], "inner string"), spark.createDataFrame([(x,) for x in outer], "outer string"))
    want = {(a, b) for a in inner if a for b in outer if b and a in b}
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want
    empty = spark.createDataFrame([], "inner string")
    assert matching.containments(empty, spark.createDataFrame([("a",)], "outer string")).count() == 0


def test_references_at_the_edges(spark):
    entities = [(1, "k1", "Cov", "Auto Liability", ["a1"]), (2, "k2", "Cov", "auto liability ", ["a2", "k1"]), (3, "k3", "Excl", None, None), (4, "k4", "Excl", "wo", []), (5, "k5", "Excl", "  ", [])]
    mentions = [("9", 1, "Excl", "WO"), ("9", 0, "Excl", "unknown"), ("9", 0, "Cov", None)]
    refs = ["k1", "a2", "cov:AUTO liability", " auto liability", "auto", "aut", "big auto liability form", "two words", "temp_9_Excl_1", "temp_9_Cov_1", "temp_9", "excl:", "", None, "k1"]
    got = matching.resolved_references(
        spark.createDataFrame([(x,) for x in refs], "ref string"), spark.createDataFrame(entities, "seq int, key string, kind string, value string, ids array<string>"),
        spark.createDataFrame(mentions, "chunk string, pos int, kind string, value string"),
    )
    assert {x["ref"]: (x["key"], x["step"]) for x in got.collect()} == {
        "k1": ("k1", "key"), "a2": ("k2", "attribute"), "cov:AUTO liability": ("k1", "typed"), " auto liability": ("k1", "value"), "auto": ("k1", "part"), "aut": (None, None),
        "big auto liability form": ("k1", "part"), "two words": ("k4", "part"), "temp_9_Excl_1": ("k4", "temporary"), "temp_9_Cov_1": (None, None), "temp_9": (None, None), "excl:": ("k3", "typed"), "": (None, None),
    }


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prior, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prior, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prior + (x != y))
    return row[-1]


def test_windows_of_quotes_by_brute_force(spark):
    from tidemill.plans import citations

    r = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "deltas", "delta", "coverage", "coverages", "x"]
    pages = [(p, k, [r.choice(vocabulary) for _ in range(r.choice([0, 2, 6, 30]))]) for p in range(3) for k in range(1, 6)]
    quotes = []
    for i in range(80):
        p, _, w = r.choice(pages)
        at, n = r.randrange(len(w) + 1), r.randint(1, 25)
        q = [x if r.random() < 0.9 else r.choice(vocabulary) for x in w[at : at + n]]
        quotes.append((i, p if i % 9 else None, r.choice([1, 3, None]), q))
    like = lambda a, b: a == b or _lev(a, b) <= int(max(len(a), len(b)) * 0.2)

    for least in (0.6, 0.75):
        want = {}
        for i, p, expected, q in quotes:
            q = q[:15]
            n = len(q)
            need = -(-round(n * least * 100) // 100)
            hits = []
            for parent, k, w in pages:
                for at in range(len(w) - n + 1) if parent == p and n else ():
                    window = w[at : at + n]
                    m = n - need + 1
                    block = any(q[b * n // m : (b + 1) * n // m] == window[b * n // m : (b + 1) * n // m] for b in range(m))
                    if block and sum(map(like, q, window)) >= need:
                        hits.append((abs(k - (expected or 1)), k, at))
                    assert block or sum(a == b for a, b in zip(q, window, strict=True)) < need
            if hits:
                want[i] = min(hits)[1:]
        got = citations.windows(
            spark.createDataFrame(quotes, "item_id int, parent int, expected int, q array<string>"), spark.createDataFrame(pages, "parent int, page int, w array<string>"), least
        )
        assert {x["item_id"]: (x["page"], x["at"]) for x in got.collect()} == want and len(want) > 20


def test_citation_methods(spark):
    from tidemill.plans import citations

    body = "the insurer pays for sudden damage to covered property at the described premises during the policy period only"
    half = body.split()[:9]
    chunks = [(1, 1, "nothing of note stands on this first page", [1.0, 0.0]), (1, 2, body, [0.0, 1.0]), (2, 1, "other file", [0.0, 1.0])]
    quotes = [
        (1, 1, 1, body, None), (2, 1, 1, "2. " + body.replace("sudden", "suden").replace("damage", "harm"), None), (3, 1, 1, " ".join(half) + " " + "unlike words follow here and they go on for long", [0.1, 1.0]),
        (4, 1, 3, "wholly different wording that matches none", [0.2, 1.0]), (5, 1, 3, "too short", [0.0, 1.0]), (6, 1, 3, "wholly different wording that matches none", [1.0, -9.0]),
        (7, 1, None, None, None), (8, None, 4, body, [0.0, 1.0]), (9, 1, 2, "", [0.0, 1.0]),
    ]
    got = citations.resolved(
        spark.createDataFrame(quotes, "item_id int, parent int, page int, quote string, vector array<double>"), spark.createDataFrame(chunks, "parent int, page int, text string, vector array<double>")
    )
    rows = {x["item_id"]: x for x in got.collect()}
    assert {k: (x["method"], x["page"], x["at"]) for k, x in rows.items()} == {
        1: ("direct_text_match", 2, 0), 2: ("direct_text_match", 2, 0), 3: ("semantic_chunk_match", 2, 0), 4: ("semantic_chunk_match", 2, None), 5: ("placeholder", 3, None),
        6: ("placeholder", 3, None), 7: ("placeholder", 1, None), 8: ("placeholder", 4, None), 9: ("placeholder", 2, None),
    }
    assert rows[1]["confidence"] == 0.9 and rows[5]["confidence"] == 0 and rows[4]["confidence"] == pytest.approx(1 - rows[4]["distance"])
