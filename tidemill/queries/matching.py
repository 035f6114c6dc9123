"""Matching of records, dictionaries, JSON and boxes; text sources and rules."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import matching as M
from tidemill.queries import Tables, query
from tidemill.sources import text_tables as S


def matched_sql(old: str, new: str) -> str:
    """CTEs for tables ``old`` and ``new`` of k, n (normal name) and c (canonical id), to m (old_key, new_key, how, confidence)."""
    free = lambda t, side, done: f"{t} WHERE k NOT IN (SELECT {side} FROM {done})"
    return f"""ca AS (SELECT min(k) AS old_key, c FROM {old} WHERE c <> '' GROUP BY c), cb AS (SELECT min(k) AS new_key, c FROM {new} WHERE c <> '' GROUP BY c),
m0 AS (SELECT old_key, new_key FROM ca JOIN cb USING (c)), a1 AS (SELECT * FROM {free(old, 'old_key', 'm0')}), b1 AS (SELECT * FROM {free(new, 'new_key', 'm0')}),
m1 AS (SELECT a1.k AS old_key, b1.k AS new_key FROM a1 JOIN b1 ON a1.k = b1.k), a2 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY k) AS i FROM {free('a1', 'old_key', 'm1')}),
b2 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY k) AS i FROM {free('b1', 'new_key', 'm1')}), m2 AS (SELECT a2.k AS old_key, b2.k AS new_key FROM a2 JOIN b2 USING (n, i) WHERE n <> ''),
a3 AS (SELECT * FROM {free('a2', 'old_key', 'm2')}), b3 AS (SELECT * FROM {free('b2', 'new_key', 'm2')}),
pr AS (SELECT a3.k AS old_key, min(b3.k) AS new_key FROM a3 JOIN b3 ON length(a3.n) > 8 AND length(b3.n) > 8 AND (contains(a3.n, b3.n) OR contains(b3.n, a3.n))
AND list_has_any(list_filter(regexp_split_to_array(a3.n, '\\W+'), lambda w: w <> ''), list_filter(regexp_split_to_array(b3.n, '\\W+'), lambda w: w <> '')) GROUP BY a3.k),
m3 AS (SELECT min(old_key) AS old_key, new_key FROM pr GROUP BY new_key)"""


def matched_rows(removed: str = "'removed' AS how, 0.0::DOUBLE AS confidence") -> str:
    return f"""SELECT *, 'canonical' AS how, 1.0::DOUBLE AS confidence FROM m0 UNION ALL SELECT *, 'key', 1.0 FROM m1 UNION ALL SELECT *, 'name', 0.9 FROM m2 UNION ALL SELECT *, 'contained', 0.85 FROM m3
UNION ALL SELECT k, NULL, {removed} FROM a3 WHERE k NOT IN (SELECT old_key FROM m3) UNION ALL SELECT NULL, k, 'added', 0.0 FROM b3 WHERE k NOT IN (SELECT new_key FROM m3)"""


_TWO_SETS = """a AS (SELECT p_partkey AS k, lower(trim(p_name)) AS n, CASE WHEN p_partkey % 7 = 0 THEN 'c' || p_partkey END AS c FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT p_partkey AS k, lower(trim(p_name)) || CASE WHEN p_size % 3 = 0 THEN ' plus' ELSE '' END AS n, CASE WHEN p_partkey % 7 = 1 THEN 'c' || (p_partkey - 1) END AS c FROM part WHERE p_partkey % 4 <> 0)"""


def _two_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.part.where("p_partkey % 3 <> 0").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).alias("c"))
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" plus"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Physical Damage - "), "p_name", F.lit(" Coverage"))).otherwise(F.col("p_name"))
    new = t.part.where("p_partkey % 4 <> 0").select("p_partkey", name.alias("p_name"), F.when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("c"), (F.col("p_partkey") - 1).cast("string"))).alias("c"))
    return old, new


@query("j13_name_matched", f"WITH {_TWO_SETS}, {matched_sql('a', 'b')} {matched_rows()}")
def _(t: Tables) -> DataFrame:
    return M.name_matched(*_two_sets(t), "p_partkey", "p_name", "c")


@query("j13_endorsement", f"""WITH {_TWO_SETS}, {matched_sql('a', 'b')} {matched_rows("'unchanged', 1.0")}""")
def _(t: Tables) -> DataFrame:
    return M.name_matched(*_two_sets(t), "p_partkey", "p_name", "c", endorsement=True)


@query("j15_aligned_sections", """SELECT a.l_returnflag, a.n AS one, b.n AS two FROM (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a
JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b ON a.l_returnflag = b.l_returnflag""")
def _(t: Tables) -> DataFrame:
    side = lambda s, n: t.lineitem.where(F.col("l_linestatus") == s).groupBy("l_returnflag").agg(F.count("*").alias(n))
    return side("F", "one").join(side("O", "two"), "l_returnflag")


_TERMS = [(1, "red", "warm"), (2, "blue", "cold"), (3, "small", "size"), (4, "steel", "metal")]


@query("j17_dictionary_match", """WITH e(priority, term, value) AS (VALUES (1, 'red', 'warm'), (2, 'blue', 'cold'), (3, 'small', 'size'), (4, 'steel', 'metal')),
m AS (SELECT p_partkey, arg_min(value, CASE WHEN lower(trim(p_name)) = term THEN 0 ELSE 100 END + priority) AS value, min(CASE WHEN lower(trim(p_name)) = term THEN 'exact' ELSE 'partial' END) AS how
FROM part JOIN e ON contains(lower(trim(p_name)), term) OR contains(term, lower(trim(p_name))) GROUP BY 1)
SELECT p.p_partkey, value, how FROM part p LEFT JOIN m USING (p_partkey)""")
def _(t: Tables) -> DataFrame:
    entries = t.spark.createDataFrame(_TERMS, "priority int, term string, value string")
    return M.dictionary_match(t.part.select("p_partkey", "p_name"), "p_name", entries).drop("p_name")


@query("j16_containment_lookup", """WITH b AS (SELECT DISTINCT lower(p_brand) AS term FROM part), s AS (SELECT p_partkey, lower(p_brand || ' ' || p_size) AS x FROM part)
SELECT p_partkey, max(term) AS term, max(len(term) / len(x)) AS score FROM s JOIN b ON contains(x, term) AND len(term) / len(x) >= 0.5 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    terms = t.part.select(F.lower("p_brand").alias("term")).distinct()
    # A contained term starts at a word, so the first word is an equi-join key.
    rows = t.part.select("p_partkey", F.lower(F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"))).alias("x"))
    keyed = rows.withColumn("w", F.explode(F.array_distinct(F.split("x", " "))))
    hit = keyed.join(terms.withColumn("w", F.split_part("term", F.lit(" "), F.lit(1))), "w").where(F.col("x").contains(F.col("term")))
    score = F.length("term") / F.length("x")
    return hit.withColumn("score", score).where("score >= 0.5").groupBy("p_partkey").agg(F.max("term").alias("term"), F.max("score").alias("score"))


@query("j18_reference_cascade", """WITH r AS (SELECT DISTINCT c_name AS ref, c_custkey FROM customer), a AS (SELECT c_name AS ref, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_name AS ref, c_custkey + 1000000 AS id FROM customer WHERE c_acctbal > 0)
SELECT r.ref, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'key' WHEN b.id IS NOT NULL THEN 'value' END AS step FROM r LEFT JOIN a USING (ref) LEFT JOIN b USING (ref)""")
def _(t: Tables) -> DataFrame:
    refs = t.customer.select(F.col("c_name").alias("ref"))
    a = t.customer.where("c_mktsegment = 'BUILDING'").select("c_name", F.col("c_custkey").alias("id"))
    b = t.customer.where("c_acctbal > 0").select("c_name", (F.col("c_custkey") + 1_000_000).alias("id"))
    return M.reference_cascade(refs, "ref", [("key", a, "c_name"), ("value", b, "c_name")])


def _json_orders(t: Tables, change: bool) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice") + 1).otherwise(F.floor("o_totalprice")) if change else F.floor("o_totalprice")
    return t.orders.select("o_orderkey", F.to_json(F.struct(F.struct("o_orderstatus").alias("state"), price.cast("bigint").alias("price"))).alias("doc"))


@query("r5_json_diff", """SELECT o_orderkey, 'price' AS path, floor(o_totalprice)::BIGINT::VARCHAR AS old, (floor(o_totalprice)::BIGINT + 1)::VARCHAR AS new, 'increase' AS change, 1.0::DOUBLE AS delta FROM orders WHERE o_orderkey % 3 = 0""")
def _(t: Tables) -> DataFrame:
    return M.json_diff(_json_orders(t, False), _json_orders(t, True), "o_orderkey", "doc")


@query("r3_deep_merge")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", M.deep_merged(F.to_json(F.struct("o_orderstatus")), F.to_json(F.struct("o_orderpriority"))).alias("doc"))


@query("s10_tolerant_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t: Tables) -> DataFrame:
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Result: "), "props", F.lit(" thanks"))).otherwise(F.col("props"))
    return t.events.select("event_id", F.get_json_object(S.tolerant_json(wrapped), "$.k").cast("bigint").alias("k"))


@query("s11_broken_json_field", "SELECT event_id, event_type AS kind FROM events")
def _(t: Tables) -> DataFrame:
    broken = F.concat(F.lit('{"id": 1, "kind": "'), "event_type", F.lit('", "rest": [1, '))
    return t.events.select("event_id", S.broken_field(broken, "kind").alias("kind"))


@query("e7_nested_get", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, 'none' AS missing FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("missing"))


@query("s8_markdown_tables", "SELECT p_partkey, 0 AS \"table\", 0 AS row, p_name AS name, p_brand AS brand FROM part")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Intro\n\n| name | brand |\n|---|---|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" | more |\n\nEnd"))
    rows = S.markdown_tables(t.part.select("p_partkey", text.alias("t")), "p_partkey", "t")
    return rows.select("p_partkey", "table", "row", F.element_at("cells", "name").alias("name"), F.element_at("cells", "brand").alias("brand"))


@query("s7_footer_forms", """SELECT o_custkey, 'CG ' || (o_orderkey % 3) AS form, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS pages FROM orders GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("body\nmore\nCG "), (F.col("o_orderkey") % 3).cast("string"))
    out = S.footer_forms(t.orders.withColumn("x", text), "o_custkey", "o_orderkey", F.col("x"), r"CG \d")
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query("f20_pattern_classes", """WITH n AS (SELECT doc_id, regexp_matches(text, '[0-9]{4}')::INT + regexp_matches(text, '@')::INT AS contact, regexp_matches(lower(text), 'rights reserved')::INT + regexp_matches(lower(text), 'license')::INT AS legal FROM documents)
SELECT doc_id, CASE WHEN greatest(contact, legal) = 0 THEN NULL WHEN contact >= legal THEN 'contact' ELSE 'legal' END AS label,
CASE WHEN greatest(contact, legal) > 0 THEN least(0.95::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * greatest(contact, legal)) END AS score FROM n""")
def _(t: Tables) -> DataFrame:
    rules = [("contact", ["[0-9]{4}", "@"]), ("legal", ["(?i)rights reserved", "(?i)license"])]
    return t.documents.select("doc_id", X.best_class(F.col("text"), rules).alias("c")).select("doc_id", "c.label", "c.score")


@query("f21_score_heuristics", "SELECT doc_id, round(least(1.0, 0.3 + CASE WHEN n_chars > 1000 THEN 0.3 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.25 ELSE 0 END + CASE WHEN contains(text, '@') THEN 0.2 ELSE 0 END), 3)::DOUBLE AS score FROM documents")
def _(t: Tables) -> DataFrame:
    points = F.lit(0.3) + F.when(F.col("n_chars") > 1000, 0.3).otherwise(0.0) + F.when(F.col("lang") == "en", 0.25).otherwise(0.0) + F.when(F.contains("text", F.lit("@")), 0.2).otherwise(0.0)
    return t.documents.select("doc_id", F.round(F.least(F.lit(1.0), points), 3).alias("score"))


@query("f22_effect_lattice", """SELECT doc_id, CASE WHEN a AND b THEN 'BOTH' WHEN a THEN 'COVERAGE' WHEN b THEN 'EXCLUSION' ELSE 'NONE' END AS role FROM (SELECT doc_id, contains(text, '@') AS a, regexp_matches(text, '[0-9]{3}') AS b FROM documents)""")
def _(t: Tables) -> DataFrame:
    found = F.filter(F.array(F.when(F.contains("text", F.lit("@")), "COVERAGE"), F.when(F.col("text").rlike("[0-9]{3}"), "EXCLUSION")), lambda x: x.isNotNull())
    role = F.when(F.size(found) == 2, "BOTH").when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("NONE")
    return t.documents.select("doc_id", role.alias("role"))


@query("f24_page_features", """SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, regexp_matches(text, '\\|.*\\|') AS has_table, regexp_matches(text, '^\\s*[a-z]') AS mid_sentence, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("lines"), F.col("text").rlike(r"\|.*\|").alias("has_table"),
        F.col("text").rlike(r"^\s*[a-z]").alias("mid_sentence"), F.regexp_count("text", F.lit("[0-9]+")).cast("bigint").alias("numbers"),
    )


@query("f26_keyword_ratio", """WITH s AS (SELECT doc_id, (contains(upper(text), 'RIGHTS')::INT + contains(upper(text), 'RESERVED')::INT) / 2.0::DOUBLE AS a, (contains(upper(text), 'PASSWORD')::INT + contains(upper(text), 'TOKEN')::INT + contains(upper(text), 'AKIA')::INT) / 3.0::DOUBLE AS b FROM documents)
SELECT doc_id, CASE WHEN a >= b THEN 'legal' ELSE 'keys' END AS label, greatest(a, b) AS share FROM s""")
def _(t: Tables) -> DataFrame:
    rules = [("legal", ["RIGHTS", "RESERVED"]), ("keys", ["PASSWORD", "TOKEN", "AKIA"])]
    return t.documents.select("doc_id", X.keyword_ratio_class(F.col("text"), rules).alias("c")).select("doc_id", "c.label", "c.share")


@query("f27_decision_list", """SELECT doc_id, CASE WHEN regexp_matches(text, 'AKIA[A-Z0-9]+') THEN 'keys' WHEN regexp_matches(text, '[0-9]{16}') THEN 'cards' WHEN regexp_matches(text, '@') THEN 'mail' ELSE 'prose' END AS category, len(regexp_extract_all(text, 'mail[0-9]'))::BIGINT AS n FROM documents""")
def _(t: Tables) -> DataFrame:
    text = F.col("text")
    category = F.when(text.rlike("AKIA[A-Z0-9]+"), "keys").when(text.rlike("[0-9]{16}"), "cards").when(text.rlike("@"), "mail").otherwise("prose")
    return t.documents.select("doc_id", category.alias("category"), F.regexp_count(text, F.lit("mail[0-9]")).cast("bigint").alias("n"))


def _pattern_sum(intent: str) -> str:
    return " + ".join(f"regexp_matches(lower(text), '{p}')::INT" for p in X.INTENTS[intent])


@query("f29_intents", f"""WITH n AS (SELECT conv_id, turn, text, {_pattern_sum('GENERAL')} AS g, {_pattern_sum('QA')} AS q, {_pattern_sum('ANALYSIS')} AS a, {_pattern_sum('AUDIT')} AS d FROM asked),
s AS (SELECT *, q + 1.5::DOUBLE * a + 2.0::DOUBLE * d AS total, CASE WHEN 2 * d > 1.5 * a AND 2 * d > q THEN 'AUDIT' WHEN 1.5 * a > q THEN 'ANALYSIS' ELSE 'QA' END AS best FROM n),
c AS (SELECT *, CASE best WHEN 'AUDIT' THEN d WHEN 'ANALYSIS' THEN a ELSE q END AS own, CASE WHEN total > 0 THEN CASE best WHEN 'AUDIT' THEN 2.0::DOUBLE * d WHEN 'ANALYSIS' THEN 1.5::DOUBLE * a ELSE q END / total END AS share FROM s),
f AS (SELECT *, CASE WHEN q + a + d >= 2 THEN least(0.85::DOUBLE, share) ELSE share END + CASE WHEN own >= 2 THEN least(0.2::DOUBLE, (own - 1) * 0.05::DOUBLE) ELSE 0 END AS sure FROM c)
SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'QA' WHEN g > 0 AND total = 0 THEN 'GENERAL' WHEN total = 0 OR (best <> 'QA' AND sure < 0.35) THEN 'QA' ELSE best END AS intent,
round(CASE WHEN trim(text) = '' THEN 0 WHEN g > 0 AND total = 0 THEN 1 WHEN total = 0 THEN 0.5 WHEN best = 'QA' THEN greatest(least(1.0, sure), 0.6) WHEN sure < 0.35 THEN 0.5 ELSE least(1.0, sure) END, 9)::DOUBLE AS confidence FROM f""".replace(
    "WITH n AS", "WITH asked AS (SELECT conv_id, turn, ['hello, can you help', 'what is the limit and who is the carrier', 'compare the premium, explain why', 'show the history of changes and its source', 'list', ''][(turn + conv_id) % 6 + 1] || ' ' || text AS text FROM conversations), n AS"))
def _(t: Tables) -> DataFrame:
    # Fixed questions before each message, so that every intent comes up.
    asked = F.array(*map(F.lit, ["hello, can you help", "what is the limit and who is the carrier", "compare the premium, explain why", "show the history of changes and its source", "list", ""]))
    text = F.concat(F.get(asked, ((F.col("turn") + F.col("conv_id")) % 6).cast("int")), F.lit(" "), "text")
    out = t.conversations.select("conv_id", "turn", X.intent(text).alias("i"))
    return out.select("conv_id", "turn", "i.intent", F.round("i.confidence", 9).alias("confidence"))


@query("f31_entities", """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[a-z.0-9]+@[a-z0-9.]+'))), ',') AS mails, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'AKIA[A-Z0-9]{16}'))), ',') AS keys FROM documents""")
def _(t: Tables) -> DataFrame:
    every = lambda p: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))), ",")
    return t.documents.select("doc_id", every("[a-z.0-9]+@[a-z0-9.]+").alias("mails"), every("AKIA[A-Z0-9]{16}").alias("keys"))


@query("f32_expansion")
def _(t: Tables) -> DataFrame:
    out = X.expanded(F.col("p_name"), [("red", ["crimson", "scarlet"]), ("small", ["little"])])
    return t.part.select("p_partkey", out.alias("versions"))


@query("f34_abbreviations", "SELECT p_partkey, 'PD ' || p_name || ' property damage' AS t FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.with_abbreviations(F.concat(F.lit("PD "), "p_name"), [("pd", "property damage"), ("bi", "bodily injury")]).alias("t"))


@query("f35_derived_filters", "SELECT user_id, array_to_string(list_sort(list_intersect(list_distinct(list(event_type)), ['click', 'purchase', 'signup'])), ',') AS kept FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    valid = F.array(*map(F.lit, ["click", "purchase", "signup"]))
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.array_intersect(F.collect_set("event_type"), valid)), ",").alias("kept"))


@query("f40_without_fences", "SELECT event_id, props AS t FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.without_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("t"))


@query("o9_longest_only", "SELECT p_partkey, p_name || ' set' AS t FROM part")
def _(t: Tables) -> DataFrame:
    names = F.array("p_name", F.concat("p_name", F.lit(" set")), F.left("p_name", F.lit(3)))
    return t.part.select("p_partkey", F.array_join(X.longest_only(names), ",").alias("t"))
