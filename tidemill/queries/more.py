"""Further text rules, tables, sorts and nested records."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import numbers as N
from tidemill.functions import text as X
from tidemill.operators import matching, packing, tables, windows
from tidemill.plans import chunking
from tidemill.queries import Tables, query


@query("p11_blank_evidence", "SELECT doc_id FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''")
def _(t: Tables) -> DataFrame:
    return t.documents.where(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) != "").select("doc_id")


@query("o4_stable_score_sort", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    top = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("r"))


@query("o5_priority_sort", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus = 'F', o_orderpriority, o_orderkey LIMIT 200")
def _(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.col("o_orderstatus") == "F", "o_orderpriority", "o_orderkey").limit(200).select("o_orderkey")


@query("o6_spatial_sort", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY -l_quantity, l_discount, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def _(t: Tables) -> DataFrame:
    order = [F.desc("l_quantity"), "l_discount", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.orderBy(*order).limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("j22_words_in_boxes", """SELECT a.p_partkey, b.p_partkey AS box FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size = 7
WHERE a.p_size >= b.p_size - 5 AND a.p_retailprice >= b.p_retailprice - 5 AND a.p_size + 1 <= b.p_size + 20 + 5 AND a.p_retailprice + 1 <= b.p_retailprice + 150 + 5""")
def _(t: Tables) -> DataFrame:
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    words = t.part.select("p_partkey", "p_brand", x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))
    boxes = t.part.where("p_size = 7").select(F.col("p_partkey").alias("box"), "p_brand", x.alias("bx0"), y.alias("by0"), (x + 20).alias("bx1"), (y + 150).alias("by1"))
    return matching.words_in_boxes(words, boxes, ["p_brand"]).select("p_partkey", "box")


@query("w14_inherited_structure", """WITH a AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations)
SELECT conv_id, turn, asked FROM a""")
def _(t: Tables) -> DataFrame:
    return windows.forward_filled(t.conversations, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("text")), "asked").select("conv_id", "turn", "asked")


@query("w15_lines_by_anchor", """WITH RECURSIVE o AS (SELECT l_orderkey AS k, l_quantity::DOUBLE AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
f AS (SELECT k, i, y, 0 AS line FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, CASE WHEN abs(o.y - f.y) > 5 THEN o.y ELSE f.y END, CASE WHEN abs(o.y - f.y) > 5 THEN f.line + 1 ELSE f.line END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k AS l_orderkey, line, count(*) AS n FROM f GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    out = packing.lines_by_anchor(t.lineitem, "l_orderkey", ["l_quantity", "l_linenumber", "l_partkey", "l_suppkey"], F.col("l_quantity"))
    return out.groupBy("l_orderkey", "line").agg(F.count("*").alias("n"))


@query("f7_citation_form", r"""SELECT item_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(translate(text, '‘’“”–—', chr(39) || chr(39) || chr(34) || chr(34) || '--'),
  '(?m)^\s*(?:[-*•]|\d+[.)]|[a-zA-Z][.)])\s+', '', 'g')), '[^\w\s.,;:\x27\x22$%()-]', '', 'g'), '\s+', ' ', 'g')) AS t FROM benchmark""")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.quoted_form(F.col("text")).alias("t"))


@query("f11_form_references", "SELECT p_partkey, [p_name || ' FORM', p_brand || ' FORM'] AS forms FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.form_references(F.concat("p_name", F.lit(" FORM "), "p_brand", F.lit(" FORM"))).alias("forms"))


@query("f14_canonical_id", "SELECT p_partkey, left('cov_' || CASE WHEN contains(lower(p_name), 'steel') THEN 'metal' ELSE 'other' END || '_' || regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), 50) AS id FROM part")
def _(t: Tables) -> DataFrame:
    kind = X.first_contained(F.col("p_name"), [("steel", "metal")], F.lit("other"))
    return t.part.select("p_partkey", F.left(F.concat_ws("_", F.lit("cov"), kind, X.slug(F.col("p_name"))), F.lit(50)).alias("id"))


_SYNONYMS = [("total_value", ["total value", "tiv"]), ("building_value", ["building value", "building limit"]), ("brand", ["brand name"])]


@query("f15_canonical_headers", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'total_value' WHEN 1 THEN 'building_value' WHEN 2 THEN 'brand' ELSE 'unknown_zip' END AS name, CASE p_size % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.0 END AS confidence FROM part""")
def _(t: Tables) -> DataFrame:
    m = F.col("p_size") % 4
    header = F.when(m == 0, "Total Value").when(m == 1, "Building Value (USD)").when(m == 2, "The brand").otherwise("ZIP")
    return t.part.select("p_partkey", tables.canonical_header(header, _SYNONYMS).alias("h")).select("p_partkey", "h.name", "h.confidence")


@query("f19_split_to_limit")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(texts):
        return texts.map(lambda x: chunking.split_to_limit(x or "", 200))

    return t.documents.select("doc_id", F.size(pieces("text")).alias("pieces"))


@query("f23_anchored_spans", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT *, sum(CASE WHEN i = 0 OR regexp_matches(line, '^[A-E]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM l)
SELECT doc_id, span::BIGINT AS span, min(i)::INT AS start, max(i)::INT AS "end" FROM m GROUP BY doc_id, span""")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    new = F.when((F.col("i") == 0) | F.col("line").rlike("^[A-E]"), 1).otherwise(0)
    marked = lines.withColumn("span", F.sum(new).over(Window.partitionBy("doc_id").orderBy("i")))
    return marked.groupBy("doc_id", "span").agg(F.min("i").alias("start"), F.max("i").alias("end"))


@query("f28_table_kinds", """WITH s AS (SELECT p_partkey, 0.35::DOUBLE * least(contains(lower(p_name), 'steel')::INT, 2) / 2 + 0.45::DOUBLE * least(contains(lower(p_brand), 'brand')::INT + contains(lower(p_brand), '1')::INT, 2) / 2.0 AS score,
contains(lower(p_name), 'steel')::INT + contains(lower(p_brand), 'brand')::INT + contains(lower(p_brand), '1')::INT AS n FROM part)
SELECT p_partkey, round(least(1.0, CASE WHEN n < 2 THEN score * 0.5 ELSE score + 0.1 END), 6)::DOUBLE AS score FROM s""")
def _(t: Tables) -> DataFrame:
    score = tables.table_kind_score(F.col("p_brand"), F.col("p_name"), ["brand", "1"], ["steel"])
    return t.part.select("p_partkey", F.round(score, 6).alias("score"))


@query("f30_keyword_sections", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'of') THEN 'a,b,c' WHEN contains(lower(text), 'the') THEN 'a,b' WHEN contains(lower(text), 'of') THEN 'b,c' ELSE '' END AS sections FROM conversations")
def _(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("the", "a"), ("the", "b"), ("of", "b"), ("of", "c")], "word string, section string")
    low = t.conversations.select("conv_id", "turn", F.lower("text").alias("x"))
    words = [r["word"] for r in rules.select("word").distinct().orderBy("word").collect()]
    found = low.withColumn("word", F.explode_outer(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains("x", w)))).join(F.broadcast(rules), "word", "left")  # four rules
    return found.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


@query("f33_canonical_terms", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'bodily injury' ELSE 'property damage' END AS term FROM part")
def _(t: Tables) -> DataFrame:
    synonyms = t.spark.createDataFrame([("bi", "bodily injury"), ("bodily injury", "bodily injury"), ("pd", "property damage")], "word string, term string")
    asked = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.when(F.col("p_size") % 4 == 0, "bi").otherwise("bodily injury")).otherwise("pd").alias("word"))
    return asked.join(synonyms, "word").select("p_partkey", "term")


@query("f37_effect_rules", "SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'high' WHEN contains(lower(text), 'rights') THEN 'medium' ELSE 'low' END AS severity FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.first_contained(F.col("text"), [("password", "high"), ("rights", "medium")], F.lit("low")).alias("severity"))


@query("f38_described", "SELECT p_partkey, 'Covers ' || lower(p_name) || CASE WHEN p_size > 25 THEN ' as modified by ' || p_brand ELSE '' END || '.' AS d FROM part")
def _(t: Tables) -> DataFrame:
    tail = F.when(F.col("p_size") > 25, F.concat(F.lit(" as modified by "), "p_brand")).otherwise("")
    return t.part.select("p_partkey", F.concat(F.lit("Covers "), F.lower("p_name"), tail, F.lit(".")).alias("d"))


@query("n3_sentinel_null", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name END AS v FROM part")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, " N/A ").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", F.when(~F.lower(F.trim(raw)).isin(*N.NO_NUMBER), raw).alias("v"))


def _cells(t: Tables) -> DataFrame:
    head = F.array(*(F.struct(F.lit(0).alias("row"), F.lit(i).alias("col"), F.lit(1).alias("rowspan"), F.lit(w).alias("colspan"), F.lit(x).alias("text")) for i, w, x in ((0, 1, "Name of part"), (1, 2, "Price and size"))))
    body = F.array(*(F.struct(F.lit(1).alias("row"), F.lit(i).alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), c.cast("string").alias("text")) for i, c in enumerate((F.col("p_name"), F.floor("p_retailprice"), F.when(F.col("p_size") > 9, F.col("p_size").cast("string")).otherwise("")))))
    return t.part.select("p_partkey", F.explode(F.concat(head, body)).alias("x")).select("p_partkey", "x.*")


@query("agg22_grid_confidence", """SELECT p_partkey, round((CASE WHEN p_size > 9 THEN 5 ELSE 4 END) / 6.0::DOUBLE * 0.2 + 0.25 + 0.2 + 0.2 + 0.15 * 1.0, 6)::DOUBLE AS overall FROM part""")
def _(t: Tables) -> DataFrame:
    return tables.grid_confidence(_cells(t), "p_partkey").select("p_partkey", F.round("overall", 6).alias("overall"))


@query("r9_rebuilt_headers", "SELECT p_partkey, c, CASE WHEN c = 0 THEN 'Name of part' ELSE 'Price and size' END AS header FROM part, (SELECT unnest([0, 1, 2]) AS c)")
def _(t: Tables) -> DataFrame:
    return tables.rebuilt_headers(_cells(t), "p_partkey")


@query("r14_split_words", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w <> ''))::BIGINT AS n, 0.0::DOUBLE AS low, 100.0::DOUBLE AS high FROM part")
def _(t: Tables) -> DataFrame:
    words = matching.split_words(t.part.select("p_partkey", "p_name", F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1")), "p_name")
    return words.groupBy("p_partkey").agg(F.count("*").alias("n"), F.round(F.min("x0"), 6).alias("low"), F.round(F.max("x1"), 6).alias("high"))


@query("e5_default_fill", "SELECT l_orderkey, string_agg(CASE WHEN l_quantity > 25 THEN l_quantity::INT::VARCHAR ELSE '0' END, ',' ORDER BY l_partkey, l_linenumber, l_suppkey, l_quantity) AS pages FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    item = F.struct("l_partkey", "l_linenumber", "l_suppkey", "l_quantity", F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int")).alias("page"))
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    filled = F.transform("items", lambda x: x.withField("page", F.coalesce(x["page"], F.lit(0))))
    return nested.select("l_orderkey", F.array_join(F.transform(filled, lambda x: x["page"].cast("string")), ",").alias("pages"))


@query("e6_entity_rows", "SELECT p_partkey, 'part_' || regexp_replace(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS entity_id, p_name AS name, 0.8::DOUBLE AS confidence FROM part")
def _(t: Tables) -> DataFrame:
    items = t.part.select("p_partkey", F.to_json(F.array(F.struct(F.col("p_name").alias("title")))).alias("items"))
    rows = items.lateralJoin(tables.EntityRows(F.lit("part"), F.col("items").outer()))
    return rows.select("p_partkey", "entity_id", "name", "confidence")


@query("e11_provision_rules", "SELECT doc_id, CASE WHEN contains(lower(text), 'we will pay') THEN 'coverage_expansion' WHEN contains(lower(text), 'does not apply') OR contains(lower(text), 'subject to') THEN 'coverage_restriction' WHEN contains(lower(text), 'license') THEN 'condition_modification' ELSE 'coverage_expansion' END AS kind FROM documents")
def _(t: Tables) -> DataFrame:
    rules = [("we will pay", "coverage_expansion"), ("does not apply", "coverage_restriction"), ("subject to", "coverage_restriction"), ("license", "condition_modification")]
    return t.documents.select("doc_id", X.first_contained(F.col("text"), rules, F.lit("coverage_expansion")).alias("kind"))


@query("e17_merged_super_chunks")
def _(t: Tables) -> DataFrame:
    parts = chunking.chunked(t.documents, 300, 60, 0).withColumn("g", F.coalesce("section", F.lit("")))
    return packing.merged_small(parts, "doc_id", ["chunk"], "g", F.col("tokens"), 500, 1500)


@query("s22_evidence_edges", "SELECT vec_id, 'label' || label AS node, 'HAS_EMBEDDING' AS kind FROM embeddings")
def _(t: Tables) -> DataFrame:
    nodes = t.embeddings.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("node")).distinct()
    edges = t.embeddings.select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("node"), F.lit("HAS_EMBEDDING").alias("kind"))
    return edges.join(nodes, "node", "left_semi").select("vec_id", "node", "kind")


@query("x5_section_chunks")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("# Coverage\n\n"), "text", F.lit("\n\n# Exclusions\n\nNone."))
    out = chunking.chunked(t.documents.withColumn("text", text), 400, 100, 30)
    return out.groupBy("doc_id", "section").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
