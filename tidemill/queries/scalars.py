"""Numbers, dates, keys and records."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import numbers as N
from tidemill.functions import records as R
from tidemill.functions import text as X
from tidemill.queries import Tables, query


@query("f1_collapsed", "SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.collapsed(F.col("text")).alias("t"))


@query("f2_slug", "SELECT p_partkey, 'part_' || regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")), "part").alias("slug"))


@query("f3_canonical_key", "SELECT p_partkey, substr(sha256(lower(p_type || ':' || p_name)), 1, 32) AS k FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.canonical_key(F.col("p_type"), F.col("p_name")).alias("k"))


@query("f4_entity_id", "SELECT p_partkey, lower(p_brand) || '_' || substr(sha1(lower(p_brand || ':' || p_name)), 1, 16) AS id FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.entity_id(F.col("p_brand"), F.col("p_name")).alias("id"))


@query("f5_page_hash", "SELECT doc_id, substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 16) AS h FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.page_hash(F.col("text")).alias("h"))


@query("f6_content_hash", "SELECT page_id, sha256(html) AS h FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2("html", 256).alias("h"))


@query("f8_formatting_only", """SELECT p_partkey, p_name <> b AND lower(regexp_replace(p_name, '[^0-9A-Za-z]+', '', 'g')) = lower(regexp_replace(b, '[^0-9A-Za-z]+', '', 'g')) AS same
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN upper(replace(p_name, ' ', '-')) ELSE p_name || ' x' END AS b FROM part)""")
def _(t: Tables) -> DataFrame:
    b = F.when(F.col("p_size") % 2 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.concat("p_name", F.lit(" x")))
    return t.part.select("p_partkey", X.same_but_for_signs(F.col("p_name"), b).alias("same"))


@query("f9_affix_stripped", """SELECT p_partkey, CASE WHEN ends_with(a, ' coverage') THEN trim(left(a, length(a) - 9)) ELSE a END AS name FROM
(SELECT p_partkey, CASE WHEN starts_with(n, 'additional insured -') THEN trim(substr(n, 21)) ELSE n END AS a FROM
(SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'additional insured - ' || lower(p_name) WHEN 1 THEN lower(p_name) || ' coverage' ELSE lower(p_name) END AS n FROM part))""")
def _(t: Tables) -> DataFrame:
    size = F.col("p_size") % 3
    name = F.when(size == 0, F.concat(F.lit("Additional Insured - "), "p_name")).when(size == 1, F.concat("p_name", F.lit(" Coverage"))).otherwise(F.col("p_name"))
    # What a name may start and end with.
    prefixes = ["physical damage -", "hired auto physical damage -", "additional insured -"]
    suffixes = [" - increased limit", " - reduced limit", " coverage", " - modified", " modification"]
    return t.part.select("p_partkey", X.affix_stripped(name, prefixes, suffixes).alias("name"))


@query("f10_title_case", """SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '-Ii' AS name FROM part""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.coverage_name(F.concat("p_name", F.lit("-ii coverage form"))).alias("name"))


@query("f12_term_key", """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'waiver') THEN 'waiver_of_subrogation' WHEN contains(lower(text), 'primary') THEN 'primary_and_noncontributory'
ELSE array_to_string(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda w: w <> '')[1:4], '_') END AS k FROM conversations""")
def _(t: Tables) -> DataFrame:
    rules = [r for r in X.TERMS if r[0] in ("waiver", "primary")]
    return t.conversations.select("conv_id", "turn", X.term_key(F.col("text"), rules).alias("k"))


@query("f13_keyword_category", """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'warm' WHEN contains(lower(p_name), 'blue') THEN 'cold' WHEN contains(lower(p_name), 'steel') THEN 'metal' END AS kind FROM part""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.first_contained(F.col("p_name"), [("red", "warm"), ("blue", "cold"), ("steel", "metal")]).alias("kind"))


@query("f16_paragraphs", """SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '\\n(#{1,6} )', chr(10) || chr(10) || '\\1', 'g'), '\\n\\n+'), lambda p: trim(p) <> ''))::BIGINT AS n FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.paragraphs(F.col("text"))).cast("bigint").alias("n"))


@query("f17_overlap_tail", r"""WITH l AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM l),
r AS (SELECT *, sum(floor((length(s) / 4.0::DOUBLE + len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) / 2 * 1.1::DOUBLE)) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (WHERE n <= 50), '') AS tail FROM l LEFT JOIN r USING (doc_id) GROUP BY doc_id""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.overlap_tail(F.col("text")).alias("tail"))


@query("f18_token_estimate", """SELECT doc_id, floor((length(text) / 4.0::DOUBLE + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) / 2 * 1.1::DOUBLE)::BIGINT AS tokens FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("f25_text_density", "SELECT doc_id, least(length(text) / 4000.0::DOUBLE, 1.0) AS density FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.text_density(F.col("text")).alias("density"))


@query("f39_basename", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", R.basename(F.col("url")).alias("name"))


@query("d1_date_formats", """WITH a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'soon' END AS x FROM orders)
SELECT o_orderkey, coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%m/%d/%Y'), try_strptime(x, '%Y/%m/%d'))::DATE AS day FROM a""")
def _(t: Tables) -> DataFrame:
    m = F.col("o_orderkey") % 4
    x = F.when(m == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(m == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("soon")
    return t.orders.select("o_orderkey", N.parsed_date(x).alias("day"))


@query("d2_recency", "SELECT o_orderkey, CASE WHEN abs(date_diff('day', o_orderdate::DATE, DATE '1998-01-01')) < 365 THEN 0.05::DOUBLE * (1 - abs(date_diff('day', o_orderdate::DATE, DATE '1998-01-01')) / 365) ELSE 0 END AS boost FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", N.recency(F.col("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("boost"))


@query("d3_recency_signed", "SELECT o_orderkey, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') < 365 THEN 0.05::DOUBLE * (1 - date_diff('day', o_orderdate::DATE, DATE '1998-01-01') / 365) ELSE 0 END AS boost FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", N.recency_signed(F.col("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("boost"))


@query("d4_about_a_year", """SELECT a.o_custkey, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
WHERE abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) BETWEEN 360 AND 370 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    a = t.orders.select("o_custkey", F.col("o_orderkey").alias("k1"), F.col("o_orderdate").alias("d1"))
    b = t.orders.select("o_custkey", F.col("o_orderkey").alias("k2"), F.col("o_orderdate").alias("d2"))
    return a.join(b, "o_custkey").where((F.col("k1") < F.col("k2")) & N.about_a_year(F.col("d1"), F.col("d2"))).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("d5_elapsed", "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000).alias("seconds"))


@query("d6_earliest_role", "SELECT o_custkey, arg_min(o_orderkey, o_orderdate) AS expiring FROM (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT * 1000000 + o_orderkey AS o_orderdate FROM orders) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("expiring"))


@query("n1_parsed_decimal", """WITH a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$' || o_totalprice WHEN 1 THEN '(' || o_totalprice || ')' WHEN 2 THEN 'N/A' ELSE o_totalprice || ' USD' END AS x FROM orders)
SELECT o_orderkey, CASE WHEN lower(x) <> 'n/a' THEN try_cast(regexp_replace(x, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2)) END AS v FROM a""")
def _(t: Tables) -> DataFrame:
    m, p = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    x = F.when(m == 0, F.concat(F.lit("$"), p)).when(m == 1, F.concat(F.lit("("), p, F.lit(")"))).when(m == 2, "N/A").otherwise(F.concat(p, F.lit(" USD")))
    return t.orders.select("o_orderkey", N.parsed_decimal(x).alias("v"))


@query("n2_parsed_int", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS v FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", N.parsed_int(F.concat(F.lit("about "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("v"))


@query("n4_sum_of_present", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(coalesce(CASE WHEN l_quantity > 25 THEN l_quantity END, 0) + coalesce(CASE WHEN l_quantity % 2 = 0 THEN 1 END, 0), 0)::DOUBLE AS v FROM lineitem")
def _(t: Tables) -> DataFrame:
    v = N.sum_of_present(F.when(F.col("l_quantity") > 25, F.col("l_quantity")), F.when(F.col("l_quantity") % 2 == 0, 1))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", v.cast("double").alias("v"))


def _changes(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal") * (F.col("c_custkey") % 4) / 2).alias("b"))


_PAIRS = "SELECT c_custkey, c_acctbal AS a, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal * (c_custkey % 4) / 2 END AS b FROM customer"


@query("n5_change_of_magnitude", f"""WITH p AS ({_PAIRS}), q AS (SELECT c_custkey, CASE WHEN b = 0 THEN CASE WHEN a <> 0 THEN 100.0 ELSE 0.0 END ELSE (a - b) / abs(b) * 100 END AS percent FROM p)
SELECT c_custkey, percent, CASE WHEN abs(percent) <= 5 THEN 'low' WHEN abs(percent) <= 20 THEN 'medium' ELSE 'high' END AS severity FROM q""")
def _(t: Tables) -> DataFrame:
    out = _changes(t).select("c_custkey", N.change_of_magnitude(F.col("b"), F.col("a")).alias("percent"))
    return out.withColumn("severity", N.severity(F.col("percent")))


@query("n6_change_signed", f"""WITH p AS ({_PAIRS}), q AS (SELECT c_custkey, CASE WHEN b <> 0 THEN (a - b) / b * 100 END AS percent FROM p)
SELECT c_custkey, percent, CASE WHEN percent IS NULL THEN NULL WHEN abs(percent) < 5 THEN 'low' WHEN abs(percent) < 20 THEN 'medium' ELSE 'high' END AS severity FROM q""")
def _(t: Tables) -> DataFrame:
    out = _changes(t).select("c_custkey", N.change_signed(F.col("b"), F.col("a")).alias("percent"))
    return out.withColumn("severity", N.severity(F.col("percent"), closed=False))


@query("n7_change_or_null", f"WITH p AS ({_PAIRS}) SELECT c_custkey, a - b AS change, CASE WHEN b <> 0 THEN round((a - b) / b * 100, 4) + 0.0::DOUBLE END AS percent FROM p")
def _(t: Tables) -> DataFrame:
    return _changes(t).select("c_custkey", (F.col("a") - F.col("b")).alias("change"), (F.round(N.change_signed(F.col("b"), F.col("a")), 4) + 0.0).alias("percent"))


@query("n8_delta_flag", f"""WITH p AS ({_PAIRS}) SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN a > b THEN 'POSITIVE_CHANGE' WHEN a < b THEN 'NEGATIVE_CHANGE' ELSE 'NEUTRAL' END
ELSE CASE WHEN a < b THEN 'POSITIVE_CHANGE' WHEN a > b THEN 'NEGATIVE_CHANGE' ELSE 'NEUTRAL' END END AS flag FROM p""")
def _(t: Tables) -> DataFrame:
    field = F.when(F.col("c_custkey") % 2 == 0, "limit_amount").otherwise("annual_premium")
    return _changes(t).select("c_custkey", N.delta_flag(field, F.col("b"), F.col("a")).alias("flag"))


@query("n9_advantage", f"WITH p AS ({_PAIRS}) SELECT c_custkey, CASE WHEN a > b THEN 'one' WHEN b > a THEN 'two' ELSE 'tie' END AS better FROM p")
def _(t: Tables) -> DataFrame:
    return _changes(t).select("c_custkey", N.advantage(F.col("a"), F.col("b"), True).alias("better"))


@query("n10_derived_limits", """WITH f(kind, factor) AS (VALUES ('other structures', 0.1::DOUBLE), ('personal property', 0.5::DOUBLE), ('loss of use', 0.2::DOUBLE))
SELECT p_partkey, kind, p_retailprice * factor AS amount FROM part, f WHERE p_size = 10""")
def _(t: Tables) -> DataFrame:
    # Shares of the main limit.
    shares = F.create_map(*(F.lit(x) for pair in (("other structures", 0.1), ("personal property", 0.5), ("loss of use", 0.2)) for x in pair))
    return t.part.where("p_size = 10").select("p_partkey", "p_retailprice", F.explode(shares).alias("kind", "share")).select("p_partkey", "kind", (F.col("p_retailprice") * F.col("share")).alias("amount"))


@query("n11_quality_score", "SELECT p_partkey, greatest(0.0::DOUBLE, least(10.0::DOUBLE, (1 + 0.8::DOUBLE * least(p_retailprice / 2000, 1.0::DOUBLE) - 0.3::DOUBLE * (p_size % 5)) * 10)) AS score FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", N.quality_score(F.col("p_retailprice"), F.lit(2000.0), F.col("p_size") % 5).alias("score"))


@query("n16_hybrid_score", "SELECT c_custkey, 0.7::DOUBLE * (c_acctbal / 10000) + (1 - 0.7::DOUBLE) * (c_custkey % 10) / 10 AS score FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (0.7 * (F.col("c_acctbal") / 10000) + (1 - F.lit(0.7)) * (F.col("c_custkey") % 10) / 10).alias("score"))


@query("n17_money", "SELECT o_orderkey, '$' || format('{:,.2f}', round(o_totalprice, 2)) AS price FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", N.money(F.round("o_totalprice", 2)).alias("price"))


@query("r1_alias_coalesce", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN NULL ELSE p_name END, p_brand) AS v FROM part")
def _(t: Tables) -> DataFrame:
    a = F.when(F.col("p_size") % 3 == 0, "N/A").when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", R.first_present(a, F.col("p_brand")).alias("v"))


@query("p12_truthy", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE (p_size % 4)::VARCHAR END AS v FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.first_truthy((F.col("p_size") % 4).cast("string"), F.col("p_brand")).alias("v"))


@query("r2_renamed_keys", "SELECT p_partkey, p_name AS coverage_name, p_brand AS limit_amount FROM part")
def _(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("p_name"), F.lit("limit"), F.lit(""), F.lit("amount"), F.col("p_brand"))
    out = R.renamed_keys(m, {"name": "coverage_name", "limit": "limit_amount", "amount": "limit_amount"})
    return t.part.select("p_partkey", out.alias("m")).select("p_partkey", F.element_at("m", "coverage_name").alias("coverage_name"), F.element_at("m", "limit_amount").alias("limit_amount"))


@query("r4_longest_text", "SELECT source, arg_max(doc_id, length(text) * 100000000 - doc_id) AS doc_id, max(length(text))::BIGINT AS n FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct(n, -F.col("doc_id"))).alias("doc_id"), F.max(n).cast("bigint").alias("n"))


@query("r6_positional_pick", "SELECT user_id, list(event_id ORDER BY event_id)[3] AS third FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.get(F.array_sort(F.collect_list("event_id")), F.lit(2)).alias("third"))


@query("r7_page_sequence", "SELECT p_partkey, unnest(range(p_size, p_size + 3))::INT AS page FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(R.page_sequence(F.col("p_size"), F.col("p_size") + 2)).alias("page"))


@query("r8_evidence_union", "SELECT user_id, count(DISTINCT e) AS n FROM (SELECT user_id, event_id % 7 AS e FROM events UNION ALL SELECT user_id, event_id % 5 FROM events) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.collect_list(F.col("event_id") % 7).alias("a"), F.collect_list(F.col("event_id") % 5).alias("b"))
    return g.select("user_id", F.size(F.array_distinct(F.concat("a", "b"))).cast("bigint").alias("n"))


@query("r10_spanned_cells", "SELECT p_partkey, unnest(range(p_size, p_size + greatest(p_size % 3, 1)))::INT AS col FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(R.cells_of_span(F.col("p_size"), F.col("p_size") % 3)).alias("col"))


@query("r11_row_records", "SELECT p_partkey, p_name AS name, p_brand AS brand, NULL::VARCHAR AS size FROM part")
def _(t: Tables) -> DataFrame:
    m = R.row_as_map(F.array("p_name", "p_brand"), ["name", "brand", "size"])
    return t.part.select("p_partkey", m.alias("m")).select("p_partkey", *(F.element_at("m", k).alias(k) for k in ("name", "brand", "size")))


@query("r12_swapped_address", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '12 Main St' ELSE c_name END AS address FROM customer")
def _(t: Tables) -> DataFrame:
    even = F.col("c_custkey") % 2 == 0
    address, location = F.when(even, F.col("c_name")).otherwise("12 Main St"), F.when(even, "12 Main St").otherwise(F.col("c_name"))
    swap = location.rlike(r"^\d+ \w+") & ~address.rlike(r"^\d+ \w+")
    return t.customer.select("c_custkey", F.when(swap, location).otherwise(F.col("c_name")).alias("address"))


@query("r13_box_union", "SELECT l_orderkey, min(l_quantity)::DOUBLE AS x0, max(l_quantity)::DOUBLE AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").cast("double").alias("x0"), F.max("l_quantity").cast("double").alias("x1"), F.min("l_discount").alias("y0"), F.max("l_discount").alias("y1"))
