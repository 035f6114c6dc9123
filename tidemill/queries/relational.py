"""Scans, keyed writes, projections, joins, sorts and sets."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import relational as R
from tidemill.queries import Tables, query


@query("s1_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(t: Tables) -> DataFrame:
    return R.only(t.orders.where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice"))


@query("s2_paged_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200 OFFSET 20")
def _(t: Tables) -> DataFrame:
    return R.page_of(t.orders, ["o_orderkey"], 20, 200, {"o_orderstatus": "F"}).select("o_orderkey", "o_orderstatus")


@query("s3_unique_key", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042'")
def _(t: Tables) -> DataFrame:
    return R.only(R.matching(t.customer, {"c_name": "Customer#000000042"}).select("c_custkey", "c_name"))


@query("s4_ordered_children", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey BETWEEN 1 AND 50
ORDER BY l_orderkey, l_linenumber, l_partkey""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_orderkey BETWEEN 1 AND 50")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("s14_bulk_insert", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name || '*' FROM nation")
def _(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name")
    return n.unionByName(n.select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat("n_name", F.lit("*")).alias("n_name")))


@query("s15_update_by_key", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""")
def _(t: Tables) -> DataFrame:
    changes = t.orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return R.update_by_key(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), changes, ["o_orderkey"])


@query("s16_upsert", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT -o_orderkey, 0.0 FROM orders WHERE o_orderkey BETWEEN 1 AND 5""")
def _(t: Tables) -> DataFrame:
    base = t.orders.select("o_orderkey", "o_totalprice")
    hit = base.where("o_orderkey % 7 = 0")
    changes = hit.select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("v")).unionByName(
        hit.select("o_orderkey", (F.col("o_totalprice") + 2).alias("o_totalprice"), F.lit(2).alias("v"))
    ).unionByName(base.where("o_orderkey BETWEEN 1 AND 5").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.lit(1).alias("v")))
    return R.upsert(base, changes, ["o_orderkey"], "v")


@query("s17_insert_ignore", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 20, 'new' FROM nation WHERE n_nationkey + 20 > 24")
def _(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name")
    return R.insert_missing(n, n.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.lit("new").alias("n_name")), ["n_nationkey"])


@query("s18_replace_where", """SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT l_orderkey, 'R', 0.0 FROM lineitem WHERE l_returnflag = 'R'""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"))
    new = rows.where("l_returnflag = 'R'").withColumn("l_quantity", F.lit(0.0))
    return R.replace_where(rows, F.col("l_returnflag") == "R", new)


@query("s19_compensating_delete", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def _(t: Tables) -> DataFrame:
    return R.without_keys(t.customer.select("c_custkey"), t.customer.where("c_custkey % 3 = 0").select("c_custkey"), ["c_custkey"])


@query("s24_event_frames", """SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"event_id":' || event_id || ',"user_id":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def _(t: Tables) -> DataFrame:
    from tidemill.sources.sinks import event_frame

    return t.events.select("event_id", event_frame(F.col("event_type"), F.struct("event_id", "user_id")).alias("frame"))


@query("s26_vector_rows", "SELECT doc_id, sha256(text) AS content_hash, length(text)::BIGINT AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.char_length("text").cast("bigint").alias("n"))


@query("p1_projection", "SELECT p_partkey, p_brand FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_brand")


@query("p2_conjunctive_filter", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45")
def _(t: Tables) -> DataFrame:
    return R.matching(t.lineitem, {"l_returnflag": "R", "l_linestatus": "F"}).where("l_quantity > 45").select("l_orderkey", "l_partkey")


@query("p3_in_list", "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_suppkey IN (1, 2, 3)")
def _(t: Tables) -> DataFrame:
    return R.matching(t.lineitem, {"l_returnflag": ["A", "N"], "l_suppkey": [1, 2, 3]}).select("l_orderkey", "l_returnflag")


@query("p4_dynamic_filter", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t: Tables) -> DataFrame:
    return R.matching(t.orders, {"o_orderstatus": "O", "o_orderpriority": ["1-URGENT", "2-HIGH"]}).agg(F.count("*").alias("n"))


@query("p5_is_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def _(t: Tables) -> DataFrame:
    return R.matching(t.documents.join(t.labels, "doc_id", "left"), {"quality": None}).select("doc_id")


@query("p7_exclude_self", "SELECT vec_id FROM embeddings WHERE vec_id <> 3 AND label <> 1")
def _(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id <> 3 AND label <> 1").select("vec_id")


@query("p13_display_text", "SELECT p_partkey, 'name: ' || p_name || ' | brand: ' || p_brand || ' | size: ' || p_size AS display FROM part")
def _(t: Tables) -> DataFrame:
    from tidemill.functions.records import display_text

    return t.part.select("p_partkey", display_text({"name": "p_name", "brand": "p_brand", "size": "p_size"}).alias("display"))


@query("p14_section_template", """SELECT o_orderkey, 'Order ' || o_orderkey || chr(10) || 'Status: ' || o_orderstatus ||
 CASE WHEN o_totalprice > 100000 THEN chr(10) || 'Large order' ELSE '' END AS content FROM orders""")
def _(t: Tables) -> DataFrame:
    from tidemill.functions.records import template

    return t.orders.select("o_orderkey", template(
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("Status: "), "o_orderstatus"),
        F.when(F.col("o_totalprice") > 100000, "Large order"),
    ).alias("content"))


@query("p14_section_texts", """WITH p AS (SELECT *, p_partkey % 6 AS k, p_retailprice::DECIMAL(18,2) AS price, CASE WHEN p_retailprice >= 1000 THEN (p_retailprice::DECIMAL(18,2) // 1000)::INT::VARCHAR || ',' || right('000' || ((p_retailprice::DECIMAL(18,2))::VARCHAR), 6)
  ELSE p_retailprice::DECIMAL(18,2)::VARCHAR END AS money FROM part)
SELECT p_partkey, CASE k
  WHEN 0 THEN 'Section: Declarations' || chr(10) || 'Policy Number: ' || p_partkey || chr(10) || 'Policy Period: Not specified to ' || p_size || chr(10) || 'Total Premium: $' || money || chr(10) || 'Context keywords: policy, insured, coverage, effective, premium, terms, named insured, policy number'
  WHEN 1 THEN 'Section: Coverage' || chr(10) || 'Coverage Name: ' || p_name || chr(10) || 'Included: Yes' || chr(10) || 'Deductible: $' || money || ' (' || p_type || ')' || chr(10) || 'Context keywords: limit, coverage, protection, sublimit, deductible'
  WHEN 2 THEN 'Section: Schedule of Values' || chr(10) || 'Location ID: ' || p_partkey || chr(10) || 'Construction: ' || p_type || chr(10) || 'Area: ' || p_size || ' sqft' || chr(10) || 'Context keywords: location, property, TIV, total insured value, address, occupancy'
  WHEN 3 THEN 'Section: Driver Schedule' || chr(10) || 'Driver ID: ' || p_partkey || chr(10) || 'Name: ' || p_name || chr(10) || 'License: ' || p_brand || ' (Unknown State)'
  WHEN 4 THEN 'Section: Definitions' || chr(10) || 'Term: ' || p_name || chr(10) || 'Definition: ' || p_brand || chr(10) || 'Context keywords: definition, defined, meaning, terminology, glossary, terms'
  ELSE 'Document Section: Spare Parts' || chr(10) || chr(10) || 'Paid Amount: $' || money || chr(10) || 'Part Id: ' || p_partkey || chr(10) || chr(10) || 'Colour: ' || p_brand END AS content FROM p""")
def _(t: Tables) -> DataFrame:
    from tidemill.functions.section_text import section_text

    text = lambda c: F.col(c).cast("string")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    kinds = [
        ("Declarations", {"policy_no": text("p_partkey"), "named_insured": F.lit("N/A"), "exp_date": text("p_size"), "amount_due": price}),
        ("coverages", {"coverage_name": F.lit(""), "name": text("p_name"), "ded": price, "deductible_type": text("p_type")}),
        ("sov", {"loc_no": text("p_partkey"), "latitude": F.lit("1"), "construction_type": text("p_type"), "square_footage": text("p_size")}),
        ("driver", {"id": text("p_partkey"), "name": text("p_name"), "dl_number": text("p_brand")}),
        ("definitions", {"term": text("p_name"), "meaning": text("p_brand")}),
        ("spare_parts", {"part_id": text("p_partkey"), "colour": text("p_brand"), "paid_amount": price, "claims": F.lit("[]")}),
    ]
    k = F.col("p_partkey") % 6
    section = F.coalesce(*(F.when(k == i, F.lit(s)) for i, (s, _) in enumerate(kinds)))
    data = F.coalesce(*(F.when(k == i, F.create_map(*(x for n, c in d.items() for x in (F.lit(n), c)))) for i, (_, d) in enumerate(kinds)))
    return t.part.select("p_partkey", section_text(section, data).alias("content"))


@query("j1_semi_join", "SELECT DISTINCT c.c_custkey, c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F'")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j2_left_tail", """SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1""")
def _(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("j3_star_join", """SELECT DISTINCT l.l_orderkey, p.p_brand, s.s_name, n.n_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE p.p_size <= 5""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.where("p_size <= 5"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("l_orderkey", "p_brand", "s_name", "n_name").distinct()


@query("j4_bridge_scope", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = s_suppkey AND o_orderpriority = '1-URGENT')")
def _(t: Tables) -> DataFrame:
    scope = t.lineitem.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return t.supplier.join(scope, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("j5_nested_children", """SELECT o.o_orderkey, count(l.l_partkey) AS n, string_agg(l.l_partkey, ',' ORDER BY l.l_partkey) AS parts
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def _(t: Tables) -> DataFrame:
    parents = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    nested = R.with_children(parents, t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", ["l_partkey"], "items")
    parts = F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",")
    return nested.select(F.col("l_orderkey").alias("o_orderkey"), F.size("items").cast("bigint").alias("n"), F.when(F.size("items") > 0, parts).alias("parts"))


@query("j6_batched_lookup", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("j7_lookup_cascade", """SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, coalesce(p.p_brand, s.s_name, 'none') AS found FROM
(SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) l LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON p.p_partkey = l.l_partkey
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = l.l_suppkey""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    parts = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    suppliers = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    out = R.first_lookup(rows, [(parts, ["l_partkey"], "p_brand"), (suppliers, ["l_suppkey"], "s_name")], "found")
    return out.withColumn("found", F.coalesce("found", F.lit("none")))


@query("j8_full_outer_keys", """SELECT coalesce(a.k, b.k) AS l_partkey, a.q AS q1996, b.q AS q1997 FROM
(SELECT l_partkey AS k, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1) a FULL JOIN
(SELECT l_partkey AS k, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1) b ON a.k = b.k""")
def _(t: Tables) -> DataFrame:
    def year(y: int) -> DataFrame:
        rows = t.lineitem.where(F.col("l_shipdate").between(f"{y}-01-01", f"{y}-12-31 23:59:59.999999"))
        return rows.groupBy("l_partkey").agg(F.sum("l_quantity").cast("double").alias(f"q{y}"))

    return year(1996).join(year(1997), "l_partkey", "full_outer")


@query("j9_field_diff", """WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0),
ua AS (SELECT o_orderkey, 'o_orderstatus' AS path, o_orderstatus AS v FROM a UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM a),
ub AS (SELECT o_orderkey, 'o_orderstatus' AS path, o_orderstatus AS v FROM b UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM b)
SELECT coalesce(ua.o_orderkey, ub.o_orderkey) AS o_orderkey, coalesce(ua.path, ub.path) AS path, ua.v AS old, ub.v AS new,
CASE WHEN ua.v IS NULL THEN 'added' WHEN ub.v IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM ua FULL JOIN ub ON ua.o_orderkey = ub.o_orderkey AND ua.path = ub.path WHERE ua.v IS DISTINCT FROM ub.v""")
def _(t: Tables) -> DataFrame:
    fields = ["o_orderstatus", "o_orderpriority"]
    old = t.orders.where("o_orderkey % 3 <> 0")
    new = t.orders.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END"))
    return R.field_diff(old, new, ["o_orderkey"], fields)


@query("j10_positional_zip", """WITH g AS (SELECT user_id, list(event_type ORDER BY event_id) FILTER (WHERE event_type IN ('view', 'click')) AS a,
list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY user_id),
u AS (SELECT user_id, a, b, unnest(range(greatest(coalesce(len(a), 0), coalesce(len(b), 0)))) AS pos FROM g)
SELECT user_id, pos::INT AS pos, a[pos + 1] AS types, b[pos + 1] AS bought FROM u""")
def _(t: Tables) -> DataFrame:
    def ordered(condition: str, value: str) -> F.Column:
        got = F.array_sort(F.collect_list(F.when(F.expr(condition), F.struct("event_id", F.col(value).alias("v")))))
        return F.transform(got, lambda x: x["v"])

    g = t.events.groupBy("user_id").agg(ordered("event_type IN ('view', 'click')", "event_type").alias("types"), ordered("event_type = 'purchase'", "event_id").alias("bought"))
    return R.zipped(g, ["user_id"], "types", "bought")


@query("j11_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j12_missing_required", """WITH u AS (SELECT DISTINCT user_id FROM events), r(x) AS (VALUES ('click'), ('purchase'), ('refund'), ('signup')),
h AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT user_id, string_agg(x, ',' ORDER BY x) AS missing FROM u, r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = u.user_id AND h.event_type = x) GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    out = R.missing_required(t.events, "user_id", "event_type", ["click", "purchase", "refund", "signup"])
    return out.withColumn("missing", F.array_join("missing", ","))


@query("j19_array_overlap", """WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS words FROM documents)
SELECT doc_id FROM w WHERE list_has_any(words, ['copyright', 'password=', 'license'])""")
def _(t: Tables) -> DataFrame:
    words = F.split(F.lower("text"), " ")
    return t.documents.where(F.arrays_overlap(words, F.array(*map(F.lit, ["copyright", "password=", "license"])))).select("doc_id")


@query("j20_fallback_by_label", """WITH m AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 11 = 0), l AS (SELECT DISTINCT label FROM m)
SELECT vec_id, 'direct' AS via FROM m UNION ALL
SELECT e.vec_id, 'label' FROM embeddings e JOIN l ON e.label = l.label WHERE e.vec_id % 11 <> 0 AND e.vec_id % 2 = 0""")
def _(t: Tables) -> DataFrame:
    direct = t.embeddings.where("vec_id % 11 = 0").select("vec_id", "label")
    rest = t.embeddings.where("vec_id % 2 = 0").select("vec_id", "label").join(direct, "vec_id", "left_anti").join(direct.select("label").distinct(), "label")
    return direct.select("vec_id", F.lit("direct").alias("via")).unionByName(rest.select("vec_id", F.lit("label").alias("via")))


@query("j23_interval_cover", """WITH s AS (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.event_id, e.user_id, s.a AS span_start FROM events e JOIN s ON e.user_id = s.user_id AND e.event_id BETWEEN s.a AND s.b""")
def _(t: Tables) -> DataFrame:
    spans = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("span_start"), F.max("event_id").alias("span_end"))
    return R.in_intervals(t.events.select("event_id", "user_id"), spans, "user_id", "event_id", "span_start", "span_end", 1000).select("event_id", "user_id", "span_start")


@query("j24_date_range", """SELECT l.l_orderkey, count(*) AS late FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate < o.o_orderdate OR l.l_shipdate > o.o_orderdate + INTERVAL 90 DAY GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = ~F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 90 DAY"))
    return rows.where(out).groupBy("l_orderkey").agg(F.count("*").alias("late"))


@query("o1_multi_key_sort", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 50 OFFSET 5")
def _(t: Tables) -> DataFrame:
    return R.page_of(t.conversations.select("conv_id", "turn", "role"), [F.desc("conv_id"), F.desc("turn")], 5, 50)


@query("o2_latest_n", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("o7_nearest_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY abs(l_orderkey - 500), l_orderkey < 500, l_linenumber, l_partkey, l_suppkey LIMIT 40")
def _(t: Tables) -> DataFrame:
    order = [F.abs(F.col("l_orderkey") - 500), F.col("l_orderkey") < 500, "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.orderBy(*order).limit(40).select("l_orderkey", "l_linenumber", "l_partkey")


@query("o8_truncate_list", """SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type)))[1:3], ',') AS types FROM events GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 3), ",").alias("types"))


@query("u1_union_all", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k")))


@query("u2_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("k")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"))).distinct()


@query("u3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select(F.col("o_custkey").alias("k")))


@query("u4_intersection", "SELECT user_id AS k FROM events INTERSECT SELECT o_custkey FROM orders")
def _(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("k")).intersect(t.orders.select(F.col("o_custkey").alias("k")))


@query("u5_ranked_merge", """WITH a AS (SELECT c_custkey AS k, c_acctbal / 10000 AS score FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT o_custkey AS k, max(o_totalprice) / 500000 AS score FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'one' ELSE 'two' END AS source,
greatest(a.score, b.score) + CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END AS score FROM a FULL JOIN b ON a.k = b.k""")
def _(t: Tables) -> DataFrame:
    one = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 10000).alias("score"))
    two = t.orders.groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_totalprice") / 500000).alias("score"))
    return R.merged_rankings(one, two, "k", "score")


@query("u6_ordered_dedup", """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE length(text) < 2000),
f AS (SELECT doc_id, lower(w) AS k, min(i) AS i FROM w GROUP BY 1, 2)
SELECT doc_id, string_agg(k, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id""")
def _(t: Tables) -> DataFrame:
    return t.documents.where(F.length("text") < 2000).select("doc_id", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


@query("u7_pair_partition", """WITH p(a, b) AS (VALUES ('view', 'click'), ('signup', 'purchase')),
n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
x AS (SELECT a || '+' || b AS part, n1.n + n2.n AS n FROM p JOIN n n1 ON n1.event_type = a JOIN n n2 ON n2.event_type = b)
SELECT part, n FROM x UNION ALL SELECT event_type, n FROM n WHERE event_type NOT IN (SELECT a FROM p UNION SELECT b FROM p)""")
def _(t: Tables) -> DataFrame:
    from tidemill.operators.matching import section_partition

    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return section_partition(counts, "event_type", "n", [("view", "click"), ("signup", "purchase")])
