"""Property graphs as edge and node tables: bounded traversal, seeds, scores."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def traversed(edges: DataFrame, starts: DataFrame, depth: int, kinds: Sequence[str] | None = None) -> DataFrame:
    """Nodes within ``depth`` (at most 3) undirected hops of start nodes over trails, which repeat no edge.

    ``edges``: edge_id, src, dst, kind (without ``>``); ``starts``: node. Distinct (start, node, distance, chain of kinds);
    starts themselves are left out. A hop's frontier is distinct by (start, node, chain), so trails through hubs don't multiply: each
    state meets the edges of its node once, in a join on that node, which Spark broadcasts where the frontier is small and splits
    where a hub's edges are many. What a later hop has to know of the trails to a state is which edges are in all of them, as only these
    bar its way: two at most. A second hop's trails over different middle nodes have none in common that leads anywhere but to
    the start.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1 to 3")
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    both = edges.select("edge_id", F.col("src").alias("at"), F.col("dst").alias("to"), "kind").unionByName(
        edges.where("src <> dst").select("edge_id", F.col("dst").alias("at"), F.col("src").alias("to"), "kind")
    ).where("to IS NOT NULL")
    none = F.array().cast(f"array<{edges.schema['edge_id'].dataType.simpleString()}>")
    parallel = (F.count("*").alias("n"), F.min("edge_id").alias("low"), F.max("edge_id").alias("high"))
    reached = lambda df, hop, chain: df.where("to <> start").select("start", F.col("to").alias("node"), F.lit(hop).alias("distance"), chain.alias("chain"))
    begin = starts.select(F.col("node").alias("start"), F.col("node").alias("at")).where("start IS NOT NULL").distinct()
    one = begin.join(both, "at").groupBy("start", "to", "kind").agg(*parallel)
    found = reached(one, 1, F.coalesce("kind", F.lit("")))
    if depth == 1:
        return found
    first = one.select("start", F.col("to").alias("at"), F.col("kind").alias("k1"), F.col("n").alias("n1"), F.col("low").alias("low1"))
    two = first.join(both, "at").groupBy(*first.columns, "to", F.col("kind").alias("k2")).agg(*parallel)
    # Back at the start by a way of the same kind: both edges are of the same ones.
    same = (F.col("to") == F.col("start")) & F.col("k1").eqNullSafe(F.col("k2"))
    once = lambda n, low: F.when(F.col(n) == 1, F.array(low)).otherwise(none)
    barred = F.when(same, F.when(F.col("n") == 2, F.array("low", "high")).otherwise(none)).otherwise(F.concat(once("n1", "low1"), once("n", "low")))
    two = two.where(~same | (F.col("n") > 1)).groupBy("start", "to", "k1", "k2").agg(F.min("at").alias("x"), F.max("at").alias("y"), F.max(barred).alias("barred"))
    two = two.withColumn("barred", F.when(F.col("x") == F.col("y"), F.col("barred")).otherwise(none))
    found = found.unionByName(reached(two, 2, F.concat_ws(">", "k1", "k2")))
    if depth == 2:
        return found
    three = two.select("start", F.col("to").alias("at"), "k1", "k2", "barred").join(both, "at").where(~F.array_contains("barred", F.col("edge_id")))
    return found.unionByName(reached(three, 3, F.concat_ws(">", "k1", "k2", "kind")).distinct())


def nearest_nodes(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of a traversal by distance, node and chain."""
    return found.orderBy("distance", "node", "chain", "start").limit(limit)


def seeds(nodes: DataFrame, wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes whose vector ids hold a wanted one; for wanted ids without any, nodes of their label not yet found.

    ``nodes``: node, label, vector_ids; ``wanted``: vec_id, section; ``labels``: section, label.
    """
    held = nodes.select("node", "label", F.explode("vector_ids").alias("vec_id"))
    direct = held.join(wanted, "vec_id").select("node", "vec_id").distinct()
    lost = wanted.join(direct, "vec_id", "left_anti").join(labels, "section").select("label").distinct()
    rest = nodes.join(direct, "node", "left_anti").join(lost, "label", "left_semi").select("node")
    return direct.select("node").distinct().withColumn("via", F.lit("vector")).unionByName(rest.withColumn("via", F.lit("label")))


def relevance(found: DataFrame, boosts: DataFrame, decay: float = 0.9) -> DataFrame:
    """decay to the power of distance plus the boost of a node, at most 1."""
    score = F.least(F.lit(1.0), F.pow(F.lit(decay), "distance") + F.coalesce("boost", F.lit(0.0)))
    return found.join(boosts, "node", "left").withColumn("score", score).drop("boost")


def with_provenance(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Nodes with their first non-null section by mention order and the sorted ids of their vectors."""
    per = mentions.groupBy("node").agg(
        F.min_by("section", F.when(F.col("section").isNotNull(), F.col("seq"))).alias("section"), F.array_sort(F.collect_set("vec_id")).alias("vector_ids")
    )
    return nodes.join(per, "node", "left")


def non_null(props: str) -> F.Column:
    """A property map without its nulls."""
    return F.map_filter(props, lambda _, v: v.isNotNull())


#: Attributes that may name a node, first match first.
NAMES = ("name", "title", "coverage_name", "exclusion_name", "term", "coverage_type", "policy_number", "claim_number", "endorsement_number")
#: Properties of each kind of node; those with other sources than their own name have them in the second table.
PROPERTIES = {
    "Policy": "policy_number policy_type policy_form status effective_date expiration_date policy_term total_premium base_premium rate_per_100",
    "Organization": "name role address",
    "Coverage": "name coverage_type coverage_part description per_occurrence_limit aggregate_limit deductible_amount deductible_type waiting_period coinsurance valuation_method included",
    "Condition": "title condition_type description applies_to requirements consequences",
    "Endorsement": "endorsement_number title description effective_date",
    "Location": "location_id address construction_type occupancy year_built number_of_stories sprinklered building_value contents_value bi_value tiv flood_zone",
    "Claim": "claim_number cause_of_loss status loss_date report_date paid_amount incurred_amount reserve_amount description",
    "Exclusion": "name exclusion_type description applies_to source_text",
    "Definition": "term definition_text",
    "Monetary": "amount currency description monetary_type",
    "Vehicle": "vin year make model",
    "Driver": "name date_of_birth license_number violations accidents",
}
SOURCES = {
    ("Coverage", "name"): ("name", "coverage_name", *NAMES), ("Coverage", "deductible_amount"): ("deductible", "deductible_amount"), ("Condition", "title"): ("title", "name"),
    ("Endorsement", "endorsement_number"): ("form_number", "endorsement_number"), ("Endorsement", "title"): ("title", "name"), ("Claim", "report_date"): ("report_date", "reported_date"),
    ("Exclusion", "name"): ("name", "title"), ("Exclusion", "exclusion_type"): ("exclusion_type", "type"), ("Definition", "definition_text"): ("definition_text", "definition"),
    ("Monetary", "monetary_type"): ("type",),
}


def node_properties(kind: F.Column, key: F.Column, attributes: F.Column, created: F.Column | None = None) -> F.Column:
    """The properties of a node as a map of texts without nulls: id, entity_type, name, created_at and those of its kind.

    ``attributes``: a map of texts; an empty one counts as absent where another may stand for it. A kind's own name takes the place of the
    general one, also where it is absent; other kinds have the general properties only. Without any name the key is the name.
    """
    table = {k: [{"name": n, "sources": list(SOURCES.get((k, n), (n,)))} for n in names.split()] for k, names in PROPERTIES.items()}
    rules = F.from_json(F.lit(json.dumps(table)), "map<string, array<struct<name: string, sources: array<string>>>>")
    mine = F.coalesce(F.try_element_at(rules, kind), F.array().cast("array<struct<name:string,sources:array<string>>>"))

    def first(keys: F.Column) -> F.Column:
        values = F.transform(keys, lambda k: F.try_element_at(attributes, k))
        return F.coalesce(F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0)), F.try_element_at(values, F.lit(-1)))

    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    name = F.coalesce(F.nullif(first(F.array(*map(F.lit, NAMES))), F.lit("")), key.cast("string"))
    general = F.array(pair("id", key), pair("entity_type", kind), pair("name", name), pair("created_at", created if created is not None else F.lit(None)))
    own = F.transform(mine, lambda r: F.struct(r["name"].alias("k"), F.coalesce(first(r["sources"]), F.when((kind == "Coverage") & (r["name"] == "name"), name)).alias("v")))
    general = F.filter(general, lambda g: ~F.exists(mine, lambda r: r["name"] == g["k"]))
    return F.map_from_entries(F.filter(F.concat(general, own), lambda x: x["v"].isNotNull()))


#: Kinds of node that need a description, and the boost for each match with the question.
DESCRIBED, MATCH_BOOST = ("Exclusion", "Condition"), 0.05


def scored_nodes(found: DataFrame, boosts: DataFrame, kinds: Sequence[str] = (), names: Sequence[str] = (), decay: float = 0.9) -> DataFrame:
    """``found`` (node, kind, section, distance, props) with a score; evidence without a quote is left out.

    decay to the power of distance, plus the section's boost (``boosts``: section in lower case, boost; one row a
    section), plus 0.05 for a kind asked for and 0.05 for a name, title or term that holds a name asked for.
    """
    rows = found.where((F.col("kind") != "Evidence") | (F.trim(F.coalesce(F.try_element_at("props", F.lit("quote")), F.lit(""))) != ""))
    low = lambda xs: [x.lower() for x in xs]
    called = F.lower(F.coalesce(*(F.nullif(F.try_element_at("props", F.lit(k)), F.lit("")) for k in ("name", "title", "term"))))
    kind = F.lower("kind").isin(low(kinds)) if kinds else F.lit(False)
    name = F.lit(False)
    for x in low(names):
        name = name | F.coalesce(called.contains(x), F.lit(False))
    extra = (kind.cast("int") + name.cast("int")) * MATCH_BOOST
    n = F.count("*").over(Window.partitionBy())
    few = boosts.limit(1001).withColumn("_n", F.when(n > 1000, F.raise_error(F.lit("more than 1000 boosts"))).otherwise(n)).where("_n > 0").drop("_n")
    joined = rows.join(F.broadcast(few), F.lower(rows["section"]) == few["section"], "left").drop(few["section"])
    return joined.withColumn("score", F.pow(F.lit(decay), "distance") + F.coalesce("boost", F.lit(0.0)) + extra).drop("boost")


def hydrated(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``nodes`` (node, kind, props) with sparse ones filled from ``records`` (kind, node, attributes; one row each).

    Sparse: under 3 properties, or of a kind in :data:`DESCRIBED` without description and definition_text. Attributes go
    over properties; a description that is still missing is the source_text.
    """
    value = lambda k: F.coalesce(F.try_element_at("props", F.lit(k)), F.lit(""))
    bare = F.col("kind").isin(*DESCRIBED) & (value("description") == "") & (value("definition_text") == "")
    sparse = bare | (F.size("props") < 3)
    kept = F.map_filter("props", lambda k, _: ~F.array_contains(F.map_keys("attributes"), k))
    over = F.map_concat(kept, "attributes")
    source = F.try_element_at(over, F.lit("source_text"))
    lacks = ~F.array_contains(F.map_keys(over), "description") & (F.coalesce(source, F.lit("")) != "")
    full = F.when(lacks, F.map_concat(over, F.create_map(F.lit("description"), source))).otherwise(over)
    out = nodes.join(records.select("kind", "node", "attributes"), ["kind", "node"], "left")
    return out.withColumn("props", F.when(sparse & F.col("attributes").isNotNull(), full).otherwise(F.col("props"))).select(*nodes.columns)
