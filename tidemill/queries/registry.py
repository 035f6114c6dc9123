"""Parts as the items of sections of five kinds, one of them registered here."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.registry import Registry, Rules, entities
from tidemill.queries import Tables, query

_SLUG = "regexp_replace(regexp_replace(lower({x}), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("e6_section_entities", f"""WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'Coverage' WHEN 1 THEN 'Limit' WHEN 2 THEN 'Definition' WHEN 3 THEN 'Vehicle' ELSE 'Part' END AS kind,
  CASE k WHEN 0 THEN 'cov_' || {_SLUG.format(x="p_name")} WHEN 1 THEN 'lim_' || {_SLUG.format(x="p_brand")} WHEN 2 THEN 'def_' || {_SLUG.format(x="p_name")} WHEN 3 THEN 'veh_item_2' ELSE 'part_' || p_partkey END AS entity_id,
  CASE k WHEN 0 THEN 0.5 WHEN 4 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence,
  CASE k WHEN 0 THEN 'coverage_type=' || p_brand || ';name=' || p_name WHEN 1 THEN 'limit_amount=' || p_size || ';limit_name=' || p_brand WHEN 2 THEN 'definition_text=' || p_brand || ';term=' || p_name
    WHEN 3 THEN 'size=' || p_size ELSE 'brand=' || p_brand END AS attributes FROM p WHERE k < 5""")
def _(t: Tables) -> DataFrame:
    registry = Registry()
    registry.register("parts_list", Rules("Part", "part", ("parts",), ("number",), {"brand": ("maker", "brand")}, sure=0.7))
    item = {
        0: ("coverages", F.struct(F.struct(F.array(F.struct(F.lit("").alias("coverage_name"), F.col("p_name").alias("name"), F.col("p_brand").alias("coverage_type"), F.lit(0.5).alias("confidence"))).alias("coverages")).alias("extracted_data"))),
        1: ("limits", F.struct(F.struct(F.col("p_brand").alias("coverage_name"), F.col("p_size").alias("amount")).alias("limits"))),
        2: ("definitions", F.struct(F.array(F.struct(F.col("p_name").alias("definition_term"), F.col("p_brand").alias("definition"))).alias("items"))),
        3: ("vehicle_schedule", None),
        4: ("parts_list", F.struct(F.array(F.struct(F.col("p_partkey").alias("number"), F.col("p_brand").alias("brand"))).alias("parts"))),
    }
    k = F.col("p_partkey") % 6
    # A list of a text and an object has no type in Spark, so the schedule's JSON is put together here.
    schedule = F.concat(F.lit('{"items": ["no object", {"size": '), F.col("p_size").cast("string"), F.lit("}]}"))
    data = F.coalesce(*(F.when(k == i, schedule if i == 3 else F.to_json(s)) for i, (_, s) in item.items()), F.lit("{broken"))
    section = F.coalesce(*(F.when(k == i, F.lit(name)) for i, (name, _) in item.items()), F.lit("coverages"))
    out = entities(t.part.select("p_partkey", section.alias("section"), data.alias("data")), registry, "p_partkey")
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return out.select("p_partkey", "kind", "entity_id", "confidence", pairs.alias("attributes"))
