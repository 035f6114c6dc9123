"""Question answering over vectors and a graph, and citations."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import questions as Q
from tidemill.functions import text as X
from tidemill.operators import graph as G
from tidemill.operators import packing, similarity
from tidemill.operators.relational import merged_rankings


@dataclass(frozen=True)
class Plan:
    """What a question asks for; a small driver-side value that shapes the DataFrame plan."""

    intent: str = "QA"
    sections: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    depth: int = 1
    nodes: int = 25
    k: int = 20
    most: float = 0.7
    budget: int = 8000
    boosts: dict[str, float] = field(default_factory=dict)


#: Hops and nodes by intent.
TRAVERSAL = {"QA": (1, 25), "ANALYSIS": (2, 25), "AUDIT": (3, 50), "GENERAL": (1, 25)}


def planned(question: str, spark: SparkSession, k: int = 20, most: float = 0.7) -> Plan:
    """The plan for one question: its intent, the sections and kinds of entity to look in, its expanded versions, and boosts.

    Encoders are the caller's: the vectors of ``versions`` come in as query vectors.
    """
    text = F.lit(question)
    row = spark.range(1).select(X.intent(text)["intent"].alias("intent"), Q.entities(text).alias("e"), Q.expanded(text).alias("versions"))
    row = row.select(
        "intent", "versions", Q.section_filters(F.col("e.section_hints"), F.col("intent")).alias("sections"),
        Q.entity_filters(F.col("e.coverage_types"), F.col("intent")).alias("kinds"),
    ).first()
    depth, nodes = TRAVERSAL[row["intent"]]
    return Plan(row["intent"], tuple(row["sections"]), tuple(row["kinds"]), tuple(row["versions"]), depth, nodes, k, most, boosts=Q.SECTION_BOOSTS.get(row["intent"], {}))


def answer_context(plan: Plan, vectors: DataFrame, query_vectors: DataFrame, texts: DataFrame, edges: DataFrame) -> DataFrame:
    """One lazy plan from vector search to a budgeted context: node, source, score, use, spent.

    ``vectors``: vec_id, embedding, section; only those in the plan's sections are searched, and a section's boost
    counts in the score. ``texts``: node (equal to vec_id where it has one), tokens, summary_tokens.
    """
    corpus = vectors.where(F.col("section").isin(*plan.sections)) if plan.sections else vectors
    hits = similarity.nearest_vectors(corpus.select("vec_id", "embedding"), query_vectors, plan.k, plan.most)
    best = similarity.first_seen(hits, ["vec_id"], plan.k).join(corpus.select("vec_id", "section"), "vec_id")
    boost = F.lit(0.0)
    for section, points in plan.boosts.items():
        boost = F.when(F.col("section") == section, points).otherwise(boost)
    best = best.select(F.col("vec_id").alias("node"), (1 - F.col("distance") + boost).alias("score"))
    found = G.nearest_nodes(G.traversed(edges, best.select("node"), plan.depth), plan.nodes)
    reached = found.groupBy("node").agg(F.max(F.pow(F.lit(0.9), "distance")).alias("score"))
    merged = merged_rankings(best, reached, "node", "score").join(texts, "node")
    # At most k + nodes rows from here on.
    ordered = merged.withColumn("all", F.lit(1)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node")))
    spent = packing.within_budget(ordered, "all", ["rank"], F.col("tokens"), F.col("summary_tokens"), int(0.95 * plan.budget))
    return spent.join(ordered.select("rank", "node", "source", "score"), "rank").select("node", "source", "score", "use", "spent")


def cited(quotes: DataFrame, docs: DataFrame, prefix: int = 8) -> DataFrame:
    """For each quote (item_id, quote) the document that holds it: whole (tier 1), half of it (2), a quarter (3), or none (4).

    Quotes meet documents by a hash of their first words: a quarter of the quote's, at most ``prefix``, so
    that no quote is compared with a text that doesn't hold its start and none is missed at a tier.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    hashed = lambda c, at, n: F.xxhash64(F.array_join(F.slice(c, at, n), " "))
    q = quotes.select("item_id", words(F.col("quote")).alias("q")).where(F.size("q") > 0)
    q = q.withColumn("p", F.least(F.lit(prefix), F.ceil(F.size("q") / 4)).cast("int")).withColumn("h", hashed("q", F.lit(1), F.col("p")))
    sizes = sorted(r["p"] for r in q.select("p").distinct().collect())  # at most ``prefix``
    d = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    # Hashes of windows leave a text alone; only texts and quotes that met are compared, word by word.
    each = lambda i: F.array(*(F.struct(i.alias("i"), F.lit(n).alias("p"), hashed("w", i + 1, F.lit(n)).alias("h")) for n in sizes or [prefix]))
    windows = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), each)), lambda k: k["i"] + k["p"] <= F.size("w"))
    keys = d.select("doc_id", F.explode(windows).alias("k")).select("doc_id", "k.i", "k.p", "k.h")
    met = keys.join(q.select("item_id", "p", "h"), ["p", "h"]).select("doc_id", "i", "item_id")
    met = met.join(d, "doc_id").join(q.select("item_id", "q"), "item_id")
    window = F.slice("w", F.col("i") + 1, F.size("q"))
    part = lambda n: F.slice("q", F.lit(1), n) == F.slice(window, F.lit(1), n)
    tier = F.when(window == F.col("q"), 1).when(part(F.ceil(F.size("q") / 2).cast("int")), 2).when(part(F.ceil(F.size("q") / 4).cast("int")), 3)
    best = met.select("item_id", "doc_id", tier.alias("tier")).where("tier IS NOT NULL").groupBy("item_id").agg(F.min(F.struct("tier", "doc_id")).alias("b"))
    out = quotes.select("item_id").join(best, "item_id", "left")
    return out.select("item_id", F.col("b.doc_id").alias("doc_id"), F.coalesce("b.tier", F.lit(4)).alias("tier"))
