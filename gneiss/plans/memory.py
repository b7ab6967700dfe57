"""Analyses over memories and their typed associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import scoring as S
from gneiss.functions import text as T
from gneiss.operators import graph as G
from gneiss.plans.codegraph import shape_of

REASONING = ("inferential", "causal")


def layer(kind: Column) -> Column:
    return F.when(kind.isin("consolidation", "provenance"), "provenance").otherwise("semantic")


def stats(memories: DataFrame) -> DataFrame:
    """Counts by type, by status and in all, in one pass of grouping sets."""
    return memories.groupingSets([["type"], ["status"], []], "type", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("importance").alias("mean_importance"))


def fragmentation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, n, type): isolated memories and silos of two or three."""
    sizes = G.weak_components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where("n <= 3").select("component", "n", F.when(F.col("n") == 1, "isolated_memory").otherwise("knowledge_silo").alias("type"))


def hubs(associations: DataFrame, least: int = 4) -> DataFrame:
    """(node, degree): memories with at least ``least`` associations in either direction; parallel ones count."""
    ends = associations.select(F.col("from_id").alias("node")).unionByName(associations.select(F.col("to_id").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)


def decaying(memories: DataFrame, days: int = 30, accesses: int = 1) -> DataFrame:
    rows = memories.where(F.col("status") == "active").where((F.col("age_days") > days) & (F.col("access_count") <= accesses))
    return rows.select("id", "age_days", S.decay(F.col("age_days")).alias("decay"))


def betti_breakdown(associations: DataFrame) -> DataFrame:
    """(class, n_vertices, n_edges, beta_0, beta_1): all edges, reasoning ones, and the rest, in one labelling.

    Parallel edges count each.
    """
    reasoning = F.col("type").isin(*REASONING)
    classes = F.array(F.lit("all"), F.when(reasoning, "reasoning").otherwise("structural"))
    rows = associations.select(F.explode(classes).alias("class"), "from_id", "to_id")
    tagged = rows.select("class", F.concat_ws("|", "class", "from_id").alias("src"), F.concat_ws("|", "class", "to_id").alias("dst"))
    parts = G.weak_components(G.vertices(tagged), tagged).withColumn("class", F.substring_index("node", "|", 1))
    counts = parts.groupBy("class").agg(F.count(F.lit(1)).alias("n_vertices"), F.countDistinct("component").alias("beta_0"))
    edges = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n_edges"))
    joined = counts.join(edges, "class")
    return joined.select("class", "n_vertices", "n_edges", "beta_0", F.greatest(F.lit(0).cast("long"), F.col("n_edges") - F.col("n_vertices") + F.col("beta_0")).alias("beta_1"))


def manifold(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return shape_of(G.betti(nodes, edges), memory=True)


def consolidation_trigger(memories: DataFrame, components: DataFrame) -> DataFrame:
    """One row: unconsolidated, beta_0, isolated, and whether any of the three calls for consolidation."""
    open_ = memories.agg(F.count_if((F.col("status") == "active") & (F.col("type") == "episodic")).alias("unconsolidated"))
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("beta_0"), F.count_if(F.col("n") == 1).alias("isolated"))
    row = open_.crossJoin(sizes)
    return row.select("*", ((F.col("unconsolidated") >= 15) | (F.col("beta_0") > 5) | (F.col("isolated") >= 5)).alias("needed"))


def drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """(distance, drift): Euclidean distance of two vectors (name, value) over all their names."""
    both = now.select("name", F.col("value").alias("a")).join(before.select("name", F.col("value").alias("b")), "name", "full_outer")
    gap = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    row = both.agg(F.sqrt(F.sum(gap * gap)).alias("distance"))
    return row.select("distance", F.when(F.col("distance") < 0.05, "none").when(F.col("distance") < 0.15, "low").when(F.col("distance") < 0.30, "medium").otherwise("high").alias("drift"))


def relevancy(memories: DataFrame, task: str) -> DataFrame:
    """(id, relevancy): how well archived memories suit a new task."""
    words = T.context_terms(F.lit(task))
    tags = F.exists(F.col("tags"), lambda t: F.exists(words, lambda w: F.contains(F.lower(t), w) | F.contains(w, F.lower(t))))
    terms = T.context_terms(F.col("content"))
    shared = F.size(F.array_intersect(words, terms))
    jaccard = F.when(F.size(F.array_union(words, terms)) > 0, shared / F.size(F.array_union(words, terms))).otherwise(F.lit(0.0))
    score = 0.35 * tags.cast("double") + 0.25 * F.col("importance") + 0.15 * (shared > 0).cast("double") + 0.10 * jaccard + 0.15 * S.decay(F.col("age_days"))
    return memories.select("id", score.alias("relevancy"))


def bounded_neighbours(entries: DataFrame, associations: DataFrame, depth: int = 2, most: int = 10) -> DataFrame:
    """(start, node, hops): up to ``most`` neighbours of each entry within ``depth`` steps, nearest first."""
    from pyspark.sql import Window

    pairs = G.symmetric(associations.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))
    found = G.reach(entries, pairs, depth).where("start != node")
    order = Window.partitionBy("start").orderBy("hops", "node")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
