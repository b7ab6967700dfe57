"""Connected components of an edge table, by alternating large-star and small-star rounds.

Both rounds only group and join on nodes; after the first of them a hub holds its component's
smallest node as neighbour, so no group is ever collected. Each pass is a written table. Tables of up to
``FEW`` rows stay in one partition: exchanging so little costs the driver and the tasks more than the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.storage import discard, materialize


#: Rows up to which a table is worked on in one task.
FEW = 50_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has so many rows, in one partition if they are few: joins and groups need no exchange then."""
    return df.coalesce(1) if rows <= FEW else df


def _large(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.explode(ways).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    return joined.select(F.explode(moved).alias("e")).select("e.u", "e.v").where("u != v").distinct()


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of the edges; the root is the smallest node of the component.

    Self-loops and repeated edges are fine; edges with a null end are no edges; no edges, no rows.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    given = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    counts = given.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("u") == F.col("v")).alias("loops")).first()
    now, state, rows = given.where("u != v"), None, counts["n"] - counts["loops"]
    while rows:
        following = materialize(_small(_large(gathered(now, rows))), "components")
        digest = following.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now, rows = following, digest["n"]
        if digest == state:
            break
        state = digest
    now = gathered(now, rows)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = stars.unionByName(roots)
    if not counts["loops"]:
        if rows:
            discard(given)
        return out
    lone = given.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    return out.unionByName(lone.join(out, "node", "left_anti"))
