"""Ranked lexical recall over memories, and pairs that share tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T


def postings(memories: DataFrame) -> DataFrame:
    """(term, id): the inverted index as rows."""
    return memories.select("id", F.explode(T.recall_terms(F.concat_ws(" ", "content", F.array_join("tags", " ")))).alias("term")).distinct().select("term", "id")


def query_scores(memories: DataFrame, query: str) -> DataFrame:
    """Memories that share a term with the query, with query_score = 4 exact + 2 overlap + importance."""
    wanted = T.recall_terms(F.lit(query), 2)
    terms = T.recall_terms(F.concat_ws(" ", "content", F.array_join("tags", " ")))
    exact = T.normalize_text(F.col("content")).contains(T.normalize_text(F.lit(query))).cast("double")
    scored = memories.where(F.arrays_overlap(terms, wanted))
    return scored.withColumn("query_score", 4.0 * exact + 2.0 * T.overlap(wanted, terms) + F.col("importance"))


def target_strength(file: Column, content: Column, tags: Column, target: str) -> Column:
    """How strongly a memory refers to a file: 4 its file, 3 its path in the text, 2 its name, 1 its folder as a tag."""
    name, folder = target.rpartition("/")[2], target.rpartition("/")[0].rpartition("/")[2]
    return (
        F.when(file == target, 4).when(T.normalize_text(content).contains(target.lower()), 3).when(F.array_contains(T.recall_terms(content), name.partition(".")[0].lower()), 2)
        .when(F.array_contains(tags, folder), 1).otherwise(0)
    )


def rank(scored: DataFrame, limit: int = 20) -> DataFrame:
    """The best by query score, importance, age and id: a top-k report."""
    order = [F.desc("query_score"), F.desc("importance"), F.asc("age_days"), F.asc("id")]
    return scored.orderBy(*order).limit(limit)


#: Tags that relate nothing; fixed values.
GENERIC_TAGS = ("consolidated", "auto_consolidated", "pattern")


def shared_tag_pairs(memories: DataFrame, least: int, linked: DataFrame) -> DataFrame:
    """(a, b, shared, linked): active memories of one type that share at least ``least`` tags, generic ones aside.

    Two memories share that many tags if and only if they share a set of ``least`` of them, so they are joined
    through such sets: (number of tags over ``least``) rows for a memory. Of the sets that a pair shares,
    the first one counts it. ``linked`` holds (src, dst) of known bridges, either way.
    """
    telling = F.array_sort(F.array_compact(F.array_except("tags", F.array(*map(F.lit, GENERIC_TAGS)))))
    rows = memories.where("status = 'active'").select("id", "type", telling.alias("tags")).where(F.size("tags") >= least)
    rows = rows.withColumns({"set": F.array().cast("array<string>"), "from": F.lit(1)})
    for _ in range(least):
        rest = F.posexplode(F.slice("tags", F.col("from"), F.size("tags"))).alias("at", "tag")
        rows = rows.select("*", rest).select("id", "type", "tags", F.concat("set", F.array("tag")).alias("set"), (F.col("from") + F.col("at") + 1).alias("from"))
    # Few bytes make many pairs: the number of tasks must not follow the bytes, so it is given.
    rows = rows.repartition(int(memories.sparkSession.conf.get("spark.sql.shuffle.partitions")), "type", "set")
    other = rows.select("type", "set", F.col("id").alias("b"), F.col("tags").alias("others"))
    alone = (F.size("tags") == least) | (F.size("others") == least)  # then nothing else can be shared
    both = F.when(alone, F.col("set")).otherwise(F.array_sort(F.array_intersect("tags", "others")))
    pairs = rows.select("type", "set", F.col("id").alias("a"), "tags").join(other, ["type", "set"]).where("a < b").withColumn("both", both)
    counts = pairs.where(F.slice("both", 1, least) == F.col("set")).select("a", "b", F.size("both").cast("long").alias("shared"))
    known = linked.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("_known", F.lit(True))
    return counts.join(known, ["a", "b"], "left").select("a", "b", "shared", F.coalesce("_known", F.lit(False)).alias("linked"))


def tag_groups(memories: DataFrame, least: int = 3) -> DataFrame:
    """(tag, n, ids_sha256): groups to consolidate; each memory joins only the first of its large tags."""
    own = memories.where("status = 'active' and type = 'episodic'").select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    large = own.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("tag")
    first = own.join(large, "tag").groupBy("id").agg(F.min("tag").alias("tag"))
    grouped = first.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("ids_sha256"))
    return grouped.where(F.col("n") >= least)


def pack(cards: DataFrame, budget: int) -> DataFrame:
    """The cards that greedy packing takes: best first, each if it still fits, else skipped.

    ``cards`` has scope, id, score and size. A scope's cards are folded in order of the score.
    """
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "id", "size"))),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken")),
        lambda acc, card: F.when(
            acc["used"] + card["size"] <= budget,
            F.struct((acc["used"] + card["size"]).cast("long").alias("used"), F.concat(acc["taken"], F.array(card["id"])).alias("taken")),
        ).otherwise(acc),
    )
    packed = cards.groupBy("scope").agg(fold.alias("pack"))
    return packed.select("scope", F.col("pack.used").alias("used"), F.size("pack.taken").cast("long").alias("n_taken"), F.array_join("pack.taken", ",").alias("taken"))


def newest(rows: DataFrame, group: list[str], order: list[Column], keep: int) -> DataFrame:
    """Bounded history: the newest ``keep`` rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")
