"""Keyed reconciliation of observation batches, and the journal of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(state: DataFrame, batch: DataFrame) -> DataFrame:
    """One batch merged into the state by dedup_key, in one full outer join.

    A known key is observed once more and revised if its content changed; a new key is inserted; an
    active key that is absent from a namespace of the batch is resolved. Columns of both:
    dedup_key, namespace, content; the state also has status, observations, revisions.
    """
    covered = batch.select("namespace").distinct().withColumn("_covered", F.lit(True))
    new = batch.select("dedup_key", F.col("namespace").alias("_namespace"), F.col("content").alias("_content"))
    both = state.join(new, "dedup_key", "full_outer").withColumn("namespace", F.coalesce("namespace", "_namespace")).join(covered, "namespace", "left")
    seen = F.col("_content").isNotNull()
    known = F.col("status").isNotNull()
    status = F.when(seen, "active").when(F.col("_covered") & (F.col("status") == "active"), "resolved").otherwise(F.col("status"))
    changed = (known & seen & ~F.col("content").eqNullSafe(F.col("_content"))).cast("long")
    return both.select(
        "dedup_key", "namespace", F.coalesce("_content", "content").alias("content"), status.alias("status"),
        (F.coalesce("observations", F.lit(0)) + seen.cast("long")).alias("observations"), (F.coalesce("revisions", F.lit(0)) + changed).alias("revisions"),
    )


def replay(observations: DataFrame) -> DataFrame:
    """The state after all batches of (batch, namespace, dedup_key, content), without a loop over batches.

    A key is active if the last batch of its namespace has it, and resolved otherwise; it was revised
    wherever its content differs from the time before.
    """
    order = Window.partitionBy("dedup_key").orderBy("batch")
    rows = observations.withColumn("before", F.lag("content").over(order)).withColumn("first", F.row_number().over(order) == 1)
    last = observations.groupBy("namespace").agg(F.max("batch").alias("last_batch"))
    keys = rows.groupBy("namespace", "dedup_key").agg(
        F.count(F.lit(1)).alias("observations"), F.sum((~F.col("first") & ~F.col("content").eqNullSafe(F.col("before"))).cast("long")).alias("revisions"),
        F.max_by("content", "batch").alias("content"), F.max("batch").alias("seen"),
    )
    status = F.when(F.col("seen") == F.col("last_batch"), "active").otherwise("resolved")
    return keys.join(last, "namespace").select("dedup_key", "namespace", "content", status.alias("status"), "observations", "revisions")


def coalesce_runs(events: DataFrame) -> DataFrame:
    """Consecutive events of a user with one signature as a run: user_id, run, event_type, first_id, last_id, n."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce((F.lag("event_type").over(order) != F.col("event_type")).cast("int"), F.lit(1))
    runs = events.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order))
    return runs.groupBy("user_id", "run", "event_type").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def retain(runs: DataFrame, keep: int) -> DataFrame:
    """Per user: runs kept (the newest ``keep``), runs and events archived."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("run"))
    ranked = runs.withColumn("_rank", F.row_number().over(newest))
    old = F.col("_rank") > keep
    return ranked.groupBy("user_id").agg(
        F.sum((~old).cast("long")).alias("kept_runs"), F.sum(old.cast("long")).alias("archived_runs"), F.sum(F.when(old, F.col("n")).otherwise(0)).alias("archived_events")
    )


def chained_digest(runs: DataFrame) -> DataFrame:
    """Per user: the digest of its runs in order, each over the one before and the run."""
    ordered = F.array_sort(F.collect_list(F.struct("run", F.concat_ws(":", "event_type", "n").alias("text"))))
    digest = F.aggregate(ordered, F.lit(""), lambda h, r: F.sha2(F.concat(h, F.lit("\n"), r["text"]), 256))
    return runs.groupBy("user_id").agg(digest.alias("digest"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed, deleted or reused, by the signature of each path."""
    both = old.select("path", F.col("signature").alias("_old")).join(new.select("path", F.col("signature").alias("_new")), "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed").otherwise("reused")
    return both.select("path", change.alias("change"))
