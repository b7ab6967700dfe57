"""Changes to tables of memories and associations, each as a plan from the old table to the new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.scoring import clamp01


def stored(memories: DataFrame) -> DataFrame:
    """New memories as they are kept: importance between 0 and 1, tags sorted and each once."""
    return memories.withColumn("importance", clamp01(F.coalesce("importance", F.lit(0.5)))).withColumn("tags", F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))))


def merged(observations: DataFrame) -> DataFrame:
    """One row for each dedup_key of a batch: all tags, the greatest importance, the content of the last (ordinal)."""
    return observations.groupBy("dedup_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.max("importance").alias("importance"), F.max_by("content", "ordinal").alias("content")
    )


def reconcile(state: DataFrame, batch: DataFrame, observed: DataFrame, failed: DataFrame, files: DataFrame) -> DataFrame:
    """A snapshot merged into the evidence in one outer join.

    state: dedup_key, namespace, file, content, severity, importance, tags, evidence_status,
    observations, revisions, status. batch: the same without the last four, each key once. observed,
    failed: (namespace) that were fully observed, or whose analyzer failed; files: (file) that exist.
    Seen: active, observed once more, revised if content or severity changed, tags united, importance
    the greater, taken out of the archive. Not seen in an observed namespace, and active or stale:
    orphaned if its file is gone, else resolved. In a failed one, and active: orphaned or stale.
    """
    new = batch.select("dedup_key", *[F.col(c).alias(f"_{c}") for c in ("namespace", "file", "content", "severity", "importance", "tags")], F.lit(True).alias("_seen"))
    rows = state.withColumn("_known", F.lit(True)).join(new, "dedup_key", "full_outer")
    rows = rows.withColumn("namespace", F.coalesce("_namespace", "namespace")).withColumn("file", F.coalesce("_file", "file"))
    for names, flag in ((observed, "_observed"), (failed, "_failed")):
        rows = rows.join(F.broadcast(names.select("namespace").distinct().withColumn(flag, F.lit(True))), "namespace", "left")
    rows = rows.join(files.select("file").distinct().withColumn("_there", F.lit(True)), "file", "left")
    seen, known = F.coalesce("_seen", F.lit(False)), F.coalesce("_known", F.lit(False))
    gone = (F.coalesce("file", F.lit("")) != "") & F.col("_there").isNull()
    old = F.col("evidence_status")
    after = (
        F.when(seen, "active").when(F.col("_observed") & old.isin("active", "stale"), F.when(gone, "orphaned").otherwise("resolved"))
        .when(F.col("_failed") & (old == "active"), F.when(gone, "orphaned").otherwise("stale")).otherwise(old)
    )
    changed = ~(F.col("content").eqNullSafe(F.col("_content")) & F.col("severity").eqNullSafe(F.col("_severity")))
    none = F.array().cast("array<string>")
    pick = lambda c: F.when(seen, F.col(f"_{c}")).otherwise(F.col(c))
    return rows.select(
        "dedup_key", "namespace", "file", pick("content").alias("content"), pick("severity").alias("severity"), F.when(seen, F.greatest("importance", "_importance")).otherwise(F.col("importance")).alias("importance"),
        F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("_tags", none))).alias("tags"), after.alias("evidence_status"), (F.coalesce("observations", F.lit(0)) + seen.cast("int")).cast("long").alias("observations"),
        F.when(~known, F.lit(1)).otherwise(F.col("revisions") + (seen & changed).cast("int")).cast("long").alias("revisions"), F.when(seen, "active").otherwise(F.col("status")).alias("status"),
    )


def accessed(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """One more access for each row of ids (id)."""
    times = ids.groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
    return memories.join(times, "id", "left").withColumn("access_count", (F.coalesce("access_count", F.lit(0)) + F.coalesce("_times", F.lit(0))).cast("long")).drop("_times")


def with_status(memories: DataFrame, where: Column, status: str) -> DataFrame:
    """Archive or restore what ``where`` says."""
    return memories.withColumn("status", F.when(F.coalesce(where, F.lit(False)), status).otherwise(F.col("status")))


def compacted(memories: DataFrame) -> DataFrame:
    """Consolidated episodes go to the archive; a dry run is the difference to before."""
    return with_status(memories, (F.col("status") == "active") & (F.col("type") == "episodic") & F.col("consolidated_into").isNotNull(), "archived")


def consolidated(memories: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories with ``consolidated_into``, and the associations (from_id, to_id, type) made; groups: (id, target).

    A memory in several groups goes to the smallest target; ids that are no memory make no association.
    """
    first = groups.groupBy("id").agg(F.min("target").alias("_target"))
    marked = memories.join(first, "id", "left").withColumn("consolidated_into", F.coalesce("_target", "consolidated_into")).drop("_target")
    links = groups.distinct().join(memories.select("id"), "id", "left_semi")
    return marked, links.select(F.col("id").alias("from_id"), F.col("target").alias("to_id"), F.lit("consolidation").alias("type"))


def between(associations: DataFrame, ids: DataFrame) -> DataFrame:
    """Associations both of whose ends are among ids (id)."""
    left, right = ids.select(F.col("id").alias("from_id")).distinct(), ids.select(F.col("id").alias("to_id")).distinct()
    return associations.join(left, "from_id", "left_semi").join(right, "to_id", "left_semi")


def isolated(ids: DataFrame, associations: DataFrame) -> DataFrame:
    ends = associations.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return ids.select("id").join(ends, "id", "left_anti")


def batch_links(batches: DataFrame) -> DataFrame:
    """(from_id, to_id): each memory of a batch and the next; batches: (batch, ordinal, id)."""
    after = F.lead("id").over(Window.partitionBy("batch").orderBy("ordinal", "id"))
    return batches.select(F.col("id").alias("from_id"), after.alias("to_id")).where("to_id is not null")


def capped_namespaces(counts: DataFrame, most: int = 256) -> DataFrame:
    """(namespace, n): counts of the first namespaces by arrival; the rest together as null. counts: (namespace, arrival, n).

    First every namespace becomes one row; only those rows are ranked.
    """
    sums = counts.groupBy("namespace").agg(F.min("arrival").alias("arrival"), F.sum("n").alias("n"))
    first = sums.orderBy("arrival", "namespace").limit(most).select("namespace", F.lit(True).alias("_own"))
    return sums.join(first, "namespace", "left").groupBy(F.when(F.col("_own"), F.col("namespace")).alias("namespace")).agg(F.sum("n").alias("n"))


def record_signature(columns: list[str]) -> Column:
    """sha256 over the columns by name, as text, nulls marked."""
    parts = [F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\n", *parts), 256)
