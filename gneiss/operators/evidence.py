"""Observed evidence: its freshness, recall filters and ranks, excerpts, and findings worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evidence in one of these states is history; fixed values.
INACTIVE = ("resolved", "stale", "orphaned", "superseded")
#: Types of findings of medium severity that are kept; fixed values.
KEPT_MEDIUM = ("circular_dependency", "entrypoint_high_risk", "change_risk")
EXCERPT_LINES = 12


def evidence_status(dedup_key: Column, persisted: Column) -> Column:
    """Unverified without a key, else what was stored, active by default."""
    return F.when(F.coalesce(dedup_key, F.lit("")) == "", "unverified").otherwise(F.coalesce(persisted, F.lit("active")))


def is_current(dedup_key: Column, persisted: Column) -> Column:
    return ~evidence_status(dedup_key, persisted).isin(*INACTIVE)


def with_freshness(evidence: DataFrame, hashes: DataFrame, signature: str | None) -> DataFrame:
    """``evidence`` with ``freshness``: against the hashes (file, hash) of now and the graph's signature.

    ``evidence`` has dedup_key, evidence_status, file, file_hash and graph_signature. Files are not
    looked at if ``hashes`` is empty; a null signature says nothing.
    """
    any_file = hashes.limit(1).agg((F.count(F.lit(1)) > 0).alias("_any"))
    now = hashes.select(F.col("file").alias("_file"), F.col("hash").alias("_hash")).dropDuplicates(["_file"])
    rows = evidence.join(now, F.col("file") == F.col("_file"), "left").crossJoin(F.broadcast(any_file))
    status = evidence_status(F.col("dedup_key"), F.col("evidence_status"))
    named = F.coalesce(F.col("file"), F.lit("")) != ""
    same = F.col("graph_signature") == F.lit(signature)
    fresh = (
        F.when(status != "active", status).when(named & F.col("_any") & F.col("_file").isNull(), "orphaned").when(named & (F.col("file_hash") != F.col("_hash")), "stale")
        .when(same, "fresh").when(~same, "stale").otherwise("unverified")
    )
    return rows.withColumn("freshness", fresh).drop("_file", "_hash", "_any")


def exclusion(least: float, archived: bool = False, historical: bool = False) -> Column:
    """Why recall leaves a memory out, or null: archived, its evidence status, or too little importance."""
    status = evidence_status(F.col("dedup_key"), F.col("evidence_status"))
    reason = F.when(F.lit(not archived) & (F.coalesce("status", F.lit("active")) != "active"), "archived")
    reason = reason.when(F.lit(not historical) & status.isin(*INACTIVE), status)
    return reason.when(F.coalesce("importance", F.lit(0.0)) < least, "below_min_importance")


def candidates(memories: DataFrame, kind: str | None = None, any_tag: list[str] | None = None) -> DataFrame:
    rows = memories if kind is None else memories.where(F.col("type") == kind)
    return rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, any_tag)))) if any_tag else rows


def trace(memories: DataFrame, chosen: DataFrame, least: float) -> DataFrame:
    """(outcome, n): how many memories were pruned before filtering, left out for what reason, or ranked."""
    outcomes = chosen.select(F.coalesce(exclusion(least), F.lit("ranked")).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    total = memories.agg(F.count(F.lit(1)).alias("total")).crossJoin(chosen.agg(F.count(F.lit(1)).alias("held")))
    return outcomes.unionByName(total.select(F.lit("pruned").alias("outcome"), (F.col("total") - F.col("held")).alias("n")))


#: Order with a query or a target, and without either.
DIRECTED = ("-query_score", "-target_primary", "-target_strength", "-importance", "timestamp", "id")
UNDIRECTED = ("-importance", "-timestamp", "ordinal")


def order_by(names: tuple[str, ...]) -> list[Column]:
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


def with_witness(ranked: DataFrame, most: int, order: list[Column], targets: bool = True) -> DataFrame:
    """The best ``most`` rows; if none of them is a primary target, the best one that is takes the last place.

    Only the candidates for the places are sorted in one task: two top-k reports.
    """
    best = ranked.orderBy(*order).limit(most)
    if not targets or most < 2:
        return best
    witness = ranked.where("target_primary").orderBy(*order).limit(1).withColumn("_witness", F.lit(True))
    both = best.withColumn("_witness", F.lit(False)).unionByName(witness)
    everything = Window.partitionBy(F.lit(1))
    met = F.max((F.col("target_primary") & ~F.col("_witness")).cast("int")).over(everything) == 1
    full = F.count(F.lit(1)).over(everything) > F.lit(most)
    rows = both.withColumn("_met", met).withColumn("_full", full).where(~(F.col("_witness") & F.col("_met")))
    place = F.row_number().over(Window.partitionBy("_witness").orderBy(*order))
    rows = rows.withColumn("_place", place)
    lost = ~F.col("_witness") & ~F.col("_met") & F.col("_full") & (F.col("_place") == most)
    return rows.where(~lost).drop("_witness", "_met", "_full", "_place")


def worth_storing(findings: DataFrame, correlations: DataFrame) -> DataFrame:
    """(analyzer, type, severity, file, reason): all high findings, some medium ones, every correlation."""
    reason = F.when(F.col("severity") == "high", "high_severity_finding").when((F.col("severity") == "medium") & F.col("type").isin(*KEPT_MEDIUM), "critical_medium_finding")
    own = findings.select("analyzer", "type", "severity", "file", reason.alias("reason")).where("reason is not null")
    return own.unionByName(correlations.select(F.lit("cross_analyzer").alias("analyzer"), "type", "severity", "file", F.lit("cross_analyzer_correlation").alias("reason")))


def resolve_targets(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(asked, path, n_matches): the path itself, or the only one that ends in ``/asked``; path is null if none or several do.

    Joined on the suffixes of each path, so nothing is compared with every file.
    """
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = files.select("path", F.explode(suffixes).alias("asked"))
    found = asked.select("asked").distinct().join(ends, "asked", "left")
    rows = found.groupBy("asked").agg(F.max(F.when(F.col("path") == F.col("asked"), F.col("path"))).alias("exact"), F.max("path").alias("only"), F.count("path").alias("n_matches"))
    return rows.select("asked", F.coalesce("exact", F.when(F.col("n_matches") == 1, F.col("only"))).alias("path"), "n_matches")


def excerpts(texts: DataFrame, wanted: Column, terms) -> DataFrame:
    """(path, line, text, strategy): lines with a wanted term and their neighbours, else imports, exports and
    decorators, else lines that are not blank; the first ``EXCERPT_LINES`` of each path.

    ``terms`` gives the terms of a line; each path comes once. One shuffle by path, of lines.
    """
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    rows = texts.select("path", F.posexplode(lines).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")
    rows = rows.withColumn("hit", F.arrays_overlap(terms(F.col("text")), wanted)).withColumn("head", F.ltrim("text").rlike("^(import |export |@)"))
    whole = Window.partitionBy("path")
    near = F.max("hit").over(whole.orderBy("line").rowsBetween(-1, 1))
    rows = rows.withColumn("near", near).withColumn("any_hit", F.max("hit").over(whole)).withColumn("any_head", F.max("head").over(whole))
    picked = rows.where(F.when(F.col("any_hit"), F.col("near")).when(F.col("any_head"), F.col("head")).otherwise(F.trim("text") != ""))
    first = picked.withColumn("place", F.row_number().over(whole.orderBy("line"))).where(F.col("place") <= EXCERPT_LINES)
    return first.select("path", F.when(F.col("any_hit"), "query_window").otherwise("structural_head").alias("strategy"), "line", F.substring("text", 1, 240).alias("text"))


def evidence_of_files(findings: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """(path, analyzer, type, severity): findings by every file that one of ``columns`` names."""
    named = findings.select("analyzer", "type", "severity", F.explode(F.array_distinct(F.array_compact(F.array(*columns)))).alias("path"))
    return named.join(files.select("path"), "path", "left_semi")
