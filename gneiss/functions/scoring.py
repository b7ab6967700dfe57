"""Scores, levels and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("high", "medium", "low", "info")


def saturate(x: Column, half: float) -> Column:
    return F.when(x <= 0, F.lit(0.0)).otherwise(x / (x + half))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def health(high: Column, medium: Column, low: Column, files: Column) -> Column:
    """1 / (1 + weighted findings per file), unrounded."""
    return 1.0 / (1.0 + (3.0 * high + 2.0 * medium + 1.0 * low) / F.greatest(F.lit(1), files))


def archetype(b0: Column, b1: Column, degree: Column, n: Column, memory: bool = False) -> Column:
    """The structural class of a graph; memory graphs have names of their own."""
    p = "memory_" if memory else ""
    flat = F.when(b0 > 1, f"{p}modular").otherwise("memory_tree" if memory else "tree_like")
    parted = F.when(degree < 2.5, f"{p}fragmented_sparse_cyclic").otherwise(f"{p}fragmented_cyclic")
    whole = F.when(degree < 2.5, f"{p}sparse_cyclic").when(degree < 5.0, f"{p}mixed_cyclic").otherwise(f"{p}dense_mesh")
    return F.when(n == 0, "empty").when(n == 1, "trivial").when(b1 <= 0, flat).when(b0 > 1, parted).otherwise(whole)


def legacy_risk(entrypoints: Column, fan_in: Column) -> Column:
    return F.when((entrypoints > 0) & (fan_in >= 2), "high").when(entrypoints > 0, "medium").otherwise("low")


def change_risk(is_entrypoint: Column, fan_in: Column, from_entrypoint: Column) -> Column:
    """+3 entrypoint; +2 from three dependents on, +1 from one; +2 if an entrypoint imports it."""
    score = F.when(is_entrypoint, 3).otherwise(0) + F.when(fan_in >= 3, 2).when(fan_in >= 1, 1).otherwise(0)
    return score + F.when(from_entrypoint, 2).otherwise(0)


def level(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 2, "medium").otherwise("low")


def decay(days: Column) -> Column:
    return F.pow(F.lit(0.5), days / 30.0)


def fingerprint(n: Column, e: Column, b0: Column, b1: Column, b2: Column) -> Column:
    text = F.format_string("V1|N:%s|E:%s|B0:%s|B1:%s|B2:%s", *[x.cast("string") for x in (n, e, b0, b1, b2)])
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)
