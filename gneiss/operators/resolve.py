"""From import specifiers to a graph of files: candidates, aliases, boundaries, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as T


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with target, place (of the winning candidate) and status: resolved, unresolved or external.

    Files are spread over the names they answer to, which are few, instead of imports over all their
    candidates; then one join by name decides. Names of externals meet nothing and are dealt by path.
    """
    local = F.startswith("spec", F.lit("."))
    name = F.when(local, T.resolve_relative(T.dirname(F.col("path")), F.col("spec"))).otherwise(F.concat(F.lit("\0"), "path"))
    joined = imports.select("path", "ord", "spec", name.alias("name")).join(names(files), "name", "left")
    status = F.when(~local, "external").when(F.col("target").isNull(), "unresolved").otherwise("resolved")
    return joined.select("path", "ord", "spec", "target", "place", status.alias("status"))


def names(files: DataFrame) -> DataFrame:
    """(name, target, place): of each name that ``text.candidates`` can turn into files, the best of them."""
    own = files.select("path").distinct().select(F.col("path").alias("target"), F.explode(T.answers(F.col("path"))).alias("answer"))
    best = own.groupBy(F.col("answer.name").alias("name")).agg(F.min_by("target", F.col("answer.place")).alias("target"), F.min("answer.place").alias("place"))
    return best.select("name", "target", "place")


def method(place: Column) -> tuple[Column, Column]:
    """How the winning candidate matched, and how sure that is."""
    how = F.when(place == 0, "exact").when(place <= 4, "extension").when(place <= 8, "index").otherwise("fallback")
    sure = F.when(place == 0, 1.0).when(place <= 2, 0.95).when(place <= 4, 0.90).when(place <= 8, 0.85).otherwise(0.50)
    return how, sure


def resolve_aliases(external: DataFrame, rules: DataFrame, files: DataFrame) -> DataFrame:
    """External specifiers that an alias rule (prefix, base) maps to a file; the longest matching prefix first.

    Rules are joined on every prefix of the specifier that ends at a slash or at its end.
    """
    parts = F.split("spec", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    tried = external.select("path", "ord", "spec", F.explode(prefixes).alias("prefix"))
    ruled = tried.join(rules.select("prefix", "base"), "prefix")
    rest = F.expr("substring(spec, length(prefix) + 1)")
    named = ruled.select("path", "ord", "spec", "prefix", T.resolve_relative(F.col("base"), F.concat(F.lit("."), rest)).alias("mapped"))
    spread = named.select("path", "ord", "spec", "prefix", F.posexplode(T.candidates(F.col("mapped"))).alias("place", "target"))
    hits = spread.join(files.select(F.col("path").alias("target")).distinct(), "target")
    rank = F.struct((-F.length("prefix")).alias("a"), F.col("place").alias("b"))
    return hits.groupBy("path", "ord", "spec").agg(F.min_by("target", rank).alias("target"))


def links(resolved: DataFrame) -> DataFrame:
    """(src, dst, status, n): how many imports of a file have a target, or none; ``edges`` are those with one."""
    return resolved.groupBy(F.col("path").alias("src"), F.col("target").alias("dst"), "status").agg(F.count(F.lit(1)).alias("n"))


def edges(links_: DataFrame) -> DataFrame:
    """Distinct (src, dst)."""
    return links_.where("status = 'resolved'").select("src", "dst")


def boundaries(files: DataFrame, root: str = "src") -> DataFrame:
    """(path, boundary): the nearest folder with an index file, or else the top folder, or the root."""
    folder = T.dirname(F.col("path"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    marked = files.where(T.basename(F.col("path")).isin(*T.BARRELS)).select(folder.alias("folder")).distinct()
    reach = files.select("path", F.explode(above).alias("folder")).where(F.startswith("folder", F.lit(root)))
    near = reach.join(marked, "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("near"))
    inside = F.regexp_extract("path", f"^{root}/([^/]+)/", 1)
    top = F.when(inside != "", F.concat(F.lit(f"{root}/"), inside)).otherwise(F.lit(root))
    return files.select("path").join(near, "path", "left").select("path", F.coalesce("near", top).alias("boundary"))


def barrels(files: DataFrame) -> DataFrame:
    """Folders with an index file."""
    return files.where(T.basename(F.col("path")).isin(*T.BARRELS)).select(T.dirname(F.col("path")).alias("boundary"), F.col("path").alias("barrel"))


def boundary_crossings(resolved: DataFrame, placed: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each import from another boundary that has an index file but is not imported through it."""
    here = placed.select("path", F.col("boundary").alias("from_boundary"))
    there = placed.select(F.col("path").alias("target"), F.col("boundary").alias("to_boundary"))
    marked = barrels(files).groupBy("boundary").agg(F.min("barrel").alias("barrel")).withColumnRenamed("boundary", "to_boundary")
    crossed = resolved.where("status = 'resolved'").join(here, "path").join(there, "target").where("from_boundary != to_boundary")
    return crossed.join(marked, "to_boundary").where("target != barrel").select("path", "ord", "target", "from_boundary", "to_boundary")


def quotient(edges_: DataFrame, placed: DataFrame) -> DataFrame:
    """(from_boundary, to_boundary, n, witnesses): edges between and inside boundaries, with the first two of each."""
    a = placed.select(F.col("path").alias("src"), F.col("boundary").alias("from_boundary"))
    b = placed.select(F.col("path").alias("dst"), F.col("boundary").alias("to_boundary"))
    joined = edges_.join(a, "src").join(b, "dst")
    witness = F.slice(F.array_sort(F.collect_list(F.concat_ws(">", "src", "dst"))), 1, 2)
    return joined.groupBy("from_boundary", "to_boundary").agg(F.count(F.lit(1)).alias("n"), F.array_join(witness, ",").alias("witnesses"))
