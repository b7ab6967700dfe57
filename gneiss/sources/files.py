"""Source trees, manifests, alias rules and JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import text as T


def _listed(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """Files below one root, a comma-separated list or a list of roots, each once."""
    several = roots.split(",") if isinstance(roots, str) else list(roots)
    paths = list(dict.fromkeys(r.strip() for r in several if r.strip()))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(paths)


def _plain(path: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def _below(spark: SparkSession, roots: str | list[str], path: Column) -> Column:
    """The part of a path below its root; of nested roots the longest counts."""
    several = roots.split(",") if isinstance(roots, str) else list(roots)
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    names = []
    for root in (r.strip() for r in several if r.strip()):
        whole = hadoop(root).getFileSystem(conf).makeQualified(hadoop(root)).toString()
        names.append("/" + whole[5:].lstrip("/") if whole.startswith("file:") else whole)
    plain, out = _plain(path), None
    for name in sorted(set(names), key=len, reverse=True):
        top = name.rstrip("/") + "/"
        inside, rest = F.startswith(plain, F.lit(top)), F.substr(plain, F.lit(len(top) + 1))
        out = F.when(inside, rest) if out is None else out.when(inside, rest)
    return plain if out is None else out.otherwise(plain)


def _kept(below: Column) -> Column:
    """Whether a path below its root is a source file and lies in no ignored or dot folder."""
    parts = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
    return T.is_source(below) & ~F.exists(parts, lambda p: p.isin(*T.IGNORED_FOLDERS) | (p.rlike(r"^\.[^./]")))


def _shown(path: Column, base: str) -> Column:
    """The path as tables have it: without scheme, without ``base`` and without a slash at its front."""
    bare, front = F.ltrim(_plain(path), F.lit("/")), base.strip("/")
    return F.when(F.startswith(bare, F.lit(front + "/")), F.substr(bare, F.lit(len(front) + 2))).otherwise(bare) if front else bare


def scan_sources(spark: SparkSession, roots: str | list[str], base: str = "") -> DataFrame:
    """(path, content) of the source files; ignored and dot folders below the roots and declaration files are left out.

    ``base`` is taken off the front of the paths. Bytes that are no UTF-8 are dropped; see ``skipped``.
    """
    rows = _listed(spark, roots).where(_kept(_below(spark, roots, F.col("path")))).select(_shown(F.col("path"), base).alias("path"), "content").dropDuplicates(["path"])
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.replace(valid, F.lit("\ufffd"), F.lit(""))).alias("content"))


def skipped(spark: SparkSession, roots: str | list[str], base: str = "") -> DataFrame:
    """(path, reason): source files that could not be read as they are."""
    rows = _listed(spark, roots).where(_kept(_below(spark, roots, F.col("path"))))
    return rows.where(~F.is_valid_utf8(F.col("content").cast("string"))).select(_shown(F.col("path"), base).alias("path"), F.lit("invalid_utf8").alias("reason")).distinct()


def scan_manifest(spark: SparkSession, roots: str | list[str], base: str = "") -> DataFrame:
    """(path, size, mtime, signature), paths as in ``scan_sources``: no content is read."""
    rows = _listed(spark, roots).where(_kept(_below(spark, roots, F.col("path"))))
    rows = rows.select(_shown(F.col("path"), base).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).dropDuplicates(["path"])
    return rows.withColumn("signature", F.concat_ws("-", "size", F.unix_micros("mtime")))


def scan_directories(spark: SparkSession, roots: str | list[str], max_depth: int = 2) -> DataFrame:
    """(path, files, dirs): the files and the folders directly in each folder down to a depth below its root.

    Folders that hold no file at any depth are not seen.
    """
    rows = _listed(spark, roots).select(_plain(F.col("path")).alias("path"), _below(spark, roots, F.col("path")).alias("below")).dropDuplicates(["path"])
    parts = F.split("below", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("folder"), (i == F.size(parts) - 1).alias("own"), F.get(parts, i).alias("child")))
    top = F.expr("substring(path, 1, length(path) - length(below) - 1)")
    spread = rows.select(top.alias("top"), F.explode(steps).alias("s")).select("top", "s.*").where(F.col("depth") <= max_depth)
    name = F.when(F.col("folder") == "", F.col("top")).otherwise(F.concat_ws("/", "top", "folder"))
    return spread.groupBy(name.alias("path")).agg(F.count_if("own").alias("files"), F.countDistinct(F.when(~F.col("own"), F.col("child"))).alias("dirs"))


def alias_rules(config: DataFrame) -> DataFrame:
    """(prefix, base) from JSON-with-comments configurations (path, content): compilerOptions.paths, wildcards cut off."""
    plain = F.regexp_replace(F.regexp_replace(T.strip_comments(F.col("content")), r",(\s*[}\]])", "$1"), r"[\r\n]+", " ")
    schema = "struct<compilerOptions: struct<baseUrl: string, paths: map<string, array<string>>>>"
    parsed = config.select("path", F.from_json(plain, schema).alias("c")).select("path", "c.compilerOptions.baseUrl", F.explode("c.compilerOptions.paths").alias("prefix", "targets"))
    folder = F.concat_ws("/", F.nullif(T.dirname(F.col("path")), F.lit("")), F.coalesce("baseUrl", F.lit(".")))
    target = F.regexp_replace(F.col("targets")[0], r"/?\*$", "")
    return parsed.select(F.regexp_replace("prefix", r"/?\*$", "").alias("prefix"), T.resolve_relative(folder, F.concat(F.lit("./"), target)).alias("base"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
