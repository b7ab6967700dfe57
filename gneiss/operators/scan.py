"""What single files tell: imports, kinds, type shapes, outlines, and findings by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T

# The patterns of the line findings.
LOOP = r"^\s*(for\s*\(|for\s+(?:const|let|var)\s+\w+\s+(?:of|in)|while\s*\()"
AWAIT_ASSIGN = r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*await\s+"
AWAIT_CALL = r"await\s+[\w.$]+\("
SYNC_IO = r"\b(readFileSync|writeFileSync|existsSync|mkdirSync|readdirSync|statSync|unlinkSync|rmdirSync|renameSync|copyFileSync|execSync|spawnSync)\s*\("
DELETE = r"\bdelete\s+[\w.$\[\]'\"]+"
EVAL = r"\beval\s*\("
NEW_FUNCTION = r"\bnew\s+Function\s*\("
JSON_CALL = r"JSON\.(parse|stringify)\s*\("
TIMER = r"(?:const|let|var)\s+(\w+)\s*=\s*setInterval\s*\("
TIMER_CLEARED = r"clearInterval\s*\(\s*(\w+)\s*\)"
COLLECTION = r"(?:const|let|var|private|public|protected|readonly)\s+(\w*(?:cache|Cache|pool|Pool|registry|Registry|store|Store)\w*)\s*=\s*new\s+(Map|Set)\s*\("
ALLOCATION = r"(?:const|let|var)\s+\w+\s*=\s*\{"
LISTENER = r"\.addEventListener\s*\("
LISTENER_REMOVED = r"\.removeEventListener\s*\("
CACHE_SET = r"(\w*(?:cache|Cache)\w*)\s*\.\s*set\s*\("
RANDOM_KEY = r"(?:key|Key|cacheKey|cache_key)\s*=.*(Date\.now\s*\(\)|Math\.random\s*\(\)|crypto\.randomUUID\s*\(\))"
JOINED_KEY = r"(?:key|Key|cacheKey|cache_key)\s*=\s*[\w.'\"\[\]]+\s*\+\s*[\w.'\"\[\]]+"
KEY_DELIMITER = r"['\"][\-:_|.]+['\"]"
TTL = r"(?i)(?:ttl|expire|expiry|expiration|maxAge|max_age|timeToLive|setTimeout.*(?:delete|remove|clear|evict))"
INTERFACE = r"(?s)((?:export\s+)?interface\s+\w+[^{]*\{[^}]*\})"
INTERFACE_PARTS = r"(?s)interface\s+(\w+)[^{]*\{([^}]*)\}"
ALIAS = r"(?s)((?:export\s+)?type\s+\w+\s*=\s*\{[^}]*\})"
ALIAS_PARTS = r"(?s)type\s+(\w+)\s*=\s*\{([^}]*)\}"
PROPERTY = r"^(?:readonly\s+)?(\w+)\??\s*:"
DECLARATIONS = (
    ("interface", r"(?:export\s+)?interface\s+(\w+)"), ("type", r"(?:export\s+)?type\s+(\w+)\s*="), ("class", r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("const", r"(?:export\s+)?const\s+(\w+)\s*[=:]"), ("enum", r"(?:export\s+)?enum\s+(\w+)"),
)


def imports(files: DataFrame) -> DataFrame:
    """(path, ord, spec): import specifiers in order, comments left out; repeats stay."""
    specs = F.regexp_extract_all(T.strip_comments(F.col("content")), F.lit(T.IMPORT), F.lit(1))
    return files.select("path", F.posexplode(specs).alias("ord", "spec"))


def raw_imports(files: DataFrame) -> DataFrame:
    """As ``imports``, comments included (the older scanner)."""
    return files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(T.IMPORT), F.lit(1))).alias("ord", "spec"))


def metadata(files: DataFrame) -> DataFrame:
    """(path, node_type, label, is_entrypoint, entrypoint_kind, entrypoint_confidence, is_test)."""
    kind, confidence = T.entrypoint(F.col("path"))
    return files.select(
        "path", T.node_type(F.col("path"), F.col("content")).alias("node_type"), T.label(F.col("path"), F.col("content")).alias("label"),
        (kind != "none").alias("is_entrypoint"), kind.alias("entrypoint_kind"), confidence.alias("entrypoint_confidence"), T.is_test(F.col("path")).alias("is_test"),
    )


def type_shapes(files: DataFrame) -> DataFrame:
    """(path, type_name, props): sorted property names of interfaces and object types; the last definition of a name counts."""
    content = T.strip_comments(F.col("content"))
    both = F.concat(F.regexp_extract_all(content, F.lit(INTERFACE), F.lit(1)), F.regexp_extract_all(content, F.lit(ALIAS), F.lit(1)))
    found = files.select("path", F.posexplode(both).alias("at", "body"))
    is_interface = F.col("body").rlike(r"^(?:export\s+)?interface\s")
    name = F.when(is_interface, F.regexp_extract("body", INTERFACE_PARTS, 1)).otherwise(F.regexp_extract("body", ALIAS_PARTS, 1))
    inner = F.when(is_interface, F.regexp_extract("body", INTERFACE_PARTS, 2)).otherwise(F.regexp_extract("body", ALIAS_PARTS, 2))
    names = F.transform(F.split(inner, "\n"), lambda x: F.regexp_extract(F.trim(x), PROPERTY, 1))
    props = F.array_sort(F.array_distinct(F.filter(names, lambda p: p != "")))
    last = found.select("path", name.alias("type_name"), props.alias("props"), "at")
    return last.groupBy("path", "type_name").agg(F.max_by("props", "at").alias("props"))


def isomorphic_shapes(shapes: DataFrame) -> DataFrame:
    """Pairs of type shapes with the same properties, of which there is at least one."""
    own = shapes.where(F.size("props") > 0)
    left = own.select(F.col("path").alias("file_a"), F.col("type_name").alias("type_a"), "props")
    right = own.select(F.col("path").alias("file_b"), F.col("type_name").alias("type_b"), "props")
    pairs = left.join(right, "props").where(F.struct("file_a", "type_a") < F.struct("file_b", "type_b"))
    return pairs.select("file_a", "type_a", "file_b", "type_b", F.array_join("props", ",").alias("props"))


def isomorphic_counts(shapes: DataFrame) -> DataFrame:
    """(props, pairs): how many pairs ``isomorphic_shapes`` lists of each property list, from the sizes of the groups."""
    sizes = shapes.where(F.size("props") > 0).groupBy("props").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.select(F.array_join("props", ",").alias("props"), F.expr("n * (n - 1) div 2").alias("pairs"))


def isomorphic_partners(shapes: DataFrame) -> DataFrame:
    """(file_a, n): in how many pairs of ``isomorphic_shapes`` a file comes first: once for each shape behind its own."""
    group = Window.partitionBy("props")
    own = shapes.where(F.size("props") > 0)
    behind = F.count(F.lit(1)).over(group) - F.row_number().over(group.orderBy("path", "type_name"))
    return own.select(F.col("path").alias("file_a"), behind.alias("n")).groupBy("file_a").agg(F.sum("n").alias("n")).where("n > 0")


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text): numbered lines without comments."""
    rows = files.select("path", F.posexplode(F.split(T.strip_comments(F.col("content")), "\n")).alias("at", "text"))
    return rows.select("path", (F.col("at") + 1).alias("line"), "text")


def outline(files: DataFrame) -> DataFrame:
    """(path, kind, name, line): declarations of each line, decorators and default exports."""
    rows = lines(files)
    found = [F.array(F.lit(kind), F.regexp_extract("text", pattern, 1)) for kind, pattern in DECLARATIONS]
    found.append(F.array(F.lit("decorator"), F.regexp_extract("text", r"^\s*@(\w+)", 1)))
    found.append(F.array(F.lit("default"), F.regexp_extract("text", r"export\s+(default)", 1)))
    pairs = rows.select("path", "line", F.explode(F.array(*found)).alias("pair")).where(F.col("pair")[1] != "")
    return pairs.select("path", F.col("pair")[0].alias("kind"), F.col("pair")[1].alias("name"), "line")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def looped_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with in_loop, by brace depth: a line is inside the reach of some loop header above it (or on it).

    With B the running depth after a line, the header at j reaches line i while B(i) >= B(j - 1).
    """
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = _count(F.col("text"), "{") - _count(F.col("text"), "}")
    deep = rows.withColumn("depth", F.sum(own).over(order)).withColumn("before", F.col("depth") - own)
    header = F.when(F.trim(F.col("text")).rlike(LOOP), F.col("before"))
    return deep.withColumn("in_loop", F.coalesce(F.col("depth") >= F.min(header).over(order), F.lit(False))).drop("depth", "before")


def sequential_awaits(rows: DataFrame) -> DataFrame:
    """Islands of two or more awaiting assignments, at most three lines apart and not using the one before."""
    hits = rows.withColumn("variable", F.regexp_extract("text", AWAIT_ASSIGN, 1)).where("variable != ''")
    order = Window.partitionBy("path").orderBy("line")
    hits = hits.withColumn("last_line", F.lag("line").over(order)).withColumn("last_var", F.lag("variable").over(order))
    right = F.regexp_extract("text", r"(?:const|let|var)\s+\w+\s*=\s*await\s+(.*)$", 1)
    uses = F.array_contains(F.split(right, r"\W+"), F.col("last_var"))
    fresh = F.when(F.col("last_line").isNull() | (F.col("line") - F.col("last_line") > 3) | uses, 1).otherwise(0)
    islands = hits.withColumn("island", F.sum(fresh).over(order)).groupBy("path", "island")
    spans = islands.agg(F.min("line").alias("line"), F.max("line").alias("line_end"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return spans.select("path", F.lit("sequential_await").alias("type"), F.lit("medium").alias("severity"), "line", "n")


def line_findings(files: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(path, type, severity, line, n) of the line rules named, or of all: async, deoptimisation, memory pressure and caches.

    What a rule must know of its whole file goes along with the lines, so that all rules are looked up in
    one pass over them; only islands of awaits are put together apart.
    """
    has = lambda pattern: F.col("text").rlike(pattern)
    each = lambda found: F.array_distinct(F.flatten(F.transform(F.split("content", "\n"), found)))
    none = F.array().cast("array<string>")
    freed = each(lambda x: F.concat(F.regexp_extract_all(x, F.lit(r"(\w+)\.(?:delete|clear)\s*\("), F.lit(1)), F.regexp_extract_all(x, F.lit(r"(\w+)\.size\s*[<>]"), F.lit(1))))
    content = F.col("content")
    known = files.select("path", T.strip_comments(content).alias("content")).select(
        "path", "content", content.rlike(CACHE_SET).alias("caches"), content.rlike(TTL).alias("ttl"), (content.rlike(LISTENER) & ~content.rlike(LISTENER_REMOVED)).alias("listens"),
        F.when(content.contains("clearInterval"), each(lambda x: F.array(F.regexp_extract(x, TIMER_CLEARED, 1)))).otherwise(none).alias("cleared"), F.when(content.rlike(COLLECTION), freed).otherwise(none).alias("freed"),
    )
    rows = known.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"), "caches", "ttl", "listens", "cleared", "freed")
    rows = looped_lines(rows.withColumn("line", F.col("at") + 1).drop("at"))
    heard = F.contains("text", F.lit(".addEventListener"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    timer, made = F.regexp_extract("text", TIMER, 1), F.regexp_extract("text", COLLECTION, 1)
    lasting = F.col("caches") & ~F.col("ttl") & has(CACHE_SET)
    rules = {
        "await_in_loop": ("high", F.col("in_loop") & has(AWAIT_CALL)), "sync_io": ("high", has(SYNC_IO)), "delete_operator": ("high", has(DELETE)), "eval_usage": ("high", has(EVAL)),
        "new_function": ("high", has(NEW_FUNCTION)), "json_in_loop": ("high", F.col("in_loop") & has(JSON_CALL)), "allocation_in_loop": ("medium", F.col("in_loop") & has(ALLOCATION)),
        "uncleared_timer": ("high", (timer != "") & ~F.array_contains("cleared", timer)), "unbounded_collection": ("medium", (made != "") & ~F.array_contains("freed", made)),
        "unclosed_event_listener": ("high", F.col("listens") & heard & ~F.col("heard_before")), "nondeterministic_cache_key": ("high", F.col("caches") & has(RANDOM_KEY)),
        "key_collision_risk": ("medium", F.col("caches") & has(JOINED_KEY) & ~has(KEY_DELIMITER)), "missing_ttl": ("medium", lasting), "unbounded_cache": ("medium", lasting),
    }
    wanted = {k: v for k, v in rules.items() if types is None or k in types}
    out = None
    if wanted:
        if "unclosed_event_listener" in wanted:
            rows = rows.withColumn("heard_before", F.coalesce(F.max(F.col("listens") & heard).over(before), F.lit(False)))
        hits = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))) for kind, (severity, hit) in wanted.items()]))
        out = rows.select("path", "line", F.explode(hits).alias("hit")).select("path", "hit.type", "hit.severity", "line", F.lit(1).cast("long").alias("n"))
    if types is None or "sequential_await" in types:
        awaits = sequential_awaits(lines(files))
        out = awaits if out is None else awaits.unionByName(out)
    return out


def mergeable_imports(files: DataFrame) -> DataFrame:
    """(path, spec, n, lines): specifiers imported on more than one line; the first import of a line counts."""
    rows = lines(files).select("path", "line", F.regexp_extract("text", T.IMPORT, 1).alias("spec")).where("spec != ''")
    grouped = rows.groupBy("path", "spec").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))
    return grouped.where("n > 1").select("path", "spec", "n", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))
