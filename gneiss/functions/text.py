"""Column functions for source text, paths and terms. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, names and patterns that results depend on.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
SOURCE_END = r"\.(ts|tsx|js|jsx)$"
BARRELS = ("index.ts", "index.tsx", "index.js", "index.jsx", "public-api.ts")
IGNORED_FOLDERS = ("node_modules", ".git", "dist", ".angular", ".Jules", "coverage", ".next", "out", "fixtures_min")
IMPORT = r"""import\s+(?:[^"']*\s+from\s+)?["']([^"']+)["']"""
TEST_FILE = r"\.(spec|test)\.(ts|tsx|js|jsx)$"
LEGACY_TEST_FOLDER = r"/(__tests__|tests|test)/"
ENTRYPOINTS = (
    (r"^main\.server\.(ts|js)$", "ssr_bootstrap", 0.95),
    (r"^main\.(ts|js)$", "browser_bootstrap", 0.95),
    (r"^server\.(ts|js)$", "server_http", 0.90),
    (r"^entry\.server\.(ts|js)$", "ssr_bootstrap", 0.90),
    (r"^entry\.client\.(ts|js)$", "browser_bootstrap", 0.90),
    (r"^bootstrap\.(ts|js)$", "app_bootstrap", 0.80),
)
STOPWORDS = (
    "a", "an", "and", "atau", "cek", "check", "code", "codebase", "dalam", "dan", "dari", "developer", "di", "file", "fix", "ini",
    "itu", "ke", "llm", "of", "pada", "periksa", "project", "proyek", "source", "the", "this", "to", "untuk", "yang",
)


def strip_comments(content: Column) -> Column:
    """Line comments go first, then block comments; a URL inside a string loses its tail."""
    return F.regexp_replace(F.regexp_replace(content, r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.left(path, F.greatest(F.length(path) - F.length(basename(path)) - 1, F.lit(0)))


def normalize_path(path: Column) -> Column:
    """``.`` and inner ``..`` resolved, one kind of slash; leading ``..`` stay."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    absolute = F.startswith(path, F.lit("/"))
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def _dotless(path: Column) -> Column:
    """No part is empty or begins with a dot."""
    led = F.concat(F.lit("/"), path)
    return ~(F.contains(led, F.lit("/.")) | F.contains(led, F.lit("//")) | F.endswith(led, F.lit("/")))


def resolve_relative(base_folder: Column, spec: Column) -> Column:
    """A relative specifier joined to a folder; ``..`` beyond the top is dropped.

    Where dots stand only at the head of the specifier, as they mostly do, plain string functions tell
    how far up it goes; the fold over the parts does the rest.
    """
    parts = F.filter(F.concat(F.split(base_folder, "/"), F.split(spec, "/")), lambda p: (p != "") & (p != "."))

    def step(acc: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    tail = F.regexp_replace(spec, r"^(?:\.\.?/)+", "")
    plain = _dotless(tail) & _dotless(base_folder)
    ups = (F.length(spec) - F.length(tail) - F.length(F.replace(F.left(spec, F.length(spec) - F.length(tail)), F.lit("../"), F.lit("")))) / 3
    kept = F.length(base_folder) - F.length(F.replace(base_folder, F.lit("/"), F.lit(""))) + 1 - ups.cast("int")
    return F.when(plain, F.when(kept > 0, F.concat(F.call_function("substring_index", base_folder, F.lit("/"), kept), F.lit("/"), tail)).otherwise(tail)).otherwise(folded)


def candidates(resolved: Column) -> Column:
    """The paths that a resolved specifier may mean, best first."""
    bare = F.array(resolved, *[F.concat(resolved, F.lit(e)) for e in EXTENSIONS], *[F.concat(resolved, F.lit(f"/index{e}")) for e in EXTENSIONS])
    return F.when(resolved.rlike(SOURCE_END), F.array(resolved)).otherwise(bare)


def answers(path: Column) -> Column:
    """(name, place) of all resolved specifiers that have this path among their candidates: the inverse of ``candidates``."""
    rows = [F.struct(path.alias("name"), F.lit(0).alias("place"))]
    for i, end in enumerate((*EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)), 1):
        name = F.when(F.endswith(path, F.lit(end)), F.left(path, F.length(path) - F.lit(len(end))))
        rows.append(F.struct(F.when(~name.rlike(SOURCE_END), name).alias("name"), F.lit(i).alias("place")))
    return F.filter(F.array(*rows), lambda a: a["name"].isNotNull())


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE_END) & ~path.endswith(".d.ts")


def is_test(path: Column) -> Column:
    return basename(path).rlike(TEST_FILE)


def is_test_legacy(path: Column) -> Column:
    return F.lower(path).rlike(TEST_FILE) | F.lower(path).rlike(LEGACY_TEST_FOLDER)


def entrypoint(path: Column) -> tuple[Column, Column]:
    """(kind, confidence) of the first matching rule; none and 0 without one."""
    kind, confidence = F.lit("none"), F.lit(0.0)
    for pattern, name, value in reversed(ENTRYPOINTS):
        kind = F.when(basename(path).rlike(pattern), name).otherwise(kind)
        confidence = F.when(basename(path).rlike(pattern), value).otherwise(confidence)
    return kind, confidence


def node_type(path: Column, content: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.contains(".service.") | content.contains("@Injectable"), "Service")
        .when(low.contains(".component.") | content.contains("@Component"), "Component")
        .when(low.contains(".module.") | low.contains(".routes."), "Module")
        .when(low.contains("util") | low.contains("helper"), "Helper")
        .otherwise("Other")
    )


def node_type_legacy(path: Column, content: Column) -> Column:
    """As ``node_type``, and names in the file name or a tools folder count as well."""
    name, low = basename(path), F.lower(path)
    return (
        F.when(low.contains(".service.") | content.contains("@Injectable") | name.contains("Service"), "Service")
        .when(low.contains(".component.") | content.contains("@Component") | name.contains("Component"), "Component")
        .when(low.contains(".module.") | low.contains(".routes.") | name.contains("Module"), "Module")
        .when(low.contains("util") | low.contains("helper") | low.contains("/tools/"), "Helper")
        .otherwise("Other")
    )


def label(path: Column, content: Column) -> Column:
    """The first exported class, function or const, or else the capitalised stem."""
    found = [F.nullif(F.regexp_extract(content, rf"export\s+{k}\s+(\w+)", 1), F.lit("")) for k in ("class", "function", "const")]
    stem = F.regexp_replace(basename(path), r"\..*$", "")
    words = F.transform(F.split(stem, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    return F.coalesce(*found, F.array_join(words, ""))


def normalize_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def recall_terms(text: Column, least: int = 1) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= least))


def context_terms(text: Column) -> Column:
    """Words of identifiers: camel case and underscores split, stop words and single letters left out."""
    spaced = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))
    words = F.transform(F.regexp_extract_all(spaced, F.lit(r"([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.lower)
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 2), F.array(*map(F.lit, STOPWORDS)))


def overlap(query: Column, field: Column) -> Column:
    """Share of the query's terms that the field has; 0 without terms."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, field)) / F.size(query))
