import posixpath

import pytest
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import resolve as R
from gneiss.operators import scan
from gneiss.plans import codegraph as C


def files(spark, **named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], "path string, content string")


def findings(spark, content):
    return sorted((r["type"], r["line"]) for r in scan.line_findings(files(spark, f=content)).collect())


def test_async_rules(spark):
    body = "const a = await one();\nconst b = await two();\nconst c = await three(b);\nfor (const x of xs) {\n  await go.there(x);\n}\nfs.readFileSync('a');"
    got = findings(spark, body)
    assert ("sequential_await", 1) in got and ("await_in_loop", 5) in got and ("sync_io", 7) in got
    n = [r["n"] for r in scan.line_findings(files(spark, f=body)).where("type = 'sequential_await'").collect()]
    assert n == [2]


def test_deopt_rules(spark):
    assert findings(spark, "delete config.port;\neval(code);\nnew Function ('x');") == [("delete_operator", 1), ("eval_usage", 2), ("new_function", 3)]


def test_memory_rules(spark):
    body = "while (true) {\n  const o = { a: JSON.parse(s) };\n}\nconst t = setInterval(f, 5);\nconst u = setInterval(f, 5);\nclearInterval(u);\nconst userCache = new Map();\nwindow.addEventListener('x', f);\nwindow.addEventListener('y', f);"
    assert findings(spark, body) == [("allocation_in_loop", 2), ("json_in_loop", 2), ("unbounded_collection", 7), ("uncleared_timer", 4), ("unclosed_event_listener", 8)]
    assert findings(spark, "const poolMap = new Map<string, X>();") == []


def test_cache_rules(spark):
    body = "const key = 'a' + Date.now();\nconst cacheKey = userId + productId;\nmyCache.set(cacheKey, 1);"
    assert findings(spark, body) == [("key_collision_risk", 1), ("key_collision_risk", 2), ("missing_ttl", 3), ("nondeterministic_cache_key", 1), ("unbounded_cache", 3)]
    assert ("missing_ttl", 2) not in findings(spark, "const throttle = 1;\nmyCache.set(k, 1);")


def test_in_loop_matches_the_backward_walk(spark):
    import random
    import re

    rng = random.Random(3)
    text = [rng.choice(["for (;;) {", "}", "x();", "if (a) {", "while (b) {", "} else {", "for (const a of b) x();"]) for _ in range(300)]
    loop = re.compile(scan.LOOP)

    def walk(i):
        depth = 0
        for j in range(i, -1, -1):
            depth += text[j].count("}") - text[j].count("{")
            if loop.match(text[j].strip()) and depth <= 0:
                return True
        return False

    rows = scan.looped_lines(scan.lines(files(spark, f="\n".join(text)))).collect()
    assert {r["line"]: r["in_loop"] for r in rows} == {i + 1: walk(i) for i in range(len(text))}


def test_imports_and_traps(spark):
    body = "import a, { b } from './x';\nimport * as c from \"./y\";\nimport './side';\nexport * from './no';\nimport type { T } from 'lib';\n// import './gone'\n/* import './gone2' */"
    assert [r["spec"] for r in scan.imports(files(spark, f=body)).orderBy("ord").collect()] == ["./x", "./y", "./side", "lib"]


def test_type_shapes(spark):
    body = "export interface UserDTO {\n  id: number;\n  readonly name?: string;\n}\ntype View = {\n  name: string,\n  id: number\n};\ninterface Empty { }\ninterface UserDTO {\n  id: number;\n  name: string;\n}"
    shapes = scan.type_shapes(files(spark, f=body))
    assert {r["type_name"]: r["props"] for r in shapes.collect()} == {"UserDTO": ["id", "name"], "View": ["id", "name"], "Empty": []}
    assert [(r["type_a"], r["type_b"]) for r in scan.isomorphic_shapes(shapes).collect()] == [("UserDTO", "View")]


def test_mergeable_imports(spark):
    got = scan.mergeable_imports(files(spark, f="import a from './u';\nimport b from './u';\nimport c from './v';")).collect()
    assert [(r["spec"], r["n"], r["lines"]) for r in got] == [("./u", 2, "1,2")]


def test_outline(spark):
    body = "export interface A {}\nexport type B = string;\nexport abstract class C {}\nexport async function d() {}\nexport const e = 1;\nexport enum G { X }\n@Dec\nexport default C;"
    got = {(r["kind"], r["name"]) for r in scan.outline(files(spark, f=body)).collect()}
    assert {("interface", "A"), ("type", "B"), ("class", "C"), ("function", "d"), ("const", "e"), ("enum", "G"), ("decorator", "Dec"), ("default", "default")} <= got


@pytest.mark.parametrize("path", ["a/./b/../c", "./x", "../../a/../b", "a//b/", "/r/../s", ".", "a/..", "a\\b"])
def test_normalize_path(spark, path):
    expected = posixpath.normpath(path.replace("\\", "/"))
    assert spark.range(1).select(T.normalize_path(F.lit(path)).alias("p")).first()["p"] == expected


def test_names(spark):
    row = lambda path, content="": spark.createDataFrame([(path, content)], "path string, content string").select(
        T.is_source(F.col("path")), T.is_test(F.col("path")), T.is_test_legacy(F.col("path")), T.entrypoint(F.col("path"))[0], T.node_type(F.col("path"), F.col("content")), T.node_type_legacy(F.col("path"), F.col("content")), T.label(F.col("path"), F.col("content"))
    ).first()
    assert tuple(row("a/main.server.ts")) == (True, False, False, "ssr_bootstrap", "Other", "Other", "Main")
    assert tuple(row("a/tests/b.d.ts"))[:3] == (False, False, True)
    assert tuple(row("a/user-util.spec.ts", "export const q = 1"))[1:] == (True, True, "none", "Helper", "Helper", "q")
    assert tuple(row("a/UserService.ts"))[4:6] == ("Other", "Service")


def test_terms(spark):
    row = spark.range(1).select(T.context_terms(F.lit("fixPricing_calculation of userId x")), T.recall_terms(F.lit("A b-cc 12"), 2), T.overlap(F.array(), F.array(F.lit("a")))).first()
    assert set(row[0]) == {"pricing", "calculation", "user", "id"} and row[1] == ["cc", "12"] and row[2] == 0


def test_aliases(spark):
    all_files = files(spark, **{"src/core/logger.ts": "", "src/a.ts": "import x from '@core/logger';\nimport y from 'some-lib';"})
    external = R.resolve(scan.imports(all_files), all_files).where("status = 'external'")
    rules = spark.createDataFrame([("@core", "src/core"), ("@", "src")], "prefix string, base string")
    assert [(r["spec"], r["target"]) for r in R.resolve_aliases(external, rules, all_files).collect()] == [("@core/logger", "src/core/logger.ts")]


def test_names_of_files_are_the_inverse_of_candidates(spark):
    paths = ["a.ts", "a.tsx", "x/index.ts", "x/index", "b.js.ts", "c", "q/index.ts/index.ts", ".ts", "/index.js", "z/index.jsx", "z.js"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    ends = (*T.EXTENSIONS, *(f"/index{e}" for e in T.EXTENSIONS))
    bases = {b for p in paths for b in [p, *(p[: -len(e)] for e in ends if p.endswith(e))]}
    want = {}
    for r in spark.createDataFrame([(b,) for b in bases], "base string").select("base", T.candidates(F.col("base")).alias("c")).collect():
        place = next((i for i, c in enumerate(r["c"]) if c in paths), None)
        if place is not None:
            want[r["base"]] = (r["c"][place], place)
    assert {r["name"]: (r["target"], r["place"]) for r in R.names(files).collect()} == want


def test_relative_specifiers_with_dots_anywhere(spark):
    rows = [("src/m1", "../../m2/p", "m2/p"), ("src/m1", "./a/../b", "src/m1/b"), ("src", "../../../x", "x"), ("", "./x", "x"), ("src/./m", ".//x", "src/m/x"), ("src/m", "./.x/y", "src/m/.x/y"), ("/abs", "./x", "abs/x")]
    got = spark.createDataFrame(rows, "folder string, spec string, want string").select("want", T.resolve_relative(F.col("folder"), F.col("spec")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_isomorphic_counts_are_those_of_the_pairs(spark):
    rows = [(f"f{i % 5}.ts", f"T{i}", ["id", f"w{i % 3}"] if i < 13 else []) for i in range(16)] + [("g.ts", "G", ["lone"])]
    shapes = spark.createDataFrame(rows, "path string, type_name string, props array<string>")
    pairs = scan.isomorphic_shapes(shapes).persist()
    counted = scan.isomorphic_counts(shapes)
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, pairs.groupBy("props").count().collect()))
    assert sorted(map(tuple, scan.isomorphic_partners(shapes).collect())) == sorted(map(tuple, pairs.groupBy("file_a").count().collect()))


@pytest.mark.parametrize("name", ["perf.gc", "perf.cache", "perf.deopt"])
def test_line_rules_read_files_once(spark, name):
    source = spark.createDataFrame([("f", "const t = setInterval(f, 5);\nclearInterval(t)\nconst myCache = new Map();\nmyCache.set(k, 1);")], "path string, content string")
    plan = C.ANALYZERS[name](C.CodeGraph(source))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
