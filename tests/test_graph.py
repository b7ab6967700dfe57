import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import graph as G
from gneiss.plans import codegraph as C


def edges(spark, text):
    rows = [tuple(e.split(">")) for e in text.split()]
    return spark.createDataFrame(rows, "src string, dst string")


def nodes(spark, df, more=()):
    return G.vertices(df).unionByName(spark.createDataFrame([(m,) for m in more], "node string")).distinct()


def test_degrees(spark):
    e = edges(spark, "a>d b>a c>a")
    got = {r["node"]: (r["fan_in"], r["fan_out"]) for r in G.degrees(G.vertices(e), e).collect()}
    assert got == {"a": (2, 1), "b": (0, 1), "c": (0, 1), "d": (1, 0)}


@pytest.mark.parametrize(
    ("text", "b0", "b1", "archetype"),
    [("a>b a>c b>c", 1, 1, "sparse_cyclic"), ("a>b b>c c>a d>e", 2, 1, "fragmented_sparse_cyclic"), ("a>b b>a", 1, 1, "sparse_cyclic"), ("a>b a>c", 1, 0, "tree_like")],
)
def test_betti_and_archetype(spark, text, b0, b1, archetype):
    e = edges(spark, text)
    row = C.shape_of(G.betti(G.vertices(e), e)).first()
    assert (row["beta_0"], row["beta_1"], row["archetype"]) == (b0, b1, archetype)
    assert 0 <= row["complexity"] <= 1


def test_cycle_basis_orientation(spark):
    for text, size, orientation in [("a>b a>c b>c", 4, "mixed"), ("a>b b>c c>a d>e", 4, "directed"), ("a>b b>a", 3, "directed"), ("a>a", 2, "directed")]:
        e = edges(spark, text)
        row = G.cycle_basis(G.vertices(e), e).collect()
        assert [(len(r["cycle"]), r["orientation"]) for r in row] == [(size, orientation)], text


def test_cycle_witnesses(spark):
    e = edges(spark, "b>c c>a a>b d>e x>x")
    assert sorted(r["cycle"] for r in G.cycle_witnesses(G.vertices(e), e).collect()) == [["a", "b", "c"], ["x"]]
    assert {r["node"] for r in G.on_cycle(e).collect()} == {"a", "b", "c", "x"}


def test_reach_and_paths(spark):
    e = edges(spark, "a>b b>c c>a c>d s>b s>e e>d")
    starts = spark.createDataFrame([("a",), ("s",)], "start string")
    got = {(r["start"], r["node"]): r["hops"] for r in G.reach(starts, e).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("a", "d"): 3, ("s", "b"): 1, ("s", "e"): 1, ("s", "c"): 2, ("s", "d"): 2, ("s", "a"): 3}
    parents = {r["node"]: r["parent"] for r in G.reach_path(starts.where("start = 's'"), e).collect()}
    assert parents == {"s": None, "b": "s", "e": "s", "c": "b", "d": "e", "a": "c"}


def test_reach_without_edges(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert G.reach(spark.createDataFrame([("a",)], "start string"), e).count() == 0
    assert G.betti(spark.createDataFrame([], "node string"), e).first()["n_vertices"] == 0


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    parent = {i: i for p in pairs for i in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {r["node"]: r["component"] for r in G.weak_components(G.vertices(e), e).collect()} == {x: root(x) for x in parent}


def test_diamonds_and_hubs(spark):
    e = edges(spark, "a>b a>c b>d c>d x>d y>d")
    assert [tuple(r) for r in G.diamonds(e).collect()] == [("a", "b", "c", "d")]
    assert [tuple(r) for r in G.hubs(e).collect()] == [("d", 4)]


def test_cycle_guard(spark):
    e = edges(spark, "a>b b>c")
    got = {(r["src"], r["dst"]): r["unsafe"] for r in G.would_close_cycle(edges(spark, "c>a a>c b>b"), e).collect()}
    assert got == {("c", "a"): True, ("a", "c"): False, ("b", "b"): True}


FILES = {
    "src/main.ts": "import { App } from './app';\nimport lib from 'some-lib';",
    "src/app.ts": "import { u } from './core';\nimport './missing';\nexport class App {}",
    "src/core/index.ts": "export const u = 1; // import './no'",
    "src/core/deep.service.ts": "@Injectable()\nexport class Deep {}",
    "src/app.spec.ts": "import { App } from './app';",
    "src/lone.ts": "export function lone() {}",
    "src/x/user.ts": "import { Deep } from '../core/deep.service';\nexport interface U { }",
}


@pytest.fixture(scope="module")
def code(spark):
    return C.CodeGraph(spark.createDataFrame(list(FILES.items()), "path string, content string").persist())


def test_code_graph(code):
    assert {(r["src"], r["dst"]) for r in code.edges.collect()} == {("src/main.ts", "src/app.ts"), ("src/app.ts", "src/core/index.ts"), ("src/app.spec.ts", "src/app.ts"), ("src/x/user.ts", "src/core/deep.service.ts")}
    row = code.summary().first()
    assert (row["total_files"], row["entrypoints"], row["tests"], row["unresolved_imports"], row["external_imports"]) == (7, 1, 1, 1, 1)
    assert {r["file"] for r in C.orphans(code).collect()} == {"src/lone.ts", "src/x/user.ts"}
    risks = {r["node"]: (r["score"], r["risk"]) for r in C.risks(code).collect()}
    assert risks == {"src/main.ts": (3, "medium"), "src/app.ts": (3, "medium"), "src/core/index.ts": (1, "low"), "src/core/deep.service.ts": (1, "low")}
    kinds = {(r["type"], r["file"]) for r in C.sheaf(code).collect()}
    assert ("boundary_violation", "src/x/user.ts") in kinds and ("boundary_without_public_api", "src/x") in kinds


def test_impact_of_missing_target(code, spark):
    got = C.impact(code, spark.createDataFrame([("src/core/index.ts",), ("nope",)], "start string")).collect()
    assert [(r["start"], r["downstream"], r["affected_entrypoints"]) for r in got] == [("src/core/index.ts", 3, 1)]


def test_signature_does_not_depend_on_order(code):
    other = C.CodeGraph(code.files.orderBy(F.desc("content")))
    assert code.signature().first() == other.signature().first()


def test_failing_analyzer_stops_no_other(code):
    def broken(_):
        raise RuntimeError("no")

    C.register("test.broken", broken)
    try:
        found, errors = C.analyze(code, ["topo.orphan", "test.broken"])
    finally:
        del C.ANALYZERS["test.broken"]
    assert errors == {"test.broken": "no"} and found.count() == 2


def _ahead(pairs):
    """node -> all nodes it reaches, by plain search."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    out = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = set(), [start]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[start] = seen
    return out


def test_strong_components_against_search(spark):
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(16), rng.randrange(16)) for _ in range(24)})
    e = spark.createDataFrame(pairs, "src long, dst long")
    ahead = _ahead(pairs)
    same = {x: min([x, *(y for y in ahead[x] if x in ahead[y])]) for x in ahead}
    want = {x: c for x, c in same.items() if any(y != x and same[y] == c for y in same)}
    assert {r["node"]: r["component"] for r in G.strong_components(e).collect()} == want
    placed, between = G.condensed(G.vertices(e), e)
    assert {r["node"]: r["part"] for r in placed.collect()} == same
    got = {(r["start"], r["node"]) for r in G.reach_parts(placed.select(F.col("part").alias("start")).distinct(), between).collect()}
    assert got == {(same[x], same[y]) for x in ahead for y in {x, *ahead[x]}}


def test_spread_from_several_starts(spark):
    got = {r["node"]: r["hops"] for r in G.spread(spark.createDataFrame([("a",), ("s",)], "node string"), edges(spark, "a>b b>c c>a c>d s>b s>e e>d")).collect()}
    assert got == {"a": 0, "s": 0, "b": 1, "e": 1, "c": 2, "d": 2}


@pytest.fixture
def ring(spark):
    """Six tests in a ring of imports, which import one file; a service imports the ring."""
    files = {f"src/t{i}.spec.ts": f"import './t{(i + 1) % 6}.spec';\nimport './base';" for i in range(6)}
    files |= {"src/base.ts": "", "src/a.service.ts": "import './t0.spec';", "src/main.ts": "import './a.service';"}
    return C.CodeGraph(spark.createDataFrame(list(files.items()), "path string, content string"))


def test_reach_is_counted_by_components(ring, monkeypatch):
    walked, reach = [], G.reach
    monkeypatch.setattr(G, "reach", lambda starts, *rest: walked.append(starts.count()) or reach(starts, *rest))
    assert [tuple(r) for r in C.test_reach(ring).collect()] == [("src/base.ts", 6)]
    assert walked == [1]  # not one walk for each test


def test_tested_and_impact_of_a_ring(ring, spark):
    assert [tuple(r) for r in C.tested(ring).collect()] == [("src/base.ts", 1)]
    got = {r["start"]: tuple(r)[1:4] for r in C.impact(ring, spark.createDataFrame([("src/a.service.ts",), ("src/t3.spec.ts",), ("src/main.ts",)], "start string")).collect()}
    assert got == {"src/a.service.ts": (7, 1, 1), "src/t3.spec.ts": (6, 7, 1), "src/main.ts": (8, 0, 1)}


def test_correlations_take_every_analyzer_and_miss_none(spark, monkeypatch):
    files = {"src/lone.ts": "eval(x);\nexport interface A {\n  id: number;\n}", "src/b.ts": "export interface B {\n  id: number;\n}", "src/c.ts": "import './b';\nexport interface C {\n  id: number;\n}", "src/main.ts": "import './c';"}
    g = C.CodeGraph(spark.createDataFrame(list(files.items()), "path string, content string").persist())
    got = {(r["type"], r["severity"], r["file"]): r["n"] for r in C.all_correlations(g).collect()}
    assert got == {
        ("orphan_with_issue", "high", "src/lone.ts"): 1, ("boundary_isomorphism", "low", "src/b.ts"): 2, ("boundary_isomorphism", "low", "src/c.ts"): 1,
        ("risk_without_test_path", "medium", "src/main.ts"): 1, ("risk_without_test_path", "medium", "src/c.ts"): 1,
    }
    monkeypatch.setitem(C.ANALYZERS, "topo.risk", lambda g: 1 / 0)
    with pytest.raises(RuntimeError, match="topo.risk"):
        C.all_correlations(g)


def test_diamonds_shuffle_no_single_paths(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(30)})
    found = G.diamonds(spark.createDataFrame(pairs, "src long, dst long"))
    have = set(pairs)
    want = [(s, x, y, d) for s in range(9) for x in range(9) for y in range(x + 1, 9) for d in range(9) if {(s, x), (x, d), (s, y), (y, d)} <= have]
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1  # paths are not joined with paths
