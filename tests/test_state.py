import random
import os

from pyspark.sql import functions as F

from gneiss.operators import lifecycle as L
from gneiss.operators import recall
from gneiss.plans import memory as M
from gneiss.sources import files as S
from gneiss.sources.store import SnapshotStore, read_keys, write_buckets
from gneiss.streaming import reconcile as stream

STATE = stream.STATE
BATCHES = [[("k", "n", 1.0), ("j", "n", 5.0)], [("k", "n", 2.0)], [("z", "other", 1.0)], [("j", "n", 5.0)]]


def test_reconcile_steps_and_replay_agree(spark):
    state = spark.createDataFrame([], STATE)
    for rows in BATCHES:
        state = L.reconcile(state, spark.createDataFrame(rows, "dedup_key string, namespace string, content double"))
    got = {r["dedup_key"]: (r["status"], r["observations"], r["revisions"], r["content"]) for r in state.collect()}
    assert got == {"k": ("resolved", 2, 1, 2.0), "j": ("active", 2, 0, 5.0), "z": ("active", 1, 0, 1.0)}
    flat = spark.createDataFrame([(i, *r) for i, rows in enumerate(BATCHES) for r in rows], "batch int, dedup_key string, namespace string, content double")
    assert {r["dedup_key"]: (r["status"], r["observations"], r["revisions"], r["content"]) for r in L.replay(flat).collect()} == got


def test_runs_retention_digest(spark):
    events = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate("aabba")], "event_id long, user_id long, ts long, event_type string")
    runs = L.coalesce_runs(events)
    assert [(r["event_type"], r["n"]) for r in runs.orderBy("run").collect()] == [("a", 2), ("b", 2), ("a", 1)]
    row = L.retain(runs, 2).first()
    assert (row["kept_runs"], row["archived_runs"], row["archived_events"]) == (2, 1, 2)
    assert L.chained_digest(runs).first() == L.chained_digest(runs.orderBy(F.desc("run"))).first()


def test_manifest_states(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, signature string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, signature string")
    assert {r["path"]: r["change"] for r in L.manifest_diff(old, new).collect()} == {"a": "reused", "b": "changed", "c": "deleted", "d": "added"}


def test_snapshot_store_falls_back(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.read() is None
    for n in (1, 2, 3):
        store.commit(spark.range(n))
    assert store.versions() == [2, 3] and store.read().count() == 3
    os.remove(tmp_path / "s" / "v3" / "_SUCCESS")
    assert store.read().count() == 2


def test_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    write_buckets(spark.createDataFrame([(f"m{i}", i) for i in range(200)], "id string, v long"), path)
    assert {r["v"] for r in read_keys(spark, path, ["m5", "m77", "no"]).collect()} == {5, 77}


def test_stream_equals_batches(spark, tmp_path):
    source, store = tmp_path / "in", SnapshotStore(spark, f"file://{tmp_path}/state")
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame([(*r, i) for r in rows], "dedup_key string, namespace string, content double, order int").coalesce(1).write.parquet(f"file://{source}/{i}")
        read = spark.readStream.schema("dedup_key string, namespace string, content double, order int").parquet(f"file://{source}/{i}")
        stream.start(read, store, f"file://{tmp_path}/check{i}").awaitTermination()
    assert {r["dedup_key"]: r["status"] for r in store.read().collect()} == {"k": "resolved", "j": "active", "z": "active"}


def test_source_tree(spark, tmp_path):
    for name, text in {"a.ts": "x", "b.d.ts": "x", "node_modules/c.ts": "x", "sub/d.jsx": "y", ".hid/e.ts": "x", "f.txt": "x"}.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = S.scan_sources(spark, f"{tmp_path}/src").collect()
    assert {(r["path"].rpartition("/src/")[2], r["content"]) for r in rows} == {("a.ts", "x"), ("sub/d.jsx", "y")}
    assert S.scan_manifest(spark, [f"{tmp_path}/src", f"{tmp_path}/src"]).count() == 2


def test_alias_rules(spark):
    config = spark.createDataFrame([("tsconfig.json", '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@core/*": ["src/core/*"],}, } }')], "path string, content string")
    assert [tuple(r) for r in S.alias_rules(config).collect()] == [("@core", "src/core")]


def memories(spark, rows):
    return spark.createDataFrame(rows, "id string, type string, content string, tags array<string>, importance double, age_days int, access_count int, status string")


def test_recall_prunes_to_the_rare_term(spark):
    rows = [(f"m{i}", "semantic", "common query hazard", ["t"], 1.0, 1, 0, "active") for i in range(256)] + [("rare", "semantic", "singular quasar needle", [], 0.1, 1, 0, "active")]
    hits = recall.query_scores(memories(spark, rows), "singular quasar needle").collect()
    assert [(r["id"], round(r["query_score"], 6)) for r in hits] == [("rare", 6.1)]


def test_pairs_groups_packing(spark):
    m = memories(spark, [("a", "e", "", ["x", "y"], 0.0, 0, 0, "active"), ("b", "e", "", ["x", "y", "y"], 0.0, 0, 0, "active"), ("c", "e", "", ["x"], 0.0, 0, 0, "active")])
    linked = spark.createDataFrame([("b", "a")], "src string, dst string")
    assert [tuple(r) for r in recall.shared_tag_pairs(m, 2, linked).collect()] == [("a", "b", 2, True)]
    cards = spark.createDataFrame([("s", "p", 3.0, 50), ("s", "q", 2.0, 60), ("s", "r", 1.0, 40)], "scope string, id string, score double, size long")
    assert [tuple(r) for r in recall.pack(cards, 100).collect()] == [("s", 90, 2, "p,r")]


def test_memory_betti_by_class(spark):
    a = spark.createDataFrame([("p1", "p2", "inferential"), ("p1", "p2", "causal"), ("m1", "m2", "temporal"), ("m2", "m3", "temporal"), ("m3", "m1", "temporal")], "from_id string, to_id string, type string")
    got = {r["class"]: (r["beta_0"], r["beta_1"]) for r in M.betti_breakdown(a).collect()}
    assert got == {"all": (2, 2), "reasoning": (1, 1), "structural": (1, 1)}


def test_drift_and_relevancy(spark):
    v = lambda rows: spark.createDataFrame(rows, "name string, value double")
    row = M.drift(v([("a", 0.3), ("b", 0.4)]), v([("c", 0.0)])).first()
    assert abs(row["distance"] - 0.5) < 1e-12 and row["drift"] == "high"
    m = memories(spark, [("a", "e", "pricing rules", ["pricing"], 0.5, 0, 0, "archived"), ("b", "e", "other", [], 0.5, 30, 0, "archived")])
    got = {r["id"]: r["relevancy"] for r in M.relevancy(m, "pricing calculation").collect()}
    assert abs(got["a"] - (0.35 + 0.125 + 0.15 + 0.1 / 3 + 0.15)) < 1e-9 and abs(got["b"] - (0.125 + 0.075)) < 1e-9
    assert M.bounded_neighbours(spark.createDataFrame([("x",)], "start string"), spark.createDataFrame([("x", f"n{i:02}") for i in range(20)], "from_id string, to_id string")).count() == 10


def test_trigger(spark):
    m = memories(spark, [(str(i), "episodic", "", [], 0.0, 0, 0, "active") for i in range(15)])
    parts = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")
    row = M.consolidation_trigger(m, parts).first()
    assert (row["unconsolidated"], row["beta_0"], row["isolated"], row["needed"]) == (15, 1, 0, True)


def test_source_tree_below_odd_roots(spark, tmp_path):
    root = tmp_path / ".cfg" / "dist" / "a+b"
    for name, body in {"x.ts": b"caf\xc3\xa9 \xff!", "y.ts": b"ok", "out/z.ts": b"no", "sub/w.ts": b"w"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    rows = {r["path"]: r["content"] for r in S.scan_sources(spark, str(root), str(root)).collect()}
    assert rows == {"x.ts": "caf\u00e9 !", "y.ts": "ok", "sub/w.ts": "w"}
    assert {r["path"] for r in S.scan_manifest(spark, str(root), str(root)).collect()} == set(rows)
    assert [tuple(r) for r in S.skipped(spark, str(root), str(root)).collect()] == [("x.ts", "invalid_utf8")]
    folders = {r["path"].rpartition("a+b")[2]: (r["files"], r["dirs"]) for r in S.scan_directories(spark, str(root)).collect()}
    assert folders == {"": (2, 2), "/out": (1, 0), "/sub": (1, 0)}


def test_writers_take_different_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    one, two = store._claim(1), SnapshotStore(spark, str(tmp_path / "s"))._claim(1)
    assert (one, two) == (1, 2)
    assert store.commit(spark.range(3)) == 3 and store.read().count() == 3


def test_pairs_meet_in_shared_sets_only(spark):
    rng = random.Random(3)
    tags = {f"m{i:02}": sorted(rng.sample("abcdefg", rng.randrange(0, 6))) for i in range(24)}
    rows = [(k, "active", "xy"[i % 2], [*v, *v[:1], "pattern"]) for i, (k, v) in enumerate(tags.items())]
    m = spark.createDataFrame(rows, "id string, status string, type string, tags array<string>")
    kind = {r[0]: r[2] for r in rows}
    want = {(a, b): len(set(tags[a]) & set(tags[b])) for a in tags for b in tags if a < b and kind[a] == kind[b]}
    linked = spark.createDataFrame([], "src string, dst string")
    for least in (1, 2, 3):
        got = recall.shared_tag_pairs(m, least, linked)
        assert sorted((r["a"], r["b"], r["shared"]) for r in got.collect()) == sorted((*p, n) for p, n in want.items() if n >= least)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "count(1)" not in plan  # pairs that share too little are never counted
