from pyspark.sql import functions as F

from gneiss.operators import evidence as E
from gneiss.operators import mutations as U


def test_a_primary_target_gets_the_last_place_only_if_none_is_there(spark):
    rows = spark.createDataFrame([(i, 10.0 - i, i == 7) for i in range(10)], "id int, query_score double, target_primary boolean")
    order = [F.desc("query_score"), F.asc("id")]
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(E.with_witness(rows, 3, order)) == [0, 1, 7]
    assert ids(E.with_witness(rows, 8, order)) == list(range(8))
    assert ids(E.with_witness(rows, 1, order)) == [0] and ids(E.with_witness(rows, 3, order, targets=False)) == [0, 1, 2]
    assert ids(E.with_witness(rows.where("not target_primary"), 3, order)) == [0, 1, 2]
    assert ids(E.with_witness(rows.where("id < 2"), 3, order)) == [0, 1] and ids(E.with_witness(rows.where("false"), 3, order)) == []


def test_targets_by_path_or_unique_suffix(spark):
    files = spark.createDataFrame([("src/a/x.ts",), ("src/b/x.ts",), ("src/b/y.ts",), ("x.ts",)], "path string")
    asked = spark.createDataFrame([("y.ts",), ("a/x.ts",), ("x.ts",), ("b",), ("src/b/x.ts",), (None,)], "asked string")
    got = {r["asked"]: (r["path"], r["n_matches"]) for r in E.resolve_targets(asked, files).collect()}
    assert got == {"y.ts": ("src/b/y.ts", 1), "a/x.ts": ("src/a/x.ts", 1), "x.ts": ("x.ts", 3), "b": (None, 0), "src/b/x.ts": ("src/b/x.ts", 1), None: (None, 0)}


def test_freshness_rules_in_order(spark):
    rows = [("a", None, "active", "f", "h", "g"), ("b", "k", "resolved", "f", "h", "g"), ("c", "k", None, "gone", "h", "g"), ("d", "k", None, "f", "x", "g"), ("e", "k", None, "f", "h", "g"), ("f", "k", None, "f", None, "o"), ("g", "k", None, None, None, None)]
    evidence = spark.createDataFrame(rows, "id string, dedup_key string, evidence_status string, file string, file_hash string, graph_signature string")
    hashes = spark.createDataFrame([("f", "h")], "file string, hash string")
    got = {r["id"]: r["freshness"] for r in E.with_freshness(evidence, hashes, "g").collect()}
    assert got == {"a": "unverified", "b": "resolved", "c": "orphaned", "d": "stale", "e": "fresh", "f": "stale", "g": "unverified"}
    assert {r["id"]: r["freshness"] for r in E.with_freshness(evidence, hashes.where("false"), None).collect()}["c"] == "unverified"


def test_evidence_by_file_and_excerpts(spark):
    found = spark.createDataFrame([("t", "x", "high", "a", "b"), ("t", "y", "low", "a", None), ("t", "z", "low", "none", "a")], "analyzer string, type string, severity string, file string, file_b string")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    got = sorted((r["path"], r["type"]) for r in E.evidence_of_files(found, files, ["file", "file_b"]).collect())
    assert got == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")]
    texts = spark.createDataFrame([("p", "one\r\ntwo\nthree\nfour"), ("q", "import x\n\nbody"), ("r", "\n\nbody"), ("s", "")], "path string, content string")
    rows = E.excerpts(texts, F.array(F.lit("four")), lambda c: F.array(c)).collect()
    got = sorted((r["path"], r["line"], r["text"]) for r in rows)
    assert got == [("p", 3, "three"), ("p", 4, "four"), ("q", 1, "import x"), ("r", 3, "body")]


def test_consolidation_and_storage(spark):
    memories = spark.createDataFrame([("1", 2.0, ["b", "a", "b"], None), ("2", None, None, "old")], "id string, importance double, tags array<string>, consolidated_into string")
    kept = {r["id"]: (r["importance"], r["tags"]) for r in U.stored(memories).collect()}
    assert kept == {"1": (1.0, ["a", "b"]), "2": (0.5, [])}
    marked, links = U.consolidated(memories, spark.createDataFrame([("1", "s2"), ("1", "s1"), ("9", "s1")], "id string, target string"))
    assert {r["id"]: r["consolidated_into"] for r in marked.collect()} == {"1": "s1", "2": "old"}
    assert sorted((r["from_id"], r["to_id"]) for r in links.collect()) == [("1", "s1"), ("1", "s2")]
