import duckdb
import pytest

import __spark_entry__ as entry
from gneiss.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "scan_imports", "resolve_imports", "graph_nodes", "topo_risk", "type_shapes", "outline", "boundaries", "boundary_quotient", "diamonds", "multi_importer_hubs", "weak_components", "manifold",
    "cycle_witnesses", "cycle_basis", "health", "memory_stats", "recall_top", "bridge_candidates", "consolidation_groups", "memory_betti_breakdown", "observation_state", "event_runs", "event_digest", "greedy_packing",
    "evidence_freshness", "recall_trace", "recall_undirected", "recall_directed", "evidence_top", "findings_to_store", "resolve_targets", "excerpt_windows", "memory_graph", "isolated_memories", "memory_health",
    "merged_observations", "evidence_reconcile", "compact_and_access", "consolidate", "batch_links", "archived_namespaces", "record_signatures", "findings_by_type",
    "perf_deopt", "perf_async", "perf_gc", "perf_cache", "test_gap_findings",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    plain = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else x for x in row)
    df, rel = own.QUERIES[name](spark, SF), duck.sql(own.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted((plain(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    assert got == sorted((plain(r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
