"""Registered queries of evidence, recall and the life of memories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import scoring as S
from gneiss.functions import text as T
from gneiss.operators import evidence as E
from gneiss.operators import graph as G
from gneiss.operators import mutations as U
from gneiss.operators import recall
from gneiss.plans import codegraph as C
from gneiss.plans.queries import _NODES, _RISK, code, query
from gneiss.sources import feeds
from gneiss.sources.feeds import duck, frame

#: Memories with what analyzers know of them; ``ordinal`` is their place in the store.
RECORDS = f"""
SELECT m.*, CAST(id AS BIGINT) AS ordinal, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN NULL ELSE 'k' || id END AS dedup_key,
  CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'resolved' WHEN CAST(id AS BIGINT) % 17 = 0 THEN 'stale' WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE 'active' END AS evidence_status,
  'src/' || source || '.ts' AS file, lang AS file_hash, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN NULL ELSE 'g' || CAST(CAST(id AS BIGINT) % 4 AS STRING) END AS graph_signature,
  CAST(61 - age_days AS INT) AS timestamp, CASE WHEN CAST(id AS BIGINT) % 4 = 1 THEN 's' || source ELSE NULL END AS consolidated_into
FROM ({feeds.MEMORIES}) m"""
#: The files of now and their hashes: every source but those that end in 9, with its smallest language.
HASHES = "SELECT 'src/' || source || '.ts' AS file, min(lang) AS hash FROM {documents} WHERE source NOT LIKE '%9' GROUP BY source"
#: Associations between memories of one source, by id.
LINKS = "SELECT from_id, to_id, CASE WHEN CAST(from_id AS BIGINT) % 3 = 0 THEN 'consolidation' ELSE 'temporal' END AS type FROM (SELECT CAST(doc_id AS STRING) AS from_id, CAST(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS STRING) AS to_id FROM {documents} WHERE doc_id % 9 <> 4) l WHERE to_id IS NOT NULL"

_REC = f"rec AS (SELECT *, [lang, source, size_tag] AS tags, CASE WHEN dedup_key IS NULL THEN 'unverified' ELSE coalesce(evidence_status, 'active') END AS es FROM ({duck(RECORDS)}) r)"
_FRESH = _REC + f""", h AS ({duck(HASHES)}), fresh AS (SELECT rec.*, CASE WHEN es <> 'active' THEN es WHEN h.file IS NULL THEN 'orphaned' WHEN file_hash <> h.hash THEN 'stale'
  WHEN graph_signature = 'g1' THEN 'fresh' WHEN graph_signature IS NOT NULL THEN 'stale' ELSE 'unverified' END AS freshness FROM rec LEFT JOIN h USING (file))"""
_WHY = "CASE WHEN status <> 'active' THEN 'archived' WHEN es IN ('resolved', 'stale', 'orphaned', 'superseded') THEN es WHEN importance < 0.1 THEN 'below_min_importance' END"
_TARGET = "src/src3.ts"
_SCORED = """t AS (SELECT *, list_distinct(regexp_extract_all(lower(content || ' ' || array_to_string(tags, ' ')), '([a-z0-9]+)', 1)) AS terms, ['the', 'thing', 'of', 'enen'] AS q FROM {of}),
scored AS (SELECT *, 4e0 * CAST(contains(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 'the thing of enen') AS INT) + 2e0 * (len(list_intersect(q, terms)) / 4e0) + importance AS query_score,
  file = 'src/src3.ts' AS target_primary, CASE WHEN file = 'src/src3.ts' THEN 4 ELSE 0 END AS target_strength FROM t WHERE list_has_any(terms, q))"""
_ORDER = "query_score DESC, target_primary DESC, target_strength DESC, importance DESC, timestamp, id"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, RECORDS).withColumn("tags", F.array("lang", "source", "size_tag"))


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_freshness(records(spark, sf_dir), frame(spark, sf_dir, HASHES), "g1")


def _scored(rows: DataFrame) -> DataFrame:
    primary = F.col("file") == _TARGET
    return recall.query_scores(rows, "the thing of enen").withColumn("target_primary", primary).withColumn("target_strength", F.when(primary, 4).otherwise(0))


@query(f"WITH {_FRESH} SELECT id, freshness FROM fresh")
def evidence_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir).select("id", "freshness")


@query(f"""WITH {_REC}, c AS (SELECT * FROM rec WHERE type = 'semantic' AND list_has_any(tags, ['src1', 'src2', 'src3']))
SELECT coalesce({_WHY}, 'ranked') AS outcome, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'pruned', (SELECT count(*) FROM rec) - (SELECT count(*) FROM c)""")
def recall_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return E.trace(rows, E.candidates(rows, "semantic", ["src1", "src2", "src3"]), 0.1)


@query(f"WITH {_REC} SELECT id, importance FROM rec WHERE {_WHY} IS NULL ORDER BY importance DESC, timestamp DESC, ordinal LIMIT 20")
def recall_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(E.exclusion(0.1).isNull()).orderBy(*E.order_by(E.UNDIRECTED)).limit(20).select("id", "importance")


@query(f"WITH {_REC}, {_SCORED.replace('{of}', 'rec')} SELECT id, query_score, target_primary FROM scored WHERE {_WHY} IS NULL ORDER BY {_ORDER} LIMIT 20")
def recall_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(records(spark, sf_dir).where(E.exclusion(0.1).isNull()))
    return rows.orderBy(*E.order_by(E.DIRECTED)).limit(20).select("id", "query_score", "target_primary")


@query(f"""WITH {_FRESH}, {_SCORED.replace('{of}', "(SELECT * FROM fresh WHERE freshness NOT IN ('resolved', 'stale', 'orphaned', 'superseded') AND status = 'active')")},
k AS (SELECT id, query_score, target_primary, row_number() OVER (ORDER BY {_ORDER}) AS place, min(CASE WHEN target_primary THEN 0 ELSE 1 END) OVER (ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS miss FROM scored),
met AS (SELECT coalesce(bool_or(target_primary), FALSE) AS met, count(*) AS n FROM k WHERE place <= 5), w AS (SELECT min(place) AS place FROM k WHERE target_primary)
SELECT k.id, query_score, target_primary FROM k, met, w WHERE (k.place < 5) OR (k.place = 5 AND (met OR w.place IS NULL)) OR (NOT met AND k.place = w.place)""")
def evidence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fresh(spark, sf_dir).where(~F.col("freshness").isin(*E.INACTIVE) & (F.col("status") == "active"))
    return E.with_witness(_scored(rows), 5, E.order_by(E.DIRECTED)).select("id", "query_score", "target_primary")


@query(f"""WITH RECURSIVE {_RISK}, walk(start, node) AS (SELECT node, node FROM nodes WHERE is_test UNION SELECT w.start, e.dst FROM walk w JOIN edges e ON e.src = w.node), reached AS (SELECT DISTINCT node FROM walk WHERE start <> node),
orphan AS (SELECT node FROM nodes WHERE fan_in = 0 AND NOT is_entrypoint AND NOT is_test)
SELECT 'topo.risk' AS analyzer, 'change_risk' AS type, risk AS severity, node AS file, CASE WHEN risk = 'high' THEN 'high_severity_finding' ELSE 'critical_medium_finding' END AS reason FROM risks WHERE risk IN ('high', 'medium')
UNION ALL SELECT 'cross_analyzer', 'orphan_with_issue', risk, r.node, 'cross_analyzer_correlation' FROM risks r SEMI JOIN orphan o ON o.node = r.node WHERE risk IN ('high', 'medium')
UNION ALL SELECT 'cross_analyzer', 'risk_without_test_path', risk, r.node, 'cross_analyzer_correlation' FROM risks r ANTI JOIN reached x ON x.node = r.node WHERE risk IN ('high', 'medium')
UNION ALL SELECT 'cross_analyzer', 'entrypoint_high_risk', risk, r.node, 'cross_analyzer_correlation' FROM risks r WHERE risk = 'high'""")
def findings_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code(spark, sf_dir)
    found = G.cut(C.findings(g, ["topo.orphan", "topo.risk"]))
    return E.worth_storing(found, C.correlations(found, C.tested(g)))


@query(f"""WITH {_NODES}, asked AS (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS asked FROM files UNION SELECT path FROM files),
m AS (SELECT asked, path FROM asked LEFT JOIN files ON path = asked OR ends_with(path, '/' || asked))
SELECT asked, coalesce(max(path) FILTER (path = asked), CASE WHEN count(path) = 1 THEN max(path) END) AS path, count(path) AS n_matches FROM m GROUP BY asked""")
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code(spark, sf_dir).files.select("path")
    asked = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("asked")).unionByName(files.select(F.col("path").alias("asked")))
    return E.resolve_targets(asked, files)


_TERMS = "regexp_extract_all(lower({x}), '([a-z0-9]+)', 1)"


@query(f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents),
x AS (SELECT path, i AS line, ls[i] AS text, list_has_any({_TERMS.replace('{x}', 'ls[i]')}, ['was', 'licensed']) AS hit FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
n AS (SELECT *, bool_or(hit) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, bool_or(hit) OVER (PARTITION BY path) AS any_hit, regexp_matches(ltrim(text), '^(import |export |@)') AS head FROM x),
p AS (SELECT *, bool_or(head) OVER (PARTITION BY path) AS any_head FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS place FROM p WHERE CASE WHEN any_hit THEN near WHEN any_head THEN head ELSE trim(text) <> '' END)
SELECT path, CASE WHEN any_hit THEN 'query_window' ELSE 'structural_head' END AS strategy, CAST(line AS INT) AS line, left(text, 240) AS text FROM k WHERE place <= 12""")
def excerpt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return E.excerpts(texts, F.array(F.lit("was"), F.lit("licensed")), T.recall_terms)


_GRAPH = _REC + f""", links AS ({duck(LINKS)}), v AS (SELECT id, type FROM rec WHERE status = 'active' AND es NOT IN ('resolved', 'stale', 'orphaned', 'superseded')),
a AS (SELECT * FROM links WHERE from_id IN (SELECT id FROM v) AND to_id IN (SELECT id FROM v) AND type NOT IN ('consolidation', 'provenance'))"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Active and current memories, and the semantic associations between them."""
    nodes = records(spark, sf_dir).where((F.col("status") == "active") & E.is_current(F.col("dedup_key"), F.col("evidence_status")))
    links = frame(spark, sf_dir, LINKS).where(~F.col("type").isin("consolidation", "provenance"))
    return nodes, U.between(links, nodes)


@query(f"""WITH {_GRAPH}, o AS (SELECT from_id AS id, count(*) AS fan_out FROM a GROUP BY 1), i AS (SELECT to_id AS id, count(*) AS fan_in FROM a GROUP BY 1)
SELECT v.id, v.type, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM v LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def memory_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = _graph(spark, sf_dir)
    out, into = (links.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias(n)) for c, n in (("from_id", "fan_out"), ("to_id", "fan_in")))
    return nodes.select("id", "type").join(into, "id", "left").join(out, "id", "left").fillna(0, ["fan_in", "fan_out"])


@query(f"WITH {_GRAPH} SELECT id FROM v WHERE id NOT IN (SELECT from_id FROM a UNION SELECT to_id FROM a)")
def isolated_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = _graph(spark, sf_dir)
    return U.isolated(nodes, links)


@query(f"""WITH {_GRAPH}, w AS (SELECT CAST(count(*) FILTER (es = 'stale') * 2 + count(*) FILTER (es = 'unverified') AS DOUBLE) AS weight FROM rec)
SELECT 1e0 / (1e0 + weight / greatest(1, (SELECT count(*) FROM v))) AS health FROM w""")
def memory_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale evidence counts as medium, unverified as low."""
    status = E.evidence_status(F.col("dedup_key"), F.col("evidence_status"))
    n = _graph(spark, sf_dir)[0].agg(F.count(F.lit(1)).alias("n"))
    found = records(spark, sf_dir).agg(F.count_if(status == "stale").alias("medium"), F.count_if(status == "unverified").alias("low"))
    return found.crossJoin(n).select(S.health(F.lit(0), F.col("medium"), F.col("low"), F.col("n")).alias("health"))


_BATCH = "SELECT event_id AS ordinal, event_type || ':' || CAST(user_id AS STRING) AS dedup_key, event_type AS namespace, 'f' || CAST(user_id % 10 AS STRING) AS file, value, session_id FROM (SELECT *, 's' || CAST(event_id % 3 AS STRING) AS session_id FROM {events}) e"


def _merged(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    rows = frame(spark, sf_dir, _BATCH).where((F.col("ordinal") % 2 == odd) & ~((F.col("namespace") == "purchase") & F.lit(odd == 1)))
    rows = rows.select("dedup_key", F.array("namespace", "session_id").alias("tags"), F.least(F.lit(1.0), F.col("value").cast("double") / 100).alias("importance"), (F.col("ordinal") % 5).cast("string").alias("content"), "ordinal")
    return U.merged(rows)


def _batch_sql(odd: int) -> str:
    gate = " AND namespace <> 'purchase'" if odd else ""
    return f"""(SELECT dedup_key, list_sort(list_distinct(flatten(list([namespace, session_id])))) AS tags, max(least(1e0, CAST(value AS DOUBLE) / 100)) AS importance, CAST(arg_max(ordinal, ordinal) % 5 AS VARCHAR) AS content,
  split_part(dedup_key, ':', 1) AS namespace, 'f' || CAST(CAST(split_part(dedup_key, ':', 2) AS BIGINT) % 10 AS VARCHAR) AS file FROM ({duck(_BATCH)}) b WHERE ordinal % 2 = {odd}{gate} GROUP BY dedup_key)"""


@query(f"SELECT dedup_key, array_to_string(tags, ',') AS tags, importance, content FROM {_batch_sql(1)}")
def merged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, 1).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH o AS {_batch_sql(0)}, n AS {_batch_sql(1)}, b AS (SELECT coalesce(o.dedup_key, n.dedup_key) AS dedup_key, coalesce(n.namespace, o.namespace) AS namespace, coalesce(n.file, o.file) AS file, o.dedup_key IS NOT NULL AS known, n.dedup_key IS NOT NULL AS seen,
  o.content AS oc, n.content AS nc, o.importance AS oi, n.importance AS ni, coalesce(o.tags, []) AS ot, coalesce(n.tags, []) AS nt FROM o FULL OUTER JOIN n ON o.dedup_key = n.dedup_key)
SELECT dedup_key, namespace, CASE WHEN seen THEN nc ELSE oc END AS content, CASE WHEN seen THEN greatest(coalesce(oi, ni), ni) ELSE oi END AS importance, array_to_string(list_sort(list_distinct(list_concat(ot, nt))), ',') AS tags,
 CASE WHEN seen THEN 'active' WHEN file IN ('f8', 'f9') THEN 'orphaned' WHEN namespace = 'purchase' THEN 'stale' ELSE 'resolved' END AS evidence_status,
 CAST(CAST(known AS INT) + CAST(seen AS INT) AS BIGINT) AS observations, CAST(CASE WHEN NOT known THEN 1 ELSE 1 + CAST(seen AND oc <> nc AS INT) END AS BIGINT) AS revisions FROM b""")
def evidence_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd events against the even ones; the analyzer of purchases failed, and files f8 and f9 are gone."""

    def full(rows: DataFrame) -> DataFrame:
        user = F.split("dedup_key", ":")
        return rows.withColumns({"namespace": user[0], "file": F.concat(F.lit("f"), (user[1].cast("long") % 10).cast("string")), "severity": F.lit("low")})

    old = full(_merged(spark, sf_dir, 0)).withColumns({"evidence_status": F.lit("active"), "observations": F.lit(1), "revisions": F.lit(1), "status": F.lit("active")})
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("namespace")).distinct()
    files = spark.range(8).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"))
    after = U.reconcile(old, full(_merged(spark, sf_dir, 1)), names.where("namespace <> 'purchase'"), names.where("namespace = 'purchase'"), files)
    return after.select("dedup_key", "namespace", "content", "importance", F.array_join("tags", ",").alias("tags"), "evidence_status", "observations", "revisions")


@query(f"""WITH {_REC} SELECT id, CASE WHEN status = 'active' AND type = 'episodic' AND consolidated_into IS NOT NULL THEN 'archived' ELSE status END AS status,
 CAST(access_count + CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS access_count FROM rec""")
def compact_and_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return U.accessed(U.compacted(rows), rows.where(F.col("ordinal") % 10 == 0).select("id")).select("id", "status", "access_count")


@query(f"""WITH {_REC} SELECT id AS from_id, 'sem-' || lang AS to_id, 'consolidation' AS type FROM rec WHERE type = 'episodic' AND status = 'active' AND consolidated_into IS NULL""")
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    groups = rows.where("type = 'episodic' and status = 'active' and consolidated_into is null").select("id", F.concat(F.lit("sem-"), "lang").alias("target"))
    return U.consolidated(rows, groups)[1]


@query("SELECT from_id, to_id FROM (SELECT conv_id || '-' || turn AS from_id, lead(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS to_id FROM conversations) t WHERE to_id IS NOT NULL")
def batch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return U.batch_links(rows.select(F.col("conv_id").alias("batch"), F.col("turn").alias("ordinal"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id")))


@query("""WITH s AS (SELECT l_suppkey AS namespace, min(l_orderkey) AS arrival, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY arrival, namespace) AS k FROM s)
SELECT CASE WHEN k <= 5 THEN namespace END AS namespace, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def archived_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("namespace"), F.col("l_orderkey").alias("arrival"), F.lit(1).alias("n"))
    return U.capped_namespaces(rows, 5)


@query(f"WITH {_REC} SELECT id, sha256('content=' || content || chr(10) || 'file=' || file || chr(10) || 'id=' || id || chr(10) || 'type=' || type) AS signature FROM rec WHERE content IS NOT NULL")
def record_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("content is not null").select("id", U.record_signature(["id", "type", "content", "file"]).alias("signature"))


@query(f"""WITH {_NODES} SELECT 'topo.orphan' AS analyzer, 'orphan' AS kind, count(*) AS n FROM nodes WHERE fan_in = 0 AND NOT is_entrypoint AND NOT is_test""")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.findings(code(spark, sf_dir), ["topo.orphan"])
    return found.groupBy("analyzer").agg(F.count(F.lit(1)).alias("n")).select("analyzer", F.lit("orphan").alias("kind"), "n")


#: A file for each order, a line of code for each of its lines.
CODE_LINES = """
SELECT 'src/o' || CAST(l_orderkey AS STRING) || '.ts' AS path, l_linenumber AS line, CASE l_partkey % 7 WHEN 0 THEN 'delete config.port;' WHEN 1 THEN 'eval(code);' WHEN 2 THEN 'new Function (''x'');'
  WHEN 3 THEN 'fs.readFileSync(''a'');' WHEN 4 THEN 'const v' || CAST(l_linenumber AS STRING) || ' = await one();' WHEN 5 THEN 'const t' || CAST(l_linenumber AS STRING) || ' = setInterval(f, 5);'
  ELSE 'myCache.set(k, 1);' END AS text FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INT) AS l_linenumber, l_partkey FROM {lineitem}) n"""
_RULES = f"""l AS ({duck(CODE_LINES)}), r AS (SELECT path, CAST(line AS BIGINT) AS line, CASE WHEN text LIKE 'delete%' THEN 'delete_operator' WHEN text LIKE 'eval%' THEN 'eval_usage' WHEN text LIKE 'new F%' THEN 'new_function'
  WHEN text LIKE 'fs.%' THEN 'sync_io' WHEN text LIKE '%setInterval%' THEN 'uncleared_timer' END AS type, text FROM l)"""


def _line_rules(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = frame(spark, sf_dir, CODE_LINES).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    files = rows.select("path", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("content"))
    return C.ANALYZERS[name](C.CodeGraph(files)).select("type", "severity", "file", "line", "detail")


@query(f"WITH {_RULES} SELECT type, 'high' AS severity, path AS file, line, '1' AS detail FROM r WHERE type IN ('delete_operator', 'eval_usage', 'new_function')")
def perf_deopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rules(spark, sf_dir, "perf.deopt")


@query(f"""WITH {_RULES}, a AS (SELECT path, line, CASE WHEN line - lag(line) OVER w <= 3 THEN 0 ELSE 1 END AS fresh FROM r WHERE text LIKE '%await%' WINDOW w AS (PARTITION BY path ORDER BY line)),
i AS (SELECT path, line, sum(fresh) OVER (PARTITION BY path ORDER BY line) AS island FROM a)
SELECT 'sequential_await' AS type, 'medium' AS severity, path AS file, min(line) AS line, CAST(count(*) AS VARCHAR) AS detail FROM i GROUP BY path, island HAVING count(*) >= 2
UNION ALL SELECT type, 'high', path, line, '1' FROM r WHERE type = 'sync_io'""")
def perf_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rules(spark, sf_dir, "perf.async")


@query(f"WITH {_RULES} SELECT type, 'high' AS severity, path AS file, line, '1' AS detail FROM r WHERE type = 'uncleared_timer'")
def perf_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rules(spark, sf_dir, "perf.gc")


@query(f"WITH {_RULES} SELECT t.type, 'medium' AS severity, path AS file, line, '1' AS detail FROM r, (VALUES ('missing_ttl'), ('unbounded_cache')) t(type) WHERE text LIKE 'myCache%'")
def perf_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rules(spark, sf_dir, "perf.cache")


@query(f"""WITH RECURSIVE {_NODES}, walk(start, node) AS (SELECT node, node FROM nodes WHERE is_test UNION SELECT w.start, e.dst FROM walk w JOIN edges e ON e.src = w.node), reached AS (SELECT DISTINCT node FROM walk WHERE start <> node)
SELECT 'high_influence_without_test_path' AS type, 'medium' AS severity, node AS file FROM nodes WHERE NOT is_test AND (is_entrypoint OR fan_in >= 2) AND node NOT IN (SELECT node FROM reached)
UNION ALL SELECT 'isolated_test', 'medium', node FROM nodes WHERE is_test AND fan_out = 0
UNION ALL SELECT 'no_test_files', 'high', NULL FROM nodes HAVING count(*) FILTER (is_test) = 0 AND count(*) > 0""")
def test_gap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the components without tests, which need whole components in SQL."""
    return C.test_gaps(code(spark, sf_dir)).where("type <> 'testless_component'").select("type", "severity", "file")
