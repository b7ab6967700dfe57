"""Inputs derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Every feed covers its whole tables. ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Parts by how often one follows another inside an order; rk ranks the followers of a part.
FOLLOWERS = """
SELECT src, dst, n, CAST(row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS INT) AS rk FROM (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n FROM {lineitem} a JOIN {lineitem} b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey) f"""

#: All distinct successions of parts.
DENSE = "SELECT DISTINCT src, dst FROM (" + FOLLOWERS + ") g"
#: The orders of a customer, each followed by the next: many long paths.
CHAINS = """
SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM {orders}) o WHERE dst IS NOT NULL"""
#: What a user does after what: a small graph with cycles for each user.
TRANSITIONS = """
SELECT DISTINCT src, dst FROM (
  SELECT CAST(user_id AS STRING) || ':' || event_type AS src, CAST(user_id AS STRING) || ':' || lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {events}) t
WHERE dst IS NOT NULL AND src <> dst"""

_STEM = """'m' || CAST(p_partkey % 20 AS STRING) || '/' || CASE WHEN p_size = 3 THEN 'e' || CAST(p_partkey AS STRING) || '/main'
  WHEN p_size = 1 THEN 'p' || CAST(p_partkey AS STRING) || '.spec' WHEN p_size = 2 THEN 'p' || CAST(p_partkey AS STRING) || '.service'
  WHEN p_size = 4 THEN 'util-' || CAST(p_partkey AS STRING) ELSE 'p' || CAST(p_partkey AS STRING) END"""

#: A code base with a file for each part, imports from its followers, and an index file in every other module.
FILES = f"""
WITH stems AS (SELECT p_partkey, p_size, p_name, {_STEM} AS stem FROM {{part}}),
followers AS ({FOLLOWERS}),
written AS (
  SELECT f.src, f.rk, CASE WHEN f.rk % 4 IN (1, 2) THEN 'import X from ''' || CASE WHEN s.p_size = 3 THEN '../../' ELSE '../' END || t.stem || ''';'
    WHEN f.rk % 4 = 3 THEN 'import Y from ''./missing' || CAST(f.dst AS STRING) || ''';' ELSE 'import ''lib-' || CAST(f.dst % 7 AS STRING) || '''; // x' END || chr(10) AS line
  FROM followers f JOIN stems s ON s.p_partkey = f.src JOIN stems t ON t.p_partkey = f.dst),
lines AS (SELECT src, listagg(line, '') WITHIN GROUP (ORDER BY rk) AS body FROM written GROUP BY src)
SELECT 'src/' || s.stem || '.ts' AS path, coalesce(l.body, '') || '/* import ''no'' */ export class P' || CAST(s.p_partkey AS STRING) || ' ' || chr(123) || chr(125)
  || chr(10) || 'export interface I' || CAST(s.p_partkey AS STRING) || ' ' || chr(123) || chr(10) || '  id: number;' || chr(10) || '  w' || CAST(s.p_size AS STRING) || '?: string;' || chr(10) || chr(125) AS content
FROM stems s LEFT JOIN lines l ON l.src = s.p_partkey
UNION ALL
SELECT 'src/m' || CAST(m AS STRING) || '/index.ts', 'export const M = ' || CAST(m AS STRING) || ';' FROM (SELECT DISTINCT p_partkey % 20 AS m FROM {{part}}) x WHERE m % 2 = 0"""

#: Memories: one for each document, tagged with language, source and length class.
MEMORIES = """
SELECT CAST(d.doc_id AS STRING) AS id, CASE WHEN l.quality = 1 THEN 'semantic' WHEN l.quality = 0 THEN 'procedural' ELSE 'episodic' END AS type,
  d.text AS content, d.lang AS lang, d.source AS source, 'len' || CAST(least(9, floor(d.n_chars / 1000)) AS INT) AS size_tag,
  least(CAST(1 AS DOUBLE), CAST(d.n_chars AS DOUBLE) / 10000) AS importance, CAST(d.doc_id % 3 AS INT) AS access_count, CAST(d.doc_id % 61 AS INT) AS age_days,
  CASE WHEN d.doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status
FROM {documents} d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM {labels} GROUP BY doc_id) l ON l.doc_id = d.doc_id"""

#: Associations: consecutive turns of a conversation, and what users do after what.
ASSOCIATIONS = """
SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS from_id, 'c' || CAST(conv_id AS STRING) || '-' || CAST(next_turn AS STRING) AS to_id, 'temporal' AS type
FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM {conversations}) t WHERE next_turn IS NOT NULL
UNION ALL
SELECT 'u' || src, 'u' || dst, CASE WHEN length(src) % 3 = 0 THEN 'inferential' WHEN length(src) % 3 = 1 THEN 'causal' ELSE 'consolidation' END
FROM (""" + TRANSITIONS + """) s"""

#: Observation batches: the events of a day; one key for each user and type.
OBSERVATIONS = """
SELECT CAST(date_trunc('day', ts) AS DATE) AS batch, event_type AS namespace, event_type || ':' || CAST(user_id AS STRING) AS dedup_key, max(value) AS content, count(*) AS n
FROM {events} GROUP BY 1, 2, 3"""


def duck(sql: str) -> str:
    """The feed as DuckDB reads it: tables by name."""
    import string

    names = [n for _, n, _, _ in string.Formatter().parse(sql) if n]
    return sql.format(**{n: n for n in names}).replace("AS STRING)", "AS VARCHAR)").replace("listagg(line, '') WITHIN GROUP (ORDER BY rk)", "string_agg(line, '' ORDER BY rk)")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The feed as a DataFrame."""
    import string

    names = {n for _, n, _, _ in string.Formatter().parse(sql) if n}
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(sql, **tables)
