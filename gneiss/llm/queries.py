"""The queries of this subpackage, one for each operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import bpe, decontam, jaccard, linededup, paradedup, quality, sharding, suffix, tokenbin, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"), min_words=1, every=True)


def op3_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradedup.passages(table(spark, sf_dir, "documents"))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bpe_roundtrip, op2_fuzzy_line_dedup, op3_line_field_quality, op4_winnowing_decontamination, op5_ngram_jaccard,
        op6_suffix_array_dedup, op7_paragraph_minhash, op8_histogram_shards, op9_token_blocks, op10_counterfactual_toxicity,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_BLANKS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

OP4_SQL = f"""WITH w AS (SELECT doc_id, {_LETTERS} AS words FROM documents), i AS (SELECT item_id, {_LETTERS} AS words FROM benchmark),
m AS (SELECT item_id, words, least(13, len(words)) AS m FROM i WHERE len(words) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(words, s, s + m - 1), ' ') AS win FROM m, unnest(range(1, len(words) - m + 2)) AS u(s)),
dw AS (SELECT doc_id, s, m, array_to_string(list_slice(words, s, s + m - 1), ' ') AS win FROM (SELECT * FROM w, (SELECT DISTINCT m FROM iw)), unnest(range(1, len(words) - m + 2)) AS u(s)),
hits AS (SELECT DISTINCT doc_id, s, m, item_id FROM dw JOIN iw USING (win, m)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + m)) AS u(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP5_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_BLANKS} AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, s, s + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS u(s) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT k.doc_id, s.y FROM walk k JOIN sym s ON s.x = k.r)
SELECT k.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(k.r) AS component_id FROM walk k LEFT JOIN n ON n.doc_id = k.doc_id GROUP BY k.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_winnowing_decontamination": OP4_SQL, "op5_ngram_jaccard": OP5_SQL}
