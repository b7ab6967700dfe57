import corpus_pipeline

import __spark_entry__ as entry
from gneiss.llm import jaccard, quality
from tests.llm.test_dedup import expected_lines, jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, SF).persist()
    assert good.columns == docs.columns
    field = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.assess(docs, field).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    gone = expected_lines(texts)
    lined = stage["line_dedup"](spark, good, SF).persist()
    left = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert left == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in texts.items()}
    single = stage["ngram_jaccard_join"](spark, lined, SF)
    roots = jaccard_components(left)
    assert {r["doc_id"] for r in single.collect()} == {k for k, (n, c) in roots.items() if not n or c == k}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert "pipeline" in entry.queries() and jaccard.WIDTH == 5
