import pytest

SF = "/root/testdata/sf0.001"
FOX = "The quick brown fox jumps over the lazy dog near the old river bank while many people watch it run and then go home again"
#: Texts that operators must take without a crash: null, empty, blank, tiny, periodic, odd characters, copies, near copies.
EDGES = [
    None, "", "   \n\t ", "one", "a b c", "Is on. " * 200, "é" * 300, "x" * 199, "x" * 200, "\n\n\n", "İΣς 漢字  <|endoftext|> it's", FOX, FOX, FOX + " tonight",
    " ".join(f"w{i}" for i in range(5000)), FOX + "\n" + FOX, None, "###$$$ " * 60,
]


@pytest.fixture(scope="session")
def docs(spark):
    """The documents of the smallest scale, then the edge cases: null ids, repeated ids and rows, a clashing column."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = spark.createDataFrame([(90_000 + i, t, None, None, None) for i, t in enumerate(EDGES)], schema)
    out = base.unionByName(more).repartition(3)
    return out.persist()


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, and columns whose names operators use themselves."""
    rows = [(None, FOX, 1, "k"), (None, None, 2, "k"), (7, FOX, 3, None), (7, FOX, 3, None), (7, FOX + " now", 4, "z"), (3, "", 5, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, node long, key string")


@pytest.fixture(scope="session")
def empty(docs, spark):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
