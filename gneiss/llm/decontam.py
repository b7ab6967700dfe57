"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are digits, letters and everything outside ASCII, with A-Z in lower case. A text's
fingerprints are the least hashes of its k-grams of words in every sliding window of
``WINDOW - K + 1`` k-grams, so two texts that share WINDOW consecutive words share a fingerprint.
Texts with a fingerprint of the benchmark are candidates; their k-grams are joined with those of the
items, and hits that follow each other on one diagonal are extended to spans. WINDOW - K + 1
consecutive hits are WINDOW equal words.

An item of fewer than WINDOW words is one window; such items, if any, are compared with every
sequence of their own length. Equal texts are looked at once.

Broadcasts only happen for tables that a count has shown to be small; beyond it the same joins
shuffle. Defined results: a null text has no words and is not contaminated; an item without words
has no window; repeated items count under each of their ids, and once for rows of the same id and
words; different texts of one id are compared each for itself; repeated rows are judged one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.storage import materialize

WINDOW = 13
K = 5
#: Rows up to which a table is sent to all tasks (some tens of MB).
BROADCAST_ROWS = 500_000
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FROM = "".join(map(chr, [*range(65, 91), *_SEPARATORS]))
_TO = "".join(map(chr, range(97, 123))) + " " * len(_SEPARATORS)


def word_array(text: Column) -> Column:
    """The words of a text; null has none."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), _FROM, _TO)
    return F.array_remove(F.split(spaced, " "), "")


def _grams(hashes: Column, n: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` word hashes."""
    heads = F.slice(hashes, F.lit(1), F.greatest(n - (width - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, width)]))


def _winnowed(grams: Column, span: int) -> Column:
    """The distinct least values of all windows of ``span`` values, or of fewer if there are fewer."""
    count = F.greatest(F.size(grams) - (span - 1), F.least(F.size(grams), F.lit(1)))
    heads = F.slice(grams, F.lit(1), count)
    return F.array_distinct(F.transform(heads, lambda x, i: F.array_min(F.slice(grams, i + 1, F.lit(span)))))


def _hashed(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``hashes`` (of words) and ``n_words``; columns between steps keep each from being evaluated twice."""
    out = rows.withColumn("_words", word_array(F.col(text)))
    out = out.withColumn("hashes", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    return out.withColumn("n_words", F.size("hashes"))


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_keys(text: Column) -> list[Column]:
    body = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(body, F.lit(7)).alias("k2")]


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): each row's columns but the text with k1, k2, n_words; and spans of hit words by k1, k2, item."""
    span = window - k + 1
    bench = materialize(_hashed(items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("_t")), "_t").drop("_t").where("n_words > 0").dropDuplicates(["item", "hashes"]), "benchmark")
    long_items = bench.where(F.col("n_words") >= window).withColumn("grams", _grams(F.col("hashes"), F.col("n_words"), k))
    prints = _small(materialize(long_items.select(F.explode(_winnowed(F.col("grams"), span)).alias("print")).distinct(), "benchmark-prints"))
    places = _small(materialize(long_items.select("item", F.xxhash64("hashes").alias("version"), F.posexplode("grams").alias("at", "gram")), "benchmark-grams"))

    others = [F.col(c) for c in docs.columns if c != text]
    body = docs.select(*others, *text_keys(F.col(text)), F.col(text).alias("_t"))
    hashed = _hashed(body, "_t").drop("_t")
    hashed = hashed.withColumn("grams", _grams(F.col("hashes"), F.col("n_words"), k))
    printed = materialize(hashed.withColumn("prints", _winnowed(F.col("grams"), span)).drop("grams", "hashes"), "document-prints")
    rows = printed.drop("prints")
    candidates = printed.where(F.col("n_words") >= window).select("k1", "k2", F.explode("prints").alias("print")).join(prints, "print", "left_semi").select("k1", "k2").distinct()
    candidates = _small(materialize(candidates, "candidates"))

    texts = docs.select(*text_keys(F.col(text)), F.col(text).alias("_t"))
    chosen = texts.join(candidates, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    grams = _hashed(chosen, "_t").drop("_t").withColumn("grams", _grams(F.col("hashes"), F.col("n_words"), k))
    met = grams.select("k1", "k2", F.posexplode("grams").alias("pos", "gram")).join(places, "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
    line = Window.partitionBy("k1", "k2", "item", "version", "diagonal").orderBy("pos")
    runs = met.withColumn("run", F.col("pos") - F.row_number().over(line))
    islands = runs.groupBy("k1", "k2", "item", "version", "diagonal", "run").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("stop"), F.count(F.lit(1)).alias("n"))
    spans = [islands.where(F.col("n") >= span).select("k1", "k2", "item", "start", "stop")]

    lengths = [r["n_words"] for r in bench.where(F.col("n_words") < window).select("n_words").distinct().collect()]
    if lengths:
        short = _hashed(texts.dropDuplicates(["k1", "k2"]), "_t").drop("_t")
        for m in sorted(lengths):
            own = _small(bench.where(F.col("n_words") == m).select("item", F.xxhash64(*[F.get("hashes", F.lit(j)) for j in range(m)]).alias("gram")))
            runs = short.select("k1", "k2", F.posexplode(_grams(F.col("hashes"), F.col("n_words"), m)).alias("start", "gram"))
            spans.append(runs.join(own, "gram").select("k1", "k2", "item", "start", (F.col("start") + m).alias("stop")))
    return rows, reduce(DataFrame.unionByName, spans)


def summarize(hits: DataFrame) -> DataFrame:
    """Per text key: n_hit (words inside any span), n_items and items_sha256."""
    ahead = Window.partitionBy("k1", "k2").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    merged = hits.select("k1", "k2", "start", "stop").distinct().withColumn("reach", F.coalesce(F.max("stop").over(ahead), F.lit(0)))
    fresh = F.greatest(F.col("stop") - F.greatest("start", "reach"), F.lit(0))
    words = merged.groupBy("k1", "k2").agg(F.sum(fresh).cast("long").alias("n_hit"))
    ids = hits.select("k1", "k2", "item").where("item is not null").distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    named = ids.select("k1", "k2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return words.join(named, ["k1", "k2"], "left")


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, hits = find_hits(docs.select(F.col(key).alias("doc_id"), "text"), items, **options)
    out = rows.join(summarize(hits), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated."""
    rows, hits = find_hits(docs.select(text), items, text=text, **options)
    lengths = rows.select("k1", "k2", "n_words").distinct()
    bad = summarize(hits).join(lengths, ["k1", "k2"]).where(_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    bad = _small(materialize(bad, "contaminated"))
    k1, k2 = (c for c in text_keys(F.col(text)))
    return docs.withColumns({"_h1": k1, "_h2": k2}).join(bad, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
