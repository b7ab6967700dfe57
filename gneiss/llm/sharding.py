"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by a fixed-width hexadecimal key: the hash of the text, then a hash of the row's
id. Equal texts are neighbours, and a group of copies is divided only where keeping it whole would
break the tolerance. Each round counts, over all partitions, the exact rows and bytes below finer
candidate boundaries (longer key prefixes), but only inside the prefixes that still hold a
splitter or too many rows, until every splitter is as near its target as the tolerance or the
rows themselves allow. The leaves are bounded in number by the parameters, not by the rows.

Law ``bytes``: every shard gets as near total / shards bytes as whole rows and the tolerance allow.
Defined results: a null text has no bytes (size 1, crc 0); null and repeated ids are rows like any
other; an empty table gives an empty result; shards may stay empty where rows are fewer.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.storage import materialize

#: Hexadecimal digits that one round adds; the first round makes 16 ** FIRST bins at most.
FIRST, STEP = 3, 2
KEY_DIGITS = 32


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _histogram(keys: DataFrame, active: list[str] | None, digits: int) -> list[tuple[str, int, int]]:
    rows = keys
    if active is not None:
        marks = keys.sparkSession.createDataFrame([(a,) for a in active], "active string")
        rows = keys.join(F.broadcast(marks), F.substring("key", 1, len(active[0])) == F.col("active"), "left_semi")
    bins = rows.groupBy(F.substring("key", 1, digits).alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return [(r["bin"], r["bytes"], r["n"]) for r in bins.collect()]


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.01, bins: int = 1024) -> tuple[list[str], list[int], list[int]]:
    """Leaf boundaries (ascending key prefixes), rows of each leaf, and shard of each leaf.

    ``keys`` has ``key`` and ``size``. A leaf with a splitter inside is split until that splitter is
    within tolerance * total / shards of its target or the leaf is one key; leaves of more than
    rows / bins rows are split as well, so that no task numbers more than a bounded share.
    """
    leaves = {b: (size, n) for b, size, n in _histogram(keys, None, FIRST)}
    if not leaves:
        return [], [], []
    total, rows = sum(v[0] for v in leaves.values()), sum(v[1] for v in leaves.values())
    targets = [total * i / shards for i in range(1, shards)]
    slack, most, digits = tolerance * total / shards, max(1000, rows // bins), FIRST
    while digits < KEY_DIGITS:
        below, split = 0, []
        for b in sorted(leaves):
            size, n = leaves[b]
            if len(b) == digits and n > 1:
                inside = any(below + slack < t < below + size - slack for t in targets)
                if inside or n > most:
                    split.append(b)
            below += size
        if not split:
            break
        digits = min(KEY_DIGITS, digits + STEP)
        for b in split:
            del leaves[b]
        leaves |= {b: (size, n) for b, size, n in _histogram(keys, split, digits)}
    order = sorted(leaves)
    starts = np.cumsum([0, *(leaves[b][0] for b in order)])
    cuts = [int(np.argmin(np.abs(starts - t))) for t in targets]
    shard = [bisect_right(cuts, i) for i in range(len(order))]
    return order, [leaves[b][1] for b in order], shard


def shard(
    docs: DataFrame, shards: int = 16, tolerance: float = 0.01, key: str = "doc_id", text: str = "text", bins: int = 1024,
) -> DataFrame:
    """A row for each document: its id, size, text_crc32, law, shard, slot and grown_shard."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.concat(_hex(F.xxhash64(body)), _hex(F.xxhash64(F.col(key), F.lit(1)))).alias("key"),
    )
    keyed = materialize(keyed, "shard-keys")
    order, counts, of = find_splitters(keyed, shards, tolerance, bins)
    offsets, seen = [], {}
    for n, s in zip(counts, of, strict=True):
        offsets.append(seen.get(s, 0))
        seen[s] = offsets[-1] + n
    bounds = np.array(order, dtype=f"S{KEY_DIGITS}")

    @F.pandas_udf("int")
    def leaf(k: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, k.to_numpy().astype(f"S{KEY_DIGITS}"), side="right") - 1
        return pd.Series(at.astype(np.int32))

    spark = docs.sparkSession
    places = spark.createDataFrame(
        [(i, s, o) for i, (s, o) in enumerate(zip(of, offsets, strict=True))], "leaf int, shard int, offset long"
    )
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy("key", "doc_id", "text_crc32", "size"))
    placed = keyed.withColumn("leaf", leaf("key")).withColumn("rank", rank).join(F.broadcast(places), "leaf")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", text: str = "text", **options) -> None:
    """Write the documents in shard order: one folder for each shard, its files in ranges of slots, rows with their slot.

    Every row is written once. Rows equal in id, size and checksum take the slots of their group in
    any order; a table that has columns ``shard`` or ``slot`` itself gets ``shard_`` and ``slot_``.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = {"id": F.col(key), "size": (F.octet_length(body) + 1).cast("long"), "crc": F.crc32(F.encode(body, "UTF-8"))}
    names = [f"_gneiss_{n}" for n in own]
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1)))
    placed = shard(docs, shards, key=key, text=text, **options)
    placed = placed.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "size", "text_crc32"), names, strict=True)], F.col("shard").alias("_gneiss_shard"), F.col("slot").alias("_gneiss_slot"))
    left = docs.withColumns(dict(zip(names, own.values(), strict=True))).withColumn("_gneiss_nth", nth)
    right = placed.withColumn("_gneiss_nth", nth).withColumnsRenamed({n: f"{n}2" for n in [*names, "_gneiss_nth"]})
    same = F.lit(True)
    for n in [*names, "_gneiss_nth"]:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}2"))
    shard_, slot_ = _free("shard", docs.columns), _free("slot", docs.columns)
    out = left.join(right, same).select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_gneiss_shard").alias(shard_), F.col("_gneiss_slot").alias(slot_))
    out.repartitionByRange(shard_, slot_).sortWithinPartitions(shard_, slot_).write.partitionBy(shard_).parquet(path)
