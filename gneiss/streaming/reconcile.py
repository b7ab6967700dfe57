"""Structured Streaming faces of the lifecycle: an extension, as the batch operators define the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.operators.lifecycle import reconcile
from gneiss.sources.store import SnapshotStore

STATE = "dedup_key string, namespace string, content double, status string, observations long, revisions long"


def reconciling_sink(store: SnapshotStore) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges each micro-batch (namespace, dedup_key, content, order) into the store.

    In a batch the last content of a key counts.
    """

    def merge(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("dedup_key", "namespace").agg(F.max_by("content", "order").alias("content"))
        state = store.read()
        store.commit(reconcile(state if state is not None else batch.sparkSession.createDataFrame([], STATE), last))

    return merge


def start(observations: DataFrame, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    return observations.writeStream.foreachBatch(reconciling_sink(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of ``ts``; rows later than ``late`` no longer count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
