"""The checkpoint folder: the cluster's own, or one for a session (a test) that has none."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> str:
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="gneiss-"))
    return given or sc.getCheckpointDir()
