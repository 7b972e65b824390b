"""Corpus annotation analytics on Spark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where it lies, and bound their batches.

    On a cluster the package comes with --py-files, and the path is only one more that is searched.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if os.path.isdir(root) and root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # texts may be long: fewer rows in an Arrow batch bound what the JVM and a worker hold at once
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark
