"""Tables that cut lineage: written once to the folder that the cluster shares, and read again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; in local mode (tests) a temporary folder where neither is set."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows; nothing happens where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, which goes when the process ends."""
    path = f"{shared_folder(spark)}/scriptorium-{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean_up)
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, which goes when the process ends; lost executors cost nothing that was done before."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean_up() -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before the interpreter
        while _made:
            remove(*_made.pop())
