"""Evaluation of a model over stored examples, as a run that takes up where it stopped."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.evaluation import answer_pairs
from scriptorium.storage import exists, stored

#: A loaded model answers prompts, one for each, under a sampling.
Model = Callable[[list[str], "Sampling"], list[str]]
_models: dict[str, Model] = {}


@dataclass(frozen=True)
class Sampling:
    """How a model samples: with thoughts as configured, without them always by the fast settings."""

    # The defaults, and the settings without thoughts.
    thinking: bool = True
    temperature: float = 0.6
    top_p: float = 0.95
    top_k: int = 20
    max_new_tokens: int = 4096

    def used(self) -> Sampling:
        return self if self.thinking else Sampling(False, 0.7, 0.8, 20, self.max_new_tokens)


def latest_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """The folder `checkpoint-<number>` of the greatest number, compared as a number; None where there is none."""
    if not exists(spark, folder):
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if s.isDirectory()]
    numbered = [(int(m.group(1)), f.toString()) for f in found if (m := re.fullmatch(r"checkpoint-(\d+)", f.getName()))]
    return max(numbered)[1] if numbered else None


def generate(examples: DataFrame, prompt: str, name: str, make_model: Callable[[], Model], sampling: Sampling = Sampling(), batch: int = 8) -> DataFrame:
    """examples with a column raw_output: the model's answers to the column `prompt`, null prompts as empty ones.

    The model is loaded once in each worker process, under its name, and answers so many prompts at a time.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema) + ", raw_output string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if name not in _models:
                _models.clear()
                _models[name] = make_model()
            asked = [p or "" for p in f[prompt]]
            yield f.assign(raw_output=[a for i in range(0, len(asked), batch) for a in _models[name](asked[i : i + batch], sampling.used())])

    return examples.mapInPandas(run, schema)


OUTPUTS = "key string, raw_output string, version long"


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(key, raw_output) of the last answer to each example; empty where there is nothing yet."""
    rows = spark.read.schema(OUTPUTS).parquet(path) if exists(spark, path) else spark.createDataFrame([], OUTPUTS)
    return rows.groupBy("key").agg(F.max_by("raw_output", F.struct("version", "raw_output")).alias("raw_output"))


def answer_examples(examples: DataFrame, key: str, prompt: str, path: str, name: str, make_model: Callable[[], Model], jobs: int = 8, force: bool = False, **how: object) -> DataFrame:
    """Answer the examples that `path` lacks, in so many jobs by a hash of the key, and return all outputs (key, raw_output).

    What a job has answered is there when it ends; a run that stops takes up there. Examples of one key are one example. `force` asks again.
    """
    spark = examples.sparkSession
    asked = examples.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt")).where("key IS NOT NULL").dropDuplicates(["key"])
    left = asked if force else asked.join(read_outputs(spark, path), "key", "left_anti")
    todo = stored(left.withColumn("job", F.pmod(F.xxhash64("key"), F.lit(jobs))), "examples")
    version = time.time_ns()
    for k in sorted(r.job for r in todo.select("job").distinct().collect()):
        got = generate(todo.where(F.col("job") == k).drop("job"), "prompt", name, make_model, **how)
        got.select("key", "raw_output", F.lit(version).cast("long").alias("version")).write.mode("append").parquet(path)
    return read_outputs(spark, path)


def stored_pairs(records: DataFrame, key: str, path: str) -> DataFrame:
    """answer_pairs of the raw records (key, passage, is_soc, assistant_json) that have an output at `path`."""
    outputs = read_outputs(records.sparkSession, path).withColumnRenamed("key", "o_key")
    return answer_pairs(records.drop("raw_output").join(outputs, F.col(key).cast("string") == F.col("o_key")))
