"""Reasoning traces: candidates from a model, kept in a cache, the best one put into each record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.scoring import candidate_score
from scriptorium.functions.text import file_stem

#: make_model() runs once in each task; the model takes a prompt and a number and returns so many candidates.
Model = Callable[[str, int], list[str]]
CANDIDATES = "passage_id string, idx int, trace string"


def passage_id(split: str, chunk_id: Column, passage: Column) -> Column:
    """A record's stable name: split, chunk (slashes as underscores, `unk` for null), and the first ten hex digits of the passage's MD5."""
    digest = F.left(F.md5(F.encode(F.coalesce(passage, F.lit("")), "UTF-8")), F.lit(10))
    return F.concat(F.lit(f"{split}_"), F.replace(F.coalesce(chunk_id, F.lit("unk")), F.lit("/"), F.lit("_")), F.lit("_"), digest)


def answer_label(is_soc: Column, soc_type: Column) -> Column:
    """What a prompt tells of the right answer."""
    return F.when(is_soc, F.concat(F.lit("is_soc: true, soc_type: "), F.coalesce(soc_type, F.lit("unknown")))).otherwise("is_soc: false")


def negatives_first(records: DataFrame, limit: int = 0) -> DataFrame:
    """Negatives before positives, each in the order of row_id; the first `limit` of them, all if it is 0."""
    out = records.orderBy("is_soc", "row_id")
    return out.limit(limit) if limit else out


def candidates(records: DataFrame, make_model: Callable[[], Model], prompt: Column, n: int = 4, cache: DataFrame | None = None) -> DataFrame:
    """(passage_id, idx, trace): `n` candidates for each passage_id of records, asked once and only where `cache` has none.

    Cached candidates come along. Candidates are trimmed; blank ones stay in the table and are never chosen.
    """
    asked = records.select("passage_id", prompt.alias("prompt")).dropDuplicates(["passage_id"])
    known = None if cache is None else cache.join(asked.select("passage_id"), "passage_id", "left_semi").select("passage_id", "idx", "trace")
    if known is not None:
        asked = asked.join(known.select("passage_id").distinct(), "passage_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for f in frames:
            model = model or (make_model() if len(f) else None)
            rows = [(p, i, t.strip()) for p, q in zip(f["passage_id"], f["prompt"], strict=True) for i, t in enumerate(model(q, n))]
            yield pd.DataFrame(rows, columns=["passage_id", "idx", "trace"])

    new = asked.mapInPandas(run, CANDIDATES)
    return new if known is None else new.unionByName(known)


def with_best(records: DataFrame, found: DataFrame) -> DataFrame:
    """records (passage_id, passage, is_soc, think_content, ...) with the best candidate as think_content, and its trace_score.

    The highest score wins, the first candidate on ties. Without a candidate that is not blank the old trace stays and the score is null.
    """
    real = found.where(F.trim("trace") != "").select(F.col("passage_id").alias("t_id"), F.col("idx").alias("t_idx"), F.col("trace").alias("t_trace"))
    scored = records.select("passage_id", "passage", "is_soc").dropDuplicates(["passage_id"]).join(real, F.col("passage_id") == F.col("t_id"))
    scored = scored.select("t_id", "t_idx", "t_trace", candidate_score(F.col("t_trace"), F.col("passage"), F.col("is_soc")).alias("t_score"))
    best = scored.groupBy("t_id").agg(F.max_by(F.struct("t_trace", "t_score"), F.struct("t_score", -F.col("t_idx"))).alias("t_best"))
    out = records.drop("trace_score").join(best, F.col("passage_id") == F.col("t_id"), "left")
    return out.withColumn("think_content", F.coalesce("t_best.t_trace", "think_content")).withColumn("trace_score", F.col("t_best.t_score")).drop("t_id", "t_best")


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates (passage_id, idx, trace) from the files of a cache folder: <passage_id>.jsonl, a line with a trace each; idx is the line's place, blank lines aside.

    A line without a trace is an empty candidate, and a line that is no JSON an error of the job.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.jsonl").select(file_stem(F.col("_metadata.file_path")).alias("passage_id"), F.filter(F.split("value", "\\r?\\n"), lambda x: F.trim(x) != "").alias("lines"))
    each = files.select("passage_id", F.posexplode("lines").alias("idx", "line"))
    got = F.from_json("line", "trace string", {"mode": "FAILFAST"})
    return each.select("passage_id", "idx", F.coalesce(got["trace"], F.lit("")).alias("trace"))


def to_rebuilt(records: DataFrame, system: str) -> DataFrame:
    """Records as chats with their traces: (messages, _passage_id, _is_soc, _trace_score)."""
    think = F.when(F.coalesce("think_content", F.lit("")) != "", F.concat(F.lit("<think>\n"), "think_content", F.lit("\n</think>\n"))).otherwise("")
    answer = F.concat(think, F.coalesce("assistant_json", F.lit('{"instances": []}')))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(message("system", F.lit(system)), message("user", F.coalesce("passage", F.lit(""))), message("assistant", answer))
    return records.select(messages.alias("messages"), F.col("passage_id").alias("_passage_id"), F.coalesce("is_soc", F.lit(False)).alias("_is_soc"), F.col("trace_score").alias("_trace_score"))
