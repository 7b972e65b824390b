"""Annotators as a seam: any client is called over the pending chunks, once for each chunk and model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import think_block, user_prompt
from scriptorium.operators.limits import Outcome, SharedRate, called
from scriptorium.operators.parsing import instances, parse_judgements, required_instances
from scriptorium.storage import exists, remove, stored

#: make_client() runs once in each task; the client takes (model_label, prompt) and returns the raw answer.
Client = Callable[[str, str], str]


def work_list(chunks: DataFrame, models: list[str]) -> DataFrame:
    """Every chunk with every model; the models are a short given list."""
    return chunks.withColumn("model_label", F.explode(F.array(*map(F.lit, models))))


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work that the ledger of done (model_label, chunk_id) does not have; chunks without instances count as done."""
    return work.join(done.select("model_label", "chunk_id").distinct(), ["model_label", "chunk_id"], "left_anti")


def annotate(work: DataFrame, make_client: Callable[[], Client], attempts: int = 3, pause: float = 5.0, threads: int = 1, per_second: int = 0, rate_folder: str | None = None) -> DataFrame:
    """work with columns raw, error, error_kind and attempts: the client's answers; after a failed call raw is empty, error says why, error_kind is rate, service or other.

    A client raises RateLimited or ServiceError where another attempt may help (see limits.called); any other error ends a call
    at once. With per_second, all tasks together make so many calls a second at most, by leases in rate_folder (a
    folder that all machines mount), and a pause that one is told holds for all.
    """
    asked = work.withColumn("prompt", user_prompt(*map(F.col, ("source_file", "chunk_id", "chunk_label", "chunk_index", "chunk_text", "context_before", "context_after"))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema) + ", raw string, error string, error_kind string, attempts int"
    if per_second and not rate_folder:
        raise ValueError("a shared rate needs a shared folder")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        rate = SharedRate(rate_folder, per_second) if per_second else None
        limits = {"before": rate.lease, "limited": rate.pause} if rate else {}

        def call(model: str, prompt: str) -> Outcome:
            return called(lambda: client(model, prompt), attempts, pause, **limits)

        with ThreadPoolExecutor(threads) as pool:
            for f in frames:
                got = list(pool.map(call, f["model_label"], f["prompt"]))
                f["raw"], f["error"], f["error_kind"], f["attempts"] = ([getattr(x, c) for x in got] for c in ("raw", "error", "kind", "attempts"))
                yield f.drop(columns="prompt")

    return asked.mapInPandas(run, schema)


def analyse_passage(spark: SparkSession, passage: str, make_client: Callable[[], Client], model: str = "model", **how: float) -> DataFrame:
    """One row for one passage: think_trace, instances, raw_output and error. An instance without its required fields is an error of the job."""
    columns = "model_label string, source_file string, chunk_id string, chunk_label string, chunk_text string, chunk_index int, context_before string, context_after string"
    work = spark.createDataFrame([(model, "passage", "passage_000", "", passage, 0, "", "")], columns)
    return annotate(work, make_client, **how).select(think_block(F.col("raw")).alias("think_trace"), instances(F.col("raw"), required_instances).alias("instances"), F.col("raw").alias("raw_output"), "error")


LEDGER = "model_label string, chunk_id string, raw string, error string, error_kind string, attempts int, version long"


def _ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)
    return rows.withColumn("version", F.coalesce("version", F.lit(0)))


def _latest(rows: DataFrame) -> DataFrame:
    """Of the rows of each model and chunk the one of the highest version (ties: the greatest)."""
    rest = [c for c in rows.columns if c not in ("model_label", "chunk_id")]
    best = F.max(F.struct("version", *[c for c in rest if c != "version"])).alias("l_row")
    return rows.groupBy("model_label", "chunk_id").agg(best).select("model_label", "chunk_id", *(F.col(f"l_row.{c}").alias(c) for c in rest))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The latest answer of each model and chunk that run_pending has got: (model_label, chunk_id, raw, version); empty where there is nothing yet.

    Answers are appended under versions and merged when they are read; failed calls are no answers.
    """
    return _latest(_ledger_rows(spark, path).where("error IS NULL")).select("model_label", "chunk_id", "raw", "version")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """The last failed call of each model and chunk without a later answer: (model_label, chunk_id, error, error_kind, attempts, version)."""
    last = _latest(_ledger_rows(spark, path))
    return last.where("error IS NOT NULL").select("model_label", "chunk_id", "error", "error_kind", "attempts", "version")


def set_aside_corrupt(spark: SparkSession, path: str) -> list[str]:
    """Move the ledger's files that cannot be read to its folder _corrupt, so that their work is pending again, and return their names.

    One job reads what can be read; only files that gave nothing are then tried one by one.
    """
    if not exists(spark, path):
        return []
    files = set(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).inputFiles())
    readable = spark.read.option("ignoreCorruptFiles", True).schema(LEDGER).parquet(path).select(F.col("_metadata.file_name").alias("name")).distinct()
    names = {r.name for r in readable.collect()}
    Path, conf, out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in sorted(f for f in files if f.rsplit("/", 1)[-1] not in names):
        try:
            spark.read.schema(LEDGER).parquet(f).agg(F.max("raw")).collect()
        except Exception:  # noqa: BLE001  whatever keeps it from being read
            src, folder = Path(f), Path(f"{path}/_corrupt")
            fs = src.getFileSystem(conf)
            fs.mkdirs(folder)
            fs.rename(src, Path(folder, src.getName()))
            out.append(src.getName())
    return out


def compact_ledger(spark: SparkSession, path: str, files: int = 1) -> None:
    """Rewrite the ledger as its latest rows, in so many files.

    The new rows are committed beside the old ones, whose files go then: a run that stops between leaves rows twice, which
    readers merge. Answers that are appended meanwhile stay, as only files that were there before are removed.
    """
    old = spark.read.schema(LEDGER).parquet(path).inputFiles()
    rows = spark.read.schema(LEDGER).parquet(*old).withColumn("version", F.coalesce("version", F.lit(0)))
    answers, failed = _latest(rows.where("error IS NULL")), _latest(rows).where("error IS NOT NULL")
    answers.unionByName(failed).repartition(files).write.mode("append").parquet(path)
    for f in old:
        remove(spark, f)


def run_pending(work: DataFrame, path: str, make_client: Callable[[], Client], batches: int = 16, force: bool = False, **how: float) -> DataFrame:
    """Answer what the ledger at `path` lacks, and return the ledger.

    The pending work is written once, with its batch, and done in so many jobs by a hash of chunk and model. Each job's outcomes are
    appended when it ends, so a run that stops loses one batch at most, and the next run takes up there. Failed calls are
    dead letters and stay pending; a chunk without instances is done. `force` asks everything again, and the new
    answers replace the old ones. Corrupt files of the ledger are set aside first.
    """
    spark = work.sparkSession
    set_aside_corrupt(spark, path)
    seen = _ledger_rows(spark, path)
    version = max(time.time_ns(), (seen.agg(F.max("version")).first()[0] or 0) + 1)
    left = work if force else pending(work, read_ledger(spark, path))
    share = F.pmod(F.xxhash64("model_label", "chunk_id"), F.lit(batches)).cast("int")
    todo = stored(left.withColumn("l_batch", share), "pending")
    # a batch without work gets no job and no file
    for k in sorted(r.l_batch for r in todo.select("l_batch").distinct().collect()):
        answers = annotate(todo.where(F.col("l_batch") == k).drop("l_batch"), make_client, **how).withColumn("version", F.lit(version).cast("long"))
        answers.select("model_label", "chunk_id", "raw", "error", "error_kind", "attempts", "version").write.mode("append").parquet(path)
    return read_ledger(spark, path)


def judge(traces: DataFrame, prompt: Column, make_client: Callable[[], Client], model: str, threads: int = 8) -> DataFrame:
    """traces with the judge's scores: calls run side by side in each task, and a failed one scores as a neutral answer."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.schema) + ", raw string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def call(text: str) -> str:
            try:
                return client(model, text)
            except Exception:  # noqa: BLE001  the score is neutral then
                return ""

        with ThreadPoolExecutor(threads) as pool:
            for f in frames:
                f["raw"] = list(pool.map(call, f["j_prompt"]))
                yield f.drop(columns="j_prompt")

    return parse_judgements(traces.withColumn("j_prompt", prompt).mapInPandas(run, schema)).drop("raw")
