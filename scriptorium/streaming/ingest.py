"""Continuous ingest: new text files become chunks once, and resume after a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.annotate import LEDGER
from scriptorium.operators.chunking import chunk_documents
from scriptorium.operators.parsing import flatten_results, parse_answers
from scriptorium.storage import exists, stored


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(source_file, text) of text files as they arrive in a folder."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.txt").text(folder)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def chunk_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, size: int = 20_000, overlap: int = 1_000) -> StreamingQuery:
    """Chunk all files that are there or new since the last run, and append them to a Parquet table.

    The checkpoint knows which files are done, so a rerun takes only new ones.
    """
    chunks = chunk_documents(document_stream(spark, folder), size, overlap)
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def result_stream(spark: SparkSession, ledger: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse each answer that the ledger has got since the last run, and append its instances, with their answer's version, to a Parquet table.

    Of a model and chunk an answer is taken if it is newer than what `out` has already: compacted files, which bring old answers
    again, add nothing. A batch writes its folder anew when it is repeated. Beside `out`, `<out>_done` has the versions that were
    taken, chunks without instances included; read_instances shows the latest of each.
    """
    answers = spark.readStream.schema(LEDGER).option("pathGlobFilter", "*.parquet").parquet(ledger)

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = batch.where("error IS NULL").withColumn("version", F.coalesce("version", F.lit(0))).groupBy("model_label", "chunk_id").agg(F.max(F.struct("version", "raw")).alias("l_row"))
        new = new.select("model_label", "chunk_id", "l_row.version", "l_row.raw")
        known = _done(session, out, number).groupBy("model_label", "chunk_id").agg(F.max("version").alias("k_version"))
        fresh = new.join(known, ["model_label", "chunk_id"], "left").where("k_version IS NULL OR version > k_version").drop("k_version")
        fresh = stored(fresh, "fresh")
        flatten_results(parse_answers(fresh)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.select("model_label", "chunk_id", "version").write.mode("overwrite").parquet(f"{out}_done/batch={number}")

    return answers.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _done(spark: SparkSession, out: str, but: int | None = None) -> DataFrame:
    """(model_label, chunk_id, version) of all batches but one."""
    schema = "model_label string, chunk_id string, version long, batch int"
    rows = spark.read.schema(schema).parquet(f"{out}_done") if exists(spark, f"{out}_done") else spark.createDataFrame([], schema)
    return (rows if but is None else rows.where(F.col("batch") != but)).drop("batch")


def read_instances(spark: SparkSession, out: str) -> DataFrame:
    """The instances of the latest answer of each model and chunk that result_stream has taken; those of answers that were replaced are gone."""
    last = _done(spark, out).groupBy("model_label", "chunk_id").agg(F.max("version").alias("version"))
    return spark.read.parquet(out).drop("batch").join(last, ["model_label", "chunk_id", "version"])
