"""Writers: CSV and JSON by model or track, JSON lines by split, chunk markup."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import safe_name
from scriptorium.operators.chunking import Offsets, refined_chunks, to_markup, word_offsets
from scriptorium.operators.evaluation import confusion, detection, report, typing
from scriptorium.sources.arrays import write_arrays


def _csv(df: DataFrame, path: str, quote_all: bool, by: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_results(rows: DataFrame, path: str, formats: tuple[str, ...] = ("csv", "json")) -> dict[str, str]:
    """Result rows in folders by model, as CSV and as one JSON array each; returns the folders by format."""
    named = rows.withColumn("model", safe_name(F.col("model_label")))
    out = {f: f"{path}/{f}" for f in formats}
    if "csv" in out:
        _csv(named, out["csv"], False, ["model"])
    if "json" in out:
        write_arrays(named, out["json"], "model", [c for c in ("row_id", "source_file", "chunk_index") if c in rows.columns])
    return out


def write_consensus(rows: DataFrame, path: str, track: str, formats: tuple[str, ...] = ("csv", "json")) -> dict[str, str]:
    """A track's consensus as CSV with all values quoted, and a JSON array; an empty one gives a header and an empty array."""
    out = {f: f"{path}/consensus_{track}.{f}" for f in formats}
    empty = rows.isEmpty()
    spark = rows.sparkSession
    if "csv" in out:
        if empty:
            spark.createDataFrame([(",".join(f'"{c}"' for c in rows.columns),)], "value string").coalesce(1).write.mode("overwrite").text(out["csv"])
        else:
            _csv(rows, out["csv"], True, [])
    if "json" in out:
        if empty:
            spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(out["json"])
        else:
            order = [c for c in ("source_file", "chunk_index", "chunk_id", "group_id", "row_id") if c in rows.columns]
            write_arrays(rows.withColumn("track", F.lit(track)), out["json"], "track", order)
    return out


def write_splits(chats: DataFrame, path: str) -> None:
    """Records (split, messages, and their raw fields) as JSON lines in folders by split: chats for train, val and test, raw records for test_raw."""
    chats.select("split", "messages").write.mode("overwrite").partitionBy("split").json(path)
    raw = chats.where("split = 'test'").drop("messages", "split").withColumn("split", F.lit("test_raw"))
    raw.write.mode("append").partitionBy("split").json(path)


def write_candidates(candidates: DataFrame, rebuilt: DataFrame, path: str, split: str) -> dict[str, str]:
    """A split's trace candidates and its rebuilt chats as JSON lines; returns the folders."""
    out = {"traces": f"{path}/{split}", "rebuilt": f"{path}/{split}_traces"}
    candidates.write.mode("overwrite").json(out["traces"])
    rebuilt.write.mode("overwrite").json(out["rebuilt"])
    return out


def write_evaluation(pairs: DataFrame, path: str) -> str:
    """The evaluation of answer_pairs: examples as JSON lines under `path`, and one JSON document of the metrics, which is returned, too.

    The document has n_examples, and for detection and type classification the report by label and the confusion matrix.
    """

    def metrics(labels: DataFrame) -> dict:
        table = {r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in report(labels).collect()}
        counts = {(r["y_true"], r["y_pred"]): r["n"] for r in confusion(labels).collect()}
        names = sorted({a for a, _ in counts})
        return {"report": table, "confusion_matrix": {"labels": names, "matrix": [[counts[a, b] for b in names] for a in names]}} if names else {}

    document = json.dumps({"n_examples": pairs.count(), "binary_detection": metrics(detection(pairs)), "type_classification": metrics(typing(pairs))}, indent=2, ensure_ascii=False)
    pairs.write.mode("overwrite").json(f"{path}/per_example")
    pairs.sparkSession.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metrics")
    return document


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Each file's chunks in their markup form, in a folder by file."""
    to_markup(chunks).withColumn("file", safe_name(F.col("source_file"))).select("text", "file").write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)


def write_chunk_arrays(chunks: DataFrame, path: str) -> None:
    """Each file's chunks as one JSON array in order, in a folder by file."""
    write_arrays(chunks.withColumn("file", safe_name(F.col("source_file"))), path, "file", ["chunk_index"])


def write_refined(docs: DataFrame, path: str, size: int = 20_000, overlap: int = 1_000, make_offsets: Callable[[], Offsets] = word_offsets) -> None:
    """From texts (source_file, text) to JSON arrays of chunks with contexts in tokens, a folder for each file."""
    write_chunk_arrays(refined_chunks(docs, size, overlap, make_offsets), path)


def csv_text(rows: DataFrame, columns: list[str], most: int = 100_000) -> str:
    """A view of the dashboard as CSV text for a download; a view of more than `most` rows is an error and belongs in a file."""
    shown = rows.select(*[c for c in columns if c in rows.columns])
    got = shown.select(F.to_csv(F.struct(*shown.columns), {"escape": '"'}).alias("line")).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return "\n".join([",".join(shown.columns), *(r["line"] for r in got)]) + "\n"


def pipe_lists(rows: DataFrame) -> DataFrame:
    """Lists as strings joined by bars, for flat output."""
    return rows.select(*(F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes))
