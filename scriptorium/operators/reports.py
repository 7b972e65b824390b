"""Counts and tables of the dashboard and of the export summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import type_label
from scriptorium.operators.ordering import order_buckets
from scriptorium.schemas import INSTANCE

LEVELS = ("high", "medium", "low")


def per_model(rows: DataFrame) -> DataFrame:
    return rows.where("model_label IS NOT NULL").groupBy("model_label").agg(F.count("*").alias("n"))


def pivot_counts(rows: DataFrame, row: str, models: list[str]) -> DataFrame:
    """Rows of `row` against models, filled with 0; the list of models is given, so that no job looks for it."""
    return rows.where(F.col(row).isNotNull()).groupBy(row).pivot("model_label", models).agg(F.count(F.lit(1))).na.fill(0, models)


def confidence_by_model(rows: DataFrame, models: list[str]) -> DataFrame:
    """Counts of the three levels by model; missing levels are 0, other values are left out."""
    levels = rows.sparkSession.createDataFrame([(x,) for x in LEVELS], "confidence string")
    return levels.join(pivot_counts(rows, "confidence", models), "confidence", "left").na.fill(0, models)


def key_figures(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("model_label").alias("n_models"), F.count_distinct("source_file").alias("n_files"), F.count_distinct("chunk_id").alias("n_chunks"))


def group_figures(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n_models") > 1).alias("n_multi"), F.count_if(F.col("agreement") == "full").alias("n_full"), F.count_if(F.col("agreement") == "partial").alias("n_partial"))


def export_summary(rows: DataFrame) -> DataFrame:
    """Counts of types and of confidences by model: (model_label, kind, value, n)."""
    each = rows.select("model_label", F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("soc_type").alias("value")), F.struct(F.lit("confidence").alias("kind"), F.col("confidence").alias("value")))).alias("x"))
    return each.groupBy("model_label", F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def confidence_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model_label").agg(F.count("*").alias("total"), *(F.count_if(F.col("confidence") == x).alias(x) for x in LEVELS))


def visible_groups(groups: DataFrame, min_models: int, models: list[str], files: DataFrame) -> DataFrame:
    """Groups of enough models, with a chosen model, whose file has rows in the filtered view."""
    chosen = groups.where((F.col("n_models") >= min_models) & F.arrays_overlap("models", F.array(*map(F.lit, models))))
    return chosen.join(files.select("source_file").distinct(), "source_file", "left_semi")


def field_table(rows: DataFrame, fields: list[str], models: list[str]) -> DataFrame:
    """Fields as rows and models as columns, from each model's first row of a group; empty values show a dash."""
    first = rows.withColumn("f_k", F.row_number().over(W.partitionBy("group_id", "model_label").orderBy("row_id"))).where("f_k = 1")
    shown = {f: F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("—")) for f in fields}
    long = first.select("group_id", "model_label", *(c.alias(f) for f, c in shown.items())).unpivot(["group_id", "model_label"], fields, "field", "value")
    return long.groupBy("group_id", "field").pivot("model_label", models).agg(F.first("value"))


def further_rows(rows: DataFrame, models: list[str] | None = None, most: int = 100) -> DataFrame:
    """What field_table does not show: (group_id, model_label, place, soc_type, confidence, shown) of each model's rows of a group after its first, of the chosen models or all.

    place counts them from 1 in the order of row_id; shown is the passage's first `most` characters.
    """
    chosen = rows if models is None else rows.where(F.col("model_label").isin(models))
    numbered = chosen.withColumn("f_k", F.row_number().over(W.partitionBy("group_id", "model_label").orderBy("row_id")) - 1)
    return numbered.where("f_k > 0").select("group_id", "model_label", F.col("f_k").alias("place"), type_label(F.col("soc_type")).alias("soc_type"), "confidence", F.left(F.coalesce("passage", F.lit("")), F.lit(most)).alias("shown"))


def per_file(rows: DataFrame) -> DataFrame:
    """(source_file, n) by name."""
    return rows.groupBy("source_file").agg(F.count("*").alias("n")).orderBy("source_file")


def consensus_summary(rows: DataFrame) -> DataFrame:
    """One row: consensus rows, and how many of them agree fully or partially."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("agreement") == "full").alias("n_full"), F.count_if(F.col("agreement") == "partial").alias("n_partial"))


def work_figures(chunks: DataFrame, done: DataFrame, models: list[str]) -> DataFrame:
    """(model_label, n_pending, n_done): how many of the chunks each model's ledger has."""
    had = done.select("model_label", "chunk_id").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("model_label").agg(F.count("*").alias("n_done"))
    total = chunks.agg(F.count_distinct("chunk_id").alias("n")).first()["n"]
    labels = chunks.sparkSession.createDataFrame([(m,) for m in models], "model_label string")
    n_done = F.coalesce("n_done", F.lit(0))
    return labels.join(had, "model_label", "left").select("model_label", (F.lit(total) - n_done).alias("n_pending"), n_done.alias("n_done"))


def chosen_rows(rows: DataFrame, files: list[str], models: list[str], chunk: str | None = None) -> DataFrame:
    """The dashboard's view: rows of the chosen files and models, of one chunk if it is given."""
    out = rows.where(F.col("source_file").isin(files) & F.col("model_label").isin(models))
    return out if chunk is None else out.where(F.col("chunk_id") == chunk)


def agreeing_groups(groups: DataFrame, agreement: str | None) -> DataFrame:
    """Groups of one kind of agreement; all of them without a choice."""
    return groups if agreement is None else groups.where(F.col("agreement") == agreement)


def sorted_groups(groups: DataFrame) -> DataFrame:
    """Groups of many models first, then by chunk and number; `place` counts them in that order from 0.

    Places come from the sizes of the classes (n_models) and from running numbers within them.
    """
    dealt = groups.withColumn("g_share", order_buckets(groups, F.col("chunk_id")))
    by = W.orderBy(F.desc("n_models"), "g_share")
    sizes = dealt.groupBy("n_models", "g_share").agg(F.count("*").alias("n")).select("n_models", "g_share", (F.sum("n").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("g_base"))
    at = F.row_number().over(W.partitionBy("n_models", "g_share").orderBy("chunk_id", "group_id")) - 1
    # a row for each number of models and range of chunks: small as a rule, which Spark sees for itself
    return dealt.join(sizes, ["n_models", "g_share"]).withColumn("place", at + F.col("g_base")).drop("g_share", "g_base")


def menu(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, sorted, without null."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def markdown(instances: Column, think: Column) -> Column:
    """An answer for reading: the trace, then each instance's fields under its type and confidence."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""

    def lines(x: Column, i: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.concat(F.lit("## Instance "), (i + 1).cast("string"), F.lit(" — `"), x["soc_type"], F.lit("` ("), x["confidence"], F.lit(")")), F.concat(F.lit("> "), x["passage"]), F.lit(""),
            F.concat(F.lit("**Explanation:** "), x["explanation"]), F.concat(F.lit("**Evidence:** "), F.array_join(x["evidence"], ", ")),
            F.concat(F.lit("**Narrator position:** "), x["narrator_position"], F.lit("  |  **Character:** "), F.coalesce(F.nullif(x["character_pov"], F.lit("")), F.lit("—"))),
            F.when(F.size(x["secondary_devices"]) > 0, F.concat(F.lit("**Secondary devices:** "), F.array_join(x["secondary_devices"], ", "))),
            F.when(some(x["notes"]), F.concat(F.lit("**Notes:** "), x["notes"])), F.lit(""),
        )

    found = F.array_join(F.transform(instances, lines), "\n")
    body = F.when(F.coalesce(F.size(instances), F.lit(0)) > 0, found).otherwise(F.lit("*No stream-of-consciousness instances found.*"))
    return F.concat_ws("\n", F.when(some(think), F.concat(F.lit("## Reasoning trace\n\n"), think, F.lit("\n"))), body)


def formatted(instances: Column, think: Column, form: str) -> Column:
    """An answer as text in one of the forms json (indented), csv (a header, lists joined by bars, lines end with CR LF) and markdown."""
    if form == "markdown":
        return markdown(instances, think)
    if form == "json":
        return F.to_json(F.struct(F.coalesce(think, F.lit("")).alias("think_trace"), F.coalesce(instances, F.array()).alias("instances")), {"pretty": "true", "ignoreNullFields": "false"})
    if form != "csv":
        raise ValueError(f"unknown form: {form}")
    fields = [f.split(" ", 1) for f in INSTANCE.split(", ")]

    def line(x: Column) -> Column:
        shown = {"array<string>": lambda c: F.array_join(c, "|"), "boolean": lambda c: F.initcap(c.cast("string"))}
        cells = F.struct(*(shown.get(kind, lambda c: c)(x[name]).alias(name) for name, kind in fields))
        return F.to_csv(cells, {"escape": '"', "emptyValue": "", "nullValue": ""})

    lines = F.concat(F.array(F.lit(",".join(name for name, _ in fields))), F.transform(F.coalesce(instances, F.array()), line))
    return F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n"))
