"""Classification metrics of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import without_think


def confusion(pairs: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) for all pairs of labels that occur on either side, zeros included."""
    counts = pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    names = counts.select(F.explode(F.array("y_true", "y_pred")).alias("label")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    # classes are few: the grid is made from one array of them
    grid = names.select(F.explode("labels").alias("y_true"), "labels").select("y_true", F.explode("labels").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").na.fill(0, ["n"])


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support); a zero denominator gives 0."""
    counts = pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "n", (F.col("y_true") == F.col("y_pred")).alias("hit"))
    sums = sides.groupBy(F.col("s.label").alias("label")).agg(F.sum(F.col("s.t") * F.col("n")).alias("support"), F.sum(F.col("s.p") * F.col("n")).alias("predicted"), F.sum(F.when(F.col("hit"), F.col("s.t") * F.col("n")).otherwise(0)).alias("tp"))
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("tp", "predicted"), zero), F.coalesce(F.try_divide("tp", "support"), zero)
    return sums.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"), "support")


def summary(pairs: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1, weighted_f1."""
    m = class_metrics(pairs).agg(F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    # both sides are one row each, joined on a constant key
    a = pairs.agg(F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return a.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").drop("k")


def report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of all classes, of their plain mean `macro avg` and of their mean by support `weighted avg`."""
    m = class_metrics(pairs)
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = m.agg(*(F.avg(c).alias(c) for c in names), total.alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = m.agg(*(F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names), total.alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    return m.unionByName(macro.where("support IS NOT NULL")).unionByName(weighted.where("support IS NOT NULL"))


def answer_pairs(records: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Raw records (passage, is_soc, assistant_json) with a model's answer: true and predicted detection and type beside `raw`, cut to 500 characters.

    The type is the first instance's, `other_soc` where it has none or a positive record's answer is no JSON, `none` without instances.
    Answers are read from the first { to the last }, after think blocks are gone; anything else has no instance.
    """
    schema = "instances array<struct<soc_type: string>>"
    true = F.from_json("assistant_json", schema)["instances"]
    body = F.regexp_extract(without_think(F.coalesce(raw, F.lit(""))), r"(?s)\{.*\}", 0)
    found = F.from_json(body, schema)["instances"]
    n, first = F.coalesce(F.size(found), F.lit(0)), lambda x: F.coalesce(F.get(x, F.lit(0))["soc_type"], F.lit("other_soc"))
    is_soc = F.coalesce("is_soc", F.lit(False))
    true_type = F.when(~is_soc, "none").when(true.isNull(), "other_soc").when(F.size(true) == 0, "none").otherwise(first(true))
    return records.select(
        F.coalesce("passage", F.lit("")).alias("passage"), is_soc.alias("true_is_soc"), (n > 0).alias("pred_is_soc"), true_type.alias("true_type"),
        F.when(n > 0, first(found)).otherwise("none").alias("pred_type"), F.left(F.coalesce(raw, F.lit("")), F.lit(500)).alias(raw),
    )


def detection(pairs: DataFrame) -> DataFrame:
    """answer_pairs as labels soc and none."""
    name = lambda c: F.when(F.col(c), "soc").otherwise("none")
    return pairs.select(name("true_is_soc").alias("y_true"), name("pred_is_soc").alias("y_pred"))


def typing(pairs: DataFrame) -> DataFrame:
    """The types of answer_pairs where either side is positive."""
    return pairs.where("true_is_soc OR pred_is_soc").select(F.col("true_type").alias("y_true"), F.col("pred_type").alias("y_pred"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of two annotators: observed and expected agreement from one table of label pairs, as large as the labels make it."""
    counts = pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("s"))
    labels = sides.groupBy("s.label").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.hit").alias("hit"))
    one = labels.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("t") * F.col("p").cast("double")).alias("e"))
    observed, e = F.try_divide(F.col("hit"), F.col("n")), F.try_divide(F.col("e"), F.col("n") * F.col("n"))
    return one.select("n", observed.alias("observed"), e.alias("expected"), F.try_divide(observed - e, 1 - e).alias("kappa"))
