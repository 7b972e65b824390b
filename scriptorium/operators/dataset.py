"""Training records: positives, hard and clean negatives, windows, splits and chat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import comma_list, confidence_rank, strip, think_block, window_texts, without_think
from scriptorium.operators.ordering import order_buckets
from scriptorium.schemas import DEPRECATED_TYPES

# How many models each standard data set asks for.
MIN_MODELS = {"conservative": 4, "moderate": 3, "liberal": 2}


def group_records(clustered: DataFrame, min_models: int, rare_below: int = 0) -> DataFrame:
    """One row for each positive or hard-negative group: source_file, chunk_id, passage, is_soc, hard_negative, soc_type and annotation fields.

    A group of min_models models or more is positive. One of a single model is a hard negative where
    there are two models at all and one is not enough. Groups between are left out. The type is the majority's
    (ties: higher mean confidence, first seen); types that are deprecated or in fewer than
    `rare_below` rows become other_soc. The passage is the first longest one, other fields come from the row
    of highest confidence and length; explanations of the majority type, two at most, are joined.
    """
    rank = confidence_rank(F.col("confidence"))
    rows = clustered.withColumn("d_rank", rank)
    several = rows.agg((F.count_distinct("model_label") >= 2).alias("d_several"))
    votes = rows.groupBy("group_id", "soc_type").agg(F.count("*").alias("n"), F.avg("d_rank").alias("mean"), F.min("row_id").alias("first"))
    best_type = votes.withColumn("k", F.row_number().over(W.partitionBy("group_id").orderBy(F.desc("n"), F.desc("mean"), "first"))).where("k = 1").select("group_id", F.col("soc_type").alias("top_type"))
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in ("group_id", "d_rank", "passage")]), F.struct("d_rank", F.length("passage"), -F.col("row_id")))
    told = F.array_sort(F.collect_list(F.when((F.col("soc_type") == F.col("top_type")) & (F.coalesce("explanation", F.lit("")) != ""), F.struct("row_id", "explanation"))))
    groups = rows.join(best_type, "group_id").groupBy("group_id", "top_type").agg(
        F.count_distinct("model_label").alias("n_models"),
        F.max_by("passage", F.struct(F.length("passage"), -F.col("row_id"))).alias("longest"),
        best.alias("b"),
        F.slice(F.array_distinct(F.transform(told, lambda x: x["explanation"])), 1, 2).alias("told"),
    )
    counts = clustered.groupBy(F.col("soc_type").alias("top_type")).agg(F.count("*").alias("type_rows"))
    positive = F.col("n_models") >= min_models
    hard = (F.col("n_models") == 1) & F.col("d_several") & F.lit(min_models > 1)
    kind = F.when(F.col("top_type").isin(*DEPRECATED_TYPES) | (F.coalesce("type_rows", F.lit(0)) < rare_below), "other_soc").otherwise(F.col("top_type"))
    # one row says whether there are two models at all; types outside the vocabulary are kept, so their number has no bound, and the join is left to the sizes met
    return groups.crossJoin(F.broadcast(several)).where(positive | hard).join(counts, "top_type", "left").select(
        "group_id", F.col("b.source_file").alias("source_file"), F.col("b.chunk_id").alias("chunk_id"), F.col("longest").alias("passage"),
        positive.alias("is_soc"), (~positive).alias("hard_negative"), kind.alias("soc_type"), F.col("b.confidence").alias("confidence"),
        *[F.col(f"b.{c}").alias(c) for c in ("evidence", "secondary_devices", "affective_register", "narrator_position", "character_pov", "notes") if c in rows.columns],
        F.coalesce(F.nullif(F.array_join("told", " "), F.lit("")), F.col("b.explanation"), F.lit("")).alias("explanation"),
    )


def think_text(explanation: Column, confidence: Column, evidence: Column) -> Column:
    """Explanation, confidence, and three pieces of evidence at most, a line each."""
    some = F.array_join(F.slice(comma_list(evidence), 1, 3), "; ")
    return strip(F.concat(explanation, F.lit("\nConfidence: "), confidence, F.lit("\nEvidence: "), some))


def training_records(records: DataFrame) -> DataFrame:
    """Records in their training form; the answer is a JSON string with one instance, or none for negatives."""
    text = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d)).alias(c)
    instance = F.struct(
        F.lit(True).alias("is_soc"), "passage", "soc_type", comma_list(F.col("secondary_devices")).alias("secondary_devices"), text("affective_register", "n/a"),
        text("narrator_position", "minimal"), text("character_pov", ""), "explanation", comma_list(F.col("evidence")).alias("evidence"), text("confidence", "medium"), text("notes", ""),
    )
    answer = F.when(F.col("is_soc"), F.to_json(F.struct(F.array(instance).alias("instances")))).otherwise('{"instances": []}')
    confidence = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("medium"))
    return records.select("source_file", "chunk_id", "passage", "is_soc", "hard_negative", think_text(F.col("explanation"), confidence, F.col("evidence")).alias("think_content"), answer.alias("assistant_json"))


def clean_negatives(chunks: DataFrame, positives: DataFrame) -> DataFrame:
    """The first row of each chunk (row_id, chunk_id, passage) without a positive, if its passage is not blank."""
    free = chunks.join(positives.select("chunk_id").distinct(), "chunk_id", "left_anti")
    first = free.withColumn("n_k", F.row_number().over(W.partitionBy("chunk_id").orderBy("row_id"))).where("n_k = 1").drop("n_k")
    return first.where(F.coalesce("passage", F.lit("")) != "")


def window_negatives(docs: DataFrame, per_file: int, size: int = 300, seed: int = 42) -> DataFrame:
    """`per_file` windows at most of each document (source_file, text), chosen by a hash."""
    each = docs.select("source_file", F.posexplode(window_texts(F.col("text"), size)).alias("pos", "passage"))
    order = W.partitionBy("source_file").orderBy(F.xxhash64("source_file", "pos", F.lit(seed)), "pos")
    return each.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_file).drop("k")


def split(records: DataFrame, key: Column, test: float = 0.1, val: float = 0.1, per_share: int = 100_000) -> DataFrame:
    """A column `split` (train, val, test): of each class of is_soc the given shares, one row at least while there are any.

    Rows are ranked by `key` in ranges of about `per_share` rows each, whatever the keys' spread, so that a
    class of most rows is not one task's. Rows of one key are ranked together.
    """
    ranked = records.withColumn("s_key", key)
    dealt = ranked.withColumn("s_share", order_buckets(ranked, F.col("s_key"), per_share))
    sizes = dealt.groupBy("is_soc", "s_share").agg(F.count("*").alias("n"))
    whole = W.partitionBy("is_soc")
    base = sizes.select("is_soc", "s_share", F.sum("n").over(whole).alias("s_total"), (F.sum("n").over(whole.orderBy("s_share")) - F.col("n")).alias("s_base"))
    at = F.row_number().over(W.partitionBy("is_soc", "s_share").orderBy("s_key")) + F.col("s_base")
    n = F.col("s_total")
    n_test, n_val = F.greatest(F.lit(1), F.floor(n * test)), F.greatest(F.lit(1), F.floor(n * val))
    name = F.when(at <= n_test, "test").when(at <= n_test + n_val, "val").otherwise("train")
    # a row for each class and range
    return dealt.join(F.broadcast(base), ["is_soc", "s_share"]).withColumn("split", name).drop("s_key", "s_share", "s_total", "s_base")


def to_chat(records: DataFrame, system: str) -> DataFrame:
    """Records as messages of system, user and assistant."""
    think = F.when(F.coalesce("think_content", F.lit("")) != "", F.concat(F.lit("<think>\n"), "think_content", F.lit("\n</think>\n\n")))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return records.withColumn("messages", F.array(message("system", F.lit(system)), message("user", F.col("passage")), message("assistant", F.concat(F.coalesce(think, F.lit("")), "assistant_json"))))


def role_text(messages: Column, role: str) -> Column:
    """The content of the first message of a role; null if there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def prompt_messages(messages: Column) -> Column:
    """The system and user messages, without the answer."""
    return F.slice(messages, 1, 2)


def from_chat(chats: DataFrame) -> DataFrame:
    """Chats (messages, ...) as raw records: passage, is_soc, soc_type, think_content, assistant_json beside the other columns.

    An answer with instances is positive, and its first one gives the type; an answer that is no JSON is negative.
    """
    answer = F.coalesce(role_text(F.col("messages"), "assistant"), F.lit(""))
    rest = strip(without_think(answer))
    found = F.from_json(rest, "instances array<struct<soc_type: string>>")["instances"]
    return chats.select(
        *[c for c in chats.columns if c != "messages"], F.coalesce(role_text(F.col("messages"), "user"), F.lit("")).alias("passage"), (F.coalesce(F.size(found), F.lit(-1)) > 0).alias("is_soc"),
        F.coalesce(F.get(found, F.lit(0))["soc_type"], F.lit("")).alias("soc_type"), F.coalesce(think_block(answer), F.lit("")).alias("think_content"), rest.alias("assistant_json"),
    )


def type_distribution(records: DataFrame) -> DataFrame:
    """(soc_type, n) of all instances in the positive records' answers; an instance without a type is unknown."""
    found = F.from_json("assistant_json", "instances array<struct<soc_type: string>>")["instances"]
    each = records.where("is_soc").select(F.explode(found).alias("i"))
    return each.groupBy(F.coalesce("i.soc_type", F.lit("unknown")).alias("soc_type")).agg(F.count("*").alias("n"))


def record_figures(records: DataFrame) -> DataFrame:
    """One row: positives, hard negatives, clean negatives."""
    return records.agg(F.count_if("is_soc").alias("n_positive"), F.count_if("hard_negative").alias("n_hard"), F.count_if(~F.col("is_soc") & ~F.col("hard_negative")).alias("n_clean"))
