"""Corpus preparation as a chain of stages; each is written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium import prepare
from scriptorium.llm import decontamination, near_duplicates, quality_lm, quality_rules
from scriptorium.llm import queries as q
from scriptorium.llm.common import made, release_since, work_dir
from scriptorium.llm.packing import pack_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for trusted documents of their language stay."""
    return quality_lm.keep_good(docs, q.table(prepare(spark), sf_dir, "labels"))


def quality_rule_cascade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects stay."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one of least id stays."""
    prepare(spark)
    return near_duplicates.keep_one(docs, near_duplicates.Jaccard(width=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window of ten words stay."""
    return decontamination.keep_clean(docs, q.table(prepare(spark), sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 4096 tokens."""
    prepare(spark)
    return pack_documents(docs, q.tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_cascade),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The language model and the tokenizer have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, one after the other. What a stage has stored goes when its result is written, and that result when the next one is."""
    docs, mark = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (_, stage) in enumerate(STAGES):
        path = work_dir(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release_since(mark, path)
    return docs
