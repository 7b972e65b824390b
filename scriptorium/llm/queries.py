"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium import prepare
from scriptorium.llm import decontamination, licenses, masked_lm, mixing, near_duplicates, periodic_runs, quality_lm, quality_rules, spelling_variants, toxicity
from scriptorium.llm.packing import pack_documents
from scriptorium.llm.token_counts import token_counts
from scriptorium.llm.token_output import token_output


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of the trusted ones, and the verdict by their languages' quantiles."""
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as Simple-8b files and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of all documents under a network trained on them."""
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return near_duplicates.similarity_classes(table(spark, sf_dir, "documents"), near_duplicates.Jaccard(width=4, percent=85))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in all documents."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents by canonical digests."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the cascade's verdict."""
    return quality_rules.quality_stats(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of at least 24 words and three periods in all documents, a tenth of which get periodic tails."""
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all documents' words of seven letters or more, some with a letter left out."""
    return spelling_variants.variant_groups(spelling_variants.vocabulary(spelling_variants.misspelt_words(table(spark, sf_dir, "documents"))))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a curriculum of one and a half times all words takes of each document."""
    return mixing.taken(mixing.plan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_token_output, op3_toxicity, op4_lm_scoring, op5_best_fit_packing, op6_ngram_jaccard_join, op7_decontamination, op8_license_scans, op9_token_counts, op10_quality_rules, op11_periodic_runs, op12_spelling_variants, op13_source_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_jaccard_join": near_duplicates.sql(4, 85), "op7_decontamination": decontamination.SQL, "op8_license_scans": licenses.SQL, "op10_quality_rules": quality_rules.SQL, "op11_periodic_runs": periodic_runs.sql(), "op12_spelling_variants": spelling_variants.sql(), "op13_source_mixing": mixing.sql()}
