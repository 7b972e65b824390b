"""The pipeline's stages by brute force over the smallest tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import quality_rules
from tests.llm.helpers import ODD, frame, prose
from tests.llm.test_filters import brute_components
from tests.llm.test_tokens import crc, library


def windows(text: str) -> set[tuple[str, ...]]:
    lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    held, texts = [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held.append(docs.toPandas())
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
    texts = [dict(zip(h["doc_id"], h["text"].fillna(""), strict=True)) for h in held]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    gone = set(texts[0]) - set(texts[1])
    assert not [i for i in gone if labels.get(i) == 1]
    rules = quality_rules.BASE_RULES + quality_rules.RULES
    assert set(texts[2]) == {i for i, t in texts[1].items() if not any(r.rejects(t.encode()) for r in rules)}
    roots = brute_components(texts[2], 5, 80)
    assert set(texts[3]) == {i for i, r in roots.items() if i == r}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()["text"]
    known = set().union(*(windows(t or "") for t in bench))
    sizes = {len(x) for x in known}
    assert set(texts[4]) == {i for i, t in texts[3].items() if not any(known & set(_grams(t, n)) for n in sizes)}
    packed = docs.toPandas()
    ids = {i: [*x, 1] for i, x in zip(texts[4], library([*texts[4].values()]), strict=True)}
    want = [(i, k, s, len(x[s : s + 4096]), crc(x[s : s + 4096])) for i, x in ids.items() for k, s in enumerate(range(0, len(x), 4096))]
    assert sorted(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096


def write_tables(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")


def test_chain_on_odd_documents(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, long texts, and columns with names that stages use themselves."""
    passage = prose(77, 30)
    good = {100 + i: prose(i, 80) for i in range(30)}
    more = [*ODD, *good.items(), (200, good[101]), (201, good[102] + " one"), (202, prose(60, 40) + " " + passage + " " + prose(61, 20)), (203, "### $$$ %%% " * 40)]
    docs = frame(spark, more).withColumn("kept", F.lit(None).cast("string")).withColumn("m", F.lit(3)).withColumn("key", F.lit("k"))
    labels = spark.createDataFrame([(100 + i, 1, None) for i in range(25)] + [(203, 0, 1), (None, 1, 0), (104, None, None), (104, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, passage), (None, None), (2, "")], "item_id long, text string")
    write_tables(spark, tmp_path, docs, labels, benchmark)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert {200, 201, 202, 203, 1, 2, 3, 4, 5}.isdisjoint(ids)
    assert len(ids & set(good)) > 20


def test_chain_on_empty_tables(spark, tmp_path):
    labels, benchmark = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    write_tables(spark, tmp_path, frame(spark, []), labels, benchmark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = frame(spark, [*((i, prose(i, 60)) for i in range(4)), (9, None)])
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.benchmark_decontamination):
        assert stage(spark, docs, str(tmp_path)).count() == 5


def _grams(text: str, n: int):
    lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return (tuple(w[i : i + n]) for i in range(len(w) - n + 1))
