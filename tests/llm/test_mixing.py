"""The mix against SQL, by its promises, and its texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import mixing
from tests.conftest import oracle, rows
from tests.llm.helpers import ODD, empty, frame


def sourced(spark, more=()):
    data = [*((i, t, None if i is None or i % 2 else "odd") for i, t in ODD), *more]
    return spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("copy", F.lit("x")).withColumn("m_key", F.lit(1)).withColumn("target", F.lit("t"))


def test_odd_documents_against_sql(spark):
    """Nulls in all columns, repeated rows, empty and long texts, sources without words, columns with the operator's own names."""
    more = [(100 + i, "w " * (i * 7 % 50), f"s{i % 5}") for i in range(200)] + [(7, "same text", "s1")] * 9 + [(400, " ", "blank"), (401, None, "blank"), (402, "w " * 9000, "S9"), (403, "é", "é")]
    df = sourced(spark, more)
    given = df.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    assert rows(mixing.taken(mixing.plan(df))) == oracle("/nonexistent", mixing.sql(), documents=given)
    other = mixing.Curriculum((1, 5), 90, 3, ((1.0, 2.0), (2.0, 1.0, 1.0, 4.0)))
    assert rows(mixing.taken(mixing.plan(df, other))) == oracle("/nonexistent", mixing.sql(other), documents=given)


def test_empty_and_wordless_tables(spark):
    assert mixing.plan(empty(spark)).count() == 0
    got = mixing.taken(mixing.plan(frame(spark, [(1, None), (2, " "), (None, "")]))).collect()
    assert sorted((r.taken, r.target, r.position) for r in got) == [(0, 0.0, None)] * 3


def test_promises(spark, sf_dir):
    """Targets are met to a word, a hot source with its bound included; the mix is sorted; reruns agree."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    mix = mixing.plan(docs)
    got = mix.toPandas()
    of = got.groupby("source").agg(words=("words", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (of["words"] == np.floor(of["target"])).all()
    assert (of["target"] <= 2 * of["size"]).all()
    assert abs(of["target"].sum() - 1.5 * of["size"].sum()) < 1e-3
    assert got["position"].dropna().is_monotonic_increasing
    assert (got.groupby("doc_id")["words"].sum() <= 2 * got.groupby("doc_id")["size"].first()).all()
    assert rows(mix) == rows(mixing.plan(docs.repartition(7)))


def test_schedules_are_followed(spark):
    """At half of the time a source has given what the integral of its schedule says."""
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    got = mixing.plan(docs).toPandas()
    early = got[got["position"] < 0.5].groupby("source")["words"].sum() / got.groupby("source")["words"].sum()
    assert early["s0"] == pytest.approx(5 / 8, abs=0.01)
    assert early["s1"] == pytest.approx(3 / 8, abs=0.01)
    assert early["s2"] == pytest.approx(1 / 2, abs=0.01)


def test_texts_of_the_mix(spark):
    docs = sourced(spark, [(100 + i, f"one two three {i}", "s") for i in range(20)])
    mix = mixing.plan(docs)
    got = mixing.mixed_texts(docs, mix).toPandas()
    takes = mix.where("words > 0").toPandas()
    assert sorted(len(t.split()) for t in got["text"]) == sorted(takes["words"])
    assert got["position"].is_monotonic_increasing


def test_wrong_settings():
    for bad in ({"weights": ()}, {"weights": (0,)}, {"percent": 201}, {"profiles": ((1.0,),)}, {"profiles": ((1.0, -1.0),)}):
        with pytest.raises(ValueError):
            mixing.Curriculum(**bad)
