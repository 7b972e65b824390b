"""JSON arrays by many tasks: round trips at any split and part size, foreign forms, bad records."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.ordering import order_buckets, running_total
from scriptorium.sources import arrays, readers, sinks
from tests.conftest import rows

ROWS = [{"passage": f'p"{i}\n  {{x', "chunk_index": i, "evidence": None if i % 3 else "é], "} for i in range(60)]
SCHEMA = "passage string, chunk_index int, evidence string"


@pytest.fixture
def small_splits(spark):
    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def got(scan):
    return [(r.stem, r.row_id, r.passage, r.chunk_index, r.evidence) for r in scan.rows.orderBy("row_id").collect()]


@pytest.mark.parametrize("split", [7, 64, 333, 100_000])
def test_indented_arrays_at_any_split(spark, tmp_path, small_splits, split):
    for name, part in (("b", ROWS[:40]), ("a", ROWS[40:])):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, ensure_ascii=False, indent=2))
    small_splits(split)
    want = [("a", r) for r in ROWS[40:]] + [("b", r) for r in ROWS[:40]]
    scan = arrays.scan_arrays(spark, str(tmp_path), SCHEMA)
    assert got(scan) == [(s, i, r["passage"], r["chunk_index"], r["evidence"]) for i, (s, r) in enumerate(want)]
    assert scan.bad.count() == 0


def test_foreign_forms_and_bad_files(spark, tmp_path):
    forms = {"compact": json.dumps(ROWS[:3]), "four": json.dumps(ROWS[:3], indent=4), "one": json.dumps(ROWS[:3], indent=1), "none": "[]", "blank": " \n", "lines": "[\n  " + ",\n  ".join(map(json.dumps, ROWS[:3])) + "\n]"}
    bad = {"object": '{"passage": "x"}', "numbers": "[1, 2]", "broken": '[{"passage": "x"', "rowbroken": '[\n  {"passage": "y"},\n  {"passage": \n  {"passage": "z"}\n]\n'}
    odd = {"types": '[{"passage": 5, "chunk_index": "no", "more": {"a": [1]}}]'}
    for name, text in (forms | bad | odd).items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "other.txt").write_text("[]")
    scan = arrays.scan_arrays(spark, str(tmp_path), SCHEMA)
    by = {}
    for stem, _, *r in got(scan):
        by.setdefault(stem, []).append(tuple(r))
    assert {k: len(v) for k, v in by.items()} == {"compact": 3, "four": 3, "one": 3, "lines": 3, "rowbroken": 2, "types": 1}
    assert by["types"] == [("5", None, None)]
    assert all(by[k] == [tuple(r.values()) for r in ROWS[:3]] for k in ("compact", "four", "one", "lines"))
    assert {r.stem for r in scan.bad.collect()} == set(bad)
    assert "other" not in scan.stems


@pytest.mark.parametrize("per_part", [1, 7, 1000])
def test_round_trip_in_parts(spark, tmp_path, per_part, small_splits):
    """An array of several parts is one text in the order of their names; keys may be null, equal, or hot."""
    data = [(i // 3 if i % 7 else None, f"m{i % 2 if i < 20 else 0}", f'p"{i}\n') for i in range(45)] + [(9, None, "none")]
    df = spark.createDataFrame(data, "k int, model string, passage string")
    arrays.write_arrays(df.repartition(5), str(tmp_path / "out"), "model", ["k", "passage"], per_part)
    names = {d.name.split("=")[1] for d in (tmp_path / "out").iterdir() if d.is_dir()}
    assert names == {"m0", "m1", "__HIVE_DEFAULT_PARTITION__"}
    n_parts = 0
    for model in ("m0", "m1"):
        parts = sorted((tmp_path / f"out/model={model}").glob("part-*"))
        n_parts += len(parts)
        whole = json.loads("".join(p.read_text() for p in parts))
        want = sorted(((k, p) for k, m, p in data if m == model), key=lambda x: (x[0] is not None, x[0], x[1]))
        assert [(x["k"], x["passage"]) for x in whole] == want
    assert n_parts == 2 if per_part == 1000 else n_parts > 4
    small_splits(50)
    scan = arrays.scan_arrays(spark, str(tmp_path / "out"), "k int, passage string")
    back = [(r.stem, r.k, r.passage) for r in scan.rows.orderBy("row_id").collect() if r.stem == "m0"]
    assert back == sorted((("m0", k, p) for k, m, p in data if m == "m0"), key=lambda x: (x[1] is not None, x[1], x[2]))
    assert scan.bad.count() == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, "m") for i in range(20)], "k int, model string")
    broken = df.withColumn("v", F.when(F.col("k") == 19, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="lost"):
        arrays.write_arrays(broken, str(tmp_path / "out"), "model", ["k"], 4)
    assert not [*(tmp_path / "out").rglob("part-*")]


def test_results_and_their_errors(spark, tmp_path):
    for name in ("m1", "results", "consensus_x"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"passage": name}], indent=2))
    assert [r.model_label for r in readers.read_results(spark, str(tmp_path)).collect()] == ["m1"]
    assert sorted(r.model_label for r in readers.read_results(spark, str(tmp_path), dashboard=True).collect()) == ["consensus_x", "m1"]
    (tmp_path / "m2.json").write_text("{broken")
    with pytest.raises(ValueError, match="m2"):
        readers.read_results(spark, str(tmp_path))
    with pytest.warns(UserWarning, match="m2"):
        assert readers.read_results(spark, str(tmp_path), bad="warn").count() == 1
    assert [(r.stem, r.record) for r in readers.scan_results(spark, str(tmp_path)).bad.collect()] == [("m2", "{broken")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no result files"):
        readers.read_results(spark, str(tmp_path / "empty"))


def test_ranges_of_structs(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, f"s{i:03d}") for i in range(300)], "a int, b string")
    key = F.struct("a", "b")
    dealt = df.withColumn("part", order_buckets(df, key, 40)).collect()
    ranked = sorted(dealt, key=lambda r: (r.a is not None, r.a, r.b))
    assert [r.part for r in ranked] == sorted(r.part for r in ranked)
    assert len({r.part for r in ranked}) > 4
    assert rows(running_total(df.withColumn("n", F.lit(1)), "b", "n", per_bucket=30).select("b", "before")) == sorted(((f"s{i:03d}", i) for i in range(300)), key=repr)


def test_consensus_in_parts(spark, tmp_path):
    df = spark.createDataFrame([("f", 0, "c", i, i) for i in range(50)], "source_file string, chunk_index int, chunk_id string, group_id int, row_id int")
    paths = sinks.write_consensus(df, str(tmp_path), "t", ("json",))
    assert [r.row_id for r in arrays.scan_arrays(spark, paths["json"], "group_id int").rows.orderBy("row_id").collect()] == list(range(50))
