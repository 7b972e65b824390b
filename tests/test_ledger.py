"""The ledger: latest answers, dead letters, corrupt files, compaction; errors and the shared rate; groups of a stream."""

from __future__ import annotations

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import annotate, limits, matching
from scriptorium.streaming import groups, ingest
from tests.conftest import rows

CHUNK = "source_file string, chunk_id string, chunk_label string, chunk_text string, chunk_index int, context_before string, context_after string"


def chunks(spark, n=5):
    return spark.createDataFrame([("f", f"c{i}", "", f"text {i}", i, "", "") for i in range(n)], CHUNK)


def answering(passage):
    return lambda: lambda model, prompt: '{"instances": [{"passage": "%s", "is_soc": true}]}' % passage


def test_force_replaces_answers(spark, tmp_path):
    work, path, out = annotate.work_list(chunks(spark), ["m1", "m2"]), str(tmp_path / "l"), str(tmp_path / "rows")
    stream = lambda: ingest.result_stream(spark, path, out, str(tmp_path / "check")).awaitTermination()
    annotate.run_pending(work, path, answering("old"), batches=3)
    stream()
    part = work.where("chunk_id = 'c1' AND model_label = 'm2'")
    done = annotate.run_pending(part, path, answering("new"), batches=2, force=True)
    assert done.count() == 10
    assert sorted(r.chunk_id for r in done.where("raw LIKE '%new%'").collect()) == ["c1"]
    stream()
    got = ingest.read_instances(spark, out)
    assert got.count() == 10
    assert [(r.model_label, r.chunk_id) for r in got.where("passage = 'new'").collect()] == [("m2", "c1")]
    before = rows(annotate.read_ledger(spark, path))
    annotate.compact_ledger(spark, path)
    assert len([*Path(path).glob("part-*.parquet")]) == 1
    assert rows(annotate.read_ledger(spark, path)) == before
    stream()
    assert ingest.read_instances(spark, out).count() == 10

    def nobody():
        raise AssertionError

    assert annotate.run_pending(work, path, nobody).count() == 10


def test_corrupt_files_are_pending_again(spark, tmp_path):
    work, path = annotate.work_list(chunks(spark), ["m"]), str(tmp_path / "l")
    annotate.run_pending(work.where("chunk_id < 'c3'"), path, answering("a"), batches=1)
    annotate.run_pending(work.where("chunk_id >= 'c3'"), path, answering("a"), batches=1)
    parts = sorted(Path(path).glob("part-*.parquet"), key=lambda p: p.stat().st_size)
    broken = next(p for p in parts if spark.read.parquet(str(p)).where("chunk_id >= 'c3'").count())
    broken.write_bytes(b"no parquet at all")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    asked = []
    again = annotate.run_pending(work, path, answering("b"), batches=2)
    assert again.count() == 5
    assert not asked
    assert {r.chunk_id for r in again.where("raw LIKE '%\"b\"%'").collect()} <= {"c3", "c4"}
    assert [p.name for p in (Path(path) / "_corrupt").glob("part-*")] == [broken.name]
    assert annotate.set_aside_corrupt(spark, path) == []


def test_error_classes():
    waits, pauses = [], []

    def failing(errors):
        left = list(errors)

        def call():
            if left:
                raise left.pop(0)
            return "fine"

        return call

    run = lambda *errors, **how: limits.called(failing(errors), sleep=waits.append, limited=pauses.append, **how)
    assert run() == limits.Outcome("fine", None, None, 1)
    assert run(limits.RateLimited("a"), limits.RateLimited("b")).attempts == 3
    assert (waits, pauses) == ([5.0, 10.0], [5.0, 10.0])
    waits.clear()
    assert run(limits.ServiceError("a"), limits.ServiceError("b")).raw == "fine"
    assert waits == [5.0, 5.0]
    waits.clear()
    assert run(ValueError("bug")) == limits.Outcome("", "ValueError: bug", "other", 1)
    assert not waits
    got = run(*[limits.RateLimited("x")] * 4)
    assert (got.raw, got.kind, got.attempts, waits) == ("", "rate", 3, [5.0, 10.0])
    assert run(limits.ServiceError("s"), attempts=1).kind == "service"
    assert run(attempts=0).error == "ServiceError: no attempt"


def test_dead_letters(spark, tmp_path):
    work, path = annotate.work_list(chunks(spark, 4), ["m"]), str(tmp_path / "l")

    def odd():
        def client(model, prompt):
            from scriptorium.operators.limits import RateLimited, ServiceError

            for k, e in enumerate((RateLimited, ServiceError, KeyError)):
                if f"text {k}" in prompt:
                    raise e("no")
            return "{}"

        return client

    assert annotate.run_pending(work, path, odd, batches=2, attempts=2, pause=0.0).count() == 1
    dead = {r.chunk_id: (r.error_kind, r.attempts) for r in annotate.dead_letters(spark, path).collect()}
    assert dead == {"c0": ("rate", 2), "c1": ("service", 2), "c2": ("other", 1)}
    assert annotate.run_pending(work, path, answering("x"), batches=2).count() == 4
    assert annotate.dead_letters(spark, path).count() == 0


def test_shared_rate(tmp_path):
    """Many threads with rates of their own over one folder: no second has more leases than allowed, and a pause holds for all."""
    now, lock, taken = [1000.0], threading.Lock(), []

    def sleep(s):
        with lock:
            now[0] += min(s, 0.25)

    def work():
        rate = limits.SharedRate(f"file://{tmp_path}/r", 3, lambda: now[0], sleep)
        for _ in range(6):
            rate.lease()
            taken.append(1)

    threads = [threading.Thread(target=work) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(taken) == 30
    assert now[0] >= 1009
    rate = limits.SharedRate(f"{tmp_path}/r", 3, lambda: now[0], sleep)
    rate.pause(20)
    began = now[0]
    limits.SharedRate(f"{tmp_path}/r", 3, lambda: now[0], sleep).lease()
    assert now[0] - began >= 19.9
    with pytest.raises(ValueError):
        limits.SharedRate(str(tmp_path), 0)


def test_rate_in_tasks(spark, tmp_path):
    work = annotate.work_list(chunks(spark, 3), ["m"])
    got = annotate.annotate(work, answering("a"), per_second=50, rate_folder=str(tmp_path / "rate")).collect()
    assert len(got) == 3
    assert [*(tmp_path / "rate").glob("lease-*")]
    with pytest.raises(ValueError, match="folder"):
        annotate.annotate(work, answering("a"), per_second=5)


def streamed(spark, data, batches, path):
    """The rows as files, a batch each, then their groups by the stream."""
    for i, part in enumerate(batches):
        spark.createDataFrame(part, data.schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{i:03d}")
        stream = spark.readStream.schema(data.schema).parquet(f"{path}/in/*")
        groups.run_groups(stream, f"{path}/out", f"{path}/check").awaitTermination()
    return groups.read_groups(spark, f"{path}/out")


def test_groups_of_a_stream(spark, tmp_path):
    """However rows are cut into batches, the groups are those of all rows at once."""
    r, words = random.Random(5), "a b c d e f g h".split()
    schema = "row_id long, chunk_id string, passage string, model_label string, soc_type string, source_file string"
    data = [(i, r.choice(["c1", "c2", "c3", None]), r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(1, 6)))]), f"m{r.randrange(4)}", r.choice("xyz"), f"f{r.randrange(2)}") for i in range(60)]
    df = spark.createDataFrame(data, schema)
    want = matching.groups_table(matching.number_groups(matching.cluster(df)).withColumn("group_id", F.struct("chunk_id", "chunk_group")))
    expected = rows(want.select("chunk_id", F.col("group_id.chunk_group").alias("chunk_group"), "source_file", "models", "representative", "n_models", "agreement"))
    for k, cuts in enumerate(([], [1, 30], sorted(r.sample(range(60), 4)))):
        edges = [0, *cuts, 60]
        parts = [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        assert rows(streamed(spark, df, [p for p in parts if p], str(tmp_path / str(k)))) == expected


def test_a_chunk_is_one_row_of_state(spark, tmp_path):
    """What a stream keeps of a chunk comes and goes with its rows at once, however many passages and groups it has."""
    data = [(i, f"c{i % 3}", f"word{i} other{i} third{i}", "m0", "x", "f") for i in range(30)]
    df = spark.createDataFrame(data, "row_id long, chunk_id string, passage string, model_label string, soc_type string, source_file string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = groups.run_groups(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    assert groups.read_groups(spark, f"{tmp_path}/out").count() == 30
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 3
