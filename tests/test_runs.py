"""Runs that resume: evaluation and downloads; contexts in tokens; readers that tell what failed; a cache of traces."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import prompts
from scriptorium.operators import chunking, inference, reports, traces
from scriptorium.schemas import DEPRECATED_TYPES, INSTANCE, JUDGE, SOC_TYPES
from scriptorium.sources import arrays, catalogues, downloads, readers, sinks
from scriptorium.storage import stored
from tests.conftest import rows


def test_latest_checkpoint(spark, tmp_path):
    assert inference.latest_checkpoint(spark, str(tmp_path / "none")) is None
    assert inference.latest_checkpoint(spark, str(tmp_path)) is None
    for n in ("checkpoint-9", "checkpoint-100", "checkpoint-20", "checkpoint-x", "other-500"):
        (tmp_path / n).mkdir()
    (tmp_path / "checkpoint-900").write_text("a file")
    assert inference.latest_checkpoint(spark, str(tmp_path)).endswith("/checkpoint-100")


def test_evaluation_resumes(spark, tmp_path):
    """A run that fails in its midst keeps what ended, and the next asks only for the rest; force asks again; nulls and repeated keys are one example."""
    data = [(i, f"p{i}" if i % 9 else None, i % 2 == 0, '{"instances": [{"soc_type": "hybrid"}]}' if i % 2 == 0 else '{"instances": []}') for i in range(40)]
    df = spark.createDataFrame([*data, data[3], (None, "no key", True, None)], "id int, passage string, is_soc boolean, assistant_json string").withColumns({"key": F.lit("own"), "version": F.lit("v"), "job": F.lit(1)})
    path, log = str(tmp_path / "out"), tmp_path / "asked"
    log.mkdir()

    def maker(stop=None, answer="a"):
        def model(prompts, sampling):
            assert (sampling.temperature, sampling.top_p) == (0.7, 0.8)
            for p in prompts:
                if p == stop:
                    raise RuntimeError("lost")
                (log / f"{answer}-{p}").write_text("x")
            return [f'<think>t</think>{{"instances": [{{"soc_type": "{answer}"}}]}}' if p in ("p2", "p3") else "{}" for p in prompts]

        return lambda: model

    fast = inference.Sampling(thinking=False, temperature=0.1)
    with pytest.raises(Exception, match="lost"):
        inference.answer_examples(df, "id", "passage", path, "first", maker("p17"), 5, sampling=fast)
    some = inference.read_outputs(spark, path).count()
    assert some < 40
    got = inference.answer_examples(df, "id", "passage", path, "second", maker(answer="b"), 5, sampling=fast)
    assert got.count() == 40
    assert len([n for n in os.listdir(log) if n.startswith("b-")]) <= 40 - some
    again = inference.answer_examples(df.where("id = 2"), "id", "passage", path, "third", maker(answer="c"), 2, force=True, sampling=fast)
    assert again.where("key = '2'").first().raw_output.count("c") == 2 or '"c"' in again.where("key = '2'").first().raw_output
    pairs = inference.stored_pairs(df.dropDuplicates(["id"]), "id", path)
    assert pairs.count() == 40
    assert {r.true_type for r in pairs.where("pred_is_soc").collect()} == {"hybrid", "none"}
    document = json.loads(sinks.write_evaluation(pairs, str(tmp_path / "e")))
    assert document["n_examples"] == 40
    assert inference.answer_examples(df.where("false"), "id", "passage", str(tmp_path / "nothing"), "n", maker()).count() == 0


def test_sampling():
    assert inference.Sampling().used() == inference.Sampling(True, 0.6, 0.95, 20, 4096)
    assert inference.Sampling(thinking=False, temperature=0.1, max_new_tokens=9).used() == inference.Sampling(False, 0.7, 0.8, 20, 9)


def test_downloads(spark, tmp_path):
    long = "*** START OF THE PROJECT GUTENBERG EBOOK X ***\n" + "word " * 30 + "\n*** END OF THE PROJECT GUTENBERG EBOOK X"
    books = spark.createDataFrame([(1, "A", "Öne: Two!"), (2, "B", "Short"), (3, "C", "Gone"), (4, "D", "Odd"), (5, "E", "There"), (5, "E", "There"), (6, "F", "Second address")], "id int, author string, title string")
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "pg00005_there.txt").write_text("old")

    def make():
        def get(url):
            n = url.rsplit("/", 1)[-1]
            if "/5" in url or "pg5" in url:
                raise AssertionError("not to be asked")
            if "pg4.txt" in n or n.startswith("4"):
                raise OSError("broken line")
            if n == "6-0.txt":
                return long
            return {"pg1.txt": long, "pg2.txt": "two words"}.get(n)

        return get

    got = {r.id: r for r in downloads.download_books(books, str(folder), make, 0.0, 20).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "saved", 2: "short", 3: "failed", 4: "failed", 5: "exists", 6: "saved"}
    assert (got[1].n_words, got[2].n_words, got[3].error) == (30, 2, "not found")
    assert got[4].error.count("broken line") == 3
    assert sorted(os.listdir(folder)) == ["pg00001_öne_two.txt", "pg00005_there.txt", "pg00006_second_address.txt"]
    assert (folder / "pg00001_öne_two.txt").read_text() == ("word " * 30).strip()
    assert (folder / "pg00005_there.txt").read_text() == "old"
    states = downloads.download_books(books, str(folder), make, 0.0, 20)
    assert {r.id: r.status for r in states.collect()} == {1: "exists", 2: "short", 3: "failed", 4: "failed", 5: "exists", 6: "exists"}
    assert {r.id for r in downloads.failures(states).collect()} == {2, 3, 4}
    assert downloads.download_books(books.where("false"), str(folder), make, 0.0).count() == 0
    none = spark.createDataFrame([([],), (None,)], "urls array<string>")
    assert [r.error for r in downloads.fetched(none, make, 0.0).collect()] == ["no address"] * 2


def test_pacing(spark):
    import time

    wanted = spark.createDataFrame([(f"http://h{i % 2}/x{i}",) for i in range(6)], "u string").select(F.array("u").alias("urls"))
    began = time.time()
    got = stored(downloads.fetched(wanted, lambda: lambda url: url, 0.3), "paced")
    assert time.time() - began > 0.9
    assert sorted(r.text for r in got.collect()) == sorted(f"http://h{i % 2}/x{i}" for i in range(6))


def test_contexts_in_tokens(spark, tmp_path):
    docs = spark.createDataFrame([("a.txt", "One two  three. Four five six. Seven eight nine ten."), ("b.txt", "  Alone  "), ("n.txt", None)], "source_file string, text string")
    got = {(r.source_file, r.chunk_index): (r.chunk_text, r.context_before, r.context_after) for r in chunking.refined_chunks(docs, 4, 2).collect()}
    assert got["a.txt", 0] == ("One two  three.", "", "Four five")
    assert got["a.txt", 1][1:] == ("two  three.", "Seven eight")
    assert got["a.txt", 2][1:] == ("five six.", "")
    assert got["b.txt", 0][1:] == ("", "")
    assert all(r.context_before == r.context_after == "" for r in chunking.refined_chunks(docs, 4, 0).collect())
    import public_tokenizers

    offsets = chunking.file_offsets(public_tokenizers.path("byte_bpe_50k.json"))
    own = offsets()("Überraschung naïve")
    assert all(a < b for a, b in own)
    long = chunking.refined_chunks(docs, 5, 3, offsets).where("source_file = 'a.txt'").orderBy("chunk_index").collect()
    assert "".join(r.chunk_text for r in long) == "One two  three. Four five six. Seven eight nine ten."
    for a, b in zip(long, long[1:], strict=False):
        tail, head = offsets()(a.chunk_text)[-3:], offsets()(b.chunk_text)[:3]
        assert b.context_before == a.chunk_text[tail[0][0] : tail[-1][1]]
        assert a.context_after == b.chunk_text[head[0][0] : head[-1][1]]
    sinks.write_refined(docs, str(tmp_path / "k"), 4, 2)
    back = arrays.scan_arrays(spark, str(tmp_path / "k"), "chunk_text string, context_before string, chunk_index int")
    assert sorted((r.stem, r.chunk_index) for r in back.rows.collect()) == [("a_txt", 0), ("a_txt", 1), ("a_txt", 2), ("b_txt", 0)]


def test_documents_that_cannot_be_read(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with pytest.raises(ValueError, match="no documents"):
        readers.store_documents(spark, str(folder), str(tmp_path / "t0"))
    (folder / "a.txt").write_text("fine")
    (folder / "b.docx").write_bytes(b"no zip")
    (folder / "c.csv").write_text("other")
    with pytest.warns(UserWarning, match="b.docx"):
        good, bad, counts = readers.store_documents(spark, str(folder), str(tmp_path / "t"))
    assert [tuple(r) for r in good.collect()] == [("a.txt", "fine")]
    assert [tuple(r) for r in bad.collect()] == [("b.docx", "not readable as docx")]
    assert counts == {"n_documents": 2, "n_failed": 1}
    with pytest.raises(ValueError, match="b.docx"):
        readers.store_documents(spark, str(folder), str(tmp_path / "t2"), bad="raise")
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_documents(spark, str(folder / "c.csv"))
    assert readers.read_documents(spark, str(folder / "a.txt")).count() == 1


def test_trace_cache_and_clashing_columns(spark, tmp_path):
    (tmp_path / "train_c1_0a.jsonl").write_text('{"trace": "one"}\n\n{"trace": "two", "passage_id": "x"}\n')
    (tmp_path / "train_c2_0b.jsonl").write_text('{"other": 1}')
    got = traces.read_cache(spark, str(tmp_path))
    assert rows(got) == sorted([(0, "train_c1_0a", "one"), (1, "train_c1_0a", "two"), (0, "train_c2_0b", "")], key=repr)
    records = spark.createDataFrame([("train_c1_0a", "the passage", False, "old", "own", 7)], "passage_id string, passage string, is_soc boolean, think_content string, trace string, c_id int")
    best = traces.with_best(records, got).first()
    assert (best.think_content in ("one", "two"), best.trace, best.c_id) == (True, "own", 7)


def test_further_rows(spark):
    df = spark.createDataFrame([(1, 0, "a", "imagery", "low", "x" * 150), (1, 1, "a", "imagery", "high", "y" * 150), (1, 2, "b", "odd", "low", None), (1, 3, "a", "odd", None, None)], "group_id int, row_id int, model_label string, soc_type string, confidence string, passage string")
    got = sorted(tuple(r) for r in reports.further_rows(df, ["a"]).collect())
    assert got == [(1, "a", 1, "Imagery", "high", "y" * 100), (1, "a", 2, "odd", None, "")]
    assert reports.further_rows(df, ["b"]).count() == 0


def test_techniques(spark):
    got = {r.id: r.technique for r in catalogues.positives(spark).collect()}
    assert len(got) == 22
    assert (got[4300], got[600], got[2775]) == ("direct_interior_monologue + hybrid", "soliloquy", "reverie_fantasy + indirect_interior_monologue")


def test_forms_of_an_answer(spark):
    import csv
    import io

    schema = f"t string, i array<struct<{', '.join(f.replace(' ', ': ', 1) for f in INSTANCE.split(', '))}>>"
    one = ('a "b", c', "imagery", ["x", "y"], "n/a", "minimal", "", True, "why,\nso", [], "high", "")
    df = spark.createDataFrame([("think", [one, one]), (None, None)], schema)
    shown = [{f: r[f] for f in ("json", "csv", "markdown")} for r in df.select(*(reports.formatted(F.col("i"), F.col("t"), f).alias(f) for f in ("json", "csv", "markdown"))).collect()]
    full, none = sorted(shown, key=lambda r: -len(r["json"]))
    got = list(csv.DictReader(io.StringIO(full["csv"], newline="")))
    assert [(r["passage"], r["secondary_devices"], r["is_soc"], r["explanation"], r["evidence"]) for r in got] == [('a "b", c', "x|y", "True", "why,\nso", "")] * 2
    assert json.loads(full["json"])["instances"][0]["secondary_devices"] == ["x", "y"]
    assert full["markdown"].count("## Instance") == 2
    assert none["csv"] == ",".join(f.split(" ")[0] for f in INSTANCE.split(", ")) + "\r\n"
    assert json.loads(none["json"]) == {"think_trace": "", "instances": []}
    with pytest.raises(ValueError, match="form"):
        reports.formatted(F.col("i"), F.col("t"), "xml")


def test_prompts(spark):
    assert set(json.loads(prompts.answer_form().replace("true|false", "true").replace(", ...", ""))["instances"][0]) == {f.split(" ")[0] for f in INSTANCE.split(", ")}
    text = prompts.system_prompt({"imagery": "pictures"})
    assert all(t in text for t in SOC_TYPES if t not in DEPRECATED_TYPES)
    assert "- imagery (Imagery): pictures" in text
    assert not any(f"- {t} " in text for t in DEPRECATED_TYPES)
    asked = spark.createDataFrame([("trace", None)], "t string, p string").select(prompts.judge_prompt(F.col("t"), F.col("p"), F.lit("is_soc: false"))).first()[0]
    assert asked.endswith("REASONING:\ntrace")
    assert all(f'"{f.split(" ")[0]}"' in asked for f in JUDGE.split(", "))
