"""Hand-derived cases of single operators."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import scoring, text
from scriptorium.operators import annotate, chunking, consensus, dataset, evaluation, matching, ordering, parsing, reports, traces
from scriptorium.plans import registry
from scriptorium.sources import catalogues, readers, sinks
from scriptorium.streaming import ingest


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_normalise(spark):
    assert one(spark, "Café “déjà” naïve — it’s ok_1!  ÉTÉ", text.normalise) == "café déjà naïve its ok_1 été"
    assert one(spark, None, text.normalise) == ""
    assert one(spark, "", lambda c: text.token_set(text.normalise(c))) == []


def test_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d", "e"]), ([], ["a"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(text.overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0]


def test_identifiers(spark):
    df = spark.createDataFrame([("Mrs. Dalloway (É).txt", 7), ("Mrs. Dalloway (É).txt", 1234)], "f string, i int")
    assert [r[0] for r in df.select(text.chunk_id(F.col("f"), F.col("i"))).collect()] == ["mrs-dalloway-e_007", "mrs-dalloway-e_1234"]
    assert one(spark, "***", text.safe_name) == "default"


def test_sentences(spark):
    got = one(spark, "Hi there. She left! why? Then Mr. Smith came.", text.sentences)
    assert got == ["Hi there.", "She left! why?", "Then Mr.", "Smith came."]


@pytest.mark.parametrize(("n", "k"), [(0, 0), (299, 0), (300, 0), (301, 1), (600, 1), (601, 2), (900, 2)])
def test_windows(spark, n, k):
    assert len(one(spark, " ".join(["w"] * n), text.window_texts)) == k


GOLDEN = [(0, "m1", "a b c", "A", "high"), (1, "m2", "x y z", "A", "high"), (2, "m3", "a b x y", "B", "medium"), (3, "m1", "!!!", "A", "high"), (4, "m2", "z q r s", "A", "high"), (5, "m2", "a b c", "A", "high")]


def golden_rows(spark, confidence="medium"):
    data = [(i, m, "f", None if i == 5 else "k", 0, p, t, confidence if i == 2 else c) for i, m, p, t, c in GOLDEN]
    return spark.createDataFrame(data, "row_id long, model_label string, source_file string, chunk_id string, chunk_index int, passage string, soc_type string, confidence string")


def test_clusters(spark):
    got = matching.cluster(golden_rows(spark)).orderBy("row_id").select("row_id", "chunk_group").collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (2, 0), (3, 2), (4, 3)]


def test_tracks(spark):
    own = {t.name: t for t in consensus.TRACKS}
    for confidence in ("medium", "high"):
        clustered = matching.number_groups(matching.cluster(golden_rows(spark, confidence)))
        got = consensus.ordered(consensus.apply_track(clustered, own["moderate"])).collect()
        assert [(r.row_id, r.n_models, r.models_agreed, r.agreement) for r in got] == [(0, 2, "m1, m3", "partial")]
    clustered = matching.number_groups(matching.cluster(golden_rows(spark)))
    assert consensus.apply_track(clustered, own["conservative"]).count() == 0
    got = consensus.ordered(consensus.apply_track(clustered, own["liberal"])).collect()
    assert [r.row_id for r in got] == [0, 2, 1, 3, 4]
    assert [r.agreement for r in got] == ["partial", "partial", "full", "full", "full"]
    longest = consensus.Track("l", min_models=2, min_confidence="low", resolve_type="longest")
    assert [r.row_id for r in consensus.apply_track(clustered, longest).collect()] == [2]


def test_structural_chunks(spark):
    docs = spark.createDataFrame([("b.txt", "front matter\n\nCHAPTER I\n\nThe text.\n\nCHAPTER II\nmore\n"), ("e.txt", None)], "source_file string, text string")
    got = chunking.chunk_documents(docs).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.chunk_label, r.chunk_text) for r in got] == [("b_000", "CHAPTER I", "CHAPTER I\n\nThe text."), ("b_001", "CHAPTER II", "CHAPTER II\nmore")]
    assert got[0].context_after == got[1].chunk_text
    assert got[1].context_before == got[0].chunk_text


def test_sentence_packing():
    s = [f"S{i} abcdef." for i in range(1, 5)]
    assert all(len(x) == 10 for x in s)
    got = chunking.pack_sentences(" ".join(s), 20, 10)
    assert got == [("Chunk 1", f"{s[0]} {s[1]}"), ("Chunk 2", f"{s[1]} {s[2]}"), ("Chunk 3", f"{s[2]} {s[3]}")]
    # of three sentences with their spaces two are within 30 beside a third: 21 + 10 is too much
    six = [f"S{i} abcdef." for i in range(6)]
    assert [t for _, t in chunking.pack_sentences(" ".join(six), 45, 30)] == [" ".join(six[0:4]), " ".join(six[2:6])]
    assert chunking.pack_sentences("  Aa bb. Cc dd.  \n", 100, 10) == [("Chunk 1", "  Aa bb. Cc dd.  \n")]
    assert chunking.pack_sentences("", 10, 1) == [("Chunk 1", "")]


def test_sentence_packing_by_brute_force():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["A", "b", ".", "! ", " ", "\n", "C"]) * r.randrange(1, 4) for _ in range(r.randrange(0, 80)))
        size, overlap = r.randrange(1, 40), r.randrange(0, 40)
        sentences = re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)
        want, first, used = [], 0, 0
        for i, s in enumerate(sentences):
            if i > first and used + len(s) > size:
                want.append(" ".join(sentences[first:i]))
                new = i
                while new > first and len(" ".join(sentences[new:i])) + len(sentences[new - 1]) <= overlap:
                    new -= 1
                first, used = new, len(" ".join(sentences[new:i]))
            used += len(s)
        want.append(" ".join(sentences[first:]))
        assert [t for _, t in chunking.pack_sentences(text, size, overlap)] == want


def test_groups_by_table_and_index():
    r = random.Random(5)
    tokens = [[f"t{k}" for k in r.sample(range(30), r.randrange(0, 12))] for _ in range(60)]
    groups: list[list[set]] = []
    want = []
    for x in map(set, tokens):
        g = next((k for k, members in enumerate(groups) if any(x and m and len(x & m) / min(len(x), len(m)) >= 0.35 for m in members)), len(groups))
        groups[g:] = groups[g:] or [[]]
        groups[g].append(x)
        want.append(g)
    assert matching.assign_groups(tokens) == want
    matching.MOST_CELLS, most = 0, matching.MOST_CELLS
    try:
        assert matching.assign_groups(tokens) == want
    finally:
        matching.MOST_CELLS = most


def test_rows_of_one_id_stay_apart(spark):
    rows = golden_rows(spark).withColumn("row_id", F.lit(0).cast("long"))
    assert matching.cluster(rows).count() == 5
    empty = matching.number_groups(matching.cluster(rows.where("false")))
    assert empty.count() == 0


def test_order_buckets(spark):
    df = spark.range(1000).select(F.format_string("k%04d", F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5 + 1).alias("n"))
    got = {r.k: r.before for r in ordering.running_total(df, "k", "n", per_bucket=60).collect()}
    total = 0
    for r in sorted(df.collect()):
        assert got[r.k] == total
        total += r.n
    assert df.withColumn("b", ordering.order_buckets(df, F.col("k"), 60)).select("b").distinct().count() > 8
    # one outlier and many equal keys
    skew = spark.range(3000).select(F.when(F.col("id") == 0, 10**12).otherwise(F.col("id") % 1500).alias("key"), F.lit(True).alias("is_soc"))
    by = {r["split"]: r["count"] for r in dataset.split(skew, F.col("key"), per_share=200).groupBy("split").count().collect()}
    assert by == {"train": 2400, "val": 300, "test": 300}
    shares = skew.withColumn("b", ordering.order_buckets(skew, F.col("key"), 200)).groupBy("b").count().collect()
    assert max(r["count"] for r in shares) < 1000


def test_narrators():
    got, _ = chunking.splitter_for("x/As-I-Lay-Dying.txt")("Darl\n\none\n\nCora\n\ntwo\n\nDarl\n\nthree", 100, 10)
    assert [label for label, _ in got] == ["Darl (1)", "Cora (1)", "Darl (2)"]


def test_markup(spark):
    files = spark.createDataFrame([("a.txt", '<chunk-5 label="A">\nfoo\n</chunk-9>\n<chunk-7>\n \n</chunk-7>\n<chunk-8>bar')], "source_file string, text string")
    got = chunking.from_markup(files).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chunk_label, r.chunk_text, r.context_before, r.context_after) for r in got] == [(0, "A", "foo", "", "bar"), (1, "", "bar", "foo", "")]


def test_lenient_parse():
    got = parsing.lenient_instances('<think>a {b}</think>\n{"soc_instances":[{"passage":"p","is_soc":"false","secondary_devices":"a, b"},3]} tail')
    assert len(got) == 1
    assert {k: got[0][k] for k in ("passage", "soc_type", "secondary_devices", "affective_register", "narrator_position", "is_soc", "confidence")} == {
        "passage": "p", "soc_type": "other_soc", "secondary_devices": ["a", "b"], "affective_register": "n/a", "narrator_position": "minimal", "is_soc": True, "confidence": "medium"
    }
    assert parsing.lenient_instances(None) == parsing.lenient_instances("{") == []
    assert parsing.strict_instances('```json\n{"instances": [{"passage": "p", "is_soc": false}, {"passage": "q"}]}\n```')[0]["passage"] == "q"
    assert parsing.first_object('x {"a": 1} {"b": 2}') == {"a": 1}


def test_scores(spark):
    df = spark.createDataFrame([("indirect_interior_monologue", "p")], "t string, p string")
    assert df.select(scoring.specificity(F.col("t"))).first()[0] == 1.0
    df = spark.createDataFrame([('He says "the old man" here', "see The Old Man run"), ("one two three four", "x one two three four"), ("a b", "c")], "t string, p string")
    assert [r[0] for r in df.select(scoring.grounding(F.col("t"), F.col("p"))).collect()] == [1.0, 0.5, 0.0]
    df = spark.createDataFrame([('"a b c"', "a b c", False, 0.8)], "t string, p string, s boolean, k double")
    assert df.select(scoring.reward(F.col("t"), F.col("p"), F.col("s"), F.col("k"), F.lit(None).cast("double"))).first()[0] == pytest.approx(0.66)


def test_metrics(spark):
    pairs = spark.createDataFrame([("soc", "soc"), ("soc", "none"), ("none", "none"), ("none", "none")], "y_true string, y_pred string")
    got = {r.label: (r.precision, r.recall, r.f1) for r in evaluation.class_metrics(pairs).collect()}
    assert got["soc"] == (1.0, 0.5, pytest.approx(2 / 3))
    assert got["none"] == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8))
    assert evaluation.summary(pairs).first().accuracy == 0.75
    assert {(r.y_true, r.y_pred): r.n for r in evaluation.confusion(pairs).collect()} == {("none", "none"): 2, ("none", "soc"): 0, ("soc", "none"): 1, ("soc", "soc"): 1}


@pytest.mark.parametrize(("n", "sizes"), [(1, (0, 0, 1)), (2, (0, 1, 1)), (10, (8, 1, 1)), (19, (17, 1, 1)), (20, (16, 2, 2))])
def test_split(spark, n, sizes):
    got = dataset.split(spark.range(n).withColumn("is_soc", F.lit(True)), F.col("id")).groupBy("split").count().collect()
    by = {r["split"]: r["count"] for r in got}
    assert tuple(by.get(k, 0) for k in ("train", "val", "test")) == sizes


def test_kappa_and_report(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y_true string, y_pred string")
    got = evaluation.kappa(pairs).first()
    assert (got.n, got.observed, got.expected) == (4, 0.5, pytest.approx((2 * 1 + 1 * 3) / 16))
    assert got.kappa == pytest.approx((0.5 - 5 / 16) / (1 - 5 / 16))
    assert evaluation.kappa(pairs.where("false")).first().n == 0
    table = {r.label: (r.precision, r.recall, r.support) for r in evaluation.report(pairs).collect()}
    assert table["macro avg"] == (pytest.approx(4 / 9), pytest.approx(0.5), 4)
    assert table["weighted avg"] == (pytest.approx((2 * 1 + 1 / 3) / 4), pytest.approx(0.5), 4)


def test_answers_against_records(spark, tmp_path):
    told = '{"instances": [{"soc_type": "hybrid"}]}'
    data = [("p", True, told, 'x {"instances": [{"passage": "q"}]} y'), ("q", False, "{}", "no"), ("r", True, "broken", "{broken}"), ("s", None, told, "<think>{</think>" + told)]
    pairs = evaluation.answer_pairs(spark.createDataFrame(data, "passage string, is_soc boolean, assistant_json string, raw_output string"))
    got = {r.passage: (r.true_is_soc, r.pred_is_soc, r.true_type, r.pred_type) for r in pairs.collect()}
    assert got == {"p": (True, True, "hybrid", "other_soc"), "q": (False, False, "none", "none"), "r": (True, False, "other_soc", "none"), "s": (False, True, "none", "hybrid")}
    document = json.loads(sinks.write_evaluation(pairs, str(tmp_path / "e")))
    assert document["n_examples"] == 4
    assert document["binary_detection"]["confusion_matrix"] == {"labels": ["none", "soc"], "matrix": [[1, 1], [1, 1]]}
    assert document["type_classification"]["report"]["hybrid"]["support"] == 1
    assert spark.read.json(str(tmp_path / "e/per_example")).count() == 4


def test_traces(spark):
    records = spark.createDataFrame([(0, "the old man ran home", True, "imagery", "old", '{"instances": []}', "a/b"), (1, "x", False, "", "kept", None, None)], "row_id long, passage string, is_soc boolean, soc_type string, think_content string, assistant_json string, chunk_id string")
    named = records.withColumn("passage_id", traces.passage_id("train", F.col("chunk_id"), F.col("passage")))
    assert [r.passage_id for r in named.orderBy("row_id").collect()] == ["train_a_b_" + hashlib.md5(b"the old man ran home").hexdigest()[:10], "train_unk_" + hashlib.md5(b"x").hexdigest()[:10]]
    assert [r.row_id for r in traces.negatives_first(named).collect()] == [1, 0]
    assert [r.row_id for r in traces.negatives_first(named, 1).collect()] == [1]

    def model():
        return lambda prompt, n: [" vague "] * (n - 1) + [f'"{prompt}" is imagery'] if " " in prompt else ["  "] * n

    found = traces.candidates(named, model, F.col("passage"), 3)
    best = traces.with_best(named, found).orderBy("row_id").collect()
    assert [(r.think_content, r.trace_score is None) for r in best] == [('"the old man ran home" is imagery', False), ("kept", True)]

    def no_model():
        raise AssertionError

    again = traces.candidates(named, no_model, F.col("passage"), 3, found.persist())
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in found.collect())
    chats = traces.to_rebuilt(traces.with_best(named, found), "sys").collect()
    assert {c.messages[2].content for c in chats} == {'<think>\n"the old man ran home" is imagery\n</think>\n{"instances": []}', '<think>\nkept\n</think>\n{"instances": []}'}
    back = dataset.from_chat(traces.to_rebuilt(traces.with_best(named, found), "sys")).collect()
    assert {(r.passage, r.think_content, r.is_soc) for r in back} == {("the old man ran home", '"the old man ran home" is imagery', False), ("x", "kept", False)}


def test_long_texts_fold_in_time_with_their_length(spark):
    """A million characters, with and without one of several letters: not each compared with all of those."""
    import time

    frames = [spark.createDataFrame([(t,)], "t string") for t in ("plain text, " * 80_000, "é à text… " * 100_000)]
    shown = [df.select(text.slug(F.col("t")).alias("s")) for df in frames]
    wanted = ["-".join(["plain-text"] * 80_000), "-".join(["e-a-text"] * 100_000)]
    assert [df.first()["s"] for df in shown] == wanted
    began = time.time()
    assert [df.first()["s"] for df in shown] == wanted
    assert time.time() - began < 4


def test_every_character_folds_as_the_library_has_it(spark):
    """All code points that are assigned, one a row and many in a row, and names of files."""
    import sys
    import unicodedata

    chars = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF and unicodedata.category(c) != "Cn"]
    joined = ["".join(chars[i : i + 97]) for i in range(0, len(chars), 97)]
    fold = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    several = [c for c in chars if ord(c) > 127 and len(fold(c)) > 1]
    texts = joined + several + ["", "ﬁn ﬀ e\u0301 Å ½"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", text.ascii_folded(F.col("t"))).collect())
    assert [got[i] for i in range(len(texts))] == [fold(t) for t in texts]
    names = spark.createDataFrame([("Dvořák.txt",), ("Čapek.txt",), ("Erdős.txt",), ("ﬁn.txt",), (None,)], "f string")
    assert [r[0] for r in names.select(text.chunk_id(F.col("f"), F.lit(1))).collect()] == ["dvorak_001", "capek_001", "erdos_001", "fin_001", "null_001"]


def test_one_clustering_and_clashing_columns(spark, sf_dir):
    """Plans over grouped annotations cluster no more, and columns with the operators' own names do no harm."""
    df = golden_rows(spark).withColumns({c: F.lit("x") for c in ("before", "n", "g_row", "n_before", "p_one")})
    numbered = matching.number_groups(matching.cluster(df.drop("g_row", "n_before")))
    grouped = matching.grouped_annotations(df.drop("g_row", "n_before"))
    assert sorted((r.row_id, r.group_id, r.before) for r in numbered.collect()) == sorted((r.row_id, r.group_id, r.before) for r in grouped.collect())
    for name in ("passage_groups", "consensus_moderate", "dataset_records"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" not in plan
    plan = registry.queries()["consensus_moderate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(group_id") == 1


def test_pairs_meet_by_key_and_not_by_token(spark):
    """Rows move once with their tokens; no rows are made or shuffled for each token that two have in common."""
    rows = spark.createDataFrame([(1, "k", "a b c d"), (2, "k", "A, b! x y z"), (3, "k", "..."), (4, "k", None), (5, "l", "a b c d"), (6, None, "a b"), (7, None, "a b"), (8, "k", "q")], "row_id long, key string, passage string")
    got = matching.overlapping_pairs(rows, "key")
    assert [tuple(r) for r in got.collect()] == [(1, 2, 0.5)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "HashAggregate" not in plan


def plan_of(spark, sf_dir, name: str) -> str:
    return registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_group_order_reads_no_text_again(spark, sf_dir):
    """What tables of groups need is stored with the groups; texts are read for the clustering alone."""
    for name in ("group_order", "group_figures", "partial_groups", "passage_groups"):
        plan = plan_of(spark, sf_dir, name)
        assert "documents.parquet" not in plan and "passage" not in plan, name


def test_dataset_records_read_no_text_again(spark, sf_dir):
    """Stored rows are all that is read, and the best row's fields move without its passage."""
    plan = plan_of(spark, sf_dir, "dataset_records")
    assert "documents.parquet" not in plan
    best = re.findall(r"max_by\(struct\(.*?\), struct", plan)
    assert best and not any("passage" in x for x in best)


def test_type_distribution_reads_no_text_again(spark, sf_dir):
    assert "documents.parquet" not in plan_of(spark, sf_dir, "type_distribution")


def test_field_comparison_reads_no_text_again(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "field_comparison")
    assert "documents.parquet" not in plan and "passage" not in plan


def test_cluster_keeps_copies_and_chosen_columns(spark):
    rows = spark.createDataFrame([(1, "c", "a b c", "x"), (1, "c", "a b c", "y"), (None, "c", "q r", "z"), (2, "c", None, "x"), (3, None, "a", "x")], "row_id long, chunk_id string, passage string, more string")
    got = matching.grouped_annotations(rows, columns=["more"])
    assert sorted(got.columns) == ["chunk_group", "chunk_id", "group_id", "more", "row_id"]
    assert sorted((r.more, r.row_id or 0, r.group_id) for r in got.collect()) == [("x", 1, 0), ("x", 2, 1), ("y", 1, 0), ("z", 0, 2)]


def test_ledger(spark, tmp_path):
    chunks = spark.createDataFrame([("f", f"c{i}", "", "text", i, "", "") for i in range(6)], "source_file string, chunk_id string, chunk_label string, chunk_text string, chunk_index int, context_before string, context_after string")
    work, path = annotate.work_list(chunks, ["m1", "m2"]), str(tmp_path / "ledger")

    class Odd(Exception):
        pass

    def failing():
        def client(model, prompt):
            if model == "m2":
                raise Odd("down")
            return '{"instances": []}'

        return client

    done = annotate.run_pending(work, path, failing, batches=3, attempts=2, pause=0.0)
    assert done.count() == 6
    figures = {r.model_label: (r.n_pending, r.n_done) for r in reports.work_figures(chunks, done, ["m1", "m2"]).collect()}
    assert figures == {"m1": (0, 6), "m2": (6, 0)}
    done = annotate.run_pending(work, path, lambda: lambda model, prompt: '{"instances": [{"passage": "p", "is_soc": true}]}', batches=3)
    assert sorted((r.model_label, r.chunk_id) for r in done.collect()) == sorted((m, f"c{i}") for m in ("m1", "m2") for i in range(6))
    ingest.result_stream(spark, path, str(tmp_path / "rows"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 6
    ingest.result_stream(spark, path, str(tmp_path / "rows"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 6


def test_judge(spark):
    df = spark.createDataFrame([("a",), ("b",)], "trace string")

    def client():
        def call(model, text):
            if text == "b":
                raise RuntimeError("down")
            return '{"grounding": 1, "rationale": "x"}'

        return call

    got = {r.trace: (r.grounding, r.skepticism, r.rationale) for r in annotate.judge(df, F.col("trace"), client, "m").collect()}
    assert got == {"a": (1.0, 0.5, "x"), "b": (0.5, 0.5, "")}


def test_one_passage(spark):
    told = '<think> why </think>{"instances": [{"is_soc": true, "passage": "p", "soc_type": "imagery", "explanation": "e"}]}'
    got = annotate.analyse_passage(spark, "text", lambda: lambda model, prompt: told if "text" in prompt else "")
    assert got.select("think_trace", "instances.passage", "raw_output", "error").first() == ("why", ["p"], told, None)
    assert got.select(reports.markdown(F.col("instances"), F.col("think_trace"))).first()[0].startswith("## Reasoning trace\n\nwhy\n\n## Instance 1 — `imagery` (medium)\n> p\n")


def test_required_fields(spark):
    assert parsing.required_instances('t {"instances": [{"is_soc": false, "passage": "p"}]}')[0]["is_soc"] is False
    assert parsing.required_instances("nothing") == []
    with pytest.raises(ValueError, match="passage"):
        parsing.required_instances('{"instances": [{"is_soc": true}]}')


def test_numbered_lines(spark, tmp_path):
    n = 3000
    (tmp_path / "a.jsonl").write_text("".join(f'{{"x": {i}}}\n' + "\n" * (i % 3) for i in range(n)))
    (tmp_path / "b.jsonl").write_text("".join(f'{{"y": {i}}}\n' for i in range(n - 7)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        left = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x long", numbered=True)
        right = readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "y long", numbered=True)
        got = readers.zip_files(left, right).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == n - 7
    assert all(r.x == r.y == r.row_id for r in got)


def test_settings(spark, tmp_path):
    (tmp_path / ".env").write_text("# c\nexport A='x y'\nB=1 # one\nbad line\n")
    env = readers.read_env(str(tmp_path / ".env"))
    assert env == {"A": "x y", "B": "1"}
    (tmp_path / "m.yaml").write_text("models:\n  - label: a\n    model_name: n\n    base_url: u\n    api_key: ${A}\ntracks:\n  t:\n    min_models: 3\n")
    (tmp_path / "m.json").write_text('{"models": [{"label": "a", "model_name": "n", "base_url": "u", "api_key": "${NO}"}]}')
    settings = readers.load_settings(str(tmp_path / "m.yaml"), env)
    assert readers.load_profiles(settings, env)[0].api_key == "x y"
    assert readers.load_tracks(settings)["t"].min_models == 3
    with pytest.raises(ValueError, match="key"):
        readers.load_profiles(readers.load_settings(str(tmp_path / "m.json"), env), env)
    assert readers.load_profiles({}, {"MODEL_NAME": "n", "API_KEY": "k"})[0].label == "n"


def test_arrays_and_splits(spark, tmp_path):
    rows = spark.createDataFrame([(i, "m/1" if i % 3 else "m2", None if i == 4 else f'p"{i}') for i in range(7)], "row_id long, model_label string, passage string")
    paths = sinks.write_results(rows, str(tmp_path / "r"))
    got = {d.name: json.loads(next(d.glob("part*")).read_text()) for d in (tmp_path / "r/json").iterdir() if d.is_dir()}
    assert paths["json"].endswith("json")
    assert [x["row_id"] for x in got["model=m2"]] == [0, 3, 6]
    assert [x["passage"] for x in got["model=m_1"]] == ['p"1', 'p"2', None, 'p"5']
    sinks.write_consensus(rows.where("false"), str(tmp_path / "c"), "t")
    assert next((tmp_path / "c/consensus_t.json").glob("part*")).read_text() == "[]\n"
    assert next((tmp_path / "c/consensus_t.csv").glob("part*")).read_text() == '"row_id","model_label","passage"\n'
    chats = spark.createDataFrame([("train", "a"), ("val", "b"), ("test", "c")], "split string, passage string").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("passage").alias("content"))))
    sinks.write_splits(chats, str(tmp_path / "s"))
    assert {r["split"] for r in spark.read.json(str(tmp_path / "s")).collect()} == {"train", "val", "test", "test_raw"}
    assert spark.read.json(str(tmp_path / "s/split=test_raw")).first().passage == "c"
    assert sinks.csv_text(rows.where("row_id = 1"), ["row_id", "passage", "none"]) == 'row_id,passage\n1,"p""1"\n'
    with pytest.raises(ValueError, match="more than 2"):
        sinks.csv_text(rows, ["row_id"], 2)
    files = spark.createDataFrame([("a b.txt", 1, "y"), ("a b.txt", 0, "x")], "source_file string, chunk_index int, chunk_text string")
    sinks.write_chunk_arrays(files, str(tmp_path / "k"))
    assert [x["chunk_text"] for x in json.loads(next((tmp_path / "k").glob("file=a_b_txt/part*")).read_text())] == ["x", "y"]


def test_unreadable_documents(spark, tmp_path):
    (tmp_path / "c.docx").write_bytes(b"no zip")
    got = readers.read_documents(spark, str(tmp_path), failed=True).collect()
    assert [(r.source_file, r.text, r.error) for r in got] == [("c.docx", None, "not readable as docx")]


def test_token_chunks(spark):
    text = "One two three. Four five\nsix seven.\n\n" + " ".join(f"w{i}" for i in range(25)) + "  end"
    docs = spark.createDataFrame([("A b.txt", text), ("n.txt", None)], "source_file string, text string")
    for strategy in ("sentence", "recursive", "token"):
        got = chunking.token_chunks(docs, strategy, 7, 3).orderBy("chunk_index").collect()
        assert "".join(r.chunk_text for r in got) == text
        assert strategy == "sentence" or all(len(r.chunk_text.split()) <= 7 for r in got)
        assert got[0].chunk_id == "A b_000"
        assert got[1].context_before == got[0].chunk_text[-3:]
    by_chars = chunking.token_chunks(docs, "token", 10, 0, lambda: len).collect()
    assert all(len(r.chunk_text) <= 10 for r in by_chars)
    with pytest.raises(ValueError, match="unknown"):
        chunking.token_chunks(docs, "semantic")


def test_views(spark):
    groups = spark.createDataFrame([(0, "c2", 1), (1, "c1", 3), (2, "c1", 1), (3, "c3", 3)], "group_id long, chunk_id string, n_models int")
    assert [r.group_id for r in reports.sorted_groups(groups).orderBy("place").collect()] == [1, 3, 2, 0]
    instance = [("p", "imagery", ["a"], "minimal", "", "why", ["e1", "e2"], "high", "")]
    df = spark.createDataFrame([(instance, "thought"), ([], "")], "i array<struct<passage string, soc_type string, secondary_devices array<string>, narrator_position string, character_pov string, explanation string, evidence array<string>, confidence string, notes string>>, t string")
    first, second = (r[0] for r in df.select(reports.markdown(F.col("i"), F.col("t"))).collect())
    assert first.startswith("## Reasoning trace\n\nthought\n\n## Instance 1 — `imagery` (high)\n> p\n\n**Explanation:** why\n**Evidence:** e1, e2\n")
    assert "**Character:** —" in first
    assert second == "*No stream-of-consciousness instances found.*"


def test_catalogues(spark):
    a, b = (spark.createDataFrame(x, "id int, author string, title string") for x in ([(1, "A", "T"), (1, "A", "T"), (2, "B", "U")], [(2, "B", "U"), (3, "C", "V")]))
    assert sorted(tuple(r) for r in readers.repeated_books(a, b).collect()) == [(1, 2, 1), (2, 2, 2)]
    assert {r.id: (r.n, r.n_catalogs) for r in catalogues.repeated(spark).collect()} == {2166: (2, 1), 1400: (2, 1), 2775: (2, 2)}
    assert catalogues.negatives(spark).count() == len(catalogues.NEGATIVES) - 2
    assert catalogues.positives(spark).where("id = 2775").first().title == "The Good Soldier"
    there = spark.createDataFrame([("pg00003_c_v.txt",)], "source_file string")
    assert [r.id for r in readers.missing_books(b, there).collect()] == [2]


def test_training_records(spark):
    clustered = matching.number_groups(matching.cluster(golden_rows(spark))).withColumns({c: F.lit("e, f") for c in ("explanation", "evidence", "secondary_devices", "affective_register", "narrator_position", "character_pov", "notes")})
    got = dataset.training_records(dataset.group_records(clustered, 2)).collect()
    assert {r.is_soc for r in got} == {True, False}
    assert all(r.assistant_json == '{"instances": []}' for r in got if not r.is_soc)
    chat = dataset.to_chat(dataset.training_records(dataset.group_records(clustered, 2)), "sys").first()
    assert [m.role for m in chat.messages] == ["system", "user", "assistant"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "in/b.TXT").write_text("bé")
    (tmp_path / "in/c.docx").write_bytes(b"no zip")
    (tmp_path / "in/d.csv").write_text("no")
    assert sorted(tuple(r) for r in readers.read_documents(spark, str(tmp_path / "in")).collect()) == [("a.txt", "é"), ("b.TXT", "bé")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/m1.json").write_text('[{"passage": "p"}, {"passage": "q", "model_label": "x"}]')
    (tmp_path / "r/m2.json").write_text('[{"passage": "r"}]')
    (tmp_path / "r/consensus_a.json").write_text('[{"passage": "no"}]')
    got = readers.read_results(spark, str(tmp_path / "r")).orderBy("row_id").collect()
    assert [(r.row_id, r.model_label, r.passage) for r in got] == [(0, "m1", "p"), (1, "x", "q"), (2, "m2", "r")]
    paths = sinks.write_results(readers.read_results(spark, str(tmp_path / "r")), str(tmp_path / "out"))
    assert spark.read.json(paths["json"], multiLine=True).count() == 3
    assert spark.read.option("header", True).csv(paths["csv"]).count() == 3


def test_annotate_and_resume(spark):
    chunks = spark.createDataFrame([("f", "c0", "", "text", 0, "", ""), ("f", "c1", "", "more", 1, "", "")], "source_file string, chunk_id string, chunk_label string, chunk_text string, chunk_index int, context_before string, context_after string")
    work = annotate.work_list(chunks, ["m1", "m2"])
    left = annotate.pending(work, spark.createDataFrame([("m1", "c0")], "model_label string, chunk_id string"))
    got = annotate.annotate(left, lambda: lambda model, prompt: '{"instances": [{"passage": "%s"}]}' % model)
    parsed = parsing.flatten_results(parsing.parse_answers(got.select("model_label", "chunk_id", "raw")))
    assert sorted((r.chunk_id, r.passage) for r in parsed.collect()) == [("c0", "m2"), ("c1", "m1"), ("c1", "m2")]


def test_chunk_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("One. Two.")
    for more in (1, 2):
        ingest.chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == more
        (tmp_path / "in/b.txt").write_text("Three.")


def test_books_and_config(spark):
    books = readers.catalog(spark, [(1, "A. Author", "One"), (1, "B", "Again"), (2, "C", "Two")])
    assert sorted(r.title for r in books.collect()) == ["One", "Two"]
    assert readers.pick_books(books, author="author").count() == 1
    assert sorted(r.title for r in readers.pick_books(books, ids=[2, 9]).collect()) == ["Two", "pg9"]
    got = readers.fetch_books(books, lambda: lambda url: "w " * 1200 if "files/2/2.txt" in url else None).collect()
    assert [r.id for r in got] == [2]
    assert readers.interpolate("${A} ${B}", {"A": "x"}) == "x ${B}"
    assert readers.load_tracks({"tracks": {"t": {"min_models": 1}}})["t"].min_models == 1
    with pytest.raises(ValueError, match="unknown"):
        readers.choose_models(["a"], ["b"])


def test_whole_texts(spark, tmp_path):
    """Texts that differ, or agree, only after their 40th word, by brute force on all words."""
    from scriptorium.plans import registry

    own = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    same = " ".join(f"s{i}" for i in range(400))
    texts = [f"{own(0)} {same}", f"{own(1)} {same}", own(2) + " " + " ".join(f"a{i}" for i in range(400)), own(2) + " " + " ".join(f"b{i}" for i in range(400)), '{"a": "b" ' * 30]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    q = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    sets = [set(t.lower().split()) for t in texts]
    # document 0 is reported by four annotators, as rows 0 to 3; the others are rows 4, 8, 12, 16
    row = {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 8: 2, 12: 3, 16: 4}
    expected = {(a, b) for b in row for a in row if a < b and len(sets[row[a]] & sets[row[b]]) / min(len(sets[row[a]]), len(sets[row[b]])) >= 0.35}
    assert {(r.a, r.b) for r in q("overlapping_passages")} == expected
    assert {x for p in expected for x in p} == {0, 1, 2, 3, 4}
    group = {r.row_id: r.group_id for r in q("passage_groups")}
    assert len({group[i] for i in (0, 1, 2, 3, 4)}) == 1
    assert len({group[i] for i in (0, 8, 12)}) == 3
    assert {r.doc_id: r.passage for r in q("parsed_answers")} == {i: " ".join(t.split()) for i, t in enumerate(texts)}
