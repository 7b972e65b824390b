"""Chats as tokens and labels, and chunks by subject: goldens, odd rows, and the library by brute force."""

from __future__ import annotations

import re
import zlib
from math import ceil, log, sqrt

import numpy as np
from pyspark.sql import functions as F

from scriptorium.operators import chat, semantic
from scriptorium.plans import registry
from tests.conftest import rows


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.add_special_tokens(["<|im_start|>", "<|im_end|>", "<think>", "</think>"])
    return t


def expected(spark, sf_dir) -> dict[int, tuple[list[int], list[int]]]:
    t, texts = library(), {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        body = f'<think>{r.text}</think>\n{{"instances": []}}' if r.role == "assistant" else r.text
        texts[r.conv_id] = texts.get(r.conv_id, "") + f"<|im_start|>{r.role}\n{body}<|im_end|>\n"
    end, out = t.token_to_id("</think>"), {}
    for k, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids[:1024]
        last = max((i for i, x in enumerate(ids) if x == end), default=-1)
        out[k] = ids, [-100 if i <= last else x for i, x in enumerate(ids)]
    return out


def crc(xs) -> int:
    return zlib.crc32(" ".join(map(str, xs)).encode())


def test_ids_and_labels_against_the_library(spark, sf_dir):
    want = expected(spark, sf_dir)
    got = {r.conv_id: (r.n_tokens, r.n_ignored, r.ids_crc32, r.labels_crc32) for r in registry.chat_tokens(spark, sf_dir).collect()}
    assert got == {k: (len(x), y.count(-100), crc(x), crc(y)) for k, (x, y) in want.items()}
    assert any(n > 0 for _, n, _, _ in got.values())
    batches = {r.conv_id: (r.batch, r.length, r.n_tokens, r.n_ignored, r.ids_crc32) for r in registry.chat_batches(spark, sf_dir).collect()}
    place = {k: i // 16 for i, k in enumerate(sorted(want))}
    longest = {b: max(len(want[k][0]) for k in want if place[k] == b) for b in place.values()}
    for k, (ids, labels) in want.items():
        more = longest[place[k]] - len(ids)
        assert batches[k] == (place[k], longest[place[k]], len(ids), labels.count(-100) + more, crc(ids + [50256] * more))


def test_template_and_odd_messages(spark):
    data = [(1, [("user", "a"), ("assistant", "b {role}")]), (2, [(None, None)]), (3, []), (4, None)]
    df = spark.createDataFrame(data, "k long, messages array<struct<role: string, content: string>>")
    got = dict(df.select("k", chat.ChatTemplate().text(F.col("messages"), answer_next=True)).collect())
    assert got[1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb {role}<|im_end|>\n<|im_start|>assistant\n"
    assert got[2] == "<|im_start|>\n<|im_end|>\n<|im_start|>assistant\n"
    assert got[3] == got[4] == "<|im_start|>assistant\n"


def test_labels(spark):
    data = [(0, []), (1, [1, 2, 3]), (2, [9, 1, 9, 2]), (3, [9]), (4, [1, 8, 2]), (5, [8, 9, 1])]
    df = spark.createDataFrame(data, "k long, ids array<int>")
    one = dict(df.select("k", chat.think_labels(F.col("ids"), [9])).collect())
    assert one == {0: [], 1: [1, 2, 3], 2: [-100, -100, -100, 2], 3: [-100], 4: [1, 8, 2], 5: [-100, -100, 1]}
    # a tag of several tokens: up to the last one of any of them
    assert dict(df.select("k", chat.think_labels(F.col("ids"), [9, 8])).collect())[4] == [-100, -100, 2]
    assert dict(df.select("k", chat.think_labels(F.col("ids"), [])).collect())[3] == [9]


def test_encoding_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * (i * 3)) for i in range(40)] + [(99, None)], "k long, chat_text string")
    encoder = lambda: lambda texts: [[ord(c) for c in t] for t in texts]
    got = {r.k: len(r.input_ids) for r in chat.encoded(df, encoder, 50, batch_chars=7).collect()}
    assert got == {**{i: min(50, 3 * i) for i in range(40)}, 99: 0}
    assert chat.encoded(df.where("false"), encoder, 5).count() == 0
    padded = chat.padded_batches(chat.encoded(df, encoder, 50).withColumn("labels", F.col("input_ids")).withColumn("p_n", F.lit("own")).drop("p_n"), "k", 4, 0)
    for r in padded.collect():
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask)
        assert sum(r.attention_mask) == got[r.k]


def brute_distances(texts: list[str]) -> list[list[float]]:
    """From the definition, by sets and sums in floating point."""
    from hashlib import md5

    split = [[s for s in re.split(r"(?<=[.!?])(?=\s+[A-Z])", t) if s] for t in texts]
    bags = [[{} for _ in s] for s in split]
    for own, bag in zip(split, bags, strict=True):
        for s, b in zip(own, bag, strict=True):
            for w in re.findall(r"[^\W_]+", s.lower()):
                p = int(md5(w.encode()).hexdigest()[:8], 16) % 262144
                b[p] = b.get(p, 0) + 1
    every = [b for bag in bags for b in bag]
    weight = {p: int(1000 * log((1 + len(every)) / (1 + sum(p in b for b in every)))) for b in every for p in b}
    out = []
    for bag in bags:
        v = [{p: c * weight[p] for p, c in b.items()} for b in bag]
        norm = [sqrt(sum(x * x for x in b.values())) for b in v]
        out.append([1 - sum(x * b.get(p, 0) for p, x in a.items()) / (n * m) if n and m else 1.0 for a, b, n, m in zip(v, v[1:], norm, norm[1:], strict=False)])
    return out


TEXTS = ["The cat sat. The cat slept. The cat purred. Ships sail far. Ships sail west. A whale!", "One only", "Same here. Same here. Same here.", "Ürban ölfield. NAÏVE café? Über all. ... X", "word " * 300]


def test_breaks_by_brute_force(spark):
    docs = spark.createDataFrame([(f"d{i}.txt", t) for i, t in enumerate(TEXTS)] + [("null.txt", None), ("empty.txt", ""), (None, "A b. C d.")], "source_file string, text string").withColumn("position", F.lit("x"))
    want = brute_distances([*TEXTS, "A b. C d."])
    got = semantic.sentence_breaks(docs, 50.0).collect()
    for name, d in zip([f"d{i}.txt" for i in range(len(TEXTS))] + [None], want, strict=True):
        own = sorted((r.position, r.distance, r.is_break) for r in got if r.source_file == name)
        assert np.allclose([x for _, x, _ in own], d, atol=1e-9)
        if d:
            limit = sorted(d)[ceil(len(d) / 2) - 1]
            assert [b for _, _, b in own] == [x >= limit - 1e-9 and x > 1e-9 for x in d]
    assert not [r for r in got if r.source_file in ("null.txt", "empty.txt")]


def test_chunks_join_to_the_text(spark, sf_dir):
    docs = spark.createDataFrame([(f"d{i}.txt", t) for i, t in enumerate(TEXTS)] + [("null.txt", None), ("empty.txt", "")], "source_file string, text string")
    got = semantic.semantic_chunks(docs, 8, 3, 60.0, 2).collect()
    for i, t in enumerate(TEXTS):
        own = sorted((r.chunk_index, r.chunk_text, r.context_before, r.chunk_id, r.chunk_label) for r in got if r.source_file == f"d{i}.txt")
        assert "".join(x[1] for x in own) == t
        assert [x[0] for x in own] == list(range(len(own)))
        assert all(len(x[1].split()) <= 8 or len(semantic.split_sentences(x[1])) == 1 for x in own)
        assert [x[2] for x in own[1:]] == [x[1][-3:] for x in own[:-1]]
        assert own[0][3:] == (f"d{i}_000", "Chunk 1")
    assert {r.source_file for r in got} == {f"d{i}.txt" for i in range(len(TEXTS))}
    counted = semantic.semantic_chunks(docs, 20, 0, make_counter=lambda: len, weights=np.ones(64, np.int64))
    assert all(len(r.chunk_text) <= 20 or len(semantic.split_sentences(r.chunk_text)) == 1 for r in counted.collect())
    assert semantic.semantic_chunks(docs.where("false")).count() == 0


def test_packing():
    assert semantic.packed([3, 3, 3, 9, 1], [False, False, False, False], 6, 0) == [0, 0, 1, 2, 3]
    assert semantic.packed([1, 1, 1, 1], [True, True, True], 100, 2) == [0, 0, 1, 1]
    assert semantic.packed([], [], 5, 1) == []
    assert semantic.subject_breaks([], 95) == []
    assert semantic.subject_breaks([0.0, 0.0], 50) == [False, False]
    assert semantic.subject_breaks([0.1, 0.9, 0.5], 95) == [False, True, False]


def test_queries_agree_in_parts(spark, sf_dir):
    """Weights do not depend on how the documents are dealt over tasks."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.format_string("doc %d.txt", "doc_id").alias("source_file"), "text")
    assert (semantic.term_weights(d) == semantic.term_weights(d.repartition(5))).all()
    assert rows(semantic.semantic_chunks(d, 50, 0)) == rows(semantic.semantic_chunks(d.repartition(3), 50, 0))


def test_the_encoder_sees_few_characters_at_once(spark):
    """200,000 characters at most, or one text."""
    chats = spark.createDataFrame([(i, "x" * 3_000) for i in range(300)] + [(300, "y" * 250_000)], "i long, chat_text string").coalesce(1)

    def make():
        def encode(texts):
            size = sum(map(len, texts))
            return [[size, len(texts)] for _ in texts]

        return encode

    got = [tuple(r.input_ids) for r in chat.encoded(chats, make, 10).collect()]
    assert len(got) == 301 and all(size <= 200_000 or n == 1 for size, n in got) and (250_000, 1) in got
