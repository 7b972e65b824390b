"""Token output, packing and counts against the libraries themselves."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import queries as q
from scriptorium.llm.packing import pack, pack_documents, plan_sequences, sequences, token_pieces
from scriptorium.llm.simple8b import decode_blocks, encode_blocks, encode_documents, pack_file, unpack_file
from scriptorium.llm.token_counts import PieceCounter, frequencies, token_counts
from scriptorium.llm.token_output import _starts, read_tokens, token_output, write_tokens
from scriptorium.llm.tokenization import WordEncoder
from tests.llm.helpers import ODD, empty, frame

WORDS, PIECES = q.tokenizer("word_bpe_49k.json"), q.tokenizer("piece_bpe_32k.model")
TEXTS = [t or "" for _, t in ODD]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700), max_size=5))
def test_codec_round_trip(blocks):
    values, sizes = np.array([v for b in blocks for v in b], np.uint64), np.array([len(b) for b in blocks], np.int64)
    words, n, escapes, m = encode_blocks(values, sizes)
    assert (decode_blocks(words, n, sizes, escapes, m) == values).all()


def test_file_round_trip():
    lengths = np.array([0, 1, 5000, 3])
    ids = np.random.default_rng(1).integers(0, 49_408, lengths.sum()).astype(np.uint32)
    data = pack_file(np.arange(4), np.array([True, False, True, True]), lengths, encode_documents(ids, lengths))
    got = list(unpack_file(data, together=4))
    assert (np.concatenate([g[3] for g in got]) == ids).all()
    assert (np.concatenate([g[2] for g in got]) == lengths).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab É.,!'|\n\t▁s")), st.characters(codec="utf-8")), max_size=20), max_size=6))
def test_encoders_equal_libraries(texts):
    import sentencepiece

    ids, n = WordEncoder(WORDS).encode(pa.array(texts, pa.string())) if texts else (np.zeros(0), np.zeros(0))
    want = library(texts) if texts else []
    assert ids.tolist() == [i for x in want for i in x]
    assert n.tolist() == [len(x) for x in want]
    if texts:
        model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        words, owner, place, n = frequencies(pa.array(texts, pa.string()))
        pieces = PieceCounter(PIECES).count(words.to_pylist())
        assert np.bincount(owner, pieces[place] * n, len(texts)).tolist() == [len(model.encode(t)) for t in texts]


def test_token_output(spark):
    got = token_output(frame(spark), WORDS).collect()
    want = sorted((i is not None, i or 0, ids + [2]) for (i, _), ids in zip(ODD, library(TEXTS), strict=True))
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i if has else None for has, i, _ in want]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i if has else -1, len(x), crc(x)) for has, i, x in want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert token_output(empty(spark), WORDS).count() == 0


def test_ids_of_many_rows_fill_several_files(spark, tmp_path):
    """One id of most rows, nulls, and ids beyond 2^53 that floating point could not tell apart."""
    big = (1 << 60) + 1
    data = [(7, f"text {i} " + "word " * 40) for i in range(90)] + [(None, f"none {i}") for i in range(30)] + [(big + i, f"big {i} " * 9) for i in range(30)] + [(i, f"small {i}") for i in range(-5, 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = f"file://{tmp_path}/t"
    files = write_tokens(docs, out, WORDS, file_chars=1500)
    got = sorted(read_tokens(spark, out, files, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted((i for i, _ in data), key=lambda i: (i is not None, i))
    assert sum(r.n_documents for r in files.collect()) == len(data)
    assert files.count() > 6
    assert max(r.n_documents for r in files.collect()) < 60


def test_files_hold_ids(spark, tmp_path):
    out = f"file://{tmp_path}"
    files = write_tokens(frame(spark), out, WORDS, file_chars=1000)
    assert files.count() > 1
    got = {r.doc_id: r.ids for r in read_tokens(spark, out, files, with_ids=True).collect()}
    assert got[4] == [*library(["one"])[0], 2]


def test_packing(spark):
    got = pack_documents(frame(spark), WORDS).collect()
    assert len(got) >= len(ODD)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(len(x) + 1 for x in library(TEXTS))
    assert sum(r.length for r in got) == total
    assert len(bins) <= -(-total // 4096) + 1
    assert pack_documents(empty(spark), WORDS).count() == 0


def test_sequences_hold_ids(spark):
    pieces = token_pieces(frame(spark), WORDS, with_ids=True).persist()
    got = sequences(pack(pieces)).collect()
    assert all(len(r.ids) == r.n_tokens <= 4096 for r in got)
    assert sum(r.n_tokens for r in got) == sum(len(x) + 1 for x in library(TEXTS))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=200))
def test_plan_uses_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=61)
    used = np.zeros(61, int)
    plan = plan_sequences(counts, 60)
    for pattern, times in plan:
        assert sum(pattern) <= 60
        for k in pattern:
            used[k] += times
    assert (used == counts).all()
    # never worse than first fit in descending order by more than one in ten
    bins: list[int] = []
    for k in sorted(lengths, reverse=True):
        i = next((i for i, b in enumerate(bins) if b + k <= 60), None)
        if i is None:
            bins.append(k)
        else:
            bins[i] += k
    assert sum(t for _, t in plan) <= len(bins) * 1.1 + 1


def test_replaces_smallest_by_two():
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert plan_sequences(counts, 10)[0][0] == (6, 2, 2)
    assert plan_sequences(np.bincount([6, 5, 5], minlength=11), 10) == [((5, 5), 1), ((6,), 1)]


def test_packing_takes_lengths_within_capacity(spark):
    with pytest.raises(ValueError, match="from 3 to 11"):
        pack(spark.createDataFrame([(1, 11), (2, 3)], "doc_id long, length long"), 10)


def test_ranks_over_shares(spark):
    """One length of most pieces, ranked in many shares: each sequence is full and each piece has its place."""
    pieces = spark.createDataFrame([(i, 3) for i in range(500)] + [(1000 + i, 4) for i in range(100)], "doc_id long, length long").persist()
    got = pack(pieces, 10, rows_per_rank=7).collect()
    assert len(got) == len({(r.sequence_id, r.offset) for r in got}) == 600
    filled = np.bincount([r.sequence_id for r in got], [r.length for r in got])
    assert filled.max() == 10
    assert (filled == 10).sum() == 100


def test_starts_of_files(spark):
    files = spark.createDataFrame([(k, f"part-{k:06d}.s8b", 10 + k) for k in range(10)], "part int, file string, n_tokens long")
    want = [(k, sum(10 + j for j in range(k))) for k in range(10)]
    assert sorted(tuple(r) for r in _starts(files, 3).collect()) == sorted(tuple(r) for r in _starts(files).collect()) == want


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark), PIECES).collect())
    want = sorted((i or -1, len(t.encode()), n := len(model.encode(t)), n > 4096) for (i, _), t in zip(ODD, TEXTS, strict=True))
    assert got == want
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark), PIECES, block_chars=100).collect()) == want
    assert token_counts(empty(spark), PIECES).count() == 0


def whole_table(spark, sf_dir):
    """Documents with the library's ids of their whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: (r.text or "", ids) for r, ids in zip(docs, library([r.text or "" for r in docs]), strict=True)}


def test_token_output_of_the_whole_table(spark, sf_dir):
    want, start = [], 0
    for i, (_, ids) in sorted(whole_table(spark, sf_dir).items()):
        want.append((i, start, len(ids) + 1, crc([*ids, 2])))
        start += len(ids) + 1
    assert sorted(tuple(r) for r in q.op2_token_output(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_packing_of_the_whole_table(spark, sf_dir):
    want = []
    for i, (_, ids) in whole_table(spark, sf_dir).items():
        ids = [*ids, 1]
        want += [(i, k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    got = q.op5_best_fit_packing(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]]
        assert ends[-1] <= 4096


def test_token_counts_of_the_whole_table(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, (t, _) in whole_table(spark, sf_dir).items())
    assert sorted(tuple(r) for r in q.op9_token_counts(spark, sf_dir).collect()) == want


def test_a_full_table_keeps_what_comes_again():
    """Strings of every slice are encoded once, though other strings fill the table again and again."""
    encoder = WordEncoder(WORDS, most=30)
    asked, learn = Counter(), encoder._learn
    encoder._learn = lambda words, *more: (asked.update(words), learn(words, *more))
    for k in range(8):
        texts = [f"always été again {chr(97 + k)}{chr(97 + i)}q 1{k}{i}" for i in range(20)]
        ids, lengths = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]
        assert len(encoder.at) <= 30 // 2 + 2 * 50
    assert [asked[w] for w in ("always", "été", "again")] == [1, 1, 1]
