"""Token counts without ids: pieces are counted once per distinct pre-token, joined to frequencies, and summed."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import as_bytes, column_of, distinct_words, from_bytes, gathered, per_text, text_array, text_column, written

_SPACE = "▁"
_RUNS = re.compile(f"\n{_SPACE}*[^{_SPACE}\n]*|{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text for a sentencepiece BPE model: no piece spans two of them.

    A pre-token that begins with a line feed stands as it is; after a carriage return stands one
    that is given whole; any other has one space before it that is not written out. Joined they
    give the text with the leading space that the library adds.
    """
    found = _RUNS.findall(_SPACE + text.replace(" ", _SPACE)) if text else []
    return [x[1:] if x[0] == _SPACE and len(x) > 1 and x[1] != _SPACE else x if x[0] == "\n" else "\r" + x for x in found]


@cache
def piece_counter(model_file: str) -> PieceCounter:
    """The worker process's counter for a model."""
    return PieceCounter(model_file)


class PieceCounter:
    """Numbers of pieces of pre-tokens."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.opens = np.array([p.startswith(_SPACE) for p in pieces])
        for piece in pieces:
            if re.search(f"[^{_SPACE}]{_SPACE}|.\n|\n.", piece):
                raise ValueError(f"piece {piece!r} spans two pre-tokens of this operator")

    def count(self, tokens: list[str], together: int = 256) -> np.ndarray:
        """The number of pieces of each pre-token; many are given to the library as one line of words."""
        n = np.zeros(len(tokens), np.int64)
        plain = [i for i, t in enumerate(tokens) if _SPACE not in t]
        for k in range(0, len(plain), together):
            part = plain[k : k + together]
            ids = np.array(self.model.encode(" ".join([tokens[i] for i in part])))
            first = np.flatnonzero(self.opens[ids])
            # a token that begins with a line feed has the space before it in this line only
            n[part] = np.diff(np.append(first, len(ids))) - [tokens[i][0] == "\n" for i in part]
        for i in set(range(len(tokens))) - set(plain):
            t = tokens[i]
            n[i] = len(self.model.encode(t)) - 1 if t[0] == "\n" else len(self.model.encode("\n" + t[1:])) - 2
        return n


def frequencies(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts; and for each text and its distinct ones: the text, the place among them, how often."""
    rare = pc.match_substring_regex(texts, "^[ \n]| $")
    for x in ("  ", " \n", "\n ", _SPACE):
        rare = pc.or_(rare, pc.match_substring(texts, x))
    rare = rare.to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
    usual = np.flatnonzero(~rare)
    place, words, sizes = distinct_words(pc.replace_substring(texts.take(pa.array(usual)), "\n", " \n"))
    pairs, n = np.unique(np.repeat(usual, sizes) * (1 << 32) + place, return_counts=True)
    owner, place = pairs >> 32, pairs & 0xFFFFFFFF
    if rare.any():
        owners, tokens, often = [], [], []
        for i in np.flatnonzero(rare).tolist():
            found = Counter(pre_tokens(texts[i].as_py()))
            owners += [i] * len(found)
            tokens += found.keys()
            often += found.values()
        coded = pa.chunked_array([words, pa.array(tokens, pa.string())]).combine_chunks().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        place = np.concatenate([at[place], at[len(at) - len(tokens) :]])
        owner, n = np.concatenate([owner, np.array(owners, np.int64)]), np.concatenate([n, np.array(often, np.int64)])
        order = np.argsort(owner, kind="stable")
        owner, place, n = owner[order], place[order], n[order]
    return words, owner, place, n


_OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_BLOCKS = "block long, rows binary, names array<struct<bucket: int, names: binary>>"


def _packed(names: list[bytes]) -> bytes:
    """Strings as one compressed value."""
    sizes = np.fromiter(map(len, names), np.uint32, len(names))
    return zlib.compress(np.uint32(len(names)).tobytes() + sizes.tobytes() + b"".join(names), 1)


def _unpacked(value: bytes) -> list[str]:
    data = zlib.decompress(value)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)).tolist()
    return [data[s:e].decode() for s, e in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 16_000_000) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs.

    Null and empty texts have no bytes and no tokens. Null and repeated ids give rows of their own.
    Other columns are not read. Blocks of about `block_chars` bytes of text hold their documents' pre-token
    frequencies. A block names each of its pre-tokens once, in buckets by a hash, as many as there are blocks
    but between 32 and 20,000. A bucket's task keeps a table of its names and encodes each distinct one once in the whole
    run; the counts return to the blocks, where they meet the frequencies and are summed.
    """
    text = text_column(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.spark_partition_id().cast("long").alias("part"))
    size = rows.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    buckets = int(min(20_000, max(32, size // block_chars)))

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(gathered(batches, block_chars)):
            words, owner, place, n = frequencies(text_array(b))
            raw = words.cast(pa.binary())
            bucket = np.fromiter(map(zlib.crc32, raw.to_pylist()), np.int64, len(raw)) % buckets
            order = pc.sort_indices(pa.table({"bucket": bucket, "name": raw}), [("bucket", "ascending"), ("name", "ascending")]).to_numpy()
            back = np.empty(len(order), np.int32)
            back[order] = np.arange(len(order), dtype=np.int32)
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (back[place], n.astype(np.int32))]
            counted = pa.RecordBatch.from_arrays([column_of(b, "doc_id"), column_of(b, "n_bytes"), *lists], names=["doc_id", "n_bytes", "place", "n"])
            bucket, names = bucket[order], raw.take(pa.array(order)).to_pylist()
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist() if len(bucket) else []
            parts = [{"bucket": int(bucket[i]), "names": _packed(names[i:j])} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            kind = pa.list_(pa.struct([("bucket", pa.int32()), ("names", pa.binary())]))
            yield pa.RecordBatch.from_arrays([pa.array([(column_of(b, "part")[0].as_py() << 32) + k], pa.int64()), pa.array([as_bytes(counted)], pa.binary()), pa.array([parts], kind)], names=["block", "rows", "names"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, own, known = piece_counter(model_file), None, {}
        for b in batches:
            out = []
            for bucket, value in zip(column_of(b, "bucket").to_pylist(), column_of(b, "names").to_pylist(), strict=True):
                if bucket != own:
                    own, known = bucket, {}
                names = _unpacked(value)
                if new := [x for x in names if x not in known]:
                    known.update(zip(new, counter.count(new).tolist(), strict=True))
                out.append(zlib.compress(np.fromiter(map(known.__getitem__, names), np.uint32, len(names)).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([column_of(b, "block"), column_of(b, "bucket"), pa.array(out, pa.binary())], names=["of_block", "bucket", "counts"])

    def total(key: tuple, blocks: pa.Table, counts: pa.Table) -> pa.Table:
        values = counts.sort_by("bucket")["counts"].to_pylist()
        pieces = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(zlib.decompress(x), np.uint32) for x in values)]).astype(np.int64)
        out = []
        for value in blocks["rows"]:
            rows = from_bytes(value)
            sizes = pc.list_value_length(column_of(rows, "n")).to_numpy(zero_copy_only=False)
            n = per_text(pieces[column_of(rows, "place").flatten().to_numpy()] * column_of(rows, "n").flatten().to_numpy(), sizes)
            out.append(pa.table({"doc_id": column_of(rows, "doc_id"), "n_bytes": column_of(rows, "n_bytes"), "n_tokens": n, "over_limit": n > limit}))
        return pa.concat_tables(out)

    blocks = written(rows.mapInArrow(block, _BLOCKS), "token-frequencies")
    named = blocks.select("block", F.explode("names").alias("x")).select("block", "x.bucket", "x.names")
    # rows that a task holds are dealt by their bucket and sorted, so a bucket's rows follow each other
    counts = named.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(count, "of_block long, bucket int, counts binary")
    return blocks.select("block", "rows").groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(total, _OUT)
