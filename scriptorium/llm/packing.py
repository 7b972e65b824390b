"""Best-two-fit packing of tokenized documents into sequences of fixed length.

Which pieces share a sequence depends on their lengths alone, and lengths are bounded by the sequence
length. So the plan is made on the driver from the histogram of lengths (at most `capacity` numbers,
whatever the input's size): each step builds one sequence by the method and repeats it as often as the
histogram allows. The pieces are then ranked within their length and find their place by an interval join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if, column_of, give_back, slices, text_array, text_column, written
from scriptorium.llm.tokenization import word_encoder
from scriptorium.llm.token_output import with_end

MOST_BROADCAST = 400_000


class _Lengths:
    """The lengths that still have unpacked pieces, with search for the largest at most x."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.live = np.flatnonzero(counts)

    def largest(self, most: int, taken: Counter) -> int:
        """The largest length <= most that has a piece beyond those taken; 0 if there is none."""
        i = int(np.searchsorted(self.live, most, "right")) - 1
        while i >= 0:
            k = int(self.live[i])
            if self.counts[k] > taken[k]:
                return k
            i -= 1
        return 0

    def best_pair(self, most: int, taken: Counter) -> tuple[int, int]:
        """Two lengths with the largest sum <= most; ties take the longer first length. (0, 0) if there are none."""
        left = self.counts[self.live].copy()
        for k, n in taken.items():
            i = int(np.searchsorted(self.live, k))
            if i < len(self.live) and self.live[i] == k:
                left[i] -= n
        free = self.live[left > 0]
        many = dict(zip(free.tolist(), left[left > 0].tolist(), strict=True))
        if not len(free):
            return 0, 0
        j = np.searchsorted(free, most - free, "right") - 1
        ok = j >= 0
        other = free[np.maximum(j, 0)]
        alone = np.array([many[k] < 2 for k in free.tolist()])
        same = ok & (other == free) & alone  # the same piece can't be taken twice
        other = np.where(same, free[np.maximum(j - 1, 0)], other)
        ok &= ~(same & (j < 1))
        if not ok.any():
            return 0, 0
        total = np.where(ok, free + other, -1)
        i = int(len(total) - 1 - np.argmax(total[::-1]))
        return int(free[i]), int(other[i])


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how many sequences) that use up counts[length] pieces of every length.

    A sequence is filled greedily with the largest piece that fits. If a gap remains, its smallest
    piece is replaced with the two unpacked pieces that fit the gap and its place together most
    tightly, if that is tighter than before. The pattern is then repeated while pieces last, which
    leaves one of its lengths with fewer pieces than the pattern needs.
    """
    lengths = _Lengths(counts.astype(np.int64).copy())
    out = []
    while len(lengths.live):
        taken: Counter = Counter()
        pattern, gap = [], capacity
        while gap and (k := lengths.largest(gap, taken)):
            # all of the same length that fit at once
            n = int(min(gap // k, lengths.counts[k] - taken[k]))
            pattern += [k] * n
            taken[k] += n
            gap -= n * k
        if gap:
            small = pattern[-1]
            taken[small] -= 1
            a, b = lengths.best_pair(gap + small, taken)
            if a + b > small:
                pattern[-1:] = [a, b]
        need = Counter(pattern)
        times = int(min(lengths.counts[k] // n for k, n in need.items()))
        for k, n in need.items():
            lengths.counts[k] -= times * n
        if any(not lengths.counts[k] for k in need):
            lengths.live = np.flatnonzero(lengths.counts)
        out.append((tuple(sorted(pattern, reverse=True)), times))
    return out


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of docs: only longer documents are cut.

    A null text is empty and gives one piece with the end id alone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file)
        for b in slices(batches, 2_000_000):
            ids, lengths = with_end(*encoder.encode(text_array(b)), end_id)
            ids = ids.astype("<u4")
            n = -(-lengths // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            size = np.minimum(capacity, lengths[row] - start)
            ends = np.cumsum(size)
            crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), size.tolist(), strict=True)]
            cols = [column_of(b, "doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        # the worker goes on to other stages' tasks, which need the memory
        encoder.forget()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_rank: int = 10_000) -> DataFrame:
    """Give each piece a sequence_id and its offset there; pieces has a column `length` of 1 to capacity.

    `pieces` must be stored data, as it is read twice. Ranks within a length are counted in shares of
    about `rows_per_rank` pieces, so that a length that a third of all pieces have is dealt over many
    tasks. All other columns are kept as they are; an empty table gives an empty one. A length outside
    1 to capacity is an error.
    """
    spark = pieces.sparkSession
    keys = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ends = pieces.agg(F.min("length").alias("low"), F.max("length").alias("high")).first()
    if ends["low"] is not None and (ends["low"] < 1 or ends["high"] > capacity):
        raise ValueError(f"lengths are from {ends['low']} to {ends['high']}, not from 1 to {capacity}")
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        counts[r["length"]] = r["n"]
    rows, base, used = [], 0, np.zeros(capacity + 1, np.int64)
    for pattern, times in plan_sequences(counts, capacity):
        offset = 0
        for k, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append((k, int(used[k]), int(used[k]) + n * times, base, n, offset))
            used[k] += n * times
            offset += n * k
        base += times
    # one row for each length of a pattern; their number depends on the capacity, not on the input
    schema = "p_length long, rank_from long, rank_to long, first_sequence long, per_sequence long, first_offset long"
    plan = spark.createDataFrame(rows, schema)
    # a length's intervals follow each other without gaps; each one is also listed under the blocks of ranks that it meets
    block = max(1, int(counts.sum()) // max(1, len(rows)))
    plan = plan.withColumn("p_block", F.explode(F.sequence(F.floor(F.col("rank_from") / block), F.floor((F.col("rank_to") - 1) / block))))
    shares = F.lit((counts // rows_per_rank + 1).tolist())[F.col("length").cast("int")]
    salted = pieces.withColumn("p_share", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keys if c in ("doc_id", "piece", "ids_crc32")]), shares).cast("int"))
    before = salted.groupBy("length", "p_share").agg(F.count("*").alias("n")).select(F.col("length").alias("b_length"), F.col("p_share").alias("b_share"), (F.sum("n").over(W.partitionBy("length").orderBy("p_share")) - F.col("n")).alias("p_base"))
    order = [F.col(f"`{c}`") for c in ("doc_id", "piece", "ids_crc32") if c in keys]
    ranked = salted.withColumn("p_rank", F.row_number().over(W.partitionBy("length", "p_share").orderBy(*order)) - 1)
    placed = ranked.join(before, (F.col("length") == F.col("b_length")) & (F.col("p_share") == F.col("b_share"))).withColumn("p_rank", F.col("p_rank") + F.col("p_base"))
    here = (F.col("length") == F.col("p_length")) & (F.floor(F.col("p_rank") / block) == F.col("p_block")) & (F.col("rank_from") <= F.col("p_rank")) & (F.col("p_rank") < F.col("rank_to"))
    found = placed.join(broadcast_if(plan, MOST_BROADCAST), here)
    local = F.col("p_rank") - F.col("rank_from")
    return found.select(
        *[F.col(f"`{c}`") for c in keys],
        (F.col("first_sequence") + F.floor(local / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (local % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Tokenize docs once, store the pieces, and pack them (see token_pieces and pack)."""
    return pack(written(token_pieces(docs, tokenizer_file, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: (sequence_id, n_tokens, ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
