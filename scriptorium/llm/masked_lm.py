"""Masked pseudo-likelihood: a window network predicts every token from both sides.

A token's probability is that of its class, given the classes beside it, times the word's share of its class.
The most frequent words of the whole corpus are a class each, other words share classes by their ends; shares
come from the counts of all words, so the vocabulary is as large as the corpus makes it. The network sees two
classes on each side, has one hidden layer, and two softmax layers: over groups of classes, and over the
classes of a group. Tasks train copies of it on their own texts, and the copies' weighted means, taken in
steps, are the next round's start. A document's score is the sum of its tokens' log-probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import column_of, per_text, slices, text_array, text_column, written

SIDES = (-2, -1, 1, 2)


@dataclass(frozen=True)
class Classes:
    """Word classes: `words` have one each, the others one of `shared` by a hash of their last two characters."""

    words: dict[str, int]
    shared: int

    @property
    def size(self) -> int:
        return len(self.words) + self.shared

    def of(self, words: pa.Array | list[str]) -> np.ndarray:
        words = pa.array(words, pa.string()) if isinstance(words, list) else words
        ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        hashed = np.array([len(self.words) + zlib.crc32(e.encode()) % self.shared for e in ends.dictionary.to_pylist()], np.int64)
        own = pc.index_in(words, value_set=pa.array(self.words, pa.string()))
        shared = own.is_null().to_numpy(zero_copy_only=False)
        return np.where(shared, hashed[ends.indices.to_numpy(zero_copy_only=False)], own.fill_null(0).to_numpy(zero_copy_only=False))


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-case words between white space: places among the distinct ones, those, words per text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, counts


@dataclass(frozen=True)
class Shares:
    """Counts of the words: `words` has the frequent ones with their `log_n`, `rest` (word, n) all others.

    `log_all` is for each class the logarithm of its tokens and one more, which stands for all unseen words;
    it is 0 for a class of one word, whose share is 1.
    """

    words: pa.Array
    log_n: np.ndarray
    log_all: np.ndarray
    rest: DataFrame


def beside(own: np.ndarray, counts: np.ndarray, edge: int) -> np.ndarray:
    """The classes beside each token of texts of `counts` tokens, of own's type; `edge` stands for a text's edge."""
    gap = 2
    padded = np.full(len(own) + gap * (len(counts) + 1), edge, own.dtype)
    at = np.arange(len(own)) + gap * (np.repeat(np.arange(len(counts)), counts) + 1)
    padded[at] = own
    out = np.empty((len(own), len(SIDES)), own.dtype)
    for i, s in enumerate(SIDES):
        out[:, i] = padded[at + s]
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    """The columns' probabilities, in place: a column for each token, as short rows are slow to add up."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


class Network:
    """The window network; its numbers lie in one float32 array, so that copies are averaged at once."""

    def __init__(self, classes: int, hidden: int, flat: np.ndarray | None = None) -> None:
        self.classes, self.hidden = classes, hidden
        self.width = math.isqrt(classes - 1) + 1
        groups = -(-classes // self.width)
        shapes = [(len(SIDES), classes + 1, hidden), (hidden,), (hidden, classes), (classes,), (hidden, groups), (groups,)]
        sizes = [int(np.prod(s)) for s in shapes]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else flat.astype(np.float32)
        cuts = np.cumsum([0, *sizes])
        self.side, self.bias, self.out, self.base, self.group_out, self.group_base = (self.flat[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], shapes, strict=True))
        # both output layers with their bases as a last row, for inputs with a last column of ones
        self.rooms: dict[str, np.ndarray] = {}
        self.layer, self.group_layer = self.flat[cuts[2] : cuts[4]].reshape(hidden + 1, classes), self.flat[cuts[4] :].reshape(hidden + 1, groups)

    @classmethod
    def fresh(cls, frequency: np.ndarray, hidden: int, seed: int = 7) -> Network:
        """Small random weights, and the classes' frequencies as the first guess."""
        net = cls(len(frequency), hidden)
        rng = np.random.default_rng(seed)
        net.side[:] = rng.normal(0, 0.1, net.side.shape)
        net.out[:] = rng.normal(0, 0.1, net.out.shape)
        net.group_out[:] = rng.normal(0, 0.1, net.group_out.shape)
        net.base[:] = np.log((frequency + 1) / (frequency.sum() + len(frequency)))
        net.group_base[:] = np.log(np.add.reduceat(np.exp(net.base), np.arange(0, len(frequency), net.width)))
        return net

    def _room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """Memory for numbers that the next batch takes over: new pages for each batch cost more than what is done there."""
        if name not in self.rooms or self.rooms[name].size < rows * columns:
            self.rooms[name] = np.empty(rows * columns, np.float32)
        return self.rooms[name][: rows * columns].reshape(rows, columns)

    def _hidden(self, beside: np.ndarray) -> np.ndarray:
        """The hidden layer, and a last column of ones."""
        out, x, y = self._room("h", len(beside), self.hidden + 1), self._room("x", len(beside), self.hidden), self._room("y", len(beside), self.hidden)
        self.side[0].take(beside[:, 0], axis=0, out=x, mode="clip")
        for i in range(1, len(SIDES)):
            x += self.side[i].take(beside[:, i], axis=0, out=y, mode="clip")
        x += self.bias
        out[:, -1] = 1
        np.tanh(x, out=out[:, :-1])
        return out

    def _groups(self, group: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """For each group of tokens that are sorted by their group: its classes and its tokens."""
        ends = np.searchsorted(group, np.arange(len(self.group_base) + 1)).tolist()
        for g, (first, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if end > first:
                yield slice(g * self.width, min((g + 1) * self.width, self.classes)), slice(first, end)

    def _both(self, h: np.ndarray, by_group: list[tuple[slice, slice]]) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities of the groups, and those of the classes within each token's group: columns of tokens, 0 where a group has fewer classes."""
        outer, inner = self._room("outer", len(self.group_base), len(h)), self._room("inner", self.width, len(h))
        inner[:] = -np.inf
        for classes, i in by_group:
            np.matmul(self.layer[:, classes].T, h[i].T, out=inner[: classes.stop - classes.start, i])
        return _softmax(np.matmul(self.group_layer.T, h.T, out=outer)), _softmax(inner)

    def log_probability(self, own: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """The log-probability of each token's class given the classes beside it."""
        out = np.empty(len(own), np.float32)
        for s in range(0, len(own), 8192):
            order = np.argsort((own[s : s + 8192] // self.width).astype(np.uint16), kind="stable")
            group, place = np.divmod(own[s + order], self.width)
            at = np.arange(len(order))
            outer, inner = self._both(self._hidden(beside[s + order]), list(self._groups(group)))
            out[s + order] = np.log(np.maximum(outer[group, at] * inner[place, at], np.float32(1e-37)))
        return out

    def gradient(self, own: np.ndarray, beside: np.ndarray, into: Network | None = None) -> np.ndarray:
        """The gradient of the mean negative log-probability, laid out as the weights; it may go into a network of the same shape."""
        g, n = into or Network(self.classes, self.hidden), len(own)
        g.flat[:] = 0
        order = np.argsort((own // self.width).astype(np.uint16), kind="stable")
        beside = beside.take(order, axis=0)
        group, place = np.divmod(own.take(order), self.width)
        by_group, at, h = list(self._groups(group)), np.arange(n), self._hidden(beside)
        outer, inner = self._both(h, by_group)
        outer[group, at] -= 1
        inner[place, at] -= 1
        outer /= n
        inner /= n
        g.group_layer[:] = (outer @ h).T
        back, more = self._room("x", n, self.hidden), self._room("y", n, self.hidden)
        np.matmul(outer.T, self.group_out.T, out=back)
        for classes, i in by_group:
            p = inner[: classes.stop - classes.start, i]
            g.layer[:, classes] = (p @ h[i]).T
            np.matmul(p.T, self.out[:, classes].T, out=more[i])
        back += more
        np.multiply(h[:, :-1], h[:, :-1], out=more)
        back *= np.subtract(1, more, out=more)
        g.bias[:] = np.ones(n, np.float32) @ back
        for i in range(len(SIDES)):
            kinds = beside[:, i].astype(np.uint16)
            counts = np.bincount(kinds)
            there = np.flatnonzero(counts)
            g.side[i][there] = np.add.reduceat(back.take(np.argsort(kinds, kind="stable"), axis=0, out=more, mode="clip"), (np.cumsum(counts) - counts)[there], axis=0)
        return g.flat


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16_000_000):
            place, words, _ = _split(text_array(b))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(place, minlength=len(words)).astype(np.int64))], names=["word", "n"])

    return docs.select(text_column(docs).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mean(spark: SparkSession, copies: DataFrame) -> np.ndarray | None:
    """The weighted mean of copies (part, weight, flat), taken over groups of groups so that no task has many."""

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        w = t["weight"].to_numpy()
        flats = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in t["flat"]])
        return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int64()), "weight": [float(w.sum())], "flat": pa.array([(w @ flats / w.sum()).astype(np.float32).tobytes()], pa.binary())})

    copies = written(copies, "copies")
    while (n := copies.count()) > 1:
        groups = max(1, n // 32)
        copies = written(copies.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups))).groupBy("group").applyInArrow(merge, "part long, weight double, flat binary"), "means")
    row = copies.first()
    return np.frombuffer(row["flat"], np.float32) if row else None


def vocabulary(docs: DataFrame, words: int = 192, shared: int = 64, table: int = 262_144) -> tuple[Classes, np.ndarray, Shares] | None:
    """Classes, their tokens, and the shares of all words in them; None if docs have no word.

    The `table` most frequent words go to every task, a fixed number; the others stay in a written table.
    """
    counts = written(word_counts(docs), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(table).toArrow()
    if not top.num_rows:
        return None
    frequent = pa.concat_arrays(top["word"].cast(pa.string()).chunks)
    n = top["n"].to_numpy().astype(np.float64)
    singles = frequent[:words].to_pylist()
    classes = Classes({w: i for i, w in enumerate(singles)}, shared)
    by_end = np.zeros(shared)
    for r in counts.groupBy(F.pmod(F.crc32(F.encode(F.right("word", F.lit(2)), "UTF-8")), F.lit(shared)).alias("end")).agg(F.sum("n").alias("n")).collect():
        by_end[r["end"]] = r["n"]
    for w, k in zip(singles, n, strict=False):
        by_end[zlib.crc32(w[-2:].encode()) % shared] -= k
    log_all = np.r_[np.zeros(len(singles)), np.log(by_end + 1)]
    last = {"word": frequent[-1].as_py(), "n": int(n[-1])}
    rest = counts.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > F.lit(last["word"]))))
    return classes, np.r_[n[: len(singles)], by_end], Shares(frequent, np.log(n), log_all, rest)


def encode(docs: DataFrame, classes: Classes, shares: Shares) -> DataFrame:
    """Rows (row, doc_id, classes, share, tail), written, one for each row of docs.

    classes holds the tokens' classes as 16-bit numbers; share is the sum of the logarithms of the tokens' shares of
    their classes, in which words outside the table count as seen once; tail lists these, as often as they occur.
    """
    frequent, log_frequent, log_all = shares.words, shares.log_n, shares.log_all

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8_000_000):
            place, words, counts = _split(text_array(b))
            own, at = classes.of(words), pc.index_in(words, value_set=frequent)
            outside = at.is_null().to_numpy(zero_copy_only=False)
            log_n = log_frequent[at.fill_null(0).to_numpy(zero_copy_only=False)]
            log_n[outside] = 0
            own, share = own[place], np.where(own < len(classes.words), 0, log_n - log_all[own])[place]
            tail = np.flatnonzero(outside[place])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_text(outside[place].astype(np.int64), counts))), pa.int32()), words.take(pa.array(place[tail])))
            bounds = pa.py_buffer(np.append(0, np.cumsum(2 * counts)).astype(np.int32))
            blob = pa.Array.from_buffers(pa.binary(), len(counts), [None, bounds, pa.py_buffer(own.astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([column_of(b, "row"), column_of(b, "doc_id"), blob, pa.array(per_text(share, counts), pa.float64()), lists], names=["row", "doc_id", "classes", "share", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return written(rows.mapInArrow(run, "row long, doc_id long, classes binary, share double, tail array<string>"), "encoded")


def _own(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a batch's tokens, tokens per text."""
    blob = column_of(b, "classes")
    ends = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
    data = blob.buffers()[2]
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint16) if data is not None else np.zeros(0, np.uint16)
    return own, np.diff(ends).astype(np.int64) // 2


def train(encoded: DataFrame, frequency: np.ndarray, hidden: int = 24, rounds: int = 2) -> np.ndarray:
    """Weights learnt from all texts of encoded.

    In each round a task passes over its texts once and learns from all their tokens, in a mixed order.
    """
    spark = encoded.sparkSession
    flat = Network.fresh(frequency, hidden).flat
    rows = encoded.select("classes", F.spark_partition_id().alias("part"))
    for k in range(rounds):

        def learn(batches: Iterable[pa.RecordBatch], k: int = k, flat: np.ndarray = flat) -> Iterator[pa.RecordBatch]:
            net, slope = Network(len(frequency), hidden, flat.copy()), Network(len(frequency), hidden)
            speed = np.full(len(net.flat), 1e-6, np.float32)
            seen, part, rng = 0, 0, np.random.default_rng(k)
            for b in slices(batches, 1_000_000, "classes"):
                part = column_of(b, "part")[0].as_py()
                own, n = _own(b)
                near = beside(own, n, len(frequency))
                use = rng.permutation(len(own))
                for s in range(0, len(use), 4096):
                    i = use[s : s + 4096]
                    g = net.gradient(own.take(i), near.take(i, axis=0), slope)
                    speed += g * g
                    net.flat -= np.float32(0.1) * g / np.sqrt(speed)
                seen += len(use)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen)]), pa.array([net.flat.tobytes()], pa.binary())], names=["part", "weight", "flat"])

        flat = _mean(spark, rows.mapInArrow(learn, "part long, weight double, flat binary"))
    return flat


def scores(encoded: DataFrame, shares: Shares, flat: np.ndarray, hidden: int = 24) -> DataFrame:
    """Rows (doc_id, n_tokens, log_prob, mean_log_prob), one for each row of encoded.

    log_prob is the sum of the tokens' conditional log-probabilities. Null and empty texts have no token,
    log_prob 0 and no mean. The words outside the table meet their counts in a join on words.
    """
    size = len(shares.log_all)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(size, hidden, flat)
        for b in slices(batches, 2_000_000, "classes"):
            own, n = _own(b)
            log_p = per_text(net.log_probability(own, beside(own, n, size)).astype(np.float64), n)
            yield pa.RecordBatch.from_arrays([column_of(b, "row"), column_of(b, "doc_id"), pa.array(n), pa.array(log_p + column_of(b, "share").to_numpy())], names=["row", "doc_id", "n_tokens", "log_p"])

    by_class = encoded.select("row", "doc_id", "classes", "share").mapInArrow(run, "row long, doc_id long, n_tokens long, log_p double")
    tail = encoded.select("row", F.explode("tail").alias("word")).join(shares.rest, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    total = F.col("log_p") + F.coalesce("more", F.lit(0.0))
    return by_class.join(tail, "row", "left").select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on docs and score them (see train and scores)."""
    got = vocabulary(docs)
    if got is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_prob"), F.lit(None).cast("double").alias("mean_log_prob"))
    classes, frequency, shares = got
    encoded = encode(docs, classes, shares)
    return scores(encoded, shares, train(encoded, frequency))
