"""Chunks cut where the subject changes: neighbouring sentences are compared by their terms, weighted by the corpus."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import file_stem
from scriptorium.operators.chunking import with_contexts

SENTENCE_END = re.compile(r"(?<=[.!?])(?=\s+[A-Z])")
TERM = re.compile(r"[^\W_]+")
#: Terms share so many places, so what the corpus says of them is bounded whatever its size.
PLACES = 1 << 18


def split_sentences(text: str) -> list[str]:
    """Sentences, each with the white space before it; joined they are the text."""
    return [s for s in SENTENCE_END.split(text) if s]


class Terms:
    """Places of terms, remembered up to a bound."""

    def __init__(self, places: int = PLACES, most: int = 200_000) -> None:
        self.places, self.most, self.known = places, most, {}

    def of(self, sentence: str) -> dict[int, int]:
        """How often each place occurs in a sentence."""
        out: dict[int, int] = {}
        for t in TERM.findall(sentence.lower()):
            k = self.known.get(t)
            if k is None:
                if len(self.known) >= self.most:
                    self.known.clear()
                k = self.known[t] = int(md5(t.encode()).hexdigest()[:8], 16) % self.places
            out[k] = out.get(k, 0) + 1
        return out


def term_weights(docs: DataFrame, places: int = PLACES) -> np.ndarray:
    """For each place the whole-numbered weight of its terms: 1000 ln((1 + sentences) / (1 + sentences that have it)), over all docs (text).

    Each task adds up its own sentences, so rows of (place, number) move, not terms; at most `places` sums come to the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, seen, n = Terms(places), np.zeros(places, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                for s in split_sentences(text or ""):
                    n += 1
                    seen[list(terms.of(s))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *seen[at].tolist()], pa.int64())], ["place", "n"])

    got = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = got["place"].to_numpy(), got["n"].to_numpy()
    total, seen = int(n[place < 0].sum()), np.zeros(places, np.int64)
    seen[place[place >= 0]] = n[place >= 0]
    return np.floor(1000 * np.log((1 + total) / (1 + seen))).astype(np.int64)


def distances(sentences: list[str], terms: Terms, weights: np.ndarray) -> list[float]:
    """1 less the cosine of each two neighbours' weighted terms; 1 where one has no weight. Sums are whole numbers, so they are exact."""
    vectors = [{k: c * w for k, c in terms.of(s).items() if (w := int(weights[k]))} for s in sentences]
    size = [sum(x * x for x in v.values()) for v in vectors]
    out = []
    for a, b, n, m in zip(vectors, vectors[1:], size, size[1:], strict=False):
        if len(b) < len(a):
            a, b = b, a
        dot = sum(x * b.get(k, 0) for k, x in a.items())
        out.append(max(0.0, 1.0 - dot / (sqrt(n) * sqrt(m))) if n and m else 1.0)
    return out


def subject_breaks(found: list[float], percentile: float) -> list[bool]:
    """Whether a text is cut behind each sentence but the last: where the distance reaches the given percentile of the text's own distances, and is not 0."""
    if not found:
        return []
    limit = sorted(found)[max(0, ceil(percentile / 100 * len(found)) - 1)]
    return [d >= limit and d > 0 for d in found]


def packed(sizes: list[int], breaks: list[bool], size: int, least: int) -> list[int]:
    """The chunk number of each sentence: a chunk ends before a sentence that it has no room for, and at a break once it holds `least` tokens."""
    out, chunk, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i and (used + n > size or (breaks[i - 1] and used >= least)):
            chunk, used = chunk + 1, 0
        out.append(chunk)
        used += n
    return out


def sentence_breaks(docs: DataFrame, percentile: float = 95.0, weights: np.ndarray | None = None) -> DataFrame:
    """(source_file, position, distance, is_break) of each sentence but a text's last, by the terms of all docs (source_file, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(term_weights(docs) if weights is None else weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(len(shared.value))
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = distances(split_sentences(text or ""), terms, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.float64()), pa.array(subject_breaks(found, percentile), pa.bool_())], ["source_file", "position", "distance", "is_break"])

    return docs.select(F.col("source_file").cast("string"), "text").mapInArrow(run, "source_file string, position int, distance double, is_break boolean")


def semantic_chunks(
    docs: DataFrame, size: int = 20_000, overlap: int = 1_000, percentile: float = 95.0, least: int | None = None, make_counter: Callable[[], Callable[[str], int]] | None = None, weights: np.ndarray | None = None,
) -> DataFrame:
    """Chunks of docs (source_file, text) of `size` tokens at most, cut at changes of subject; a longer sentence is one chunk.

    A chunk goes on over breaks until it holds `least` tokens (a quarter of the size). make_counter() runs once in each task, as for
    token_chunks; words count without one. `weights` are those of term_weights over a corpus, of the docs themselves if none are given. Chunks joined give
    the text. Null and empty texts have no chunk. overlap is the contexts' length in characters.
    """
    spark, low = docs.sparkSession, size // 4 if least is None else least
    shared = spark.sparkContext.broadcast(term_weights(docs) if weights is None else weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, terms = make_counter() if make_counter else lambda t: len(t.split()), Terms(len(shared.value))
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sentences = split_sentences(text or "")
                chunk = packed([count(s) for s in sentences], subject_breaks(distances(sentences, terms, shared.value), percentile), size, low)
                pieces: list[list[str]] = []
                for k, s in zip(chunk, sentences, strict=True):
                    if k == len(pieces):
                        pieces.append([])
                    pieces[k].append(s)
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([f"Chunk {i + 1}" for i in range(n)], pa.string()), pa.array(["".join(p) for p in pieces], pa.string()), pa.array(range(n), pa.int32())],
                    ["source_file", "chunk_label", "chunk_text", "chunk_index"],
                )

    out = docs.select(F.col("source_file").cast("string"), "text").mapInArrow(run, "source_file string, chunk_label string, chunk_text string, chunk_index int")
    return with_contexts(out.withColumn("chunk_id", F.format_string("%s_%03d", file_stem(F.col("source_file")), "chunk_index")), overlap)
