"""Maximal runs of repeated words in texts, by Stoye and Gusfield's search of the suffix tree.

The tree is kept as a suffix array with longest common prefixes: a split of the array at place m is a node whose depth
is the prefix at m, and whose two sides are its leaves on either hand. A square (a word sequence twice in a row) of period q
begins at i exactly if i and i + q are leaves of one node and share q words; where they part at a node of depth q, the square is
branching, and cannot be moved one word to the right. Walking only the smaller side of each node finds all branching squares in
n log n steps; each is the right end of a run, which the rotations to its left complete.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import column_of, ragged, slices, text_array, text_column

SPACES = np.array([32 if 9 <= c <= 13 else c for c in range(256)], np.uint8)
MOST_LEAVES = 2_000_000


@dataclass(frozen=True)
class Runs:
    """Which runs count: those of `words` words at least and `periods` times their period at least (two or more)."""

    words: int = 24
    periods: int = 3

    def __post_init__(self) -> None:
        if self.words < 2 or self.periods < 2:
            raise ValueError("a run has two words and two periods at least")

    @property
    def shared(self) -> int:
        """Words that the first two periods' starts of any such run have in common at least: its length less its period."""
        return min(max(self.words - q, (self.periods - 1) * q) for q in range(1, self.words + 1))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between white space (space and U+0009 to U+000D), one text after the other, and the number of each text's."""
    texts = pa.concat_arrays([texts])  # without an offset
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer(SPACES[np.frombuffer(data, np.uint8)].tobytes()) if data else data
    lists = pc.split_pattern(pa.StringArray.from_buffers(len(texts), offsets, plain), " ")
    words, of = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(words, "")
    return words.filter(real), np.bincount(of[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_repeats(codes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Which texts may have two equal windows of `width` words: their trees have a node so deep, or hashes met by chance."""
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(codes))
    window, k = _mixed(codes), 1
    while 2 * k <= width:
        n = max(0, len(window) - k)
        window[:n] = window[:n] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + window[k:]
        k *= 2
    whole = left >= k
    text, window = text[whole], window[whole] ^ _mixed(text[whole])
    order = np.argsort(window)
    twice = window[order[1:]] == window[order[:-1]]
    return np.isin(np.arange(len(counts)), text[order[1:]][twice])


def prefix_ranks(codes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: how many suffixes come before those that share their first 2^k words with suffix i; at the last level all differ.

    Each level sorts only the suffixes that the one before leaves together. Suffixes of different texts are never together.
    One more place at the end holds -1.
    """
    n = len(codes)
    text, end = np.repeat(np.arange(len(counts)), counts), np.repeat(np.cumsum(counts), counts)
    key = text * (int(codes.max(initial=0)) + 1) + codes
    together, rank, h, levels = np.arange(n), np.zeros(n + 1, np.int64), 1, []
    rank[n] = -1
    while True:
        order = np.argsort(key, kind="stable")
        place, key = together[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        first = np.r_[True, rank[place][1:] != rank[place][:-1]][: len(key)] if levels else np.arange(len(key)) == 0
        at = np.arange(len(key))
        base = rank[place] if levels else np.zeros(len(key), np.int64)
        rank = rank.copy()
        rank[place] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        levels.append(rank.astype(np.int32))
        alone = new & np.r_[new[1:], True][: len(new)]
        together = np.sort(place[~alone])
        if not len(together):
            return levels
        follow = np.where(together + h < end[together], rank[np.minimum(together + h, n)] + 1, 0)
        key = rank[together] * (n + 1) + follow
        h *= 2


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes a and b of a text share."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a] == levels[k][b]) * (1 << k)
        a, b, out = a + step, b + step, out + step
    return out


def node_bounds(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one before it with a depth no greater, and the first one after it with a lesser depth."""
    before, after, stack = [0] * len(depth), [len(depth)] * len(depth), []
    for m, d in enumerate(values := depth.tolist()):
        while stack and values[stack[-1]] > d:
            after[stack.pop()] = m
        before[m] = stack[-1] if stack else 0
        stack.append(m)
    return np.array(before, np.int64), np.array(after, np.int64)


def branching_squares(levels: list[np.ndarray], counts: np.ndarray, periods: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of all branching squares, but for periods of which the text does not hold `periods`."""
    rank = levels[-1][:-1].astype(np.int64)
    n = len(rank)
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    ends = np.cumsum(counts)
    start, end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
    depth = np.r_[0, common_prefixes(levels, array[:-1], array[1:])][:n]
    low, high = node_bounds(depth)
    nodes = np.flatnonzero((depth > 0) & (depth * periods <= (end - start)[array]))
    small_left = nodes - low[nodes] <= high[nodes] - nodes
    first, size = np.where(small_left, low[nodes], nodes), np.minimum(nodes - low[nodes], high[nodes] - nodes)
    other_low, other_high = np.where(small_left, nodes, low[nodes]), np.where(small_left, high[nodes], nodes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), MOST_LEAVES), "left")
    for a, b in zip(cuts, [*cuts[1:], len(nodes)], strict=True):
        if a == b:
            continue
        leaf = array[ragged(first[a:b], size[a:b])]
        of = np.repeat(np.arange(a, b), size[a:b])
        q, lo, hi = depth[nodes[of]], other_low[of], other_high[of]
        for at in (leaf + q, leaf - q):
            inside = np.flatnonzero((at >= start[leaf]) & (at < end[leaf]))
            there = rank[at[inside]]
            hit = inside[(there >= lo[inside]) & (there < hi[inside])]
            found.append((np.minimum(leaf[hit], at[hit]), q[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def maximal_runs(codes: np.ndarray, counts: np.ndarray, which: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (counted over all texts), length and smallest period of all runs that count, by start and period."""
    levels = prefix_ranks(codes, counts)
    at, q = branching_squares(levels, counts, which.periods)
    start = np.repeat(np.cumsum(counts) - counts, counts)[at]
    more = np.zeros(len(at), np.int64)  # rotations to the left
    for k in range(len(levels) - 1, -1, -1):
        i = at - more - (1 << k)
        same = i >= start
        same[same] = levels[k][i[same]] == levels[k][i[same] + q[same]]
        more += same * (1 << k)
    begin, length = at - more, more + 2 * q
    good = length >= np.maximum(which.words, which.periods * q)
    begin, length, q = begin[good], length[good], q[good]
    # one stretch may be found with multiples of its smallest period
    order = np.lexsort((q, length, begin))
    begin, length, q = begin[order], length[order], q[order]
    new = np.r_[True, (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])][: len(begin)]
    begin, length, q = begin[new], length[new], q[new]
    order = np.lexsort((q, begin))
    return begin[order], length[order], q[order]


def runs_of_texts(words: pa.Array, counts: np.ndarray, which: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """maximal_runs of texts given as words. A text without two equal windows of which.shared words has no run that counts, and no tree is built."""
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    deep = with_repeats(codes, counts, which.shared)
    if not deep.any():
        return (np.zeros(0, np.int64),) * 3
    kept = np.flatnonzero(np.repeat(deep, counts))
    begin, length, q = maximal_runs(codes[kept], counts[deep], which)
    return kept[begin], length, q


def periodic_runs(docs: DataFrame, which: Runs = Runs()) -> DataFrame:
    """Runs of the whole texts of docs (doc_id, text): doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of words in which words `period` apart are equal, which no neighbour extends, and whose period is its smallest.
    collapsed is the text without the words that some run has after its first period, the others joined by one space. Null and
    empty texts have no words, no runs and an empty collapsed text; repeated rows are each treated by themselves, other
    columns are left out. A text is one task's work and takes some 150 bytes of memory a word while its tree is built.
    """
    given = docs.select("doc_id", text_column(docs).alias("text"))
    of = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_000_000):
            words, counts = split_words(text_array(b))
            begin, length, q = runs_of_texts(words, counts, which)
            ends = np.cumsum(counts)
            text = np.searchsorted(ends, begin, "right")
            edges = np.searchsorted(text, np.arange(len(counts) + 1))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (begin - (ends - counts)[text], length, q)], fields=list(of))
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, begin + q, 1)
            np.add.at(change, begin + length, -1)
            kept = np.cumsum(change)[: len(words)] == 0
            left = np.r_[0, np.cumsum(kept)][np.r_[0, ends]]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept))), " ")
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with periodic tails in a tenth of the texts, told by the crc32 h of the decimal doc_id.

    Where 10 divides h and there are words, with g = h // 10, n words, a = g % n and p = 1 + (n - a) // (3 + g % 8), the words from a on
    repeat the p words that follow a. A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(text_column(docs), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return docs.select("doc_id", F.when(h % 10 == 0, F.when(n > 0, changed)).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per document of periodic_runs: n_runs, its run of most periods (start, length, period, exponent_milli; ties: first start, least period) and digests of runs and collapsed text."""
    better = lambda x, y: F.coalesce(F.nullif(F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int"), F.lit(0)), F.nullif(F.signum(x["start"] - y["start"]).cast("int"), F.lit(0)), F.signum(x["period"] - y["period"]).cast("int"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", F.get(F.array_sort("runs", better), F.lit(0)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def sql(which: Runs = Runs()) -> str:
    """DuckDB SQL of run_digests(periodic_runs(planted(documents))): runs are stretches of places whose windows of which.shared words come again after a period."""
    k = which.shared
    return rf"""WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1]))) END AS h FROM documents, crc),
e AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS g8 FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g8) AS p FROM e),
w AS (SELECT r, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM p, unnest(range(0, n)) AS u(i)),
l AS (SELECT r, list(word ORDER BY i) AS w FROM w GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i + 1:i + {k}], ' ') AS x FROM l, unnest(range(0, len(w) - {k - 1})) AS u(i)),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM win a JOIN win b ON a.r = b.r AND a.x = b.x AND a.i < b.i),
stretch AS (SELECT r, q, min(i) AS s, max(i) - min(i) + {k} + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
runs AS (SELECT r, s, len, min(q) AS q FROM stretch WHERE len >= greatest({which.words}, {which.periods} * q) GROUP BY r, s, len),
told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_max({{'s': s, 'len': len, 'q': q}}, (len / q, -s, -q)) AS best FROM runs GROUP BY r),
gone AS (SELECT DISTINCT w.r, w.i FROM w JOIN runs ON w.r = runs.r AND w.i >= runs.s + runs.q AND w.i < runs.s + runs.len),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)"""
