"""Jaccard join of word-shingle sets by parity sketches, and the components of its links.

A shingle's hash picks a place of the set's size band, where it is XORed into a 64-bit word, and one parity
bit of a bit sketch, which it flips. So one shingle more or less changes one word and one bit, and neither
the number of words that differ nor the bits' Hamming distance ever exceeds the size of the sets' symmetric
difference. That difference is at most d for two sets of a band that link. With d + 1 + s places, s + 1
words at least must agree (pigeonhole). So each set may leave out its s most frequent words, in an order
that is the same for all sets: of the words that agree, the last in that order stays with both. Words that
stay and are equal give the candidates, the Hamming distance thins them, and the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if, column_of, release, slices, text_array, text_column, written

MOST_BROADCAST = 1_000_000
_SETS = "doc_id long, text_key long, n_shingles long, set_id long, band int, own binary, above binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (constants of a published finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Jaccard:
    """Shingles of `width` words; two sets link when 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80

    def difference(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


@dataclass(frozen=True)
class Band:
    """Sizes low to high; linked sets have s + 1 equal words of these places, s being `spare`; `bits` of parity."""

    low: int
    high: int
    places: int
    spare: int
    bits: int


@lru_cache
def bands(rule: Jaccard) -> tuple[Band, ...]:
    """The size bands.

    Sets below the first band link with equal sets only. A band's sizes differ by 1.3 or 100 / percent
    at most, so linked sets are in one band or in neighbours. Twenty-four parity bits for each shingle of the
    largest difference tell sets that differ by a tenth more, so few pairs that do not link are verified.
    """
    out, low = [], -(-rule.percent // (100 - rule.percent))
    while low < 1 << 40:
        high = max(low, int(low * max(1.3, 100 / rule.percent)))
        d = rule.difference(high, high)
        spare = max(3, (d + 1) // 4)
        out.append(Band(low, high, d + 1 + spare, spare, 64 * max(4, -(-24 * (d + 1) // 64))))
        low = high + 1
    return tuple(out)


@lru_cache
def _lows(rule: Jaccard) -> np.ndarray:
    return np.array([b.low for b in bands(rule)])


def band_of(rule: Jaccard, n: int) -> int:
    """The band of a size; -1 below the first."""
    return int(np.searchsorted(_lows(rule), n, "right")) - 1


def parity(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The parity bits of a set of 64-bit shingle hashes, in 64-bit words; `bits` is a multiple of 64."""
    at = ((shingles & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def sketch_keys(shingles: np.ndarray, number: int, band: Band) -> tuple[np.ndarray, int]:
    """Join keys of a sorted set, and how many of its most frequent keys it may still leave out.

    A key is a place with its word; the band's number is in the low 8 bits. Empty places come first in the
    order of frequency: up to `spare` of them are left out here, those of greatest key.
    """
    at = (((shingles >> np.uint64(32)) * np.uint64(band.places)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    keys = _keys(at[starts], np.bitwise_xor.reduceat(mix(shingles), starts), number)
    empty = band.places - len(starts)
    if empty > band.spare:
        free = np.setdiff1d(np.arange(band.places), at[starts], assume_unique=True)
        keys = np.r_[keys, np.sort(_keys(free, np.zeros(len(free), np.uint64), number))[: empty - band.spare]]
    return keys, max(0, band.spare - empty)


def _keys(places: np.ndarray, words: np.ndarray, number: int) -> np.ndarray:
    keys = mix(words ^ mix(places.astype(np.uint64) + np.uint64(1 + number * (1 << 40))))
    return ((keys & ~np.uint64(255)) | np.uint64(number)).view(np.int64)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z is lower-cased, words end at ASCII white space.

    A text of fewer words is one shingle as a whole; one without words has none.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    owner = owner[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(owner, minlength=len(texts))
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    m = max(0, len(h) - width + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(width):
        rolled += h[j : j + m] * factors[j]
    rolled = mix(rolled)
    starts = np.cumsum(sizes) - sizes
    out = []
    for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[start : start + n - width + 1]))
        elif n:
            out.append(mix(np.array([(h[start : start + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_id(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def sketched(docs: DataFrame, rule: Jaccard) -> DataFrame:
    """One row for each row of docs: id of its shingle set, size, band, parity bits for that band and for the next one if a link can reach there."""
    table = bands(rule)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4_000_000):
            n, ids, band, own, above = [], [], [], [], []
            for s in shingle_sets(text_array(b), rule.width):
                k = band_of(rule, len(s))
                n.append(len(s))
                ids.append(_set_id(s) if len(s) else None)
                band.append(k)
                own.append(parity(s, table[k].bits).tobytes() if k >= 0 else None)
                above.append(parity(s, table[k + 1].bits).tobytes() if _reaches(rule, k, len(s)) else None)
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), column_of(b, "text_key"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(band, pa.int32()), pa.array(own, pa.binary()), pa.array(above, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_id", "band", "own", "above"])

    text = text_column(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, _SETS)


def _reaches(rule: Jaccard, band: int, n: int) -> bool:
    """Whether a set of n shingles can link with one of the next band."""
    return n > 0 and 100 * n >= rule.percent * bands(rule)[band + 1].low


def _keyed(docs: DataFrame, rule: Jaccard) -> DataFrame:
    """(key, set_id, spare) for all words of all texts' sketches; a batch's repeated sets count once."""
    table = bands(rule)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4_000_000):
            keys, owners, spares, met = [np.zeros(0, np.int64)], [], [], set()
            for s in shingle_sets(text_array(b), rule.width):
                if not len(s) or (own := _set_id(s)) in met:
                    continue
                met.add(own)
                k = band_of(rule, len(s))
                for band in ([k] if k >= 0 else []) + ([k + 1] if _reaches(rule, k, len(s)) else []):
                    got, spare = sketch_keys(s, band, table[band])
                    keys.append(got)
                    owners.append(own)
                    spares.append(spare)
            sizes = [len(x) for x in keys[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(owners, np.int64), sizes)), pa.array(np.repeat(np.array(spares, np.int32), sizes))], names=["key", "set_id", "spare"])

    return docs.select(text_column(docs).alias("text")).mapInArrow(run, "key long, set_id long, spare int")


def _grouped(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, key: str = "key") -> DataFrame:
    """Stream over rows dealt and sorted by key; work gets whole groups, many at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = column_of(b, key).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(keys, keys[-1], "left"))  # the last group may go on
            if last or (held and column_of(held[-1], key)[-1].as_py() != keys[0]):
                yield from work(pa.Table.from_batches([*held, b.slice(0, last)])).to_batches()
                held = []
            held.append(b.slice(last))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


#: Keys of 2 ** MOST_COMMON sets or more are equally common; only this many rows of a key are ever held.
MOST_COMMON = 14


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows of keys that two or more sets have, each once: (key, set_id, spare, common); common is log2 of the key's sets."""
    most = 1 << MOST_COMMON
    names = ["key", "set_id", "spare"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        long_key, last_id = None, None  # a key of which `most` rows have gone out already, and its last set

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            size = np.diff(np.r_[starts, len(rows[0])])
            is_long = rows[0][starts] == long_key if long_key is not None else np.zeros(len(starts), bool)
            common = np.where(is_long, MOST_COMMON, np.minimum(np.log2(size), MOST_COMMON)).astype(np.int32)
            keep = np.repeat((size > 1) | is_long, size)
            return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in rows), pa.array(np.repeat(common, size)[keep])], names=[*names, "common"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = [np.concatenate([h, column_of(b, c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names, strict=True)]
            new = np.r_[rows[0][0] != long_key or rows[1][0] != last_id, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            rows = [x[new] for x in rows]
            if not len(rows[0]):
                held = rows
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last key's rows may go on
            if len(rows[0]) - last >= most or rows[0][-1] == long_key:
                if last:
                    yield out([x[:last] for x in rows])
                long_key, last_id = int(rows[0][-1]), int(rows[1][-1])
                yield out([x[last:] for x in rows])
                held = [x[:0] for x in rows]
            else:
                if last:
                    yield out([x[:last] for x in rows])
                held = [x[last:] for x in rows]
        if len(held[0]):
            yield out(held)

    return keyed.repartition(F.col("key")).sortWithinPartitions("key", "set_id").mapInArrow(run, "key long, set_id long, spare int, common int")


def _meetings(shared: DataFrame) -> DataFrame:
    """(key, set_id, low, high): the keys that sets keep and share, with each key's least and greatest set.

    A set leaves out its `spare` most frequent keys of a band; ties go by the key, so that all sets agree on the order.
    """
    order = W.partitionBy("set_id", F.col("key").bitwiseAND(255)).orderBy(F.desc("common"), F.desc("key"))
    stay = written(shared.withColumn("rank", F.row_number().over(order)).where("rank > spare").select("key", "set_id"), "kept-keys")
    ends = stay.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high")
    met = written(stay.join(ends, "key").select("key", "set_id", "low", "high"), "meetings")
    release(stay)
    return met


def _bits(data: pa.Array, words: int) -> np.ndarray:
    """Equally long bit sketches as rows of 64-bit words."""
    whole = pa.concat_arrays(data.chunks) if isinstance(data, pa.ChunkedArray) else data
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64).reshape(len(whole), words)


def _near(pairs: DataFrame, sketches: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs (a, b) whose parity bits differ no more than those of linked sets can."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = rule.difference(column_of(b, "n1").to_numpy(), column_of(b, "n2").to_numpy())
            x, y, ok = column_of(b, "x"), column_of(b, "y"), np.zeros(b.num_rows, bool)
            size = pc.binary_length(x).to_numpy(zero_copy_only=False)
            for n in np.unique(size).tolist():
                i = np.flatnonzero(size == n)
                at = pa.array(i)
                ok[i] = np.bitwise_count(_bits(x.take(at), n // 8) ^ _bits(y.take(at), n // 8)).sum(axis=1) <= most[i]
            yield b.select(["a", "b"]).filter(pa.array(ok))

    one = sketches.select(*(F.col(c).alias(d) for c, d in (("set_id", "a"), ("n_shingles", "n1"), ("band", "band1"), ("own", "own1"), ("above", "above1"))))
    two = sketches.select(*(F.col(c).alias(d) for c, d in (("set_id", "b"), ("n_shingles", "n2"), ("band", "band2"), ("own", "own2"), ("above", "above2"))))
    high = F.greatest("band1", "band2")
    both = pairs.join(one, "a").join(two, "b").where(F.abs(F.col("band1") - F.col("band2")) < 2)
    sides = both.select("a", "b", "n1", "n2", F.when(F.col("band1") == high, F.col("own1")).otherwise(F.col("above1")).alias("x"), F.when(F.col("band2") == high, F.col("own2")).otherwise(F.col("above2")).alias("y"))
    return sides.where("x IS NOT NULL AND y IS NOT NULL").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs (a, b) whose shingle sets link; the sets are taken again from one text each."""

    def shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4_000_000):
            got = shingle_sets(text_array(b), rule.width)
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) if len(s) else None for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["set_id", "shingles"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = column_of(b, "x"), column_of(b, "y")
            ok = [rule.links(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    some = pairs.select(F.col("a").alias("set_id")).union(pairs.select(F.col("b").alias("set_id"))).distinct()
    keys = sets.join(broadcast_if(some, MOST_BROADCAST), "set_id", "left_semi").groupBy("set_id").agg(F.min("text_key").alias("text_key")).select("text_key")
    text = text_column(docs)
    texts = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(broadcast_if(keys, MOST_BROADCAST), "text_key", "left_semi").dropDuplicates(["text_key"])
    stored = written(texts.select("text").mapInArrow(shingled, "set_id long, shingles binary"), "shingles")
    bodies = stored.dropDuplicates(["set_id"])
    one = bodies.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    two = bodies.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    out = written(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    release(stored)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b): root is the component's least node.

    Alternating large and small stars: every node's neighbours are hung below its least one, until
    every component is one star. The edges of each step are written to the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    for k in count():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, written(small.where("u <> v").distinct(), f"star{k}")
        if k:
            release(before)
        # done when every node hangs once, and below a node that hangs nowhere
        sides = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("s"))
        ends = sides.groupBy("s.node").agg(F.sum("s.below").alias("below"), F.max("s.above").alias("above"))
        if ends.where("below > 1 OR below = 1 AND above = 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise AssertionError


def _across(t: pa.Table, rule: Jaccard, best: bool) -> pa.Table:
    """Pairs of a key's sets that are in different components and near enough by their bits.

    Sets outside the key's largest component are compared with the key's sets, in blocks; of each one only the nearest, if best.
    """
    key, ids, roots, sizes = (t[c].to_numpy() for c in ("key", "set_id", "root", "n_shingles"))
    pairs = [np.zeros((0, 2), np.int64)]
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        kinds, kind, n = np.unique(roots[s:e], return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            continue
        words = _bits(t["sketch"][s:e], bands(rule)[int(key[s]) & 255].bits // 64)
        ask = np.flatnonzero(kind != np.argmax(n))
        step = max(1, 4_000_000 // words.size)
        for k in range(0, len(ask), step):
            i = ask[k : k + step]
            far = np.bitwise_count(words[i][:, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)
            ok = (far <= rule.difference(sizes[s + i][:, None], sizes[s:e][None, :])) & (kind[i][:, None] != kind[None, :])
            if best:
                far[~ok] = 1 << 40
                nearest = far.argmin(axis=1)
                one = np.flatnonzero(ok[np.arange(len(i)), nearest])
                x, y = ids[s + i[one]], ids[s + nearest[one]]
            else:
                u, v = np.nonzero(ok)
                x, y = ids[s + i[u]], ids[s + v]
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    got = np.unique(np.concatenate(pairs), axis=0)
    return pa.table({"a": got[:, 0], "b": got[:, 1]})


def similarity_classes(docs: DataFrame, rule: Jaccard = Jaccard()) -> DataFrame:  # noqa: B008  frozen
    """Each document's component: (doc_id, n_shingles, component_id), one row for each row of docs.

    component_id is the least doc_id that links lead to. Null and empty texts and texts without words
    have no shingles and link with nothing; their component is their own id. Equal sets are one node,
    so copies are never paired. Sets are known by 64-bit hashes of their 64-bit shingle hashes.

    The sets that share a key are compared with its least and greatest set first. Others of the key
    are compared only while they are in different components, and only if the sketches' Hamming
    distance allows it: each with its nearest one first, then with all. So a group of n near copies
    costs about n comparisons, and no link between components is lost.
    """
    sets = written(sketched(docs, rule), "sketches")
    shared = written(_shared(_keyed(docs, rule)), "shared-keys")
    met = _meetings(shared)
    release(shared)
    some = met.select("set_id").distinct()
    sketches = written(sets.join(broadcast_if(some, MOST_BROADCAST), "set_id", "left_semi").dropDuplicates(["set_id"]).select("set_id", "n_shingles", "band", "own", "above"), "some-sketches")

    def pair(x: str, y: str) -> DataFrame:
        return met.where(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    stars = written(_near(pair("low", "set_id").union(pair("high", "set_id")).distinct(), sketches, rule), "star-pairs")
    links = _linked(stars, docs, sets, rule)
    root = components(links)

    def unsettled(root: DataFrame) -> DataFrame:
        """Sets beside the pivots of keys that more than one component shares, with their bits for the key's band."""
        rest = met.where("set_id <> low AND set_id <> high").select("key", "set_id").join(root.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        keys = rest.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        return rest.join(keys, "key", "left_semi").join(sketches, "set_id").select("key", "set_id", "root", "n_shingles", F.when(F.col("band") == F.col("key").bitwiseAND(255), F.col("own")).otherwise(F.col("above")).alias("sketch"))

    # first each set's nearest neighbour, which settles most; then whatever is left between components
    done = stars
    for step, best in (("nearest", True), ("rest", False)):
        found = _grouped(unsettled(root), lambda t, best=best: _across(t, rule, best), "a long, b long").distinct()
        more = written(found.join(done, ["a", "b"], "left_anti"), f"{step}-pairs")
        links = links.union(_linked(more, docs, sets, rule))
        root = components(links)
        done = done.union(more)
    release(met, sketches)

    classes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("low_id")).join(root.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    lowest = classes.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = classes.join(lowest, "root").select("set_id", "component_id")
    return sets.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Jaccard = Jaccard()) -> DataFrame:  # noqa: B008  frozen
    """The rows of docs whose doc_id is the least of its component, with all their columns.

    Rows of one doc_id are taken for one document; rows without doc_id are kept.
    """
    kept = broadcast_if(written(similarity_classes(docs, rule).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct(), "kept"), MOST_BROADCAST)
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def sql(width: int = 4, percent: int = 85) -> str:
    """DuckDB SQL of similarity_classes: all pairs with a common shingle, and a walk along the links."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {width} - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - {width} + 2, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ids AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_ids JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= {percent} * (p.n + q.n - c)),
walk AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a),
low AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""
