"""Greedy clustering of passages that different annotators report for one chunk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import normalised_words
from scriptorium.operators.ordering import running_total
from scriptorium.storage import stored

THRESHOLD = 0.35
MOST_CELLS = 50_000_000


def assign_groups(tokens: list, threshold: float = THRESHOLD) -> list[int]:
    """Group numbers of a chunk's passages in their order.

    A passage joins the first group that has a member it overlaps enough, else it opens one. Common tokens are
    counted through a table of passages and tokens, or an index from tokens to passages where that would be large.
    """
    sizes = np.array([len(x) for x in tokens], np.int64)
    known, numbers = np.unique(np.concatenate([np.asarray(x) for x in tokens if len(x)]), return_inverse=True) if sizes.any() else ((), np.zeros(0, np.int64))
    own = np.split(numbers, np.cumsum(sizes)[:-1]) if len(sizes) else []
    groups, made = np.zeros(len(own), np.int64), 0
    common = _by_table(own, len(known)) if len(own) * len(known) <= MOST_CELLS else _by_index(own)
    for i, n in enumerate(common):
        least = np.minimum(sizes[:i], sizes[i])
        near = (n > 0) & (n >= threshold * least)
        near[near] = n[near] / least[near] >= threshold
        groups[i] = groups[:i][near].min() if near.any() else made
        made = max(made, int(groups[i]) + 1)
    return groups.tolist()


def _by_table(own: list[np.ndarray], n_tokens: int) -> Iterator[np.ndarray]:
    """For each passage how many tokens it has in common with each one before it."""
    table = np.zeros((len(own), n_tokens), np.uint8)
    for i, x in enumerate(own):
        yield table[:i, x].sum(axis=1, dtype=np.int64)
        table[i, x] = 1


def _by_index(own: list[np.ndarray]) -> Iterator[np.ndarray]:
    where: dict[int, list[int]] = {}
    for i, x in enumerate(own):
        met = [j for t in x.tolist() for j in where.get(t, ())]
        yield np.bincount(np.array(met, np.int64), minlength=i)
        for t in x.tolist():
            where.setdefault(t, []).append(i)


def token_hashes(passage: Column) -> Column:
    """64-bit hashes of a passage's distinct normalised words."""
    return F.array_distinct(F.transform(normalised_words(passage), lambda t: F.xxhash64(t)))


def cluster(annotations: DataFrame, threshold: float = THRESHOLD, columns: Iterable[str] | None = None) -> DataFrame:
    """Annotations (row_id, chunk_id, passage, ...) with their chunk's group number `chunk_group`; of their columns all, or row_id, chunk_id and those named.

    Rows of one chunk are compared in the order of row_id, then of the passage's hash; rows without chunk_id go. The order decides
    the groups, so a chunk is one task's work; chunks are bounded by what a text chunk's annotators report. Rows move once, with
    the tokens' 64-bit hashes, and only with the columns that are kept. Rows that are equal in chunk, row_id and passage are in one group.
    """
    kept = annotations.columns if columns is None else [c for c in annotations.columns if c in {"row_id", "chunk_id", *columns}]
    narrow = annotations.where(F.col("chunk_id").isNotNull()).select(*kept, F.xxhash64("passage").alias("g_hash"), token_hashes(F.col("passage")).alias("g_tokens"))

    def scan(chunk: pa.Table) -> pa.Table:
        chunk = chunk.take(pa.compute.sort_indices(chunk, [("row_id", "ascending"), ("g_hash", "ascending")]))
        keys = list(zip(chunk["row_id"].to_pylist(), chunk["g_hash"].to_pylist(), strict=True))
        first = [not i or k != keys[i - 1] for i, k in enumerate(keys)]
        tokens = chunk["g_tokens"].filter(pa.array(first)).combine_chunks()
        groups = assign_groups(np.split(tokens.flatten().to_numpy(), tokens.offsets.to_numpy()[1:-1] - tokens.offsets[0].as_py()), threshold)
        all_groups = np.array(groups, np.int32)[np.cumsum(first) - 1]
        return chunk.drop_columns(["g_hash", "g_tokens"]).append_column("chunk_group", pa.array(all_groups))

    schema = T.StructType([*narrow.drop("g_hash", "g_tokens").schema.fields, T.StructField("chunk_group", T.IntegerType())])
    return narrow.groupBy("chunk_id").applyInArrow(scan, schema)


def _first_numbers(groups: DataFrame) -> DataFrame:
    """(n_chunk, n_first): how many groups the chunks before each one have."""
    per_chunk = groups.groupBy(F.col("chunk_id").alias("n_chunk")).agg((F.max("chunk_group") + 1).alias("n_groups"))
    return running_total(per_chunk, "n_chunk", "n_groups", "n_first").select("n_chunk", "n_first")


def _numbered(clustered: DataFrame, before: DataFrame) -> DataFrame:
    return clustered.join(before, F.col("chunk_id") == F.col("n_chunk")).withColumn("group_id", (F.col("n_first") + F.col("chunk_group")).cast("long")).drop("n_chunk", "n_first")


def number_groups(clustered: DataFrame) -> DataFrame:
    """A column group_id over all chunks: chunks ascending, groups in the order of their first rows."""
    return _numbered(clustered, _first_numbers(clustered))


def grouped_annotations(annotations: DataFrame, threshold: float = THRESHOLD, columns: Iterable[str] | None = None) -> DataFrame:
    """Annotations with chunk_group and group_id, as number_groups(cluster(...)) gives them, clustered once; all their columns, or those that cluster keeps.

    What is clustered is stored with all that is kept, and the chunks' first numbers beside it; whatever is computed from the
    result reads the columns that it needs, and never texts again for their groups.
    """
    rows = stored(cluster(annotations, threshold, columns), "groups")
    before = stored(_first_numbers(rows), "numbers")
    return _numbered(rows, before)


def overlapping_pairs(annotations: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, overlap) of rows of one key whose passages overlap enough.

    Each row moves once with its tokens' 64-bit hashes, and each pair of a key is compared where it meets; nothing is
    made or shuffled by common token.
    """
    t = annotations.select(F.col(key).alias("k"), "row_id", token_hashes(F.col("passage")).alias("tokens"))
    x, y = t.alias("x"), t.alias("y")
    least = F.least(F.size("x.tokens"), F.size("y.tokens"))
    # one expression, so that the order of rows is seen before their tokens are compared
    overlap = F.when((F.col("x.row_id") < F.col("y.row_id")) & (least > 0), F.size(F.array_intersect("x.tokens", "y.tokens")) / least)
    pairs = x.join(y, F.col("x.k") == F.col("y.k")).select(F.col("x.row_id").alias("a"), F.col("y.row_id").alias("b"), overlap.alias("overlap"))
    return pairs.where(F.col("overlap") >= threshold)


def groups_table(clustered: DataFrame) -> DataFrame:
    """One row for each group_id: models, number of models, representative passage (where passages are kept), agreement.

    The representative is the first of the longest passages; models are named in the order of their first rows.
    """
    rows = F.array_sort(F.collect_list(F.struct("row_id", "model_label")))
    out = clustered.groupBy("group_id", "chunk_id").agg(
        F.min("source_file").alias("source_file"),
        F.array_distinct(F.transform(rows, lambda r: r["model_label"])).alias("models"),
        F.count_distinct("soc_type").alias("n_types"),
        *([F.max_by("passage", F.struct(F.length("passage"), -F.col("row_id"))).alias("representative")] if "passage" in clustered.columns else []),
    )
    n = F.size("models")
    return out.withColumn("n_models", n).withColumn("agreement", F.when(n == 1, "single").when(F.col("n_types") == 1, "full").otherwise("partial")).drop("n_types")


