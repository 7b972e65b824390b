"""Passage groups of annotations as they arrive: each chunk's token sets and groups are kept as state, and changed groups come out."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from scriptorium.operators.matching import THRESHOLD, token_hashes
from scriptorium.storage import exists

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = "chunk_id string, chunk_group int, source_file string, models array<string>, representative string, n_models int, agreement string"
#: A chunk's passages in their order: the 64-bit hashes of all, how many each has, and its group; then the fields of each group.
_STATE = "tokens binary, sizes array<int>, groups array<int>, source_files array<string>, models array<array<string>>, types array<array<string>>, representatives array<string>"


class Members:
    """A chunk's passages so far: which group a next one joins, the first that has a member it overlaps enough, or a new one."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.sizes, self.groups, self.where, self.made = threshold, [], [], {}, 0

    def add(self, tokens: list[int], group: int | None = None) -> int:
        """Take a passage into a given group, or into its own."""
        if group is None:
            common = Counter(chain.from_iterable(map(self.where.get, tokens, repeat(()))))
            near = [self.groups[i] for i, n in common.items() if n / min(len(tokens), self.sizes[i]) >= self.threshold]
            group = min(near, default=self.made)
        for t in tokens:
            self.where.setdefault(t, []).append(len(self.sizes))
        self.sizes.append(len(tokens))
        self.groups.append(group)
        self.made = max(self.made, group + 1)
        return group


def _regroup(threshold: float) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk = Members(threshold)
        tokens, sizes, groups, *fields = state.get if state.exists else (b"", [], [], [], [], [], [])
        for own, group in zip(np.split(np.frombuffer(tokens, np.int64), np.cumsum(sizes, dtype=np.int64)[:-1]), groups, strict=bool(sizes)):
            chunk.add(own.tolist(), group)
        summaries = [[f, list(m), list(t), p] for f, m, t, p in zip(*fields, strict=True)]
        new, changed = [], {}
        # a chunk's rows of one batch; their order decides, as it does for all at once
        for r in pd.concat(rows).sort_values(["row_id", "g_hash"], kind="stable").itertuples(index=False):
            new.append(np.asarray(r.g_tokens, np.int64))
            group = chunk.add(new[-1].tolist())
            if group == len(summaries):
                summaries.append([None, [], [], None])
            s = changed[group] = summaries[group]
            s[0] = r.source_file if s[0] is None else s[0] if r.source_file is None else min(s[0], r.source_file)
            for seen, value in ((s[1], r.model_label), (s[2], r.soc_type)):
                if value is not None and value not in seen:
                    seen.append(value)
            if r.passage is not None and (s[3] is None or len(r.passage) > len(s[3])):
                s[3] = r.passage
        state.update((tokens + b"".join(x.tobytes() for x in new), chunk.sizes, chunk.groups, *map(list, zip(*summaries, strict=True))))
        agreement = ["single" if len(s[1]) == 1 else "full" if len(s[2]) == 1 else "partial" for s in changed.values()]
        yield pd.DataFrame({
            "chunk_id": [key[0]] * len(changed), "chunk_group": list(changed), "source_file": [s[0] for s in changed.values()], "models": [s[1] for s in changed.values()],
            "representative": [s[3] for s in changed.values()], "n_models": [len(s[1]) for s in changed.values()], "agreement": agreement,
        })

    return run


def group_updates(annotations: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of a stream of annotations (row_id, chunk_id, passage, model_label, soc_type, source_file) the groups that each batch has changed, as they are then.

    The last row of each chunk and group is what matching.groups_table makes of all rows so far, however the rows are cut into
    batches, if rows of a chunk arrive in the order of row_id. Rows without chunk_id are in no group. State is kept by
    chunk, as one row that comes and goes with the chunk's rows, and bounded by what is reported of one.
    """
    rows = annotations.where("chunk_id IS NOT NULL").select("chunk_id", "row_id", F.xxhash64("passage").alias("g_hash"), token_hashes(F.col("passage")).alias("g_tokens"), "model_label", "soc_type", "source_file", "passage")
    return rows.groupBy("chunk_id").applyInPandasWithState(_regroup(threshold), GROUPS, _STATE, "update", "NoTimeout")


def run_groups(annotations: DataFrame, out: str, checkpoint: str, threshold: float = THRESHOLD) -> StreamingQuery:
    """Take what is new in a stream of annotations, and write the groups that changed to `out`, a folder a batch; a batch that is repeated writes its folder anew."""
    annotations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return group_updates(annotations, threshold).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_groups(spark: SparkSession, out: str) -> DataFrame:
    """Each group as its last batch left it; empty where nothing has come yet."""
    if not exists(spark, out):
        return spark.createDataFrame([], GROUPS)
    rows = spark.read.schema(f"{GROUPS}, batch int").parquet(out)
    last = rows.groupBy("chunk_id", "chunk_group").agg(F.max_by(F.struct("source_file", "models", "representative", "n_models", "agreement"), "batch").alias("g"))
    return last.select("chunk_id", "chunk_group", "g.*")
