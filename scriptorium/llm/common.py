"""Helpers that the corpus operators share: the shared work folder, written tables, Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared spark.checkpoint.dir.

    Where that setting is absent, in local mode only (tests), a temporary folder of the driver is used,
    and it also becomes the context's checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
            spark.sparkContext.setCheckpointDir(base)
    if not _made:
        atexit.register(clean_up)
    path = f"{base.rstrip('/')}/scriptorium-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up() -> None:
    """Remove the written tables of this process; results that were not yet read need them."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before the interpreter
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, and lost executors cost nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove tables that `written` made and that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.stored_at)
        _made.remove((df.sparkSession, df.stored_at))


def made() -> int:
    """A mark of the tables that were made so far, for release_since."""
    return len(_made)


def release_since(mark: int, *keep: str) -> None:
    """Remove all tables that were made since a mark, but those at the given paths: for use when what needed them is written."""
    for spark, path in _made[mark:]:
        if path not in keep:
            _delete(spark, path)
            _made.remove((spark, path))


def slices(batches: Iterable[pa.RecordBatch], chars: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `chars` bytes of `column`, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(_lengths(batch, column))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + chars, "right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return free memory to the system: a worker goes on to other tasks, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterable[pa.RecordBatch], chars: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Join record batches to ones with about `chars` bytes of `column`; larger ones are cut."""
    held, size = [], 0
    for b in slices(batches, chars, column):
        n = int(_lengths(b, column).sum())
        if held and size + n > chars:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def as_bytes(batch: pa.RecordBatch) -> bytes:
    """A record batch as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(value: pa.Scalar) -> pa.RecordBatch:
    """The record batch of as_bytes."""
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _lengths(batch: pa.RecordBatch, column: str) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def text_array(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts as an Arrow array, null as the empty text."""
    return batch.column(batch.schema.get_field_index(column)).fill_null("")


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Split texts at every space: each word's place among the distinct words, those, words per text."""
    import pyarrow.compute as pc

    lists = pc.split_pattern(texts, " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, counts


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of `values` over runs of `counts` items."""
    total, ends = np.append(0, np.cumsum(values)), np.cumsum(counts)
    return total[ends] - total[ends - counts]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every row, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def text_column(df: DataFrame, name: str = "text") -> F.Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """Broadcast df only when it is counted and has at most `most` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


Mapper = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]
