"""Token ids of documents as Simple-8b files: written in ascending doc_id order, and read back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scriptorium.llm.common import broadcast_if, column_of, slices, text_array, text_column, work_dir, written
from scriptorium.llm.simple8b import encode_documents, pack_file, unpack_file
from scriptorium.llm.tokenization import word_encoder

MOST_BROADCAST = 400_000
#: Beyond so many files, files grow instead.
MOST_FILES = 200_000
MOST_SAMPLED = 1_000_000
NO_ID = -(1 << 63)
_ENCODED = "part int, doc_id long, n_tokens long, piece binary"
_FILES = "part int, file string, n_documents long, n_tokens long, n_bytes long"


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one end id after each text's."""
    ends = np.cumsum(lengths + 1)
    out = np.empty(len(ids) + len(lengths), np.uint32)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    out[mask] = ids
    out[ends - 1] = end_id
    return out, lengths + 1


def id_bounds(rows: DataFrame, parts: int, n: int) -> np.ndarray:
    """The bounds between `parts` ranges of doc_id with about as many of the n rows each, ascending; nulls are NO_ID, the least.

    They are quantiles of a sample of 64 ids a range, a million at most: 8 MB, however large the table. An id of many rows is
    a bound several times.
    """
    if parts == 1:
        return np.zeros(0, np.int64)
    wanted = min(MOST_SAMPLED, 64 * parts)
    sample = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).sample(min(1.0, wanted / n), 5).limit(2 * wanted).toArrow()["id"]
    ids = np.sort(sample.to_numpy())
    return ids[np.arange(1, parts) * len(ids) // parts] if len(ids) else ids


def deal(bounds: np.ndarray, ids: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """The part of each document: how many bounds its id has reached. One whose id is a bound several times goes to one of the parts between them, by its content."""
    part = np.searchsorted(bounds, ids, "right")
    wide = part - np.searchsorted(bounds, ids, "left")
    for i in np.flatnonzero(wide > 1).tolist():
        part[i] -= zlib.crc32(pieces[i]) % int(wide[i])
    return part.astype(np.int32)


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_file: str, end_id: int = 2, file_chars: int = 24_000_000) -> DataFrame:
    """Encode docs (doc_id, text) and write them as files part-NNNNNN.s8b in out_dir.

    Part k holds the documents whose id lies between the k-th and next of as many bounds as files of about
    `file_chars` characters are needed (see id_bounds); inside a part they ascend by id, and rows without id come
    first of all. Null texts are empty and have the end id alone. Repeated ids give documents of their own,
    side by side; those of an id that fills several files are dealt to them by their content. Texts are
    encoded before the one shuffle, which moves coded ids only. Returns the files' manifest (part, file, n_documents, n_tokens, n_bytes).
    out_dir must be a folder that all executors reach through a URI that pyarrow.fs can open.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    total = rows.agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows")).first()
    size = total["n"] or 0
    parts = int(size // max(file_chars, size // MOST_FILES)) + 1 if size else 1
    bounds = id_bounds(rows, parts, total["rows"])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file)
        for b in slices(batches, 4_000_000):
            ids, lengths = with_end(*encoder.encode(text_array(b)), end_id)
            doc_id = column_of(b, "doc_id")
            pieces = encode_documents(ids, lengths)
            part = deal(bounds, doc_id.fill_null(NO_ID).to_numpy(zero_copy_only=False), pieces)
            yield pa.RecordBatch.from_arrays([pa.array(part), doc_id, pa.array(lengths), pa.array(pieces, pa.binary())], names=["part", "doc_id", "n_tokens", "piece"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        from pyarrow import fs

        ids, lengths = table["doc_id"].combine_chunks(), table["n_tokens"].to_numpy()
        has = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        pieces = table["piece"].to_pylist()
        order = sorted(range(len(pieces)), key=lambda i: (has[i], values[i], lengths[i], pieces[i]))
        data = pack_file(values[order], has[order], lengths[order], [pieces[i] for i in order])
        part = key[0].as_py()
        store, path = fs.FileSystem.from_uri(out_dir)
        store.create_dir(path, recursive=True)
        name = f"part-{part:06d}.s8b"
        # a second attempt writes the same bytes; the rename puts whole files only in place
        draft = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(data)
        store.move(draft, f"{path}/{name}")
        return pa.table({"part": pa.array([part], pa.int32()), "file": [name], "n_documents": pa.array([len(pieces)], pa.int64()), "n_tokens": pa.array([int(lengths.sum())], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})

    # as many tasks as files: a task's bytes do not grow with the input
    return written(rows.mapInArrow(encode, _ENCODED).repartition(parts, "part").groupBy("part").applyInArrow(write, _FILES), "token-files")


def _starts(files: DataFrame, together: int = 4096) -> DataFrame:
    """(at_part, base): the tokens before each file, added up within runs of `together` files and over the runs."""
    parts = files.select(F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("at_part"), "n_tokens").withColumn("run", F.floor(F.col("at_part") / together))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    # a row for each run of files goes through one task, not one for each file
    runs = parts.groupBy("run").agg(F.sum("n_tokens").alias("n")).select(F.col("run").alias("of_run"), F.coalesce(F.sum("n").over(before.orderBy("run")), F.lit(0)).alias("before"))
    inside = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before.partitionBy("run").orderBy("at_part")), F.lit(0)))
    return inside.join(broadcast_if(runs, MOST_BROADCAST), F.col("run") == F.col("of_run")).select("at_part", (F.col("base") + F.col("before")).alias("base"))


def read_tokens(spark: SparkSession, out_dir: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: (doc_id, start, n_tokens, ids_crc32[, ids]), start over all files in order."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if files.isEmpty():
        return spark.createDataFrame([], schema)
    base = _starts(files)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").schema("path string, modificationTime timestamp, length long, content binary").load(out_dir)
    joined = content.select("content", F.regexp_extract("path", r"part-(\d+)\.s8b$", 1).cast("int").alias("at_part")).join(broadcast_if(base, MOST_BROADCAST), "at_part").select("content", F.coalesce("base", F.lit(0)).cast("long").alias("base"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, first in zip(column_of(b, "content"), column_of(b, "base").to_pylist(), strict=True):
                for doc_ids, has, lengths, ids in unpack_file(memoryview(content.as_buffer())):
                    ids = ids.astype("<u4")
                    ends = np.cumsum(lengths)
                    crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    cols = [pa.array(doc_ids, mask=~has), pa.array(first + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    first += int(lengths.sum())

    return joined.mapInArrow(decode, schema)


def token_output(docs: DataFrame, tokenizer_file: str, end_id: int = 2, out_dir: str | None = None) -> DataFrame:
    """Write docs' ids as Simple-8b files and return what is read back from them."""
    spark = docs.sparkSession
    out_dir = out_dir or work_dir(spark, "tokens")
    return read_tokens(spark, out_dir, write_tokens(docs, out_dir, tokenizer_file, end_id))
