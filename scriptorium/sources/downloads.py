"""Downloads as files: hosts side by side, each at its own pace; files that are there are left, and appear whole."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import book_name, strip_boilerplate, words
from scriptorium.sources.readers import BOOK_URLS
from scriptorium.storage import stored

#: get(url) gives a text, or None where the host has none; whatever it raises is a failure of that address.
Get = Callable[[str], str | None]


def book_urls(number: Column) -> Column:
    """The addresses of a public book, in the order in which they are tried."""
    return F.array(*(F.replace(F.lit(u), F.lit("{id}"), number.cast("string")) for u in BOOK_URLS))


def fetched(wanted: DataFrame, make_get: Callable[[], Get], delay: float = 2.0) -> DataFrame:
    """wanted (urls array<string>, ...) with text, from the first address that has one, and error: what the others raised, if none has.

    All of a host's addresses are one task's, one after the other, with a pause after each row that was asked for; rows go by the host of
    their first address. make_get() runs once in each task. A row without addresses is an error.
    """
    host = F.coalesce(F.regexp_extract(F.get("urls", F.lit(0)), r"^\w+://([^/]+)", 1), F.lit(""))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema) + ", text string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = None
        for f in frames:
            out = []
            for urls in f["urls"]:
                get = get or make_get()
                text, why = None, [] if urls is not None and len(urls) else ["no address"]
                for u in [] if urls is None else urls:
                    try:
                        text = get(u)
                    except Exception as e:  # noqa: BLE001  the next address is tried
                        why.append(f"{u}: {type(e).__name__}: {e}")
                    if text is not None:
                        break
                out.append((text, None if text is not None else "; ".join(why) or "not found"))
                time.sleep(delay)
            yield f.drop(columns="f_host").assign(text=[t for t, _ in out], error=[e for _, e in out])

    return wanted.withColumn("f_host", host).repartition("f_host").mapInPandas(run, schema)


def write_texts(rows: DataFrame, folder: str) -> DataFrame:
    """rows (source_file, text, ...) as files in a folder that all machines mount; returns rows without text, with `saved`.

    A file is written under another name and renamed, so it is there whole or not at all; one that is there already stays, and is not saved.
    """
    root = folder.removeprefix("file://")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", saved boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        for f in frames:
            saved = []
            for name, text in zip(f["source_file"], f["text"], strict=True):
                part, final = os.path.join(root, f".{name}.{uuid4().hex[:8]}"), os.path.join(root, name)
                with open(part, "w", encoding="utf-8", newline="") as out:
                    out.write(text)
                try:
                    os.link(part, final)  # fails where another task was first, unlike a rename
                    saved.append(True)
                except FileExistsError:
                    saved.append(False)
                os.remove(part)
            yield f.drop(columns="text").assign(saved=saved)

    return rows.mapInPandas(run, schema)


def download_books(books: DataFrame, folder: str, make_get: Callable[[], Get], delay: float = 2.0, least_words: int = 1_000) -> DataFrame:
    """Fetch catalogued books (id, author, title) into a folder: (id, source_file, status, n_words, error) for each.

    status is exists (nothing was asked for), saved, short (fewer than least_words without the boilerplate; no file), or failed, with what the
    addresses raised. What was fetched is stored before files are written, so a lost task asks again for its own rows only. The
    name has the number and the title. A number that the catalogue has twice is fetched once.
    """
    root = folder.removeprefix("file://")
    named = books.dropDuplicates(["id"]).withColumn("source_file", book_name(F.col("id"), F.col("title")))
    there = books.sparkSession.createDataFrame([(n,) for n in (os.listdir(root) if os.path.isdir(root) else [])], "e_file string")
    present = named.join(there, F.col("source_file") == F.col("e_file"), "left_semi").select("id", "source_file", F.lit("exists").alias("status"), F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("string").alias("error"))
    missing = named.join(there, F.col("source_file") == F.col("e_file"), "left_anti").select("id", "source_file", book_urls(F.col("id")).alias("urls"))
    got = stored(fetched(missing, make_get, delay).drop("urls"), "downloads").withColumn("text", strip_boilerplate(F.col("text"))).withColumn("n_words", F.when(F.col("text").isNotNull(), F.size(words(F.col("text")))))
    written = write_texts(got.where(F.col("n_words") >= least_words).select("id", "source_file", "text", "n_words"), folder)
    saved = written.select("id", "source_file", F.when(F.col("saved"), "saved").otherwise("exists").alias("status"), "n_words", F.lit(None).cast("string").alias("error"))
    others = got.where(F.col("n_words").isNull() | (F.col("n_words") < least_words)).select("id", "source_file", F.when(F.col("n_words").isNull(), "failed").otherwise("short").alias("status"), "n_words", "error")
    return stored(present.unionByName(saved).unionByName(others), "download-states")


def failures(states: DataFrame) -> DataFrame:
    """The books that download_books could not save."""
    return states.where(F.col("status").isin("failed", "short"))
