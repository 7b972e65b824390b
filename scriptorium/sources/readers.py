"""Readers: raw documents, chunk markup, annotators' results, JSON lines, configuration, pages over HTTP."""

from __future__ import annotations

import io
import json
import os
import re
import warnings
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import reduce
from importlib.util import find_spec
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import book_name, file_stem, strip_boilerplate, words
from scriptorium.operators.chunking import from_markup, is_markup
from scriptorium.operators.consensus import TRACKS, Track, parse_track
from scriptorium.operators.ordering import running_total
from scriptorium.schemas import RESULT
from scriptorium.sources.arrays import Scan, scan_arrays

EXTENSIONS = ("txt", "doc", "docx", "pdf")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str | None:
    """Paragraphs of a Word document, blank ones left out; None if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in (body.findall(f"{_WORD}p") if body is not None else []))
    return "\n\n".join(p for p in paragraphs if p.strip())


def pdf_text(data: bytes) -> str | None:
    """Text of a PDF's pages, empty ones left out; None without the optional reader or if it cannot be read."""
    try:
        from pypdf import PdfReader
        from pypdf.errors import PdfReadError
    except ImportError:
        return None
    try:
        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    except PdfReadError:
        return None
    return "\n\n".join(p for p in pages if p.strip())


def read_documents(spark: SparkSession, folder: str, failed: bool = False, observation: Observation | None = None) -> DataFrame:
    """(source_file, text) of a folder's documents; with `failed`, those that cannot be read, too: their text is null and `error` says why.

    Plain text is UTF-8, or Latin-1 where it is no valid UTF-8, and stays in the JVM. Files of other types are none of a folder's
    documents; one that is asked for by its name is an error. An observation gets n_documents and n_failed of the job that reads them.
    store_documents keeps both kinds from one scan.
    """
    given = spark.read.format("binaryFile").load(folder)
    names = given.inputFiles()
    if len(names) == 1 and names[0].rsplit("/", 1)[-1] == folder.rstrip("/").rsplit("/", 1)[-1] and not re.search(rf"\.({'|'.join(EXTENSIONS)})$", folder, re.IGNORECASE):
        raise ValueError(f"unsupported type: {folder}")
    files = given.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")
    files = files.withColumn("ext", F.lower(F.regexp_extract("source_file", r"\.([^.]*)$", 1))).where(F.col("ext").isin(*EXTENSIONS))

    @F.pandas_udf("string")
    def extract(ext: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([(pdf_text if e == "pdf" else docx_text)(bytes(c)) for e, c in zip(ext, content, strict=True)])

    plain = files.where("ext = 'txt'").select("source_file", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")).alias("text"), F.lit(None).cast("string").alias("error"))
    missing = "" if find_spec("pypdf") else ": its reader is not installed"
    why = F.when(F.col("text").isNull(), F.concat(F.lit("not readable as "), "ext", F.when(F.col("ext") == "pdf", missing).otherwise("")))
    office = files.where("ext <> 'txt'").select("source_file", "ext", extract("ext", "content").alias("text")).select("source_file", "text", why.alias("error"))
    out = plain.unionByName(office)
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    return out if failed else out.where("text IS NOT NULL").drop("error")


def store_documents(spark: SparkSession, folder: str, out: str, bad: str = "warn") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Read a folder's documents once into a table at `out`: the good ones (source_file, text), the others (source_file, error), and how many there were.

    A folder without documents is an error; ones that cannot be read are an error (bad="raise"), a warning with some names, or neither
    (bad="ignore"). They stay in the table, so nothing is lost silently.
    """
    seen = Observation()
    read_documents(spark, folder, failed=True, observation=seen).withColumn("readable", F.col("error").isNull()).write.mode("overwrite").partitionBy("readable").parquet(out)
    counts = {k: seen.get[k] for k in ("n_documents", "n_failed")}
    if not counts["n_documents"]:
        raise ValueError(f"no documents in {folder}")
    rows = spark.read.schema("source_file string, text string, error string, readable boolean").parquet(out)
    failed = rows.where("NOT readable").select("source_file", "error")
    if counts["n_failed"] and bad != "ignore":
        names = ", ".join(sorted(r.source_file for r in failed.limit(100).collect()))
        if bad == "raise":
            raise ValueError(f"documents that cannot be read: {names}")
        warnings.warn(f"documents that cannot be read are set aside: {names}", stacklevel=2)
    return rows.where("readable").select("source_file", "text"), failed, counts


def read_chunks(spark: SparkSession, folder: str, overlap: int = 1_000) -> DataFrame:
    """Chunks of a folder's marked-up text files."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("text"))
    return from_markup(files.where(is_markup(F.col("text"))), overlap)


def scan_results(spark: SparkSession, folder: str, schema: str = RESULT, dashboard: bool = False) -> Scan:
    """The rows of all models' result arrays, with row_id in the order of file names and places, and the records that cannot be read.

    Combined and consensus files in the same folder are left out; the dashboard's scan leaves out the combined one only. A
    row without model_label takes its file's name.
    """
    skip = (lambda s: s == "results") if dashboard else (lambda s: s in ("results", "consensus") or s.startswith("consensus_"))
    scan = scan_arrays(spark, folder, schema, skip)
    return Scan(scan.rows.withColumn("model_label", F.coalesce("model_label", "stem")).drop("stem"), scan.bad, scan.stems)


def read_results(spark: SparkSession, folder: str, schema: str = RESULT, dashboard: bool = False, bad: str = "raise") -> DataFrame:
    """The rows of scan_results. Records that cannot be read are an error, or with bad="warn" left out under a warning; a folder without results is an error."""
    scan = scan_results(spark, folder, schema, dashboard)
    if not scan.stems:
        raise ValueError(f"no result files in {folder}")
    return scan.checked(bad, "result files")


def read_jsonl(spark: SparkSession, path: str, schema: str, numbered: bool = False) -> DataFrame:
    """JSON lines with a given schema; blank lines are left out. `numbered` adds row_id: the line's place, over all files by name.

    Lines are numbered within the blocks that tasks read, and only the blocks' sizes are summed.
    """
    if not numbered:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).where(F.trim("value") != "")
    lines = lines.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.concat("file", F.format_string("#%020d", "start")))
    blocks = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    named = running_total(blocks, "block", "n").select("block", "first", "before")
    each = lines.select("block", "at", F.from_json("value", f"struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.split(', '))}>").alias("r"))
    return each.join(named, "block").select("r.*", (F.col("at") - F.col("first") + F.col("before")).alias("row_id"))


def zip_files(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of two files at the same place (see read_jsonl's `numbered`); the longer one's rest goes."""
    return left.join(right, key)


def read_env(path: str) -> dict[str, str]:
    """The settings of a .env file: NAME=value lines, `export` and quotes allowed; comments and other lines are left out."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line):
                value = m.group(2)
                out[m.group(1)] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else re.sub(r"\s+#.*$", "", value)
    return out


def load_settings(path: str, env: dict[str, str] | None = None) -> dict:
    """A configuration file on the driver, YAML or JSON, with ${NAME} replaced in all its texts; YAML needs its optional reader."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        got = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path} needs a YAML reader, which is not installed; JSON does without") from e
        got = yaml.safe_load(text)

    def filled(x):  # noqa: ANN001, ANN202
        if isinstance(x, dict):
            return {k: filled(v) for k, v in x.items()}
        return [filled(v) for v in x] if isinstance(x, list) else interpolate(x, env) if isinstance(x, str) else x

    return filled(got or {})


@dataclass(frozen=True)
class ModelProfile:
    """An annotating model: where it answers, under which name, and how it samples."""

    label: str
    model_name: str
    base_url: str
    api_key: str = ""
    temperature: float = 0.3
    max_tokens: int = 4096


def load_profiles(settings: dict, env: dict[str, str] | None = None) -> list[ModelProfile]:
    """The profiles that a configuration lists under `models`; without any, a single one from the environment.

    A profile without a usable key is an error.
    """
    env = dict(os.environ) if env is None else env
    names = {f.name for f in fields(ModelProfile)}
    out = [ModelProfile(**{k: v for k, v in m.items() if k in names}) for m in settings.get("models") or []]
    if not out:
        name = env.get("MODEL_NAME", "")
        out = [ModelProfile(env.get("MODEL_LABEL") or name or "default", name, env.get("API_BASE_URL", ""), env.get("API_KEY", ""))]
    if bad := [p.label for p in out if not usable_key(p.api_key)]:
        raise ValueError(f"no usable key for: {', '.join(bad)}")
    return out


def interpolate(value: str, env: dict[str, str] | None = None) -> str:
    """Replace ${NAME} by the environment's value; names that are not set stay."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m.group(1), m.group(0)), value)


def usable_key(value: str) -> bool:
    """Whether a configured key is there and was replaced."""
    return bool(value) and not value.startswith("${")


def load_tracks(settings: dict) -> dict[str, Track]:
    """Tracks of a parsed configuration file; the standard ones where it names none."""
    named = settings.get("tracks") or {}
    return {k: parse_track(k, v or {}) for k, v in named.items()} or {t.name: t for t in TRACKS}


def choose_models(known: list[str], wanted: list[str]) -> list[str]:
    """The wanted labels, all known ones if none is wanted; unknown ones are an error."""
    if unknown := sorted(set(wanted) - set(known)):
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    return [m for m in known if not wanted or m in wanted]


#: Where a public e-book's text may lie.
BOOK_URLS = ("https://www.gutenberg.org/cache/epub/{id}/pg{id}.txt", "https://www.gutenberg.org/files/{id}/{id}-0.txt", "https://www.gutenberg.org/files/{id}/{id}.txt")


def fetch_books(catalog: DataFrame, make_get: Callable[[], Callable[[str], str | None]], least_words: int = 1000) -> DataFrame:
    """(id, text) of catalogued books: the first URL that answers, without boilerplate; short texts are left out.

    make_get() runs once in each task and gives the function that fetches a URL, or None.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make_get()
        for f in frames:
            texts = [next((t for u in BOOK_URLS if (t := get(u.format(id=i))) is not None), None) for i in f["id"]]
            yield pd.DataFrame({"id": f["id"], "text": texts})

    raw = catalog.select("id").distinct().mapInPandas(run, "id int, text string").where("text IS NOT NULL")
    return raw.withColumn("text", strip_boilerplate(F.col("text"))).where(F.size(words(F.col("text"))) >= least_words)


def catalog(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """A catalogue (id, author, title), the first entry of each id."""
    rows = [(i, *e) for i, e in enumerate(entries)]
    each = spark.createDataFrame(rows, "pos int, id int, author string, title string")
    return each.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("pos"))).where("k = 1").drop("k", "pos")


def missing_books(books: DataFrame, existing: DataFrame) -> DataFrame:
    """Books whose text file (book_name of id and title) is not among the existing files (column source_file)."""
    named = books.withColumn("source_file", book_name(F.col("id"), F.concat_ws(" ", "author", "title")))
    return named.join(existing.select("source_file").distinct(), "source_file", "left_anti")


def repeated_books(*catalogs: DataFrame) -> DataFrame:
    """(id, n, n_catalogs): ids that one catalogue lists twice or several list."""
    each = [c.select("id", F.lit(k).alias("k")) for k, c in enumerate(catalogs)]
    return reduce(DataFrame.unionByName, each).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_catalogs")).where("n > 1")


def pick_books(books: DataFrame, author: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Books of an author (part of the name, any case), or of given ids; ids that are not catalogued are added by number."""
    if ids:
        asked = books.sparkSession.createDataFrame([(i,) for i in ids], "id int").distinct()
        return asked.join(books, "id", "left").select("id", F.coalesce("author", F.lit("unknown")).alias("author"), F.coalesce("title", F.concat(F.lit("pg"), F.col("id").cast("string"))).alias("title"))
    return books.where(F.contains(F.lower("author"), F.lit(author.lower()))) if author else books
