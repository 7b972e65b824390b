"""JSON arrays that many tasks write and read: parts that joined in the order of their names are one array, and rows as the splits' borders."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators.ordering import order_buckets, running_total

#: A row of an array begins on a line of its own, two spaces in. No text can hold this: line ends in JSON texts are escaped.
BORDER = "\n  {"
PER_PART = 100_000


def write_arrays(rows: DataFrame, path: str, by: str, order: list[str], per_part: int = PER_PART) -> None:
    """Rows as one JSON array for each value of `by`, in folders by that value: a line for each row, brackets around them.

    The rows are dealt to tasks by ranges of the order columns, whatever their `by`, so no task has a whole array. Each task's part of an
    array is a file; a folder's files in the order of their names are the array, and where there is one, it is the array. Only
    the numbers of rows by part and array are gathered: they tell a task which of its rows opens or closes an array. The
    files appear when the job commits, all of them or none. Rows that are equal in all order columns keep any order.
    """
    key = F.struct(*order) if order else F.struct(F.lit(0).alias("none"))
    line = F.to_json(F.struct(*[c for c in rows.columns if c != by]), {"ignoreNullFields": "false"})
    each = rows.select(F.col(by).cast("string").alias("a_by"), key.alias("a_key"), line.alias("a_row"))
    dealt = each.withColumn("a_part", order_buckets(each, F.col("a_key"), per_part))
    counts = dealt.groupBy("a_by", "a_part").agg(F.count("*").alias("a_n"))
    in_part, in_array = W.partitionBy("a_part").orderBy("a_by").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("a_by")
    bounds = counts.select(
        F.col("a_by").alias("b_by"), F.col("a_part").alias("b_part"), F.coalesce(F.sum("a_n").over(in_part), F.lit(0)).alias("a_first"), "a_n",
        (F.min("a_part").over(in_array) == F.col("a_part")).alias("a_opens"), (F.max("a_part").over(in_array) == F.col("a_part")).alias("a_closes"),
    )
    known = dealt.join(bounds, F.col("a_by").eqNullSafe(F.col("b_by")) & (F.col("a_part") == F.col("b_part")))
    parts = (dealt.agg(F.max("a_part")).first()[0] or 0) + 1
    ordered = known.repartitionById(parts, F.col("a_part").cast("int")).sortWithinPartitions(F.asc_nulls_first("a_by"), "a_key")
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) - F.col("a_first")
    placed = ordered.withColumn("a_at", at)
    opens, closes = F.col("a_opens") & (F.col("a_at") == 0), F.col("a_closes") & (F.col("a_at") == F.col("a_n") - 1)
    value = F.concat(F.when(opens, "[\n").otherwise(""), F.lit("  "), "a_row", F.when(closes, "\n]").otherwise(","))
    placed.select(value.alias("value"), F.col("a_by").alias(by)).write.mode("overwrite").partitionBy(by).text(path)


@dataclass(frozen=True)
class Scan:
    """What a scan of files gave: rows, the records that could not be read (stem, record), and the files' stems."""

    rows: DataFrame
    bad: DataFrame
    stems: list[str]

    def checked(self, bad: str, what: str) -> DataFrame:
        """The rows. Where there are bad records, `raise` is an error, `warn` a warning with some files' names, `ignore` neither."""
        if bad not in ("raise", "warn", "ignore"):
            raise ValueError(f"unknown way with bad records: {bad}")
        if bad != "ignore":
            found = sorted({r.stem for r in self.bad.select("stem").limit(100).collect()})
            if found and bad == "raise":
                raise ValueError(f"{what} that cannot be read: {', '.join(found)}")
            if found:
                warnings.warn(f"{what} that cannot be read are left out: {', '.join(found)}", stacklevel=3)
        return self.rows


def _struct(schema: str, more: str = "") -> str:
    return f"struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.split(', '))}{more}>"


def _bordered(spark: SparkSession, file: str) -> bool:
    """Whether a file's first row begins after two spaces, on a line of its own: its first bytes tell."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return re.match(rb"(\s*\[\n)?  \{", bytes(stream.readNBytes(64))) is not None
    finally:
        stream.close()


def scan_arrays(spark: SparkSession, folder: str, schema: str, skip: Callable[[str], bool] = lambda stem: False) -> Scan:
    """Rows of all JSON arrays in a folder (*.json, or folders of write_arrays), with stem and row_id: their places, files in the order of their paths.

    Arrays whose rows each begin on a line of their own after two spaces, as write_arrays and common writers with an
    indentation of two give them, are read in blocks by many tasks: rows are what lies between such borders. An array in
    another form is one task's. Blocks' sizes are summed, so that no task numbers all rows. stem is the file's name without
    its ending, or a part's folder's value; `skip` tells stems that are left out. A row's missing fields, and those of another
    type, are null. Bad are records that are no JSON, and files that hold no array of objects; they count as a place. An empty file is no array and no error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).inputFiles()
    stem_of = {f: unquote(re.search(r"=([^/]*)/part-[^/]*$|([^/]+?)(\.[^./]*)?$", f).expand(r"\1\2")) for f in files if f.endswith(".json") or re.search(r"=[^/]*/part-[^/]*$", f)}
    kept = [f for f in sorted(stem_of) if not skip(stem_of[f])]
    with ThreadPoolExecutor(32) as pool:  # first bytes of many files of a slow store
        bordered = [f for f, split in zip(kept, pool.map(lambda f: _bordered(spark, f), kept), strict=True) if split]
    whole = sorted(set(kept) - set(bordered))
    text, out = F.col("value"), []
    place = ["file", F.concat("file", F.format_string("#%020d", "start")).alias("block"), "at"]
    corrupt = {"columnNameOfCorruptRecord": "a_bad"}
    if bordered:
        lines = spark.read.option("lineSep", BORDER).text(bordered).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        lines = lines.withColumn("at", F.monotonically_increasing_id()).where(F.trim(F.translate("value", "\n", " ")) != "[")
        body = F.regexp_replace("value", r"(\s*,|\s*\])\s*$", "")
        body = F.when(F.startswith(F.ltrim("value"), F.lit("{")), body).otherwise(F.concat(F.lit("{"), body))
        one = lines.withColumn("body", body).withColumn("r", F.from_json("body", _struct(schema, ", a_bad: string"), corrupt))
        fine = F.col("r.a_bad").isNull() | F.try_parse_json("body").isNotNull()
        out.append(one.select(*place, F.when(fine, F.array(F.col("r").dropFields("a_bad"))).alias("rows"), F.when(~fine, text).alias("record")))
    if whole:
        texts = spark.read.text(whole, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        texts = texts.withColumn("at", F.monotonically_increasing_id()).where(F.trim(F.translate("value", "\n\r\t", "   ")) != "")
        found = F.when(F.startswith(F.ltrim(F.translate("value", "\n\r\t", "   ")), F.lit("[")), F.from_json("value", f"array<{_struct(schema)}>"))
        fine = F.col("rows").isNotNull() & ~F.exists("rows", lambda r: r.isNull())
        out.append(texts.withColumn("rows", found).select(*place, F.when(fine, F.col("rows")).alias("rows"), F.when(~fine, text).alias("record")))
    if not out:
        empty = spark.createDataFrame([], f"{schema}, stem string, row_id long")
        return Scan(empty, spark.createDataFrame([], "stem string, record string"), [])
    records = reduce(DataFrame.unionByName, out)
    told = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    records = records.withColumn("stem", F.regexp_replace(told, r"^.*?(?:=([^/]*)/part-[^/]*|([^/]+?)(?:\.[^./]*)?)$", "$1$2"))
    blocks = running_total(records.groupBy("block").agg(F.sum(F.coalesce(F.size("rows"), F.lit(1))).alias("n"), F.min("at").alias("first")), "block", "n").select("block", "first", "before")
    rows = records.where("rows IS NOT NULL").join(blocks, "block").select("stem", (F.col("before") + F.col("at") - F.col("first")).alias("a_base"), F.posexplode("rows").alias("a_pos", "r"))
    return Scan(rows.select("r.*", "stem", (F.col("a_base") + F.col("a_pos")).alias("row_id")), records.where("record IS NOT NULL").select("stem", "record"), [stem_of[f] for f in kept])
