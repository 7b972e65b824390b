"""Benchmark decontamination by a positional inverted index of the training text, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after a document's last word in the index; no word can be this.
_END = "\0"
#: Tables of more rows than this are joined by a shuffle, not by a broadcast.
MOST_BROADCAST = 400_000


def words_of(text: F.Column) -> F.Column:
    """Words of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII; null has none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _BETWEEN), "")


@dataclass(frozen=True)
class PositionalIndex:
    """Stored postings (row, pos, term); one row of term NUL for each document has its id, and its length as pos."""

    postings: DataFrame

    @property
    def documents(self) -> DataFrame:
        """(row, doc_id, n_words) of all documents."""
        return self.postings.where(F.col("term") == _END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))

    @property
    def terms(self) -> DataFrame:
        return self.postings.where(F.col("term") != _END).select("row", "pos", "term")


def build_index(docs: DataFrame, terms: DataFrame) -> PositionalIndex:
    """Store where in docs (doc_id, text) the given terms (column term) stand.

    Every row of docs is a document of its own, whatever its id; null texts have no words. Terms are
    filtered where they are read, so that only postings some search can ask for are stored.
    """
    ends = docs.sparkSession.createDataFrame([(_END,)], "term string")
    wanted = terms.select("term").where(F.col("term").isNotNull()).distinct().union(ends)
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.concat(words_of(F.col("text")), F.array(F.lit(_END))).alias("words"))
    all_terms = each.select("row", "doc_id", F.posexplode("words").alias("pos", "term"))
    found = all_terms.join(broadcast_if(wanted, MOST_BROADCAST), "term")
    return PositionalIndex(written(found.select("row", "pos", "term", F.when(F.col("term") == _END, F.col("doc_id")).alias("doc_id")), "postings"))


def phrase_matches(index: PositionalIndex, phrases: DataFrame, window: int = 10) -> DataFrame:
    """Where runs of `window` or more words of the phrases occur: (phrase, row, first, n_words).

    phrases has (phrase, words), words without null; a phrase of fewer words must occur as a whole.
    For each window the lists of its two rarest terms are intersected after their offsets are taken
    off, which leaves (row, phrase, shift) candidates. Then the lists of all the phrase's terms are
    intersected with those candidates, and runs of consecutive words are kept. Overlapping windows of
    one occurrence make one run.
    """
    phrases = phrases.where(F.size("words") > 0)
    terms = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("k", "term"))
    frequency = index.terms.groupBy("term").agg(F.count("*").alias("tf"))
    known = written(terms.join(broadcast_if(frequency, MOST_BROADCAST), "term"), "phrase-terms")
    # windows by their first word; one with a term that no document has is short of words and goes
    inside = known.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("k") - window + 1), F.greatest(F.lit(0), F.least(F.col("k"), F.col("n") - window)))))
    rare = (
        inside.groupBy("phrase", "n", "w")
        .agg(F.count("*").alias("m"), F.slice(F.array_sort(F.collect_list(F.struct("tf", "k", "term"))), 1, 2).alias("r"))
        .where(F.col("m") == F.least(F.col("n"), F.lit(window)))
    )
    first, second = F.col("r")[0], F.element_at("r", -1)
    anchors = written(rare.select("phrase", first["term"].alias("term"), first["k"].alias("k"), second["term"].alias("term2"), second["k"].alias("k2")).distinct(), "anchors")
    near = index.terms.join(broadcast_if(anchors, MOST_BROADCAST), "term").select("row", "phrase", (F.col("pos") - F.col("k")).alias("shift"), F.col("term2").alias("term"), (F.col("pos") - F.col("k") + F.col("k2")).alias("pos"))
    seconds = index.terms.join(broadcast_if(anchors.select(F.col("term2").alias("term")).distinct(), MOST_BROADCAST), "term", "left_semi")
    shifts = written(near.join(seconds, ["row", "pos", "term"], "left_semi").select("row", "phrase", "shift").distinct(), "shifts")
    rows = shifts.select("row").distinct()
    there = index.terms.join(broadcast_if(rows, MOST_BROADCAST), "row", "left_semi")
    asked = shifts.join(broadcast_if(known.select("phrase", "n", "k", "term"), MOST_BROADCAST), "phrase").withColumn("pos", F.col("shift") + F.col("k"))
    hits = asked.join(there, ["row", "pos", "term"], "left_semi")
    run = F.col("k") - F.row_number().over(W.partitionBy("row", "phrase", "shift").orderBy("k"))
    runs = hits.withColumn("run", run).groupBy("row", "phrase", "shift", "n", "run").agg(F.min("pos").alias("first"), F.count("*").alias("n_words"))
    return runs.where(F.col("n_words") >= F.least(F.col("n"), F.lit(window))).select("phrase", "row", "first", "n_words")


def proximity_matches(index: PositionalIndex, phrases: DataFrame, slop: int = 5) -> DataFrame:
    """Documents in which all terms of a phrase stand near each other: (phrase, row, pos).

    pos is a place of the phrase's rarest term with every other term at most `slop` words away, in
    any order. phrases has (phrase, words).
    """
    terms = phrases.select("phrase", F.explode(F.array_distinct("words")).alias("term"))
    frequency = index.terms.groupBy("term").agg(F.count("*").alias("tf"))
    known = terms.join(broadcast_if(frequency, MOST_BROADCAST), "term", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    ranked = written(known.withColumn("rank", F.row_number().over(W.partitionBy("phrase").orderBy("tf", "term"))).withColumn("m", F.count("*").over(W.partitionBy("phrase"))), "ranked-terms")
    anchors = ranked.where("rank = 1").select("phrase", "m", "term")
    at = index.terms.join(broadcast_if(anchors, MOST_BROADCAST), "term").select("phrase", "m", "row", F.col("pos").alias("at"))
    asked = at.join(ranked.where("rank > 1").select("phrase", "term"), "phrase", "left")
    # each place asks for the slop words on both sides, so the join has equal keys only
    places = asked.withColumn("pos", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)))
    near = places.join(index.terms, ["row", "pos", "term"], "left_semi").groupBy("phrase", "row", "at", "m").agg(F.count_distinct("term").alias("got"))
    alone = at.where("m = 1").select("phrase", "row", F.col("at").alias("pos"))
    return near.where("got = m - 1").select("phrase", "row", F.col("at").alias("pos")).union(alone)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Each document's words inside windows of benchmark items.

    Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of docs.
    benchmark has (item_id, text); null texts and texts without words give no window. A row without
    item_id can mark words but has no id to count. Repeated item ids count once.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    phrases = written(items.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    index = build_index(docs, phrases.select(F.explode("words").alias("term")))
    runs = written(phrase_matches(index, phrases.select("phrase", "words"), window), "runs")
    places = runs.select("row", F.explode(F.sequence("first", F.col("first") + F.col("n_words").cast("int") - 1)).alias("pos")).distinct()
    hit = places.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = runs.select("row", "phrase").distinct().join(broadcast_if(phrases.select("phrase", "item_ids"), MOST_BROADCAST), "phrase").select("row", F.explode("item_ids").alias("item_id"))
    ids = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    out = index.documents.join(hit, "row", "left").join(ids, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    ids_or_none = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(ids_or_none).cast("long").alias("n_items"), F.sha2(F.array_join(ids_or_none, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without any word inside a benchmark window, with all their columns.

    Texts are known by a 64-bit hash here, so that rows without or with repeated ids are judged by
    their own text.
    """
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    bad = broadcast_if(written(contamination(docs.select(key.alias("doc_id"), "text"), benchmark, window).where("contaminated").select(F.col("doc_id").alias("bad_key")).distinct(), "contaminated"), MOST_BROADCAST)
    return docs.join(bad, key == bad["bad_key"], "left_anti")


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rk, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT rk, i, n, id FROM dw JOIN win USING (n, g)),
h AS (SELECT rk, count(DISTINCT p) AS n_hit FROM (SELECT rk, unnest(range(i, i + n)) AS p FROM m) GROUP BY rk),
its AS (SELECT rk, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rk, id FROM m WHERE id IS NOT NULL) GROUP BY rk)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rk) LEFT JOIN its USING (rk)
"""
