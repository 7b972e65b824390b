"""Mixing sources to target weights: a curriculum whose weights change over the training time.

A source's demand is the integral of its weight schedule; a document's place in its source's stream of words is
looked up in the inverse of that integral, which gives its time of training, and takes are sorted by that time in ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if, release, text_column, written
from scriptorium.operators.ordering import running_total

PER_BUCKET = 2_000
MOST_BUCKETS = 65_536
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Curriculum:
    """How sources are mixed.

    `weights` go round over the sources in the order of their names, null last. All sources together are to give `percent`
    of their words, each `most` times its words at most. `profiles` go round likewise: factors of the weight at
    equally spaced times from start to end of training, linear between them; they shape when words are
    taken, not how many.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    most: int = 2
    profiles: tuple[tuple[float, ...], ...] = ((3.0, 2.0, 1.0), (1.0, 2.0, 3.0), (1.0, 3.0, 1.0))

    def __post_init__(self) -> None:
        if not self.weights or min(self.weights) <= 0 or self.percent <= 0 or self.most < 1 or self.percent > 100 * self.most:
            raise ValueError("weights must be positive, and the percentage within what `most` passes give")
        if not self.profiles or any(len(p) < 2 or min(p) <= 0 for p in self.profiles):
            raise ValueError("a profile has two positive factors or more")


def training_time(profile: tuple[float, ...], share: str) -> str:
    """SQL: the time from 0 to 1 at which a schedule has demanded `share` (0 to 1) of all it demands.

    The schedule is linear between its knots, so its integral is quadratic there: b u + a u^2 = c is solved for the time u
    after a knot, in the form that has no difference of near values.
    """
    m = len(profile) - 1
    area = sum((p + q) / 2 for p, q in zip(profile, profile[1:], strict=False)) / m
    f = [p / area for p in profile]
    up = [0.0]
    for p, q in zip(f, f[1:], strict=False):
        up.append(up[-1] + (p + q) / 2 / m)
    number = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    cases = []
    for k in range(m):
        a, b, c = (f[k + 1] - f[k]) * m / 2, f[k], f"({share} - {number(up[k])})"
        time = f"{number(k / m)} + {number(2.0)} * {c} / ({number(b)} + sqrt({number(b * b)} + {number(4 * a)} * {c}))"
        cases.append(f"WHEN {share} < {number(up[k + 1])} THEN {time}" if k < m - 1 else f"ELSE {time}")
    return f"CASE {' '.join(cases)} END" if m > 1 else cases[0].removeprefix("ELSE ")


def _time_sql(profiles: tuple[tuple[float, ...], ...], rank: str, share: str) -> str:
    return "CASE " + " ".join(f"WHEN {rank} % {len(profiles)} = {k} THEN {training_time(p, share)}" for k, p in enumerate(profiles)) + " END"


def source_targets(sizes: DataFrame, how: Curriculum) -> DataFrame:
    """(m_key, source, m_rank, source_size, target, goal) of each source in sizes (m_key, source, size, copies).

    What a source's share has above `most` times its size goes to the others by weight, until none has too much. Each
    round is one sum over the sources, of which the last rounds' levels only rise; a round that finds no new source
    above is the last.
    """
    sums = sizes.groupBy("m_key").agg(F.first("source", ignorenulls=True).alias("source"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    ranked = running_total(sums.withColumn("m_one", F.lit(1)), "m_key", "m_one", "m_rank").drop("m_one")
    weight = F.element_at(F.array(*map(F.lit, how.weights)), (F.col("m_rank") % len(how.weights) + 1).cast("int"))
    sources = written(ranked.withColumn("m_weight", weight).withColumn("m_most", F.col("source_size") * how.most), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        above = F.col("m_most") < F.lit(level) * F.col("m_weight")
        n, full, weights = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("m_most")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("m_weight")))).first()
        if n == capped or not weights:
            break
        level, capped = (total * how.percent / 100 - full) / weights, n
    target = F.least(F.col("m_most").cast("double"), F.lit(level) * F.col("m_weight"))
    out = sources.withColumn("target", target).withColumn("goal", F.floor("target"))
    out.stored_at = sources.stored_at
    return out


def plan(docs: DataFrame, how: Curriculum = Curriculum()) -> DataFrame:
    """The mix: a row for each take of a document, sorted by time of training in ranges, stored.

    Columns doc_id, source, size (words of the text), source_size, target (words that the source is to give), copy (0, or
    the number among rows of equal doc_id, source and size), pass, words (that this take has, from the text's first), position
    (0 to 1; null where words is 0). Documents of a source follow each other in the order of their ids' digests, pass after pass, until
    the source has given its target, rounded down; only the last take of a source may be a part of its document. A
    document that is not taken at all has one row with words 0.

    Null texts have size 0, a null id is one value as any other, null sources are one source, repeated rows are taken one by one. An empty
    table gives an empty mix; where no text has a word, targets are 0.
    """
    size = F.regexp_count(text_column(docs), F.lit(WORD)).cast("long")
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = docs.select(key.alias("m_key"), F.col("source"), F.col("doc_id"), size.alias("size"))
    rows = written(rows.groupBy("m_key", "source", "doc_id", "size").agg(F.count("*").alias("copies")), "sizes")
    sources = source_targets(rows, how)
    # ranges of digests: a source of most rows is dealt over as many tasks as the table's size asks for
    buckets = min(MOST_BUCKETS, rows.count() // PER_BUCKET + 1)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    of = F.floor(F.conv(F.left("m_digest", F.lit(4)), 16, 10).cast("long") * buckets / 65_536)
    dealt = rows.withColumn("m_digest", digest).withColumn("m_bucket", of).withColumn("m_words", F.col("size") * F.col("copies"))
    up_to = W.rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("m_key", "m_bucket").agg(F.sum("m_words").alias("m_sum"))
    base = base.select("m_key", "m_bucket", F.coalesce(F.sum("m_sum").over(up_to.partitionBy("m_key").orderBy("m_bucket")), F.lit(0)).alias("m_base"))
    inside = F.coalesce(F.sum("m_words").over(up_to.partitionBy("m_key", "m_bucket").orderBy("m_digest", "doc_id", "size")), F.lit(0))
    placed = dealt.withColumn("m_before", inside).join(base, ["m_key", "m_bucket"])
    placed = placed.join(broadcast_if(sources.select("m_key", "m_rank", "source_size", "target", "goal"), 100_000), "m_key")
    # copies in blocks, so that no row holds the numbers of all
    each = placed.withColumn("m_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 4096))))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("m_block") * 4096, F.least(F.col("copies"), (F.col("m_block") + 1) * 4096) - 1)))
    each = each.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(how.most - 1))))
    start = F.col("pass") * F.col("source_size") + F.col("m_base") + F.col("m_before") + F.col("copy") * F.col("size")
    each = each.withColumn("m_start", start).withColumn("words", F.greatest(F.lit(0), F.least("size", F.col("goal") - F.col("m_start")))).where("words > 0 OR pass = 0")
    share = each.withColumn("m_share", F.when(F.col("words") > 0, F.col("m_start").cast("double") / F.col("target")))
    timed = share.withColumn("position", F.when(F.col("words") > 0, F.expr(_time_sql(how.profiles, "m_rank", "m_share"))))
    order = [F.asc_nulls_last("position"), F.asc("m_rank"), F.asc("m_digest"), F.asc("doc_id"), F.asc("size"), F.asc("copy"), F.asc("pass")]
    ordered = timed.repartitionByRange(*order).sortWithinPartitions(*order)
    out = written(ordered.select("doc_id", "source", "size", "source_size", "target", "copy", "pass", "words", "position"), "mix")
    release(rows, sources)
    return out


def taken(mix: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken (words, repeats counted), position (of the first take, null if none)."""
    rows = mix.groupBy("source", "doc_id", "size", "copy").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"), F.round(F.min("position"), 9).alias("position"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed_texts(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The training texts in the order of the mix: doc_id, source, pass, position, text (a last take has its first words only)."""
    size = F.regexp_count(text_column(docs), F.lit(WORD)).cast("long")
    texts = docs.select("doc_id", "source", size.alias("size"), text_column(docs).alias("m_text"))
    texts = texts.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("m_text"))) - 1)
    takes = mix.where("words > 0")
    same = [takes[c].eqNullSafe(texts[c]) for c in ("doc_id", "source", "size")] + [takes["copy"] == texts["copy"]]
    cut = F.when(takes["words"] == takes["size"], F.col("m_text")).otherwise(F.expr(r"array_join(slice(regexp_extract_all(m_text, '[^\\x20\\x09-\\x0D]+', 0), 1, cast(words AS int)), ' ')"))
    out = takes.join(texts, same).select(takes["doc_id"], takes["source"], "pass", "position", cut.alias("text"))
    return out.repartitionByRange("position").sortWithinPartitions("position", "source", "doc_id", "pass")


def sql(how: Curriculum = Curriculum()) -> str:
    """DuckDB SQL of `taken(plan(documents, how))`."""
    return rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, how.weights))}][k % {len(how.weights)} + 1] AS weight FROM s),
-- sources fill up in the order of what they have for a unit of weight; the level is the highest that what is left gives
o AS (SELECT *, (SELECT sum(source_size) FROM w) * {how.percent} / 100 AS whole, coalesce(sum({how.most} * source_size) OVER up, 0) AS full_up, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS open
      FROM w WHERE source_size > 0 WINDOW up AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((CAST(whole AS DOUBLE) - CAST(full_up AS DOUBLE)) / CAST(open AS DOUBLE)) AS level FROM o),
t AS (SELECT source, k, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(CAST({how.most} * source_size AS DOUBLE), level * weight) END AS target FROM w, l),
p AS (SELECT d.*, t.k, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY digest, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, list_sum(list_transform(range(0, {how.most}), lambda i: greatest(0, least(size, CAST(floor(target) AS BIGINT) - before - i * source_size)))) AS taken, before / target AS share FROM p)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CASE WHEN taken > 0 THEN round({_time_sql(how.profiles, "k", "share")}, 9) END AS position FROM r"""
