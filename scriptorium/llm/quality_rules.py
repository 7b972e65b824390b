"""Quality rules as a short-circuit cascade: next comes the rule that rejects most per second of what is left."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import column_of, slices, text_column

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_LETTERLESS = re.compile(rb"(?<!\S)[^A-Za-z\x80-\xff\s]+(?!\S)")


def _without(text: bytes, chars: bytes) -> int:
    """How many of these characters the text has."""
    return len(text) - len(text.translate(None, chars))


def count_repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
    return int(np.count_nonzero(np.r_[hit, False, False] | np.r_[False, hit, False] | np.r_[False, False, hit]))


def text_lines(text: bytes) -> list[bytes]:
    """The lines that have a word."""
    return [x for x in text.split(b"\n") if x.strip(_SPACES)]


def base_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    chars = len(text) if text.isascii() else len(text.decode())
    lines = text_lines(text)
    return len(words), chars - _without(text, _SPACES), _without(text, _SYMBOLS), len(lines) - len(set(lines)), count_repeated_words(words)


@dataclass(frozen=True)
class Rule:
    """A named test of a whole UTF-8 text; True rejects it."""

    name: str
    rejects: Callable[[bytes], bool]


def few_words(text: bytes) -> bool:
    return len(text.split()) < 50


def repetitive(text: bytes) -> bool:
    words = text.split()
    return 100 * count_repeated_words(words) > 50 * len(words)


def many_symbols(text: bytes) -> bool:
    return 100 * _without(text, _SYMBOLS) > 30 * len(text.split())


def repeated_lines(text: bytes) -> bool:
    lines = text_lines(text)
    return 100 * (len(lines) - len(set(lines))) > 50 * len(lines)


def odd_word_length(text: bytes) -> bool:
    n, chars = len(text.split()), len(text.decode()) - _without(text, _SPACES)
    return chars > 20 * n or chars < 2 * n


def shouting(text: bytes) -> bool:
    upper = _without(text, _UPPER)
    return upper > _without(text, _LOWER)


def letterless(text: bytes) -> bool:
    return 100 * len(_LETTERLESS.findall(text)) > 40 * len(text.split())


BASE_RULES = (Rule("few_words", few_words), Rule("repetitive", repetitive))
RULES = (Rule("many_symbols", many_symbols), Rule("repeated_lines", repeated_lines), Rule("odd_word_length", odd_word_length), Rule("shouting", shouting), Rule("letterless", letterless))


def _bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return column_of(batch, "text").fill_null("").cast(pa.binary()).to_pylist()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_column(docs).alias("text"))


def order_rules(seconds: np.ndarray, rejects: np.ndarray) -> list[int]:
    """The order of rules from their cost and verdict on each text of a sample (texts x rules).

    Next is always the rule with most rejections per second among the texts that the rules before it leave.
    Rules that reject none of these follow by their cost alone, the cheapest first; ties keep the given order.
    """
    left, out = np.ones(len(seconds), bool), []
    while len(out) < seconds.shape[1]:
        rest = [i for i in range(seconds.shape[1]) if i not in out]
        cost = {i: float(seconds[left, i].sum() if left.any() else seconds[:, i].sum()) for i in rest}
        gain = {i: int(rejects[left, i].sum()) for i in rest}
        best = min(rest, key=lambda i: (-gain[i] / (cost[i] + 1e-9), cost[i], i))
        out.append(best)
        left &= ~rejects[:, best]
    return out


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, before: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """Rules in the order that order_rules gives for about `sample_rows` rows from all partitions of docs.

    Rows that a rule of `before` rejects don't reach the cascade and are not measured. The sample decides
    on the order only. An empty sample leaves the order as given.
    """

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seconds, rejects = [], []
            for text in _bytes_of(b):
                if any(r.rejects(text) for r in before):
                    continue
                took, no = [], []
                for rule in rules:
                    began = time.thread_time()
                    no.append(bool(rule.rejects(text)))
                    took.append(time.thread_time() - began)
                seconds.append(took)
                rejects.append(no)
            yield pa.RecordBatch.from_arrays([pa.array(seconds, pa.list_(pa.float64())), pa.array(rejects, pa.list_(pa.bool_()))], names=["seconds", "rejects"])

    n = docs.count()
    sample = _texts(docs.sample(min(1.0, sample_rows / n), 7) if n > sample_rows else docs)
    got = sample.mapInArrow(measure, "seconds array<double>, rejects array<boolean>").collect()  # some numbers for each row of the sample
    if not got:
        return rules
    return tuple(rules[i] for i in order_rules(np.array([r["seconds"] for r in got]), np.array([r["rejects"] for r in got], bool)))


def run_cascade(texts: list[bytes], rules: Iterable[Rule]) -> np.ndarray:
    """True for texts that no rule rejects; each rule sees only what those before it have left."""
    left = np.arange(len(texts))
    for rule in rules:
        if not len(left):
            break
        left = left[[not rule.rejects(texts[i]) for i in left]]
    kept = np.zeros(len(texts), bool)
    kept[left] = True
    return kept


def quality_stats(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Each row's base counts and verdict: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed texts (under 50 words, or over half of the words in repeated three-word windows) do not
    enter the cascade. Null texts are empty and fail. One row for each row of docs, whatever its id.
    """
    planned = plan_cascade(docs, rules, sample_rows, BASE_RULES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = _bytes_of(b)
            stats = np.array([base_stats(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])
            kept = np.zeros(len(texts), bool)
            own = np.flatnonzero(~failed)
            kept[own] = run_cascade([texts[i] for i in own], planned)
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), *(pa.array(stats[:, i]) for i in range(5)), pa.array(failed), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    planned = plan_cascade(docs, rules, sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(run_cascade(_bytes_of(b), planned)))

    return docs.mapInArrow(run, docs.schema)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS row_key, doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT row_key, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM w, unnest(range(1, len(words) - 1)) AS t(i)),
rep AS (SELECT row_key, i, count(*) OVER (PARTITION BY row_key, g) AS n FROM win),
hit AS (SELECT row_key, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) AS o(d) WHERE n > 1 GROUP BY row_key),
s AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
         len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letterless
  FROM w LEFT JOIN hit USING (row_key)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 30 * n_words AND 100 * n_dup_lines <= 50 * n_lines
       AND word_chars <= 20 * n_words AND word_chars >= 2 * n_words AND n_upper <= n_lower
       AND 100 * n_letterless <= 40 * n_words AS kept
FROM f
"""
