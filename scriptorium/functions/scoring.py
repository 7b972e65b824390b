"""Scores of reasoning traces and rewards, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import words
from scriptorium.schemas import SCEPTICAL_PHRASES, SPECIFIC_WORDS

_QUOTED = "[\"‘’“”]([^\"']+)[\"‘’“”]"


def _hits(text: Column, phrases: tuple[str, ...]) -> Column:
    lower = F.lower(text)
    return reduce(lambda a, b: a + b, (F.contains(lower, F.lit(p)).cast("int") for p in phrases))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, as inside a lambda it would be for each element."""
    return F.transform(F.array(value), body)[0]


def grounding(trace: Column, passage: Column) -> Column:
    """1 if a quotation of three or more words stands in the passage, 0.5 if any four words of the trace do, else 0."""
    quotes = F.regexp_extract_all(trace, F.lit(_QUOTED), F.lit(1))
    plain = lambda w, i: F.regexp_replace(F.lower(F.array_join(F.slice(w, i, 4), " ")), r"(?U)[^\p{L}\p{N}_\s]", "")

    def in_passage(lower: Column) -> Column:
        quoted = F.exists(quotes, lambda q: (F.size(words(q)) >= 3) & F.contains(lower, F.trim(F.lower(q))))
        run = _let(words(trace), lambda w: F.exists(F.when(F.size(w) > 3, F.sequence(F.lit(1), F.size(w) - 3)), lambda i: F.contains(lower, plain(w, i))))
        return F.when(quoted, 1.0).when(F.coalesce(run, F.lit(False)), 0.5).otherwise(0.0)

    return _let(F.lower(passage), in_passage)


def specificity(trace: Column) -> Column:
    """1 with two of the specific words, 0.5 with one; a word inside another counts too."""
    n = _hits(trace, SPECIFIC_WORDS)
    return F.when(n >= 2, 1.0).when(n == 1, 0.5).otherwise(0.0)


def skepticism(trace: Column, is_soc: Column) -> Column:
    """0.4 for each sceptical phrase of a positive, 0.5 of a negative, 1 at most."""
    return F.least(F.lit(1.0), _hits(trace, SCEPTICAL_PHRASES) * F.when(is_soc, 0.4).otherwise(0.5))


def candidate_score(trace: Column, passage: Column, is_soc: Column) -> Column:
    return 0.4 * grounding(trace, passage) + 0.35 * specificity(trace) + 0.25 * skepticism(trace, is_soc)


def reward(trace: Column, passage: Column, is_soc: Column, judged_skepticism: Column, judged_coherence: Column) -> Column:
    """Reward of a completion; missing judgements count 0.5, and so do specificity and coherence of negatives."""
    half = F.lit(0.5)
    spec = F.when(is_soc, specificity(trace)).otherwise(half)
    coherence = F.when(is_soc, F.coalesce(judged_coherence, half)).otherwise(half)
    return 0.2 * grounding(trace, passage) + 0.2 * F.coalesce(judged_skepticism, half) + 0.2 * spec + 0.4 * coherence
