"""Prompts of annotators and judges, made from the vocabularies, so that a type or field is named in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.schemas import CONFIDENCE_RANK, DEPRECATED_TYPES, INSTANCE, JUDGE, NARRATOR_POSITIONS, SOC_TYPES, TYPE_LABELS


def answer_form() -> str:
    """The JSON that an annotator is to answer with: each field of an instance and what it may hold."""
    choices = {"soc_type": "|".join(t for t in SOC_TYPES if t not in DEPRECATED_TYPES), "narrator_position": "|".join(NARRATOR_POSITIONS), "confidence": "|".join(CONFIDENCE_RANK)}
    kinds = {"string": '"text"', "boolean": "true|false", "array<string>": '["text", ...]'}
    fields = [f.split(" ", 1) for f in INSTANCE.split(", ")]
    shown = (f'"{name}": ' + (f'"{choices[name]}"' if name in choices else kinds[kind]) for name, kind in fields)
    return '{"instances": [{' + ", ".join(shown) + "}]}"


def system_prompt(types: dict[str, str] | None = None) -> str:
    """Instructions for an annotator; `types` gives the meaning of each type that one wants explained, by name."""
    told = types or {}
    lines = [f"- {t} ({TYPE_LABELS.get(t, t)})" + (f": {told[t]}" if t in told else "") for t in SOC_TYPES if t not in DEPRECATED_TYPES]
    return "\n".join([
        "You annotate literary prose for stream of consciousness. Think first, between <think> and </think>: quote the words that decide, and say why each near miss is none.",
        "Then answer with JSON alone, in this form:", answer_form(), "A text without such passages has an empty list of instances. Passages are copied word for word.", "Types:", *lines,
    ])


def judge_prompt(trace: Column, passage: Column, label: Column) -> Column:
    """What a judge is asked about a trace: the four scores from 0 to 1, and why; null parts are empty."""
    fields = ", ".join(f'"{f.split(" ")[0]}": ' + ("0.0" if f.endswith("double") else '"why"') for f in JUDGE.split(", "))
    ask = (
        "Score the reasoning below from 0.0 to 1.0, strictly: grounding (it quotes the passage word for word, and the quote decides), skepticism (it weighs what speaks against its verdict), "
        f"specificity (it names techniques), type_coherence (what it argues is the type it names). Answer with JSON alone: {{{fields}}}"
    )
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(f"{ask}\n\nLABEL: "), some(label), F.lit("\n\nPASSAGE:\n"), some(passage), F.lit("\n\nREASONING:\n"), some(trace))
