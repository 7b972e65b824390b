"""Annotators' answers as rows: lenient and strict JSON, and the first object in a text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.schemas import INSTANCE, JUDGE

_THINK = re.compile(r"<think>.*?</think>", re.DOTALL)
_FENCE = re.compile(r"```(?:json)?")
_TEXTS = {"passage": "", "soc_type": "other_soc", "affective_register": "n/a", "narrator_position": "minimal", "character_pov": "", "explanation": "", "confidence": "medium", "notes": ""}


def _items(value: Any) -> list[str]:
    if isinstance(value, str):
        return [x.strip() for x in value.split(",") if x.strip()]
    return [str(x) for x in value] if isinstance(value, list) else []


def lenient_instances(raw: str | None) -> list[dict]:
    """Instances of an answer: think blocks go, from the first { to the last } must be JSON; anything else gives none.

    Items that are no objects are left out; missing or odd fields take defaults; is_soc is what Python
    takes for true.
    """
    text = _THINK.sub("", raw or "")
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        return []
    try:
        got = json.loads(text[start : end + 1])
    except ValueError:
        return []
    found = got.get("instances", got.get("soc_instances", [])) if isinstance(got, dict) else []
    out = []
    for x in found if isinstance(found, list) else []:
        if isinstance(x, dict):
            row = {k: str(x.get(k, d)) for k, d in _TEXTS.items()}
            out.append(row | {"is_soc": bool(x.get("is_soc", True)), "secondary_devices": _items(x.get("secondary_devices")), "evidence": _items(x.get("evidence"))})
    return out


def strict_instances(raw: str | None) -> list[dict]:
    """Instances of an answer that is JSON as a whole once think blocks and code fences are gone; only stream-of-consciousness ones."""
    text = _FENCE.sub("", _THINK.sub("", raw or "")).strip()
    try:
        got = json.loads(text)
    except ValueError:
        return []
    found = (got.get("instances") or got.get("soc_instances")) if isinstance(got, dict) else []
    out = []
    for x in found if isinstance(found, list) else []:
        if isinstance(x, dict) and x.get("is_soc", True):
            row = {k: str(x.get(k) or ("medium" if k == "confidence" else "")) for k in _TEXTS}
            out.append(row | {"is_soc": True, "secondary_devices": _items(x.get("secondary_devices")), "evidence": _items(x.get("evidence"))})
    return out


def required_instances(raw: str | None) -> list[dict]:
    """Instances of an answer from the first { to the last }; an instance without is_soc or passage is an error."""
    found = re.search(r"\{.*\}", _THINK.sub("", raw or ""), re.DOTALL)
    try:
        got = json.loads(found.group(0)) if found else {}
    except ValueError:
        got = {}
    out = []
    for x in got.get("instances", []):
        if missing := [k for k in ("is_soc", "passage") if k not in x]:
            raise ValueError(f"an instance lacks {', '.join(missing)}")
        row = {k: str(x.get(k, {"soc_type": "", "narrator_position": ""}.get(k, d))) for k, d in _TEXTS.items()}
        out.append(row | {"is_soc": bool(x["is_soc"]), "secondary_devices": _items(x.get("secondary_devices")), "evidence": _items(x.get("evidence"))})
    return out


def instances(raw: Column, read: Callable[[str | None], list[dict]] = lenient_instances) -> Column:
    """The instances of answers, as an array."""

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in INSTANCE.split(', '))}>>")
    def parse(answers: pd.Series) -> pd.Series:
        return answers.map(read)

    return parse(raw)


def parse_answers(answers: DataFrame, strict: bool = False, required: bool = False) -> DataFrame:
    """answers with a column `raw`: one row for each instance, its fields beside the other columns and its place `pos`.

    `required` ends the job at an instance without its required fields.
    """
    others = [c for c in answers.columns if c != "raw"]
    found = instances(F.col("raw"), required_instances if required else strict_instances if strict else lenient_instances)
    return answers.select(*others, F.posexplode(found).alias("pos", "instance")).select(*others, "pos", "instance.*")


def flatten_results(instances: DataFrame) -> DataFrame:
    """Instances as flat result rows: only stream of consciousness, lists joined by commas."""
    joined = {c: F.array_join(c, ", ") for c in ("secondary_devices", "evidence")}
    return instances.where("is_soc").withColumns(joined).drop("is_soc")


def first_object(text: str | None) -> dict:
    """The first complete JSON object of a text; empty if there is none."""
    cut = _THINK.sub("", text or "")
    decoder = json.JSONDecoder()
    start = cut.find("{")
    while start >= 0:
        try:
            got, _ = decoder.raw_decode(cut, start)
            return got if isinstance(got, dict) else {}
        except ValueError:
            start = cut.find("{", start + 1)
    return {}


def parse_judgements(answers: DataFrame) -> DataFrame:
    """answers with a column `raw`, and the judge's scores; missing or odd ones are 0.5."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name in ("grounding", "skepticism", "specificity", "type_coherence"):
                f[name] = [_number(first_object(x).get(name)) for x in f["raw"]]
            f["rationale"] = [str(first_object(x).get("rationale", "")) for x in f["raw"]]
            yield f

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema)
    return answers.mapInPandas(run, f"{schema}, {JUDGE}")


def _number(x: Any) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return 0.5
