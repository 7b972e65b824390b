"""Every query of the engine against its SQL, or against plain Python, at the smallest size."""

from __future__ import annotations

import re

import pytest

from scriptorium.plans import registry
from scriptorium.schemas import SCEPTICAL_PHRASES, SOC_TYPES, SPECIFIC_WORDS
from tests.conftest import oracle, rows

_HEADINGS = (r"^\s*(?:CHAPTER|Chapter|PART|Part|BOOK|Book)\s+(?:[IVXLCDM]+|\d+|[A-Z][a-z]+)\b.*$", r"^\s*[IVXLCDM]+\.\s*$", r"^[A-Z][A-Z\s]{2,}$", r"^\s*[-*_]{3,}\s*$", r"^\s*\[.+\]\s*$")
_QUOTES = "[\"‘’“”]([^\"']+)[\"‘’“”]"


def packed(text: str, size: int, overlap: int) -> list[str]:
    sentences, out, first, used = re.split(r"(?<=[.!?])\s+(?=[A-Z])", text), [], 0, 0
    for i, s in enumerate(sentences):
        if i > first and used + len(s) > size:
            out.append(" ".join(sentences[first:i]))
            new = i
            while new > first and len(" ".join(sentences[new:i])) + len(sentences[new - 1]) <= overlap:
                new -= 1
            first, used = new, len(" ".join(sentences[new:i]))
        used += len(s)
    return [*out, " ".join(sentences[first:])]


def structural(doc) -> list[tuple]:
    text = "CHAPTER I\n" + doc.text.replace("\n", "\nChapter 2\n")
    points = sorted({(m.start(), m.group().strip()) for p in _HEADINGS for m in re.finditer(p, text, re.MULTILINE)})
    points = [p for k, p in enumerate(points) if not k or p[0] != points[k - 1][0]]
    if len(points) < 2:
        return [(f"Chunk {k}", t) for k, t in enumerate(packed(text, 2000, 200), 1)]
    out = []
    for (start, label), end in zip(points, [p for p, _ in points[1:]] + [len(text)], strict=True):
        body = text[start:end].strip()
        parts = packed(body, 2000, 200) if len(body) > 2000 else [body] if body else []
        out += [(label if len(body) <= 2000 else f"{label} ({j}/{len(parts)})", t) for j, t in enumerate(parts, 1)]
    return out


def scores(trace: str, passage: str, is_soc: bool) -> tuple[float, float, float]:
    low, t = passage.lower(), trace.lower()
    words = re.findall(r"[^ \t\n\x0b\f\r]+", trace)
    quotes = [q for q in re.findall(_QUOTES, trace) if len(q.split()) >= 3]
    grams = (re.sub(r"[^\w\s]", "", " ".join(words[i : i + 4]).lower()) for i in range(len(words) - 3))
    grounded = 1.0 if any(q.lower().strip(" ") in low for q in quotes) else 0.5 if any(g in low for g in grams) else 0.0
    n = sum(w in t for w in SPECIFIC_WORDS)
    return grounded, min(n, 2) / 2, min(1.0, sum(p in t for p in SCEPTICAL_PHRASES) * (0.4 if is_soc else 0.5))


def check_structural_chunks(docs, got):
    want = {(f"doc {d.doc_id}.txt", k, *x) for d in docs for k, x in enumerate(structural(d))}
    assert {(r.source_file, r.chunk_index, r.chunk_label, r.chunk_text) for r in got} == want
    assert len(got) == len(want)


def check_token_chunks(docs, got):
    by: dict[str, list] = {}
    for r in got:
        by.setdefault(r.source_file, []).append((r.chunk_index, r.chunk_text))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in by.items()} == {f"doc {d.doc_id}.txt": d.text for d in docs if d.text}
    assert all(0 < len(t.split()) <= 100 or not t.split() for v in by.values() for _, t in v)


def check_trace_rewards(docs, got):
    for r, d in zip(sorted(got), sorted(docs), strict=True):
        i = d.doc_id
        trace = f'It could appear {d.source} {SOC_TYPES[i % 12]} but falls short: "{" ".join(re.findall(r"[^ \t\n\x0b\f\r]+", d.text))}"'
        g, sp, sk = scores(trace, d.text, i % 2 == 0)
        assert r.score == pytest.approx(0.4 * g + 0.35 * sp + 0.25 * sk), i
        assert r.reward == pytest.approx(0.2 * g + 0.1 + 0.2 * (sp if i % 2 == 0 else 0.5) + 0.2), i


def check_best_traces(docs, got):
    for r, d in zip(sorted(got), sorted(docs), strict=True):
        found = [f"It could appear imagery but falls short: {d.text}".strip(), f'"{d.text}" would need a soliloquy']
        value = [sum(a * b for a, b in zip((0.4, 0.35, 0.25), scores(t, d.text, d.doc_id % 2 == 0), strict=True)) for t in found]
        assert r.think_content == found[value.index(max(value))], d.doc_id
        assert r.trace_score == pytest.approx(max(value))


def check_sampled_windows(docs, got):
    whole = {}
    for d in docs:
        w = re.findall(r"[^ \t\n\x0b\f\r]+", d.text)
        whole[str(d.doc_id)] = {(i // 300, " ".join(w[i : i + 300])) for i in range(0, len(w) - 300, 300)}
    chosen: dict[str, set] = {}
    for r in got:
        chosen.setdefault(r.source_file, set()).add((r.pos, r.passage))
    assert {k: len(v) for k, v in chosen.items()} == {k: min(3, len(v)) for k, v in whole.items() if v}
    assert all(v <= whole[k] for k, v in chosen.items())


#: Held against the tokenizer's library in test_training_tokens.
LIBRARY = {"chat_tokens", "chat_batches"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - LIBRARY))
def test_query(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    if name in registry.oracle_sql():
        assert rows(got) == oracle(sf_dir, registry.oracle_sql()[name])
    if f"check_{name}" in globals() or name not in registry.oracle_sql():
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").na.fill("").collect()
        globals()[f"check_{name}"](docs, got.collect())


def test_tracks_have_rows(spark, sf_dir):
    assert all(registry.queries()[f"consensus_{t}"](spark, sf_dir).count() for t in ("conservative", "moderate", "liberal", "longest"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
