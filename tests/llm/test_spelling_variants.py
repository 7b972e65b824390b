"""Spelling variants by brute force and SQL: near words, forms, roots, and how words are read."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import spelling_variants as sv
from tests.conftest import oracle, rows
from tests.llm.helpers import ODD, empty, frame


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts: dict[str, int], factor: int = 10) -> list[tuple]:
    out = []
    form = {}
    for w in counts:
        found = sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x))
        form[w] = found[0] if found and counts[found[0]] >= factor * counts[w] else None
        out.append([w, len(found)])
    rows_of = []
    for w, n in out:
        root = w
        while form[root]:
            root = form[root]
        rows_of.append((form[w], counts.get(form[w]), counts[w], n, root, w))
    return sorted(rows_of, key=repr)


def words_of(spark, counts):
    return spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)] + [(None,)] * 3, "word string")


def test_random_vocabulary(spark):
    """Few letters, so that words have many neighbours; empty words, letters beyond the BMP, equal neighbours, chains of forms."""
    r = random.Random(2)
    counts = {"".join(r.choice("aabé🙂") for _ in range(r.randrange(1, 7))): r.choice([2, 3, 25, 300, 4000]) for _ in range(250)} | {"": 2, "zz": 2, "zzz": 20, "zzzz": 200, "q" * 3000: 2, "q" * 3001: 20}
    got = sv.variant_groups(sv.vocabulary(words_of(spark, counts)))
    assert rows(got.select("form", "form_n", "n", "n_near", "root", "word")) == brute(counts)


def test_neighbourhood_is_full_and_distinct():
    """With a table that lets everything through, all changed forms come out, each once."""
    table = sv.BitTable(13, np.full(1 << 10, 255, np.uint8))
    letters = np.array([ord(c) for c in "abc"])
    for word in ("a", "aab", "abcabc", "ccc", "xyx"):
        codes = np.array([[ord(c) for c in word]], np.int64)
        got = [t for _, texts in sv.neighbourhood(codes, letters, table) for t in texts]
        n = len(word)
        want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + 1 :] for i in range(n) for c in "abc" if c != word[i]} | {word[:i] + c + word[i:] for i in range(n + 1) for c in "abc"}
        assert sorted(got) == sorted(want)
        assert all(near(word, t) for t in got)


def test_blocks_do_not_matter(spark, monkeypatch):
    counts = {"abcdefg": 30, "abcdefgh": 2, "abcdfg": 3, "xbcdefg": 2}
    monkeypatch.setattr(sv, "BLOCK", 1)
    table = sv.BitTable(13, np.full(1 << 10, 255, np.uint8))
    codes = np.array([[97, 98, 97]], np.int64)
    small = sorted(t for _, x in sv.neighbourhood(codes, np.array([97, 98]), table) for t in x)
    monkeypatch.setattr(sv, "BLOCK", 1000)
    assert small == sorted(t for _, x in sv.neighbourhood(codes, np.array([97, 98]), table) for t in x)
    assert rows(sv.variant_groups(sv.vocabulary(words_of(spark, counts))).select("form", "form_n", "n", "n_near", "root", "word")) == brute(counts)


def test_words_of_odd_documents(spark):
    texts = [*ODD, (30, "Reading READING reÀding×÷Ab  shorter-than seven"), (31, None), (-5, "wandering Wandering")] + [(i, "wandering ÉTERNELLE abcdefg") for i in range(60)]
    got = Counter(r.word for r in sv.misspelt_words(frame(spark, texts)).collect())
    want: Counter = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += len(w) >= 7
    assert got == +want
    given = frame(spark, texts).select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    groups = sv.variant_groups(sv.vocabulary(sv.misspelt_words(frame(spark, texts))))
    assert rows(groups) == oracle("/nonexistent", sv.sql(), documents=given)


def test_empty_tables(spark):
    assert sv.variant_groups(sv.vocabulary(sv.misspelt_words(empty(spark)))).count() == 0
    with pytest.raises(ValueError):
        sv.variant_groups(sv.vocabulary(words_of(spark, {"a": 2})), 1)
