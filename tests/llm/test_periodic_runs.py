"""Periodic runs by brute force: random texts, odd ones, and the query over the whole smallest table."""

from __future__ import annotations

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import periodic_runs as pr
from scriptorium.llm import queries as q
from tests.llm.helpers import ODD, empty, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list[str], which: pr.Runs = pr.Runs()) -> list[tuple[int, int, int]]:
    """Every period's stretches of equal words; of one stretch the smallest period."""
    least: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // which.periods + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(which.words, which.periods * p):
                least.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda x: (x[0], x[2]))


def collapsed(words: list[str], runs) -> str:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def changed(doc_id, words: list[str]) -> list[str]:
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def want(doc_id, text) -> tuple:
    words = changed(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    digest = lambda x: sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(collapsed(words, runs)))


def test_random_texts():
    r = random.Random(4)
    for _ in range(250):
        texts = []
        for _ in range(r.randrange(6)):
            k = r.choice([1, 2, 2, 3, 5, 50])
            w = [f"w{r.randrange(k)}" for _ in range(r.randrange(90))]
            if w and r.random() < 0.6:
                w = w[: r.randrange(len(w) + 1)] + w[: r.randrange(1, len(w) + 1)] * r.randrange(1, 6) + w[-3:]
            texts.append(w)
        which = pr.Runs(*r.choice([(24, 3), (2, 2), (4, 2), (10, 3), (6, 4)]))
        words, counts = pr.split_words(pa.array([" ".join(w) for w in texts], pa.string()))
        begin, length, period = pr.runs_of_texts(words, counts, which)
        starts = np.cumsum(counts) - counts
        for w, s in zip(texts, starts, strict=True):
            own = (begin >= s) & (begin < s + len(w))
            assert list(zip((begin[own] - s).tolist(), length[own].tolist(), period[own].tolist(), strict=True)) == brute(w, which)


def test_fibonacci_words_have_many_runs():
    a, b = ["x"], ["x", "y"]
    while len(b) < 300:
        a, b = b, b + a
    which = pr.Runs(2, 2)
    begin, length, period = pr.maximal_runs(np.array([w == "x" for w in b], np.int64), np.array([len(b)]), which)
    assert list(zip(begin.tolist(), length.tolist(), period.tolist(), strict=True)) == brute(b, which)


def test_shared_words_bound():
    assert pr.Runs().shared == 16
    for bad in ((1, 3), (24, 1)):
        with pytest.raises(ValueError):
            pr.Runs(*bad)


def test_odd_documents(spark):
    """Null and empty texts, null and repeated ids, 5,000 equal words, unicode, clashing columns; leading and mixed white space."""
    more = [(20, ("a b c " * 8).strip()), (21, "a b c " * 7 + "a b"), (22, "one  two\t" * 30), (23, prose(1, 50) + " " + "u v u v w " * 6 + prose(2, 9)), (24, "x " * 23), (25, "x " * 24), (26, "\x85a b " * 24)]
    df = frame(spark, [*ODD, *more])
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(df).collect()), key=repr)
    words = [(i, WORD.findall(t or "")) for i, t in [*ODD, *more]]
    assert got == sorted(((i, len(w), brute(w), collapsed(w, brute(w))) for i, w in words), key=repr)
    digests = sorted((tuple(r) for r in pr.run_digests(pr.periodic_runs(pr.planted(df))).collect()), key=repr)
    assert digests == sorted((want(i, t) for i, t in [*ODD, *more]), key=repr)
    assert pr.periodic_runs(empty(spark)).count() == 0


def test_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = sorted(tuple(r) for r in q.op11_periodic_runs(spark, sf_dir).collect())
    expected = sorted(want(int(i), t) for i, t in zip(docs["doc_id"], docs["text"], strict=True))
    assert got == expected
    assert sum(r[1] > 0 for r in got) >= 15
