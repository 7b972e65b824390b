"""Awkward documents for the corpus operators' tests."""

from __future__ import annotations

import random

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (5, "a b c d"), (None, "no id at all"), (None, None),
    (6, "İstanbul ΣΑΣ naïve ﬁ 中文 한국 🙂 don't it's <|endoftext|>, x_y--z"), (7, "word, " * 5000), (8, "\x00\x1f ▁ a▁b\r\n  c d"), (9, "x" * 30_000),
]


def frame(spark, rows=ODD):
    """Documents with null columns, and extra ones whose names operators use themselves."""
    data = [(i, t, None, None, None, 7, "s") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, length int, row string")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()) + str(r.randrange(30)) for _ in range(n))


def empty(spark):
    return frame(spark).where("false")
