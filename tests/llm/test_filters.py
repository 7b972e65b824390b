"""Quality rules, decontamination, near duplicates and licences against SQL and brute force."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import decontamination, licenses, near_duplicates, quality_rules
from scriptorium.llm import queries as q
from tests.conftest import oracle, rows
from tests.llm.helpers import ODD, empty, frame, prose


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    assert rows(q.queries()[name](spark, sf_dir)) == oracle(sf_dir, q.oracle_sql()[name])


def test_rules_on_odd_documents(spark):
    more = [*ODD, (20, prose(1, 80)), (21, "same words here " * 40), (22, prose(2, 20) + "\n" + prose(3, 60) + "\n" + prose(2, 20))]
    df = frame(spark, more)
    assert rows(quality_rules.quality_stats(df)) == oracle("/nonexistent", quality_rules.SQL, documents=df.toPandas()[["doc_id", "text"]].astype({"doc_id": "Int64"}))
    assert [r.doc_id for r in quality_rules.keep_good(df).collect()] == [20, 22]
    assert quality_rules.quality_stats(empty(spark)).count() == 0


def test_cascade_order_does_not_matter():
    texts = [prose(i, 60).encode() for i in range(20)] + [b"A B C " * 30, b"### " * 60, b"1 2 3 4 5 6 " * 20]
    a = quality_rules.run_cascade(texts, quality_rules.RULES)
    assert (a == quality_rules.run_cascade(texts, quality_rules.RULES[::-1])).all()
    assert a.sum() == 20


def test_order_by_conditional_rates():
    """The second rule rejects what the first does and costs less than the third, which rejects others."""
    rejects = np.zeros((100, 4), bool)
    rejects[:60, 0] = rejects[:50, 1] = rejects[60:70, 2] = True
    seconds = np.tile([1.0, 1.0, 2.0, 0.5], (100, 1))
    assert quality_rules.order_rules(seconds, rejects) == [0, 2, 3, 1]


def test_sample_is_of_the_cascade(spark, monkeypatch):
    """Texts that the base rules reject are not measured, wherever they lie."""
    seen = []
    monkeypatch.setattr(quality_rules, "order_rules", lambda seconds, rejects: seen.append(rejects.shape) or list(range(rejects.shape[1])))
    docs = frame(spark, [*((i, "too short") for i in range(500)), *((500 + i, prose(i, 60)) for i in range(20))])
    quality_rules.plan_cascade(docs, sample_rows=10_000, before=quality_rules.BASE_RULES)
    quality_rules.plan_cascade(docs, sample_rows=100)
    assert seen[0] == (20, 5)
    assert 50 < seen[1][0] < 200


def test_contamination_on_odd_documents(spark):
    words = prose(5, 40)
    docs = frame(spark, [*ODD, (30, "before " + words.upper() + " after"), (31, " ".join(words.split()[:9])), (32, "zz " + words[: len(words) // 2])])
    bench = spark.createDataFrame([(1, words), (1, words), (2, None), (3, "one"), (None, "a b"), (4, ""), (5, words)], "item_id long, text string")
    got = rows(decontamination.contamination(docs, bench))
    sql = decontamination.SQL
    assert got == oracle("/nonexistent", sql, documents=docs.toPandas()[["doc_id", "text"]].astype({"doc_id": "Int64"}), benchmark=bench.toPandas().astype({"item_id": "Int64"}))
    kept = {r.doc_id for r in decontamination.keep_clean(docs, bench).collect()}
    assert {30, 32, 4}.isdisjoint(kept)
    assert 31 in kept
    assert decontamination.contamination(empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs, bench.where("false")).collect())


def test_proximity_by_brute_force(spark):
    r = np.random.default_rng(11)
    texts = {i: [f"w{int(k)}" for k in r.integers(0, 12, int(r.integers(0, 60)))] for i in range(40)}
    phrases = {k: [f"w{int(x)}" for x in r.integers(0, 14, int(r.integers(1, 5)))] for k in range(30)}
    frequency = {t: sum(w.count(t) for w in texts.values()) for p in phrases.values() for t in p}
    want = set()
    for k, p in phrases.items():
        rarest = min(set(p), key=lambda t: (frequency[t], t))
        for i, words in texts.items():
            want |= {(k, i, at) for at, w in enumerate(words) if w == rarest and all(t in words[max(0, at - 4) : at + 5] for t in p)}
    docs = frame(spark, [(i, " ".join(w)) for i, w in texts.items()])
    asked = spark.createDataFrame([*phrases.items()], "phrase long, words array<string>")
    index = decontamination.build_index(docs, asked.select(F.explode("words").alias("term")))
    got = decontamination.proximity_matches(index, asked, 4).join(index.documents, "row").collect()
    assert {(x.phrase, x.doc_id, x.pos) for x in got} == want
    assert len(got) == len(want)


def test_proximity(spark):
    docs = frame(spark, [(1, "x a y b"), (2, "a x x x x x x b"), (3, "b a")])
    index = decontamination.build_index(docs, spark.createDataFrame([("a",), ("b",)], "term string"))
    found = decontamination.proximity_matches(index, spark.createDataFrame([(0, ["b", "a"])], "phrase long, words array<string>"), 3)
    assert sorted(r.doc_id for r in found.join(index.documents, "row").collect()) == [1, 3]


def brute_components(texts: dict[int, str], width: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_against_brute_force(spark, width, percent):
    r = np.random.default_rng(width)
    texts, n = {}, 0
    for group in range(12):
        base = prose(group, int(r.integers(3, 160))).split()
        for _ in range(int(r.integers(1, 9))):
            copy = list(base)
            for _ in range(int(r.integers(0, max(2, len(base) // 25)))):
                copy[int(r.integers(len(copy)))] = f"new{int(r.integers(1000))}"
            texts[n] = " ".join(copy)
            n += 1
    df = frame(spark, [*texts.items()])
    got = {x.doc_id: x.component_id for x in near_duplicates.similarity_classes(df, near_duplicates.Jaccard(width, percent)).collect()}
    assert got == brute_components(texts, width, percent)


def test_join_on_odd_documents(spark):
    got = near_duplicates.similarity_classes(frame(spark)).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 3, 5)} == {1: (0, 1), 2: (0, 2), 3: (0, 3), 5: (1, 5)}
    kept = near_duplicates.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    assert kept.where("doc_id IS NULL").count() == 2
    assert near_duplicates.similarity_classes(empty(spark)).count() == 0


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(0)
    for n in (20, 200, 2000):
        a = np.unique(near_duplicates.mix(r.integers(0, 1 << 62, n, dtype=np.uint64)))
        b = np.unique(np.r_[a[n // 10 :], near_duplicates.mix(r.integers(0, 1 << 62, n // 10, dtype=np.uint64))])
        x, y = near_duplicates.parity(a, 256), near_duplicates.parity(b, 256)
        assert 0 < np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_linked_sets_keep_a_common_key():
    """However the keys' frequencies lie, two linked sets of a band keep a common key when each leaves out its most frequent ones."""
    r = np.random.default_rng(3)
    rule = near_duplicates.Jaccard(4, 85)
    for n in (6, 7, 9, 12, 20, 60, 300):
        for _ in range(60):
            a = np.unique(near_duplicates.mix(r.integers(0, 1 << 62, n, dtype=np.uint64)))
            b = a
            while len(b) > 5 and rule.links(a, (less := b[: len(b) - 1])):
                b = less
            band = max(near_duplicates.band_of(rule, len(a)), 0)
            kept = []
            common = {}
            for s in (a, b):
                keys, spare = near_duplicates.sketch_keys(s, band, near_duplicates.bands(rule)[band])
                rank = sorted(keys.tolist(), key=lambda k: (-common.setdefault(k, int(r.integers(0, 3))), -k))
                kept.append(set(rank[spare:]))
            assert kept[0] & kept[1]


def test_shared_keys_of_any_size(spark, monkeypatch):
    """A key's rows that go out in parts are all of them, each once, and equally common."""
    monkeypatch.setattr(near_duplicates, "MOST_COMMON", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    data = [(1, i) for i in range(40)] * 2 + [(2, 7), (2, 7), (3, 1), (3, 2), (4, 9)] + [(5, i) for i in range(8)]
    got = near_duplicates._shared(spark.createDataFrame([(k, i, 0) for k, i in data], "key long, set_id long, spare int").coalesce(1)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted((r.key, r.set_id) for r in got) == sorted({(k, i) for k, i in data if k not in (2, 4)})
    assert {r.key: r.common for r in got} == {1: 3, 3: 1, 5: 3}


def test_links_beside_the_pivots(spark, monkeypatch):
    """Groups whose least and greatest sets link with no other one: the later steps find the links."""
    base = [prose(k, 60) for k in range(4)]
    texts, n = {}, 0
    for k, b in enumerate(base):
        words = b.split()
        for j in range(10):  # a shared half, and halves that pairs of texts have in common
            own = prose(100 + 10 * k + j // 2, 60).split()
            own[j % 2 * 20] += "x"
            texts[n] = " ".join(words + own)
            n += 1
    steps = []
    linked = near_duplicates._linked
    monkeypatch.setattr(near_duplicates, "_linked", lambda pairs, *rest: (steps.append(pairs.count()), linked(pairs, *rest))[1])
    # places that hold few shingles make sets with a common half share keys
    got = {x.doc_id: x.component_id for x in near_duplicates.similarity_classes(frame(spark, [*texts.items()]), near_duplicates.Jaccard(2, 60)).collect()}
    assert got == brute_components(texts, 2, 60)
    assert len(set(got.values())) < len(texts)
    assert len(steps) == 3


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = near_duplicates.components(edges).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert {r.root: r.n for r in got} == {0: 40, 100: 1}


def test_licenses(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    docs = frame(spark, [*ODD, (40, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE")), (41, "text\nReleased under the MIT Licence\nAll rights reserved"), (42, "MIT")])
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect() if r.doc_id}
    assert got[40].text_license == "MIT"
    assert (got[41].text_license, got[41].n_notices, got[41].licenses) == (None, 2, "MIT,all-rights-reserved")
    assert not got[42].licensed
    assert licenses.license_scan(docs).count() == len(ODD) + 3
    assert licenses.license_scan(empty(spark)).count() == 0


def test_licenses_against_sql(spark):
    """One function on both sides: lines that begin like notices, spellings, whole published texts, odd documents."""
    mit, isc = (next(t for n, t in licenses.KNOWN if n == name) for name in ("MIT", "ISC"))
    more = ["copyright law\nAll rights reserved.", "Copyright 2020 A\nAll rights reserved.", "copyright (c) x", "© y\n" + mit, "(c) 1999 z\r\n" + isc.lower(), "MIT License\n\nCopyright <year>\n" + mit.replace("software", "SoftWare"), "The ISC License\nAll rights reserved.\n" + isc,
            "copyright [yyyy] n\nreleased under the MIT licence.", "Licensed  under---CC BY 4.0\nx\nlicensed under cc by-sa 4.0", "copyright\ncopyright holders and all rights reserved", "whilst & per cent", mit + " more", "Copyright notice and this permission"]
    more += [p.read_text(errors="replace") for p in sorted(Path("/usr/share/common-licenses").glob("*")) if p.is_file()]
    df = frame(spark, [*ODD, *((50 + i, t) for i, t in enumerate(more))])
    given = df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    got = rows(licenses.license_scan(df))
    assert got == oracle("/nonexistent", licenses.SQL, documents=given)
    assert sum(r[-1] is not None for r in got) >= 4


def test_licenses_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Own License\nCopyright (c) 2001 X\nYou may organise it.")
    (tmp_path / "Own-1.0--b.txt").write_text("Another wording")
    (tmp_path / "Twin.txt").write_text("another WORDING!")
    known = licenses.known_digests(spark).unionByName(licenses.folder_digests(spark, str(tmp_path)))
    docs = frame(spark, [(1, "own licence\n(c) 1999 Y\nyou may ORGANIZE it"), (2, "x\nanother wording"), (3, "All rights reserved.")])
    got = {r.doc_id: (r.text_license, r.n_notices, r.licenses) for r in licenses.license_scan(docs, known).collect()}
    assert got == {1: ("Own-1.0", 0, "Own-1.0"), 2: (None, 1, "Own-1.0"), 3: ("all-rights-reserved", 1, "all-rights-reserved")}
    assert licenses.license_scan(docs, known.where("false")).where("licensed").count() == 0


def test_published_licenses(spark):
    """Licences as their usual files have them: title, notice, wrapped lines that start with 'copyright'."""
    mit, isc = (next(t for n, t in licenses.KNOWN if n == name) for name in ("MIT", "ISC"))
    terms = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )
    texts = {
        1: ("MIT", f"MIT License\n\nCopyright (c) 2020 Someone\n\n{mit}"),
        2: ("ISC", "ISC License\n\nCopyright 2020, Someone\n\n" + isc.replace("above copyright notice", "above\ncopyright notice")),
        3: ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{terms}"),
        4: (None, f"Some License\n\n{mit}"),
    }
    published = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl"}
    for k, (file, name) in enumerate(published.items(), 10):
        if (path := Path("/usr/share/common-licenses") / file).exists():
            texts[k] = (name, path.read_text())
    got = {r.doc_id: r.text_license for r in licenses.license_scan(frame(spark, [(k, t) for k, (_, t) in texts.items()])).collect()}
    assert got == {k: name for k, (name, _) in texts.items()}
