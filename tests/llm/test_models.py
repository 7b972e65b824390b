"""The trained operators against brute force, numeric gradients and held-out labels."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import masked_lm, quality_lm, toxicity
from tests.llm.helpers import ODD, empty, frame, prose


def kneser_ney(train: list[str], texts: list[str]) -> list[float]:
    """Interpolated modified Kneser-Ney of order 4, written plainly."""
    counts = {4: Counter()}
    for t in train:
        s = "\n\n\n" + t + "\n"
        counts[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {k: quality_lm.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    context = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            context[k][g[:-1]][0] += n
            context[k][g[:-1]][min(n, 3)] += 1

    def p(g: str) -> float:
        out = 1 / (len(counts[1]) + 1)
        for k in (1, 2, 3, 4):
            if x := context[k].get(g[-k:][:-1]):
                n = counts[k].get(g[-k:], 0)
                out = (max(n - cut[k][min(n, 3) - 1], 0) if n else 0) / x[0] + sum(a * b for a, b in zip(x[1:], cut[k], strict=True)) / x[0] * out
        return out

    padded = ["\n\n\n" + t + "\n" for t in texts]
    return [sum(math.log(p(s[i - 3 : i + 1])) for i in range(3, len(s))) for s in padded]


def test_perplexity_against_brute_force(spark):
    data = [(i, prose(i, 40)) for i in range(12)] + [(20, "ÜBER!! ### ##"), (21, ""), (22, None), (None, "alpha1")]
    docs = frame(spark, data)
    model = quality_lm.train(docs.where("doc_id < 8"))
    got = quality_lm.perplexities(docs, model, shard_bytes=1000).collect()
    want = kneser_ney([t for i, t in data[:8]], [t or "" for _, t in data])
    assert sorted(round(r.log_prob, 3) for r in got) == pytest.approx(sorted(round(w, 3) for w in want), abs=2e-3)


def test_models_without_a_fold(spark):
    """Each document by the model that has not counted its fold."""
    texts = [prose(i, 30) for i in range(9)]
    docs = frame(spark, [*enumerate(texts), (100, "something else")])
    fold = F.when(F.col("doc_id") < 9, (F.col("doc_id") % 3).cast("int"))
    model = quality_lm.train(docs.where("doc_id < 9"), fold, 3)
    got = {r.doc_id: r.log_prob for r in quality_lm.perplexities(docs, model, fold).collect()}
    for f in range(3):
        mine = [i for i in range(9) if i % 3 == f]
        want = kneser_ney([t for i, t in enumerate(texts) if i % 3 != f], [texts[i] for i in mine])
        assert [got[i] for i in mine] == pytest.approx(want, abs=2e-3)
    assert got[100] == pytest.approx(kneser_ney(texts, ["something else"])[0], abs=2e-3)


def test_verdicts_by_brute_force(spark):
    """Distances, quantiles by language and verdicts from the perplexities, written plainly."""
    langs = ["aa", "bb", None]
    texts = {i: prose(i, 5 + 7 * (i % 13)) if i % 3 == 0 else prose(i, 4 + 5 * (i % 11)).upper() for i in range(120)}
    texts |= {200: "### $$$ %%% " * 30, 201: prose(7, 40), 202: "", 203: "ZZZZ 1111 " * 20}
    data = [(i, t, "cc" if i == 201 else langs[i % 3]) for i, t in texts.items()]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(90)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_lm.classify(docs, labels, 0.9).collect()}
    logs = {i: math.log(r.perplexity) for i, r in got.items()}
    trusted = [i for i in range(90)]
    group = lambda i: got[i].lang
    mean = {g: np.mean([logs[i] for i in trusted if group(i) == g]) for g in langs}
    x, y = np.array([1 / got[i].n_chars for i in trusted]), np.array([(logs[i] - mean[group(i)]) ** 2 for i in trusted])
    b = max(0.0, np.cov(x, y, bias=True)[0, 1] / np.var(x))
    a = y.mean() - b * x.mean()
    if a <= 0.01 * y.mean():
        a, b = 0.01 * y.mean(), 0.99 * y.mean() / x.mean()
    means = {g: m for g, m in mean.items() if g} | {None: np.mean([logs[i] for i in trusted])}
    place = {i: (logs[i] - means.get(group(i), means[None])) / math.sqrt(a + b / got[i].n_chars) for i in logs}
    quantile = lambda v: sorted(v)[math.ceil(0.9 * len(v)) - 1]
    limit = {g: quantile([place[i] for i in trusted if group(i) == g]) for g in ("aa", "bb")}
    over_all = quantile([place[i] for i in trusted])
    for i, r in got.items():
        assert r.kept == (place[i] <= limit.get(r.lang, over_all) + 1e-9 or r.n_chars == 1), i
    assert not got[200].kept
    assert got[202].kept


def test_classifier(spark):
    docs = frame(spark, [*ODD, *((100 + i, prose(i, 60)) for i in range(40)), (200, "### $$$ %%% " * 40)])
    labels = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(200, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_lm.classify(docs, labels).collect()}
    assert len(got) == len({i for i, _ in ODD}) + 41
    assert not got[200]
    assert all(got[100 + i] for i in range(40))
    assert quality_lm.keep_good(docs, labels).columns == docs.columns
    assert quality_lm.classify(docs, labels.where("false")).where("NOT kept").count() == 0
    assert quality_lm.classify(empty(spark), labels).count() == 0


def test_kernel_by_definition():
    def plain(a: str, b: str) -> float:
        def weights(s: str) -> dict[str, float]:
            out: dict[str, float] = defaultdict(float)
            norm = 0.0
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, len(s)):
                        for m in range(k + 1, min(len(s), i + toxicity.SPAN + 1)):
                            w = toxicity.DECAY ** (m - i + 1)
                            out[s[i] + s[j] + s[k] + s[m]] += w
                            norm += w * w
            return {u: w / math.sqrt(norm) for u, w in out.items()}

        x, y = weights(a), weights(b)
        return sum(w * y.get(u, 0) for u, w in x.items())

    words = ["^moron$", "^mo-ron$", "^oron$", "^clown$", "^ab"]
    got = toxicity.kernel(words, words[:4])
    assert got == pytest.approx(np.array([[plain(a, b) for b in words[:4]] for a in words]), abs=1e-5)


def test_toxicity_held_out(spark):
    insults = ["moron", "clown", "loser"]
    rows = [(i, prose(i, 50) + (f" {insults[i % 3]} " if i % 4 == 0 else " ") + prose(i + 900, 20)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    changed = ["mo.ron", "c l o w n.", "m..o..r..o..n", "l. o. s. e. r.", "cl--own", "mor_on", "looser", "mo*r*on!"]
    extra = [(900 + k, prose(7 + k, 30) + f" {x} " + prose(80 + k, 9)) for k, x in enumerate(changed)]
    docs = frame(spark, [*ODD, *rows, *extra])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    wrong = [i for i in range(240) if got[i].predicted != int(i % 4 == 0) and i > 9]
    assert not wrong
    assert [x for k, x in enumerate(changed) if not got[900 + k].predicted] == []
    assert all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i in (1, 2, 3))
    assert toxicity.toxicity(docs, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_toxicity_of_real_labels(spark):
    """Documents that were held out, against their labels: ranking, catches and false alarms."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert np.mean([(x > y) + 0.5 * (x == y) for x in bad.score for y in good.score]) > 0.8
    assert bad.predicted.mean() > 0.6
    assert good.predicted.mean() < 0.06


def test_changed_units():
    assert toxicity.units_of_word("..i..d..i..o..t!") == ["^i..d..i..o..t$", "^idiot$"]
    assert toxicity.units_of_word("word,") == ["^word$"]
    assert toxicity.units_of_word("") == []
    import pyarrow as pa

    _, _, units = toxicity.document_units(pa.array(["x i. d, i. o- t. y two", None, "a b"], pa.string()).fill_null(""))
    assert "^xidioty$" in units


def test_gradient():
    rng = np.random.default_rng(0)
    net = masked_lm.Network(5, 4)
    net.flat[:] = rng.normal(0, 0.5, len(net.flat))
    own, beside = rng.integers(0, 5, 50), rng.integers(0, 6, (50, 4))
    gradient = net.gradient(own, beside)
    loss = lambda flat: -masked_lm.Network(5, 4, flat).log_probability(own, beside).mean(dtype=float)
    for i in range(0, len(gradient), 5):
        step = np.zeros(len(gradient), np.float32)
        step[i] = 1e-2
        assert (loss(net.flat + step) - loss(net.flat - step)) / 2e-2 == pytest.approx(gradient[i], abs=1e-3)


def test_a_batch_is_two_softmax_layers(monkeypatch):
    """Classes of all groups go through one softmax, whose work does not grow with their number; a group of fewer classes has no others."""
    rng, calls, softmax = np.random.default_rng(1), [], masked_lm._softmax
    monkeypatch.setattr(masked_lm, "_softmax", lambda x: (calls.append(x.shape), softmax(x))[1])
    net = masked_lm.Network(7, 4)
    net.flat[:] = rng.normal(0, 0.5, len(net.flat))
    own, beside = rng.integers(0, 7, 50).astype(np.uint16), rng.integers(0, 8, (50, 4)).astype(np.uint16)
    got = net.log_probability(own, beside)
    assert calls == [(3, 50), (3, 50)]
    for y, b, p in zip(own.tolist(), beside, got, strict=True):
        h = np.tanh(sum(net.side[i][k] for i, k in enumerate(b)) + net.bias)
        outer, inner = h @ net.group_out + net.group_base, (h @ net.out + net.base)[y // 3 * 3 : y // 3 * 3 + 3]
        assert p == pytest.approx(outer[y // 3] - np.log(np.exp(outer).sum()) + inner[y % 3] - np.log(np.exp(inner).sum()), abs=1e-4)
    calls.clear()
    first, room = net.gradient(own, beside), masked_lm.Network(7, 4)
    assert len(calls) == 2
    net.gradient(own[:20], beside[:20], room)
    assert (net.gradient(own, beside, room) == first).all()


def test_pseudo_likelihood(spark):
    pattern = "red green blue black white "
    docs = frame(spark, [*ODD, *((i, pattern * 20) for i in range(100, 160)), (300, "blue red white green black " * 20)])
    got = {r.doc_id: r for r in masked_lm.pseudo_likelihood(docs).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 0
    assert got[1].mean_log_prob is None
    assert got[100].mean_log_prob > got[300].mean_log_prob + 1
    assert masked_lm.pseudo_likelihood(empty(spark)).count() == 0


def test_words_have_their_shares(spark):
    """Two words of one class in the same context: the rarer one has the lower score, as its count says, in the table or outside."""
    docs = frame(spark, [*((i, "red green blue " * 30 + "zzhing") for i in range(20)), (300, "red green blue " * 30 + "qqhing")])
    for table in (3, 1000):
        classes, frequency, shares = masked_lm.vocabulary(docs, words=3, table=table)
        encoded = masked_lm.encode(docs, classes, shares)
        got = {r.doc_id: r.log_prob for r in masked_lm.scores(encoded, shares, masked_lm.Network.fresh(frequency, 24).flat).collect()}
        assert got[0] - got[300] == pytest.approx(np.log(20), abs=1e-4)
        unseen = masked_lm.encode(frame(spark, [(1, "qqhing"), (2, "xxxing")]), classes, shares)
        got = {r.doc_id: r.log_prob for r in masked_lm.scores(unseen, shares, masked_lm.Network.fresh(frequency, 24).flat).collect()}
        assert got[1] == pytest.approx(got[2], abs=1e-5)
    flat = masked_lm.train(encoded, frequency)
    net = masked_lm.Network(len(frequency), 24, flat)
    near = np.zeros((len(frequency), 4), np.int64)
    assert np.exp(net.log_probability(np.arange(len(frequency)), near)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_by_brute_force(spark):
    """A document's score is the sum of its tokens' conditional log-probabilities, and these are those of a distribution over the words."""
    texts = [*(f"the cat sat on the {w} and the dog ran to a {w}s end" for w in ("mat", "hat", "rat", "mat", "mill", "hill")), "", "the", "a b c d e f g " * 3]
    docs = frame(spark, [*enumerate(texts)])
    classes, frequency, shares = masked_lm.vocabulary(docs, words=5, shared=4, table=12)
    encoded = masked_lm.encode(docs, classes, shares)
    flat = masked_lm.train(encoded, frequency)
    got = {r.doc_id: (r.n_tokens, r.log_prob) for r in masked_lm.scores(encoded, shares, flat).collect()}
    net, n = masked_lm.Network(len(frequency), 24, flat), Counter(w for t in texts for w in t.split())
    of = dict(zip(n, classes.of(list(n)).tolist(), strict=True))
    total = Counter()
    for w, k in n.items():
        total[of[w]] += k
    share = {w: 1.0 if of[w] < 5 else k / (total[of[w]] + 1) for w, k in n.items()}

    def plain(beside: list[int]) -> np.ndarray:
        """Probabilities of all classes."""
        h = np.tanh(net.bias + sum(net.side[i][c] for i, c in enumerate(beside)))
        soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        groups, one = soft(h @ net.group_out + net.group_base), h @ net.out + net.base
        parts = [range(g, min(g + net.width, net.classes)) for g in range(0, net.classes, net.width)]
        return np.concatenate([groups[g] * soft(one[list(part)]) for g, part in enumerate(parts)])

    for i, t in enumerate(texts):
        own = [of[w] for w in t.split()]
        at = lambda k: own[k] if 0 <= k < len(own) else net.classes
        p = [plain([at(k + s) for s in masked_lm.SIDES]) for k in range(len(own))]
        want = sum(math.log(p[k][own[k]] * share[w]) for k, w in enumerate(t.split()))
        assert got[i] == (len(own), pytest.approx(want, abs=1e-3))
        for q in p:
            assert sum(q[of[w]] * share[w] for w in n) + sum(q[c] / (total[c] + 1) for c in range(5, 9)) == pytest.approx(1, abs=1e-4)


def test_every_token_is_trained_on(spark, monkeypatch):
    """Words that stand only at the third to eighth place of each eight are targets, too, in each round."""
    docs = frame(spark, [(i, "one two three four five six seven eight " * 20) for i in range(20)])
    classes, frequency, shares = masked_lm.vocabulary(docs)
    encoded = masked_lm.encode(docs, classes, shares)
    fresh = masked_lm.Network.fresh(frequency, 24).flat
    own = np.array([classes.words[w] for w in "one two three four five six seven eight".split()])
    near = np.array([[own[(i + s) % 8] for s in masked_lm.SIDES] for i in range(8)])
    learnt = masked_lm.Network(len(frequency), 24, masked_lm.train(encoded, frequency)).log_probability(own, near)
    assert (learnt > masked_lm.Network(len(frequency), 24, fresh).log_probability(own, near)).all()
    weights = []
    mean = masked_lm._mean
    monkeypatch.setattr(masked_lm, "_mean", lambda spark, copies: (weights.append(copies.agg({"weight": "sum"}).first()[0]), mean(spark, copies))[1])
    masked_lm.train(encoded, frequency)
    assert weights == [3200, 3200]
