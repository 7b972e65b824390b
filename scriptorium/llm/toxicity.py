"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares short strings, the words of sentences: it counts the common subsequences of four
characters, each occurrence weighted by its span, so that an insult keeps most of its weight when
characters are left out or put in between. A word with marks inside also stands without them, and letters
set apart stand as one word. The machine learns from labelled texts which of their units are toxic, and from changed
forms of these: with a character put in, left out, or gaps. A document is as toxic as its most toxic unit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import column_of, ragged, slices, text_array, text_column

DECAY = 0.6
SPAN = 6
LONGEST = 24
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = re.compile(r"[\W_]+")


@lru_cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of four characters in a string of this length, the last at most SPAN after the first, and the spans' weights."""
    inner = [(d, j, k) for d in range(3, SPAN + 1) for j in range(1, d - 1) for k in range(j + 1, d)]
    at = np.array([(i, i + j, i + k, i + d) for i in range(length) for d, j, k in inner if i + d < length], np.int64).reshape(-1, 4)
    return at, DECAY ** (at[:, 3] - at[:, 0] + 1.0)


def units_of_word(word: str) -> list[str]:
    """The strings that stand for a word: lower case, without marks at its ends, and without those inside; long ones in overlapping parts."""
    w = _EDGES.sub("", word.lower()) or word.lower()
    out = []
    for x in dict.fromkeys((w, _MARKS.sub("", w))):
        if 0 < len(x) <= LONGEST:
            out.append(f"^{x}$")
        elif x:
            half = LONGEST // 2
            out += [f"^{x}$"[i : i + LONGEST] for i in range(0, len(x) + 2 - half, half)]
    return out


def changed_forms(unit: str) -> list[str]:
    """A unit with a character put in, doubled, or left out, and with gaps between its letters; none for short units."""
    w = unit.strip("^$")
    h = len(w) // 2
    if len(w) < 5 or len(w) >= LONGEST:
        return []
    forms = [w[:h] + "x" + w[h:], w[:2] + "q" + w[2:], w[:h] + w[h] + w[h:], w[:h] + w[h + 1 :], w[:1] + w[2:]]
    return [f"^{x}$" for x in forms] + [f"^{'.'.join(w)}$"[:LONGEST]]


def features(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Subsequences of units in groups of equal length: the units' places, keys (units x subsequences), weights.

    Weights are divided by a norm that depends on the length only, which keeps the kernel positive.
    """
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    for length in np.unique(sizes[sizes > 3]).tolist():
        own = np.flatnonzero(sizes == length)
        text = "".join([units[i] for i in own.tolist()])
        c = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF).astype(np.int64).reshape(len(own), length)
        at, weight = _places(length)
        yield own, (c[:, at[:, 0]] << 48) | (c[:, at[:, 1]] << 32) | (c[:, at[:, 2]] << 16) | c[:, at[:, 3]], weight / np.sqrt(weight @ weight)


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of units with landmarks."""
    marks: dict[int, list[tuple[int, float]]] = {}
    for own, keys, weight in features(landmarks):
        for i, row in zip(own.tolist(), keys.tolist(), strict=True):
            for key, w in zip(row, weight.tolist(), strict=True):
                marks.setdefault(key, []).append((i, w))
    names = np.array(sorted(marks), np.int64)
    table = np.zeros((len(names) + 1, len(landmarks)), np.float32)  # the last row is for subsequences that no landmark has
    for r, key in enumerate(names.tolist()):
        for i, w in marks[key]:
            table[r, i] += w
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for own, keys, weight in features(units):
        r = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        r = np.where(names[r] == keys, r, len(names)) if len(names) else np.zeros_like(keys)
        for t, w in enumerate(weight.tolist()):
            out[own] += np.float32(w) * table[r[:, t]]
    return out


@dataclass(frozen=True)
class StringSvm:
    """The machine with its landmarks folded in: a weight for each subsequence, a bias, and the scores' scale."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float
    middle: float

    def decide(self, units: list[str]) -> np.ndarray:
        """The decision value of each unit; strings without four characters take the bias."""
        out = np.full(len(units), self.bias)
        for own, keys, weight in features(units):
            for s in range(0, len(own), 8192):
                k = keys[s : s + 8192]
                r = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
                out[own[s : s + 8192]] += np.where(self.keys[r] == k, self.weights[r], 0.0) @ weight
        return out

    def calibrated(self, toxic: np.ndarray, forms: np.ndarray, clean: np.ndarray, steps: int = 100) -> StringSvm:
        """The scale and middle of the logistic curve that is likeliest for the decisions of documents of either label and of changed forms.

        Targets are smoothed (Platt); the changed forms weigh as much as the toxic documents together.
        """
        f, n = np.r_[toxic, forms, clean], len(toxic) + len(forms)
        target = np.r_[np.full(n, (n + 1) / (n + 2)), np.full(len(clean), 1 / (len(clean) + 2))]
        weight = np.r_[np.ones(len(toxic)), np.full(len(forms), len(toxic) / max(1, len(forms))), np.ones(len(clean))] / len(f)
        x, w = np.stack([f, np.ones(len(f))], axis=1), np.zeros(2)
        for _ in range(steps):  # Newton's method, damped by a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)))
            w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        scale = max(float(w[0]), 1e-3)
        return StringSvm(self.keys, self.weights, self.bias, scale, float(-w[1] / scale))

    def probability(self, decisions: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * (decisions - self.middle), -30, 30)))


def _fold(landmarks: list[str], alpha: np.ndarray, bias: float) -> StringSvm:
    keys, values = [], []
    for own, k, w in features(landmarks):
        keys.append(k.ravel())
        values.append((alpha[own][:, None] * w).ravel())
    names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return StringSvm(names, np.bincount(inverse, np.concatenate(values), len(names)), bias, 1.0, 0.0)


def fit_svm(strings: list[str], target: np.ndarray, cost: np.ndarray, landmarks: list[str], regularization: float = 1e-4, steps: int = 300) -> StringSvm:
    """Squared-hinge support vector machine on the Nyström features of the landmarks; targets are 1 and -1, cost is each string's."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    use = values > 1e-6 * values.max()
    project = vectors[:, use] / np.sqrt(values[use])
    x = np.c_[kernel(strings, landmarks) @ project.astype(np.float32), np.ones(len(strings), np.float32)]
    pull = np.r_[np.full(x.shape[1] - 1, regularization), 0.0]
    rate = 1 / (2 * np.linalg.eigvalsh((x * cost[:, None].astype(np.float32)).T @ x)[-1] + regularization)
    y, c = target.astype(np.float32), (cost * target).astype(np.float32)
    w = speed = np.zeros(x.shape[1])
    for t in range(steps):  # accelerated descent
        slack = np.maximum(0, 1 - y * (x @ speed.astype(np.float32))) * c
        new = speed + rate * (2 * (slack @ x) - pull * speed)
        speed = new + t / (t + 3) * (new - w)
        w = new
    return _fold(landmarks, project @ w[:-1], float(w[-1]))


def learn(bags: list[list[str]], toxic: list[int], rounds: int = 3, rank: int = 320, start: int = 2000) -> StringSvm:
    """Learn which units make a document toxic, from documents' units and labels.

    It begins with, of each toxic document, the unit that no clean one has and most toxic ones have. Each round
    takes the highest unit of every toxic document, and any beyond the margin, with their changed forms as
    positive. Of the clean units all take part: the machine is solved over a working set, `start` units by a hash
    and all that came within the margin, as a unit beyond the margin has no loss. Landmarks, `rank` of them, which is
    the rank of the Nyström features, are positives and the highest negatives in equal numbers, as what tells an
    insult from a clean word that resembles it must be seen by the kernel. Scores are calibrated on the documents'
    highest units and the positives' changed forms.
    """
    label = np.array(toxic, bool)
    names = list(dict.fromkeys(u for bag in bags for u in bag))
    number = {u: i for i, u in enumerate(names)}
    full = [k for k, bag in enumerate(bags) if bag]
    flat = np.array([number[u] for k in full for u in bags[k]], np.int64)
    sizes = np.array([len(bags[k]) for k in full], np.int64)
    of_toxic = np.repeat(label[full], sizes)
    dirty = np.bincount(flat[of_toxic], minlength=len(names))
    clean = np.bincount(flat[~of_toxic], minlength=len(names))
    if not ((clean == 0) & (dirty > 0)).any() or not clean.any():
        return StringSvm(np.zeros(1, np.int64), np.zeros(1), 0.0, 1.0, 5.0)
    starts = np.cumsum(sizes) - sizes
    known_clean = np.flatnonzero(clean)
    hashes = np.array([zlib.crc32(u.encode()) for u in names])
    working = known_clean[np.argsort(hashes[known_clean], kind="stable")][:start]
    hard = working
    value = np.where(clean == 0, dirty.astype(float), -np.inf)
    for k in range(rounds + 1):
        own = np.where(clean[flat] == 0, value[flat], -np.inf)
        top = np.repeat(np.maximum.reduceat(own, starts), sizes)
        positive = np.unique(flat[of_toxic & np.isfinite(own) & ((own == top) | ((own >= 1) & (k > 0)))])
        positive = positive[np.argsort(-dirty[positive], kind="stable")]
        forms = [x for i in positive for x in changed_forms(names[i]) if x not in number]
        marks = dict.fromkeys(np.r_[positive[: rank // 2], hard[: rank // 2]].tolist())
        cost = np.r_[np.full(len(positive), 0.5 / len(positive)), np.full(len(forms), 0.25 / max(1, len(forms))), np.full(len(working), 0.5 / start)]
        target = np.where(np.arange(len(cost)) < len(positive) + len(forms), 1.0, -1.0)
        svm = fit_svm([*(names[i] for i in positive), *forms, *(names[i] for i in working)], target, cost, [names[i] for i in marks], steps=1200 if k == rounds else 300)
        value = svm.decide(names)
        hard = known_clean[np.argsort(-value[known_clean], kind="stable")]
        working = np.union1d(working, known_clean[value[known_clean] > -1])
    top = np.maximum.reduceat(value[flat], starts)
    return svm.calibrated(top[label[full]], svm.decide(forms), top[~label[full]])


def document_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all units of all texts: text, place among the distinct units; and these.

    Units are the texts' words. A run of three or more words of one character, marks aside, is one unit
    more, as letters set apart by spaces read as one word.
    """
    lists = pc.utf8_split_whitespace(texts)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    distinct: dict[str, int] = {}
    per_word, at, letters = [], [], []
    for w in coded.dictionary.to_pylist():
        got = [distinct.setdefault(u, len(distinct)) for u in units_of_word(w)]
        per_word.append(len(got))
        at += got
        letters.append(x if len(w) < 5 and len(x := _MARKS.sub("", w.lower())) == 1 else "")
    n, at = np.array(per_word, np.int64), np.array(at, np.int64)
    starts = np.cumsum(n) - n
    owners, places = [np.repeat(owner, n[place])], [at[ragged(starts[place], n[place])]]
    single = np.flatnonzero(np.array([x != "" for x in letters], bool)[place])
    if len(single):
        cuts = np.flatnonzero((np.diff(single) != 1) | (np.diff(owner[single]) != 0)) + 1
        for run in np.split(single, cuts):
            if len(run) > 2:
                for u in units_of_word("".join([letters[i] for i in place[run]])):
                    owners.append(owner[run[:1]])
                    places.append(np.array([distinct.setdefault(u, len(distinct))]))
    return np.concatenate(owners), np.concatenate(places), list(distinct)


def labelled_bags(docs: DataFrame, labels: DataFrame, most_rows: int = 2000) -> tuple[list[list[str]], list[int]]:
    """Distinct units and labels of at most `most_rows` documents of either label: those first by a hash of their text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            owner, place, units = document_units(text_array(b))
            pairs = np.unique(owner * (len(units) + 1) + place)
            owner, place = pairs // (len(units) + 1), pairs % (len(units) + 1)
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([column_of(b, "toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(units, pa.string()).take(pa.array(place)))], names=["toxic", "units"])

    marks = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    key = F.xxhash64(text_column(docs))
    known = docs.select(F.col("doc_id").cast("long").alias("l_id"), key.alias("l_key")).join(marks, "l_id").groupBy("l_key").agg(F.max("toxic").alias("toxic"))
    # the sample is chosen by hashes alone; its texts, `most_rows` of either label at most, are then picked where they lie
    sample = known.where("toxic = 0").orderBy("l_key").limit(most_rows).union(known.where("toxic = 1").orderBy("l_key").limit(most_rows))
    picked = docs.select(key.alias("l_key"), text_column(docs).alias("text")).join(F.broadcast(sample), "l_key").dropDuplicates(["l_key"])
    bags, toxic = [], []
    for r in picked.select("text", "toxic").mapInArrow(run, "toxic int, units array<string>").toLocalIterator():
        bags.append(sorted(r["units"]))
        toxic.append(r["toxic"])
    order = sorted(range(len(bags)), key=lambda i: (toxic[i], bags[i]))
    return [bags[i] for i in order], [toxic[i] for i in order]


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 2000, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, unit), one for each row of docs.

    The machine learns from at most `most_rows` labelled documents of either label that are not held
    out. Every whole text is scored by its words alone; unit is the highest one (null without words).
    Null and empty texts score as a text without any toxic unit. Without labels of both kinds
    all documents score low.
    """
    train = docs.where(~held_out(F.col("doc_id")))
    svm = learn(*labelled_bags(train, labels, most_rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 12_000_000):
            owner, place, units = document_units(text_array(b))
            value = svm.decide(units)
            best = np.full(b.num_rows, -np.inf)
            np.maximum.at(best, owner, value[place])
            is_best = value[place] == best[owner] if len(owner) else np.zeros(0, bool)
            which = np.full(b.num_rows, -1)
            which[owner[is_best]] = place[is_best]
            score = svm.probability(np.where(np.isfinite(best), best, svm.bias))
            named = pa.array([units[i].strip("^$") if i >= 0 else None for i in which.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), column_of(b, "held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), named], names=["doc_id", "held_out", "score", "predicted", "unit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, unit string")
