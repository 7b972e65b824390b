"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

Counts of trusted text are tables sharded by n-gram. The documents to score are dealt to shards; each shard
asks for every distinct n-gram it has once, joins turn counts into probabilities, and the answers return to the
shard's texts. So neither a model nor a document's n-grams are ever rows of one task. Trusted text is dealt to folds, and
the tables hold a model without each fold beside the one of all: a trusted document is judged by what others say.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import as_bytes, broadcast_if, column_of, from_bytes, gathered, slices, text_column, texts_of, written

ORDER = 4
_PAD = 10  # a line feed: texts begin after three and end with one
_DENSE = 1 << 26
#: Ids in larger numbers are joined by a shuffle, not by a broadcast.
MOST_BROADCAST = 2_000_000
QUANTILE = 0.998


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit characters of all texts, each with its padding, and the texts' lengths there; those beyond 16 bits share one code."""
    joined = ("\n" * (ORDER - 1)).join(["", *(t + "\n" for t in texts)])
    a = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), 0xFFFF).astype(np.uint16)
    return a, np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))


@dataclass
class Grams:
    """The n-grams of texts as places in a dense table of pairs of bigrams."""

    places: np.ndarray  # of each predicted character's n-gram, text by text
    counts: np.ndarray  # predicted characters of each text: its own and the end
    pairs: np.ndarray  # the bigrams that occur, as 32-bit numbers

    @classmethod
    def of(cls, texts: list[str]) -> Grams:
        a, sizes = _codes(texts)
        if not len(texts):
            return cls(np.zeros(0, np.int64), sizes, np.zeros(1, np.int64))
        present = np.zeros(1 << 16, bool)
        present[a] = True
        alphabet = np.flatnonzero(present)
        small = (np.cumsum(present) - 1).astype(np.int32)[a]
        two = small[:-1] * len(alphabet) + small[1:]
        if len(alphabet) > 4096:
            kinds, two = np.unique(two.astype(np.int64), return_inverse=True)
        else:
            seen = np.zeros(len(alphabet) ** 2, bool)
            seen[two] = True
            kinds = np.flatnonzero(seen)
            two = (np.cumsum(seen) - 1).astype(np.int32)[two]
        pairs = (alphabet[kinds // len(alphabet)] << 16) | alphabet[kinds % len(alphabet)]
        places = two[:-2].astype(np.int64) * len(pairs) + two[2:]
        # a text's n-grams begin at each place but its last three
        ends = np.cumsum(sizes)
        inside = np.ones(len(a), bool)
        for j in range(1, ORDER):
            inside[ends - j] = False
        return cls(places[inside[: len(places)]], sizes - (ORDER - 1), pairs)

    def gram(self, places: np.ndarray) -> np.ndarray:
        """The 64-bit numbers of n-grams."""
        return (self.pairs[places // len(self.pairs)].astype(np.int64) << 32) | self.pairs[places % len(self.pairs)]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The places that occur, ascending, and how often."""
        if len(self.pairs) ** 2 <= _DENSE:
            n = np.bincount(self.places, minlength=1)
            at = np.flatnonzero(n)
            return at, n[at]
        return np.unique(self.places, return_counts=True)

    def lookup(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value of each n-gram, from those of the distinct ones."""
        if len(self.pairs) ** 2 <= _DENSE:
            dense = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.float32)
            dense[at] = values
            return dense[self.places]
        return values[np.searchsorted(at, self.places)]


def _suffix(k: int) -> F.Column:
    """The last k characters of column g, as a number of k times 16 bits."""
    return F.col("g") if k == ORDER else F.col("g").bitwiseAND(F.lit((1 << 16 * k) - 1))


def _by_model(values: list[float]) -> F.Column:
    """The value of the model that column m names."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("m") + 1)


@dataclass(frozen=True)
class KneserNey:
    """Models 0 to folds - 1, each without that fold of the text, and model `folds` of all text.

    Count tables (m, g, c) and context tables (m, x, total, n1, n2, n3) of orders 1 to ORDER; by model
    the discounts of each order and the alphabet's size.
    """

    folds: int
    counts: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    discounts: dict[int, list[tuple[float, float, float]]]
    alphabet: list[int]

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """Each distinct (m, g) with the natural logarithm of its last character's probability after the others."""
        p = grams.select("m", "g").distinct().withColumn("p", 1.0 / _by_model([float(n) for n in self.alphabet]))
        for k in range(1, ORDER + 1):
            d1, d2, d3 = (_by_model(list(d)) for d in zip(*self.discounts[k], strict=True))
            p = p.withColumn("own", _suffix(k)).join(self.counts[k].select("m", F.col("g").alias("own"), "c"), ["m", "own"], "left")
            p = p.withColumn("x", F.shiftrightunsigned("own", 16) if k > 1 else F.lit(0).cast("long")).join(self.contexts[k], ["m", "x"], "left")
            cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
            more = F.coalesce(F.greatest(F.col("c") - cut, F.lit(0.0)), F.lit(0.0)) / F.col("total")
            back = (F.col("n1") * d1 + F.col("n2") * d2 + F.col("n3") * d3) / F.col("total")
            p = p.select("m", "g", F.when(F.col("total").isNull(), F.col("p")).otherwise(more + back * F.col("p")).alias("p"))
        return p.select("m", "g", F.log("p").cast("float").alias("log_p"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of n-grams that occur 1, 2, 3, 4 times."""
    if not all(n):
        return 0.5, 0.75, 0.9  # too little text to estimate them
    y = n[0] / (n[0] + 2 * n[1])
    got = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(got))


def _split(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows by the values of an integer column."""
    values = column_of(batch, column).to_numpy(zero_copy_only=False)
    for v in np.unique(values).tolist():
        yield v, batch.filter(pa.array(values == v))


def train(trusted: DataFrame, fold: F.Column | None = None, folds: int = 0) -> KneserNey:
    """Count the n-grams of all trusted texts (column text); null texts count as empty ones. fold is 0 to folds - 1."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_000_000):
            for k, part in _split(b, "fold"):
                grams = Grams.of(texts_of(part))
                at, n = grams.distinct()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(grams.gram(at)), pa.array(n.astype(np.int64))], names=["fold", "g", "c"])

    texts = trusted.select(text_column(trusted).alias("text"), (F.lit(-1) if fold is None else fold).cast("int").alias("fold"))
    raw = texts.mapInArrow(count, "fold int, g long, c long").groupBy("fold", "g").agg(F.sum("c").alias("c"))
    models = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold"))
    counts = {ORDER: written(raw.withColumn("m", F.explode(models)).groupBy("m", "g").agg(F.sum("c").alias("c")), "grams4")}
    contexts, cuts = {}, {}
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            # of lower orders count the different characters before them
            counts[k] = written(counts[k + 1].groupBy("m", _suffix(k).alias("g")).agg(F.count("*").alias("c")), f"grams{k}")
        few = {(r["m"], r["c"]): r["n"] for r in counts[k].where("c <= 4").groupBy("m", "c").agg(F.count("*").alias("n")).collect()}
        cuts[k] = [discounts([few.get((m, i), 0) for i in range(1, 5)]) for m in range(folds + 1)]
        x = F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long")
        contexts[k] = counts[k].groupBy("m", x.alias("x")).agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count_if(F.col("c") > 2).alias("n3"))
    alphabet = {r["m"]: r["n"] for r in counts[1].groupBy("m").agg(F.count("*").alias("n")).collect()}
    return KneserNey(folds, counts, contexts, cuts, [alphabet.get(m, 0) + 1 for m in range(folds + 1)])


_SCORED = "doc_id long, lang string, m int, n_chars long, log_prob double, perplexity double"


def perplexities(docs: DataFrame, model: KneserNey, which: F.Column | None = None, shard_bytes: int = 24_000_000) -> DataFrame:
    """Rows (doc_id, lang, m, n_chars, log_prob, perplexity), one for each row of docs (doc_id, lang, text).

    `which` is the number m of the model that scores a row, the one of all text if it is null.
    n_chars counts a text's characters and its end; log_prob sums the logarithms of their
    probabilities; perplexity is per character. Null texts are empty. The rows of each model are dealt to shards of
    about `shard_bytes`, a task each. Texts move to their shards twice, compressed: to ask for n-grams, and to be scored.
    """
    number = F.lit(model.folds) if which is None else F.coalesce(which, F.lit(model.folds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_column(docs).alias("text"), number.cast("int").alias("m"))
    sizes = {r["m"]: r["n"] for r in rows.groupBy("m").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # a row for each model
    shards = np.array([sizes.get(m, 0) // shard_bytes + 1 for m in range(model.folds + 1)])
    first, tasks = np.cumsum(shards) - shards, int(shards.sum())
    dealt = rows.withColumn("shard", (_by_model(first.tolist()) + F.pmod(F.xxhash64("doc_id", F.octet_length("text")), _by_model(shards.tolist()))).cast("int"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 4_000_000):
            for k, part in _split(b, "shard"):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), column_of(part, "m").slice(0, 1), pa.array([as_bytes(part.select(["doc_id", "lang", "m", "text"]))], pa.binary())], names=["shard", "m", "rows"])

    def ask(key: tuple, parts: pa.Table) -> pa.Table:
        seen = np.zeros(0, np.int64)
        for b in gathered(map(from_bytes, parts["rows"]), 1_250_000):
            grams = Grams.of(texts_of(b))
            seen = np.union1d(seen, grams.gram(grams.distinct()[0]))
        return pa.table({"shard": np.full(len(seen), key[0].as_py(), np.int32), "m": np.full(len(seen), parts["m"][0].as_py(), np.int32), "g": seen})

    def score(key: tuple, parts: pa.Table, answers: pa.Table) -> pa.Table:
        known = answers["g"].to_numpy()
        order = np.argsort(known)
        known, log_p = known[order], answers["log_p"].to_numpy()[order]
        out = []
        for b in gathered(map(from_bytes, parts["rows"]), 1_250_000):
            grams = Grams.of(texts_of(b))
            at = grams.distinct()[0]
            each = grams.lookup(at, log_p[np.searchsorted(known, grams.gram(at))])
            starts = np.cumsum(grams.counts) - grams.counts
            total = np.add.reduceat(each.astype(np.float64), starts)
            out.append(pa.table({"doc_id": b.column(0), "lang": b.column(1), "m": b.column(2), "n_chars": grams.counts, "log_prob": total, "perplexity": np.exp(-total / grams.counts)}))
        return pa.concat_tables(out)

    packed = dealt.mapInArrow(pack, "shard int, m int, rows binary").repartition(tasks, "shard")
    asked = written(packed.groupBy("shard").applyInArrow(ask, "shard int, m int, g long"), "asked-grams")
    answers = asked.join(model.log_probabilities(asked), ["m", "g"]).select(F.col("shard").alias("to_shard"), "g", "log_p")
    return packed.groupBy("shard").cogroup(answers.repartition(tasks, "to_shard").groupBy("to_shard")).applyInArrow(score, _SCORED)


def spread(trusted: DataFrame) -> tuple[float, float]:
    """a and b of the variance a + b / n_chars of log perplexities around their language's mean, by least squares.

    trusted has (lang, n_chars, log_p). A mean over more characters varies less; a is what texts differ by themselves.
    """
    means = trusted.groupBy("lang").agg(F.avg("log_p").alias("mean"))
    x, y = 1 / F.col("n_chars"), F.pow(F.col("log_p") - F.col("mean"), 2)
    r = trusted.join(broadcast_if(means, MOST_BROADCAST), trusted["lang"].eqNullSafe(means["lang"])).agg(F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.avg(x).alias("x"), F.avg(y).alias("y")).first()
    if not r["y"]:
        return 1e-6, 0.0
    b = max(0.0, r["xy"] / r["xx"]) if r["xx"] else 0.0
    a = r["y"] - b * r["x"]
    return (a, b) if a > 0.01 * r["y"] else (0.01 * r["y"], max(0.0, 0.99 * r["y"] / r["x"]))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, folds: int = 4) -> DataFrame:
    """Rows (doc_id, lang, n_chars, perplexity, threshold, kept), one for each row of docs.

    Trusted are documents with quality 1 in labels (doc_id, quality). All of them train the model that
    scores the other documents; they themselves, dealt to folds by a hash of their ids, are scored by the models
    without their fold, as a model finds its own training text too usual. How far a log perplexity lies from
    the mean of its language's trusted documents is measured in deviations that the text's length leads to expect
    (see spread). A document is kept up to the `quantile` of these distances among the trusted documents
    of its language; languages without any take mean and quantile over all. Texts without characters are
    kept: they have no perplexity to judge by. Without trusted documents all are kept.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("good_id")).where("good_id IS NOT NULL").distinct()
    good = broadcast_if(written(good.withColumn("fold", F.pmod(F.xxhash64("good_id"), F.lit(folds)).cast("int")), "trusted"), MOST_BROADCAST)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_column(docs).alias("text"))
    model = train(own.join(good, F.col("doc_id") == F.col("good_id")), F.col("fold"), folds)
    marked = own.join(good, F.col("doc_id") == F.col("good_id"), "left")
    scored = written(perplexities(marked, model, F.col("fold")), "perplexities").withColumn("log_p", F.log("perplexity"))
    trusted = scored.where((F.col("m") < folds) & (F.col("n_chars") > 1))
    a, b = spread(trusted)
    deviation = F.sqrt(F.lit(a) + F.lit(b) / F.col("n_chars"))
    means = trusted.where("lang IS NOT NULL").groupBy(F.col("lang").alias("own_lang")).agg(F.avg("log_p").alias("mean"))
    mean = trusted.agg(F.avg("log_p").alias("mean")).first()["mean"]
    means = broadcast_if(means, MOST_BROADCAST)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(means, F.col("lang") == F.col("own_lang"), "left").withColumn("mean", F.coalesce("mean", F.lit(mean).cast("double"))).drop("own_lang").withColumn("distance", (F.col("log_p") - F.col("mean")) / deviation)

    far = placed(trusted)
    over_all = far.agg(F.percentile_approx("distance", quantile, 10_000).alias("q")).first()["q"]
    limits = broadcast_if(far.where("lang IS NOT NULL").groupBy(F.col("lang").alias("own_lang")).agg(F.percentile_approx("distance", quantile, 10_000).alias("q")), MOST_BROADCAST)
    out = placed(scored).join(limits, F.col("lang") == F.col("own_lang"), "left")
    limit = F.coalesce("q", F.lit(over_all).cast("double"))
    out = out.withColumn("threshold", F.coalesce(F.exp(F.col("mean") + limit * deviation), F.lit(float("inf"))))
    # a trusted document at the quantile itself is kept, whatever the last digit of the exponential
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", (F.coalesce(F.col("distance") <= limit, F.lit(True)) | (F.col("n_chars") <= 1)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns.

    Rows of one doc_id go together: they stay if one of them is kept. Rows without doc_id stay.
    """
    kept = broadcast_if(written(classify(docs, labels, quantile).where("kept").select(F.col("doc_id").alias("kept_id")).distinct(), "kept"), MOST_BROADCAST)
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
