"""Spelling variants: words one inserted, left-out or replaced character apart, by full neighbourhood generation.

Every word of the vocabulary gives all strings that one such change over the vocabulary's own alphabet makes of it; those that
are words, too, are its near words, and no distance is ever computed. A candidate is one 64-bit sum of a number for
each character at its place, so all candidates of many words come from prefix and suffix sums; a bit table of the vocabulary's
sums lets the few through that may be words, and only these become strings, which are hash-joined to the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import release, text_column, written

MOST_BITS = 28
BLOCK = 2_000_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CANDIDATES = "word string, near string"


def _number(code: np.ndarray | int, place: np.ndarray | int) -> np.ndarray:
    """The 64-bit number of a character at a place."""
    x = (np.asarray(code, np.uint64) << np.uint64(40)) + np.asarray(place, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_sums(words: list[str]) -> np.ndarray:
    """The sum of each word's numbers, as signed 64-bit integers."""
    out = np.zeros(len(words), np.uint64)
    for length, (of, codes) in by_length(words).items():
        out[of] = _number(codes, np.arange(length)[None, :]).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def by_length(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the words' indices and their code points, a row a word."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = {}
    for n in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == n)
        out[n] = of, np.frombuffer("".join(words[i] for i in of).encode("utf-32-le"), np.uint32).reshape(len(of), n).astype(np.int64)
    return out


class BitTable:
    """Two bits for each of a set of 64-bit sums; what is not in the set is seldom let through."""

    def __init__(self, bits: int, cells: np.ndarray) -> None:
        self.bits, self.cells = bits, cells

    @staticmethod
    def places(sums: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        sums = sums.view(np.uint64)
        return (sums >> np.uint64(64 - bits)).view(np.int64), (sums & np.uint64((1 << bits) - 1)).view(np.int64)

    def may_have(self, sums: np.ndarray) -> np.ndarray:
        """Indices of sums that may be in the set."""
        one, _ = self.places(sums, self.bits)
        first = np.flatnonzero((self.cells[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
        _, two = self.places(sums[first], self.bits)
        return first[np.flatnonzero((self.cells[two >> 3] >> (two & 7).astype(np.uint8)) & 1)]


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray, table: BitTable) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Of words of one length, given as code points: the words' rows and their distinct changed forms that the table lets through.

    Of equal forms of one word one is made: a character is left out only where the one before it differs, and put in only
    behind another one than itself. Replacements by another character are all different.
    """
    m, n = codes.shape
    zero = np.zeros((m, 1), np.uint64)
    place = np.arange(n)[None, :]
    sums = [np.concatenate([zero, np.cumsum(_number(codes, place + d), axis=1, dtype=np.uint64)], axis=1) for d in (0, -1, 1)]
    before, (ends, shorter, longer) = sums[0], [s[:, -1:] - s for s in sums]
    previous = np.concatenate([np.full((m, 1), -1), codes], axis=1)
    width = max(1, BLOCK // (m * max(1, len(alphabet))))
    for lo in range(0, n + 1, width):
        at, own = np.arange(lo, min(lo + width, n + 1)), np.arange(lo, min(lo + width, n))
        new = _number(alphabet[None, :], at[:, None])[None, :, :] + before[:, at, None]
        inside = (codes[:, own, None] != alphabet[None, None, :])
        kinds = (
            ("out", (before[:, own] + shorter[:, own + 1])[:, :, None], (codes[:, own] != previous[:, own])[:, :, None]),
            ("new", new[:, : len(own)] + ends[:, own + 1, None], inside),
            ("in", new + longer[:, at, None], previous[:, at, None] != alphabet[None, None, :]),
        )
        for kind, values, real in kinds:
            k = table.may_have(values.ravel())
            k = k[real.ravel()[k]]
            row, cell, letter = np.unravel_index(k, values.shape)
            yield row, [changed(codes[r], lo + c, kind, int(alphabet[x])) for r, c, x in zip(row.tolist(), cell.tolist(), letter.tolist(), strict=True)]


def changed(codes: np.ndarray, at: int, kind: str, letter: int) -> str:
    text = codes.astype(np.uint32).tobytes().decode("utf-32-le")
    return text[:at] + ("" if kind == "out" else chr(letter)) + text[at + (kind != "in") :]


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, n, v_sum) of the words (word) with `least` occurrences at least, stored. Nulls are no words."""
    counts = words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("v_sum", pa.array(word_sums(b.column(0).to_pylist())))

    return written(counts.mapInArrow(run, "word string, n long, v_sum long"), "vocabulary")


def bit_table(words: DataFrame) -> BitTable:
    """The table of a vocabulary's sums: 16 bits a word, 2^28 (32 MB) at most, whatever the vocabulary's size; a fuller one lets more through."""
    bits = min(MOST_BITS, max(13, (words.count() * 16).bit_length()))
    high, low = F.shiftrightunsigned("v_sum", 64 - bits), F.col("v_sum").bitwiseAND((1 << bits) - 1)
    each = words.select(F.explode(F.array(high, low)).alias("place"))
    # 64 places are one number, so at most 2^22 rows come to the driver
    cells = each.groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return BitTable(bits, out.view(np.uint8))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of words of a vocabulary (word, n, v_sum) that one change makes of each other, in both directions."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    # characters of the vocabulary; a table of code points is their bound
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.int64)
    table = bit_table(words)
    shared = spark.sparkContext.broadcast((alphabet, table.bits, table.cells))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, bits, cells = shared.value
        table = BitTable(bits, cells)
        for b in batches:
            own = b.column(0).to_pylist()
            for of, codes in by_length(own).values():
                rows = max(1, BLOCK // ((codes.shape[1] + 1) * max(1, len(letters))))
                for lo in range(0, len(of), rows):
                    for row, near in neighbourhood(codes[lo : lo + rows], letters, table):
                        yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in of[lo + row]], pa.string()), pa.array(near, pa.string())], ["word", "near"])

    found = words.select("word").mapInArrow(run, CANDIDATES)
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def variant_groups(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n, v_sum).

    A word's form is its most frequent near word (ties: the smallest), if that is `factor` times (two or more) as frequent
    at least. The root is the last word of the chain of forms, whose counts rise by the factor each time, so that chains are
    short; each round of joins halves what is left of them.
    """
    if factor < 2:
        raise ValueError("a form is at least twice as frequent")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = words.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.minus") >= factor * F.col("n")
    forms = written(joined.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    links = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        release(links)
        links = longer
        if not longer.where("moved").limit(1).count():
            break
    return forms.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt_words(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """(word) of each run of Latin letters of docs (doc_id, text) with `least` characters, in lower case (A-Z only), some with a character left out.

    Where `every` divides the crc32 h of `<doc_id>:<run>`, character h % length is gone, and the word stays if it is still long
    enough. Null texts have no words; a null id leaves nothing out. Shorter runs never count, so they are not taken from the texts at all.
    """
    low = F.translate("word", LETTERS, LETTERS.lower())
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_column(docs), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("word")).select("doc_id", low.alias("word"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word").cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)


def sql() -> str:
    """DuckDB SQL of the groups of misspelt_words(documents); near words by forms with one character left out."""
    return r"""WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, k, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || w, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + ord(c) // 64)::BIGINT, (128 + ord(c) % 64)::BIGINT] END))), lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1]))) END AS h FROM runs, crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS c FROM v, unnest(range(0, length(word))) AS u(i)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.c = b.c AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.c = v.word
          UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.c = v.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n, CASE WHEN top >= 10 * v.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = v.word AND p.near_n = best.top) END AS form FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, coalesce(form, word) AS goal, form IS NULL AS over FROM f),
walk AS (SELECT word, goal, over, 1 AS step FROM chain UNION ALL SELECT w.word, c.goal, c.over, step + 1 FROM walk w JOIN chain c ON w.goal = c.word WHERE NOT w.over),
root AS (SELECT word, arg_max(goal, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN root USING (word)""".replace("WITH crc", "WITH RECURSIVE crc", 1)
