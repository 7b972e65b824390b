"""Column functions on text: normalising, tokens, overlap, names, sentences, windows, previews."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.schemas import CONFIDENCE_RANK, TYPE_LABELS

SPACE = "[ \\t\\n\\x0b\\f\\r]+"


def words(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    """The text without white space at its ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: White space and marks of all of Unicode, spelled out: the flag that widens \s makes each step of a search slower.
WHITE = r"[\s\x{85}\p{Z}]+"
MARKS = r"[^\p{L}\p{N}_\s\x{85}\p{Z}]+"


def normalised_words(text: Column) -> Column:
    """Words in lower case without punctuation; null has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARKS, "")
    return F.filter(F.split(plain, WHITE), lambda w: w != "")


def normalise(text: Column) -> Column:
    """Lower case without punctuation, one space between words."""
    return F.array_join(normalised_words(text), " ")


def token_set(normalised: Column) -> Column:
    """Distinct words of a normalised text; none for the empty one."""
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token sets; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? and white space before an ASCII capital."""
    return F.split(text, r"(?<=[.!?])(?U:\s)+(?=[A-Z])")


def strip_boilerplate(text: Column) -> Column:
    """The text between the start and end marker lines of a public e-book, if there are such."""
    after = F.regexp_replace(text, r"(?is)^.*?\*{3}\s*START OF (THE |THIS )?PROJECT GUTENBERG EBOOK[^\n]*\n", "")
    return strip(F.regexp_replace(after, r"(?is)\*{3}\s*END OF (THE |THIS )?PROJECT GUTENBERG EBOOK.*$", ""))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def safe_name(label: Column) -> Column:
    """A label as a file name; `default` if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)[^\w\-]", "_"), "^_+|_+$", "")
    return F.when(cut == "", "default").otherwise(cut)


def book_name(number: Column, title: Column) -> Column:
    """pg00000_title.txt: the title in lower case, without marks, words joined by underscores."""
    plain = F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}_\s-]", "")
    return F.format_string("pg%05d_%s.txt", number, F.regexp_replace(F.regexp_replace(plain, r"(?U)[\s-]+", "_"), "^_+|_+$", ""))


@lru_cache
def ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of a character in ASCII, by character: one letter, or several. All others leave nothing."""
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for c in map(chr, (*range(128, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        if left := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode():
            (one if len(left) == 1 else several)[c] = left
    return one, several


def ascii_folded(text: Column) -> Column:
    """The text by compatibility decomposition (NFKD), without what is not ASCII then: accents go, ligatures and wide forms become letters.

    A decomposition depends on its character alone as far as ASCII goes, so tables of characters are enough. Texts in
    ASCII are left as they are; of others each different character of several letters is spelled out throughout the text.
    """
    one, several = ascii_folds()
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    met = F.array_intersect(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), F.lit(0)), F.array(*map(F.lit, several)))
    spelled = F.aggregate(met, F.translate(text, "".join(one), "".join(one.values())), lambda t, c: F.replace(t, c, F.element_at(table, c)))
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(spelled, r"[^\x00-\x7F]+", ""))


def slug(stem: Column) -> Column:
    """A stem as an identifier: folded to ASCII, words joined by hyphens."""
    return F.lower(F.btrim(F.regexp_replace(ascii_folded(stem), r"\P{Alnum}+", "-"), F.lit("-")))


def chunk_id(source_file: Column, index: Column) -> Column:
    """The identifier of a file's chunk: slug_000; more digits where needed."""
    return F.format_string("%s_%03d", slug(file_stem(source_file)), index)


def window_texts(text: Column, size: int = 300) -> Column:
    """Windows of `size` words side by side; they begin at 0, size, ... below n - size."""
    w = words(text)
    n = F.size(w)
    return F.when(n > size, F.transform(F.sequence(F.lit(0), n - size - 1, F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def table_cell(text: Column, most: int = 300) -> Column:
    """A text as a table's cell: bars escaped, lines joined, at most so many characters, the last two an ellipsis' place."""
    flat = F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("…"))).otherwise(flat)


def preview(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def confidence_rank(confidence: Column) -> Column:
    """3 for high, 2 for medium, 1 for low, else 0."""
    out = F.lit(0)
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def type_label(soc_type: Column) -> Column:
    """The type's name for display; other values stay as they are."""
    out = soc_type
    for name, label in TYPE_LABELS.items():
        out = F.when(soc_type == name, label).otherwise(out)
    return out


def comma_list(joined: Column) -> Column:
    """Items of a comma-joined string, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def without_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def think_block(text: Column) -> Column:
    """The first think block, stripped; empty if there is none."""
    return strip(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1))


# The parts of the annotators' prompt.
PROMPT_TASK = "\nAnalyze the [TEXT TO ANALYZE] section above. Identify and classify every SoC passage. Respond with JSON only."
PROMPT_CONTEXT = "\n[CONTEXT -- {} of {} chunk]\n"


def user_prompt(source: Column, chunk: Column, label: Column, index: Column, text: Column, before: Column, after: Column) -> Column:
    """The annotators' prompt for a chunk: where it is from, its text, and the contexts that there are."""

    def context(which: str, c: Column) -> Column:
        end, side = which.split()
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(PROMPT_CONTEXT.format(end, side)), c, F.lit("\n")))

    return F.concat_ws(
        "\n", F.concat(F.lit("Source: "), source), F.concat(F.lit("Chunk: "), chunk, F.lit(" ("), label, F.lit(")")), F.concat(F.lit("Position: "), index.cast("string")),
        context("end previous", before), F.concat(F.lit("\n[TEXT TO ANALYZE]\n"), text, F.lit("\n")), context("start next", after), F.lit(PROMPT_TASK),
    )
