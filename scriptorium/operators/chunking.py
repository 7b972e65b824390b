"""Splitting texts into chunks: by headings, by packed sentences, by narrators; contexts; the markup form."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import chunk_id, file_stem, strip

# Line patterns of headings, and the narrators whose names head one novel's sections.
HEADINGS = (
    r"^\s*(CHAPTER|Chapter)\s+([IVXLCDM]+|\d+|[A-Z][a-z]+)\b.*$",
    r"^\s*(PART|Part)\s+([IVXLCDM]+|\d+|[A-Z][a-z]+)\b.*$",
    r"^\s*(BOOK|Book)\s+([IVXLCDM]+|\d+|[A-Z][a-z]+)\b.*$",
    r"^\s*[IVXLCDM]+\.\s*$",
    r"^[A-Z][A-Z\s]{2,}$",
    r"^\s*[-*_]{3,}\s*$",
    r"^\s*\[.+\]\s*$",
)
NARRATORS = ("Darl", "Cora", "Jewel", "Dewey Dell", "Tull", "Anse", "Peabody", "Vardaman", "Cash", "Samson", "Addie", "Whitfield", "Armstid", "Moseley", "MacGowan")
# Chunk sizes and overlaps in tokens by model family (see token_chunks).
PRESETS = {
    "qwen3-8b": (9_000, 600),
    "qwen3-14b": (11_000, 800),
    "llama4-scout": (12_000, 1_000),
    "llama4-maverick": (17_000, 1_000),
    "gemini-pro": (20_000, 1_200),
    "gemini-flash": (12_000, 800),
    "claude-sonnet": (20_000, 1_000),
    "claude-opus": (25_000, 1_200),
}

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
Piece = tuple[str, str]


def pack_sentences(text: str, size: int, overlap: int) -> list[Piece]:
    """(label, text) of chunks of whole sentences, which stand as they are, blank ones too; an empty text is one empty chunk.

    Sentences fill a chunk while their lengths, without the spaces between, stay within `size`; a longer
    one is a chunk of its own. The next chunk repeats the last sentences as long as one more, beside those
    that are taken already and the spaces between them, stays within `overlap`; they count with their spaces.
    """
    out, held, used = [], [], 0
    for s in _SENTENCE.split(text):
        if held and used + len(s) > size:
            out.append(" ".join(held))
            keep, used = len(held), 0
            while keep and used + len(held[keep - 1]) <= overlap:
                keep -= 1
                used = len(" ".join(held[keep:]))
            held = held[keep:]
        held.append(s)
        used += len(s)
    if held:
        out.append(" ".join(held))
    return [(f"Chunk {i}", t) for i, t in enumerate(out, 1)]


def heading_positions(text: str) -> list[tuple[int, str]]:
    """Places and labels of headings; of several at one place the label that sorts first."""
    found: dict[int, str] = {}
    for pattern in HEADINGS:
        for m in re.finditer(pattern, text, re.MULTILINE):
            label = m.group(0).strip()
            found[m.start()] = min(label, found.get(m.start(), label))
    return sorted(found.items())


def _sections(text: str, marks: list[tuple[int, str]], size: int, overlap: int, part: str) -> list[Piece]:
    out = []
    ends = [p for p, _ in marks[1:]] + [len(text)]
    for (start, label), end in zip(marks, ends, strict=True):
        body = text[start:end].strip()
        if not body:
            continue
        if len(body) <= size:
            out.append((label, body))
            continue
        parts = pack_sentences(body, size, overlap)
        out += [(part.format(label=label, j=j, n=len(parts)), t) for j, (_, t) in enumerate(parts, 1)]
    return out


def split_headings(text: str, size: int, overlap: int) -> tuple[list[Piece], bool]:
    """Sections from heading to heading, large ones packed by sentences; what stands before the first heading is left out.

    The flag says whether neighbours' contexts belong to the chunks: not where there are no two headings.
    """
    marks = heading_positions(text)
    if len(marks) < 2:
        return pack_sentences(text, size, overlap), False
    return _sections(text, marks, size, overlap, "{label} ({j}/{n})"), True


def split_sentences(text: str, size: int, overlap: int) -> tuple[list[Piece], bool]:
    """Packed sentences alone, without contexts."""
    return pack_sentences(text, size, overlap), False


def split_narrators(text: str, size: int, overlap: int) -> tuple[list[Piece], bool]:
    """Sections headed by a narrator's name alone on a line, labelled with the narrator's running number."""
    names = "|".join(re.escape(n) for n in sorted(NARRATORS, key=len, reverse=True))
    marks = [(m.start(), m.group(0).strip()) for m in re.finditer(rf"^\s*(?:{names})\s*$", text, re.MULTILINE)]
    if len(marks) < 2:
        return pack_sentences(text, size, overlap), False
    seen: dict[str, int] = {}
    numbered = []
    ends = [p for p, _ in marks[1:]] + [len(text)]
    for (start, name), end in zip(marks, ends, strict=True):
        if text[start:end].strip():
            seen[name] = seen.get(name, 0) + 1
        numbered.append((start, f"{name} ({seen.get(name, 0)})"))
    return _sections(text, numbered, size, overlap, "{label} [{j}/{n}]"), True


Splitter = Callable[[str, int, int], tuple[list[Piece], bool]]
#: Splitters of single works: the first key that the file's stem contains decides.
CUSTOM: dict[str, Splitter] = {"as_i_lay_dying": split_narrators, "as i lay dying": split_narrators, "asilaydying": split_narrators}


def splitter_for(source_file: str) -> Splitter:
    stem = re.sub(r"\.[^./]*$", "", source_file.rsplit("/", 1)[-1]).lower().replace("-", "_")
    return next((f for key, f in CUSTOM.items() if key in stem), split_headings)


def chunk_documents(docs: DataFrame, size: int = 20_000, overlap: int = 1_000, splitter: Splitter | None = None) -> DataFrame:
    """Chunks of documents (source_file, text), with their identifiers and neighbours' contexts.

    Each document is split by itself, so the work follows the texts without a shuffle; contexts come
    from the neighbours in the same pass. overlap 0 gives empty contexts. A null text has no chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, text in zip(f["source_file"], f["text"], strict=True):
                if text is None:
                    continue
                pieces, contexts = (splitter or splitter_for(name or ""))(text, size, overlap)
                texts = [t for _, t in pieces]
                for i, (label, t) in enumerate(pieces):
                    before = texts[i - 1][-overlap:] if contexts and overlap and i else ""
                    after = texts[i + 1][:overlap] if contexts and i + 1 < len(texts) else ""
                    rows.append((name, label, t, i, before, after))
            yield pd.DataFrame(rows, columns=["source_file", "chunk_label", "chunk_text", "chunk_index", "context_before", "context_after"])

    out = docs.select("source_file", "text").mapInPandas(run, "source_file string, chunk_label string, chunk_text string, chunk_index int, context_before string, context_after string")
    return out.withColumn("chunk_id", chunk_id(F.col("source_file"), F.col("chunk_index"))).select("source_file", "chunk_id", "chunk_label", "chunk_text", "chunk_index", "context_before", "context_after")


def with_contexts(chunks: DataFrame, overlap: int = 1_000) -> DataFrame:
    """Replace the contexts by the ends of the neighbouring chunks of the same file."""
    w = W.partitionBy("source_file").orderBy("chunk_index")
    before = F.coalesce(F.right(F.lag("chunk_text").over(w), F.lit(overlap)), F.lit(""))
    after = F.coalesce(F.left(F.lead("chunk_text").over(w), F.lit(overlap)), F.lit(""))
    return chunks.withColumn("context_before", before).withColumn("context_after", after)


def to_markup(chunks: DataFrame) -> DataFrame:
    """(source_file, text): each file's chunks between numbered tags, in order. Quotes in labels become apostrophes."""
    label = F.when(F.coalesce("chunk_label", F.lit("")) != "", F.concat(F.lit(' label="'), F.replace("chunk_label", F.lit('"'), F.lit("'")), F.lit('"'))).otherwise("")
    n = F.col("chunk_index").cast("string")
    block = F.concat(F.lit("<chunk-"), n, label, F.lit(">\n"), "chunk_text", F.lit("\n</chunk-"), n, F.lit(">\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", block.alias("block"))))
    return chunks.groupBy("source_file").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "").alias("text"))


_BLOCK = r'(?s)<chunk-(\d+)(?:\s+label="([^"]*)")?\s*>(.*?)(?:</chunk-\d+>|\z)'


def from_markup(files: DataFrame, overlap: int = 1_000) -> DataFrame:
    """Chunks of marked-up files (source_file, text); empty ones go, the others are numbered anew from 0.

    A chunk ends at the next closing tag of any number, or at the end of the text.
    """
    labels = F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(2))
    bodies = F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(3))
    each = files.select("source_file", F.posexplode(F.arrays_zip(labels.alias("label"), bodies.alias("body"))).alias("pos", "c"))
    each = each.select("source_file", "pos", F.coalesce(F.col("c.label"), F.lit("")).alias("chunk_label"), strip(F.col("c.body")).alias("chunk_text")).where("chunk_text <> ''")
    index = F.row_number().over(W.partitionBy("source_file").orderBy("pos")) - 1
    out = each.withColumn("chunk_index", index).drop("pos")
    return with_contexts(out.withColumn("chunk_id", chunk_id(F.col("source_file"), F.col("chunk_index"))), overlap)


def is_markup(text: F.Column) -> F.Column:
    """Whether a chunk tag opens within the first 2000 characters."""
    return F.rlike(F.left(text, F.lit(2000)), F.lit(r'<chunk-\d+(\s+label="[^"]*")?\s*>'))


_TOKEN = re.compile(r"\s*\S+\s*")


def _packed(parts: list[str], size: int, count: Callable[[str], int]) -> list[str]:
    """Neighbouring parts joined while they hold `size` tokens together."""
    out: list[str] = []
    used = 0
    for p in parts:
        n = count(p)
        if out and used + n <= size:
            out[-1] += p
            used += n
        else:
            out.append(p)
            used = n
    return out


def _recursive(text: str, size: int, count: Callable[[str], int], levels: tuple[str, ...] = (r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?])(?=\s)", r"(?<=\s)")) -> list[str]:
    """Paragraphs, lines, sentences, words: each level cuts what is too long for the one before, and joins what is short."""
    if count(text) <= size or not levels:
        return [text]
    parts = [x for p in re.split(levels[0], text) if p for x in _recursive(p, size, count, levels[1:])]
    return _packed(parts, size, count)


def token_chunks(docs: DataFrame, strategy: str = "sentence", size: int = 20_000, overlap: int = 1_000, make_counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Chunks of documents (source_file, text) of `size` tokens at most, with identifiers of the raw file stem and neighbours' contexts.

    `sentence` packs whole sentences, `recursive` cuts paragraphs, lines, sentences and words as needed, `token`
    cuts after every `size` tokens. make_counter() runs once in each task and gives a function that counts the
    tokens of a text; words between white space count without one. A single longer word or sentence is a chunk of
    its own. Chunks joined give the text. Null texts have no chunk. overlap is in characters, as contexts are.
    """
    if strategy not in ("sentence", "recursive", "token"):
        raise ValueError(f"unknown strategy: {strategy}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make_counter() if make_counter else lambda t: len(t.split())
        for f in frames:
            rows = []
            for name, text in zip(f["source_file"], f["text"], strict=True):
                if not text:
                    continue
                if strategy == "recursive":
                    pieces = _recursive(text, size, count)
                else:
                    pieces = _packed(re.split(r"(?<=[.!?])(?=\s+[A-Z])", text) if strategy == "sentence" else _TOKEN.findall(text) or [text], size, count)
                rows += [(name, f"Chunk {i + 1}", t, i) for i, t in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["source_file", "chunk_label", "chunk_text", "chunk_index"])

    out = docs.select("source_file", "text").mapInPandas(run, "source_file string, chunk_label string, chunk_text string, chunk_index int")
    return with_contexts(out.withColumn("chunk_id", F.format_string("%s_%03d", file_stem(F.col("source_file")), "chunk_index")), overlap)


#: offsets(text) gives the place (start, end) of each of a text's tokens; make_offsets() runs once in each task.
Offsets = Callable[[str], list[tuple[int, int]]]


def word_offsets() -> Offsets:
    """Words between white space as tokens."""
    return lambda text: [m.span() for m in re.finditer(r"\S+", text)]


def file_offsets(path: str) -> Callable[[], Offsets]:
    """The tokens of a tokenizers file."""

    def make() -> Offsets:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: [o for o in t.encode(text, add_special_tokens=False).offsets if o[0] < o[1]]

    return make


def token_contexts(chunks: DataFrame, size: int, make_offsets: Callable[[], Offsets] = word_offsets) -> DataFrame:
    """Replace the contexts by the last `size` tokens of the chunk before and the first `size` tokens of the one after, of the same file.

    They are cut where tokens begin and end, so that a context is text of its chunk and never a part of a token. Only the
    ends of chunks are tokenized side by side with the others' in the window. 0 gives empty contexts.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", t_head string, t_tail string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = make_offsets()
        for f in frames:
            heads, tails = [], []
            for text in f["chunk_text"]:
                own = offsets(text or "") if size else []
                heads.append(text[own[0][0] : own[min(size, len(own)) - 1][1]] if own else "")
                tails.append(text[own[-min(size, len(own))][0] : own[-1][1]] if own else "")
            yield f.assign(t_head=heads, t_tail=tails)

    w = W.partitionBy("source_file").orderBy("chunk_index")
    ends = chunks.mapInPandas(run, schema)
    before, after = F.coalesce(F.lag("t_tail").over(w), F.lit("")), F.coalesce(F.lead("t_head").over(w), F.lit(""))
    return ends.withColumn("context_before", before).withColumn("context_after", after).drop("t_head", "t_tail")


def refined_chunks(docs: DataFrame, size: int = 20_000, overlap: int = 1_000, make_offsets: Callable[[], Offsets] = word_offsets) -> DataFrame:
    """Chunks of whole sentences, `size` tokens at most, with contexts of `overlap` tokens: from texts (source_file, text) to what a chunk file has."""

    def make_counter() -> Callable[[str], int]:
        offsets = make_offsets()
        return lambda text: len(offsets(text))

    return token_contexts(token_chunks(docs, "sentence", size, 0, make_counter), overlap, make_offsets)


def chunk_listing(chunks: DataFrame, models: int = 1) -> DataFrame:
    """What a run would ask for: (chunk_id, chunk_label, n_chars, n_calls), a call for each model."""
    return chunks.select("chunk_id", "chunk_label", F.length("chunk_text").alias("n_chars"), F.lit(models).alias("n_calls"))
