"""Tokenizers as bulk encoders: every distinct word is encoded once per worker and then looked up."""

from __future__ import annotations

import codecs
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scriptorium.llm.common import distinct_words, per_text, ragged


_LETTERS = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]) if c not in "×÷")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_LETTERS_MARKS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\\[-`{-~]*$"
#: What byte-level BPE writes for each byte: printable Latin-1 characters stay, the others are characters from U+0100 on, in order. The line feed stays too, as it parts words here.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_AS_CHARS = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS and b != 10 else chr(b) for b in range(256))
_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker process's encoder for a file; tasks that follow each other share its table."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    """Ids of whole texts by a tokenizers file whose pre-tokenizer removes white space.

    Space and line feed are never part of such a token, so a text's ids are the ids of the words
    between them, each as the library gives it. Letters of ASCII and Latin-1 with marks after them are
    two pre-tokens, so their ids are those of the letters in lower case and of the marks. What has been
    encoded is kept in a bounded table: when it holds `most` strings or `most_chars` characters, those that
    came in most slices of texts stay, up to half of that, and the others go.
    """

    def __init__(self, path: str, most: int = 150_000, most_chars: int = 3_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a string comes to the library when the table lacks it, so that the library's own table costs more than it saves
        if resize := getattr(self.tokenizer.model, "_resize_cache", None):
            resize(0)
        self.most, self.most_chars = most, most_chars
        self.forget()

    def forget(self) -> None:
        """Drop the table; what is encoded next fills it anew."""
        self.at: dict[str, int] = {}
        self.chars = 0
        self.pool = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.slices = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Drop from the table all strings but those that came in most slices of texts, or first of as many. Each one's slices are halved, so that what comes no more goes later."""
        names, order = list(self.at), np.argsort(-self.slices, kind="stable")[: self.most // 2]
        chars = np.cumsum(np.fromiter((len(names[i]) for i in order.tolist()), np.int64, len(order)))
        keep = order[chars <= self.most_chars // 2]
        pool, start, length, slices = self.pool, self.start[keep], self.length[keep], self.slices[keep]
        self.at = dict(zip((names[i] for i in keep.tolist()), range(len(keep)), strict=True))
        self.chars = int(chars[len(keep) - 1]) if len(keep) else 0
        self.pool, self.start, self.length, self.slices = pool[ragged(start, length)], np.cumsum(length) - length, length, slices // 2

    def _learn(self, words: list[str], lower: bool) -> None:
        """Add strings to the table.

        Letters in lower case go to the library's BPE model at once: its normalizer and pre-tokenizer
        only write their UTF-8 bytes as characters.
        """
        if lower:
            tokenize = self.tokenizer.model.tokenize
            got = [[x.id for x in tokenize(w)] for w in codecs.charmap_decode("\n".join(words).encode(), "strict", _AS_CHARS)[0].split("\n")]
        else:
            got = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        length = np.fromiter(map(len, got), np.int64, len(got))
        known = len(self.at)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.slices = np.concatenate([self.slices, np.zeros(len(words), np.int64)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(got), np.uint32, int(length.sum()))])
        self.at.update(zip(words, range(known, known + len(words)), strict=True))
        self.chars += sum(map(len, words))

    def _rows(self, words: pa.Array, lower: bool) -> np.ndarray:
        """The table's rows of strings, which are all letters in lower case or all others."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        rows = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = len(self.at) + np.arange(len(new))
            self._learn([names[i] for i in new.tolist()], lower)
        self.slices[rows] += 1
        return rows[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as one array, and the number of ids of each text."""
        if len(self.at) > self.most or self.chars > self.most_chars:
            self._shrink()
        place, words, counts = distinct_words(pc.replace_substring(texts, "\n", " "))
        plain = pc.match_substring_regex(words, _LETTERS_MARKS)
        is_plain, letters, others = plain.to_numpy(zero_copy_only=False), words.filter(plain), words.filter(pc.invert(plain))
        both = np.empty((len(words), 2), np.int64)
        both[is_plain, 0] = self._rows(pc.utf8_lower(pc.utf8_rtrim(letters, characters=_MARKS)), lower=True)
        both[is_plain, 1] = self._rows(pc.utf8_ltrim(letters, characters=_LETTERS), lower=False)
        both[~is_plain, 0] = self._rows(others, lower=False)
        both[~is_plain, 1] = self._rows(pa.array([""]), lower=False)[0]
        length = self.length[both]
        pool = self.pool[ragged(self.start[both].ravel(), length.ravel())]
        length = length.sum(axis=1)
        start = np.cumsum(length) - length
        ids = pool[ragged(start[place], length[place])]
        return ids, per_text(length[place], counts)
