"""Simple-8b word-aligned coding of token ids in numpy, and the file format built on it.

A 64-bit word holds a selector in its low 4 bits and 60 bits of payload. Selectors 0 to 14 name how
many ids of how many bits follow each other there; selector 15 is the escape for an id of more than
60 bits: its payload is the place of the raw id in the block's list of escapes. Ids are coded in
blocks, each starting at a word of its own, so that blocks can be decoded apart and all at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: ids in a word, bits of each, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 1024
MAGIC = b"S8BTOK01"

_COUNT = np.array([*COUNTS, 1], np.int64)


def encode_blocks(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code blocks of `sizes` values each: words, words per block, escapes, escapes per block.

    Every block takes at each place the word with most values; the last one is filled up with
    zeros. All blocks advance in step, so the work is done on arrays.
    """
    values = values.astype(np.uint64, copy=False)
    sizes = np.asarray(sizes, np.int64)
    n = len(values)
    ends = np.cumsum(sizes)
    end_of = np.repeat(ends, sizes)
    top = int(values.max()) if n else 0
    narrow = values.astype(np.uint32) if top >> 32 == 0 else values
    big = np.flatnonzero(values >= np.uint64(1 << 60)) if top >> 60 else []
    best = np.full(n, len(COUNTS) - 1, np.int8)
    best[big] = ESCAPE
    for s in range(len(COUNTS) - 2, -1, -1):  # later ones hold more values and win
        if top >> BITS[s] == 0:  # all fit, to the blocks' ends
            best[:] = s
            continue
        fit = np.flatnonzero(narrow < (1 << BITS[s]))
        if not len(fit):
            break
        last = np.flatnonzero((np.diff(fit, append=-1) != 1) | (fit + 1 == end_of[fit]))
        run = np.repeat(fit[last] + 1, np.diff(last, prepend=-1))
        enough = (run - fit >= COUNTS[s]) | (run == end_of[fit])
        best[fit[enough]] = s
    block = np.flatnonzero(sizes)
    at = (ends - sizes)[block]
    starts, owners = [], []
    while len(block):
        starts.append(at)
        owners.append(block)
        at = at + _COUNT[best[at]]
        go = at < ends[block]
        at, block = at[go], block[go]
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64), np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    first, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(first, kind="stable")
    first, owner = first[order], owner[order]
    selector = best[first]
    words = selector.astype(np.uint64)
    escapes = values[first[selector == ESCAPE]]
    escape_counts = np.bincount(owner[selector == ESCAPE], minlength=len(sizes))
    if len(escapes):
        e = np.flatnonzero(selector == ESCAPE)
        before = (np.cumsum(escape_counts) - escape_counts)[owner[e]]
        words[e] |= (np.arange(len(e)) - before).astype(np.uint64) << np.uint64(4)
    for s in range(2, len(COUNTS)):
        own = np.flatnonzero(selector == s)
        if len(own):
            i = first[own][:, None] + np.arange(COUNTS[s])
            v = np.where(i < end_of[first[own]][:, None], values[np.minimum(i, n - 1)], np.uint64(0))
            shift = (4 + BITS[s] * np.arange(COUNTS[s])).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(v << shift, axis=1)
    return words, np.bincount(owner, minlength=len(sizes)), escapes, escape_counts


def decode_blocks(words: np.ndarray, word_counts: np.ndarray, sizes: np.ndarray, escapes: np.ndarray, escape_counts: np.ndarray) -> np.ndarray:
    """The values of all blocks, one after the other."""
    sizes = np.asarray(sizes, np.int64)
    selector = (words & np.uint64(15)).astype(np.int64)
    count = _COUNT[selector]
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(2, len(COUNTS)):
        own = np.flatnonzero(selector == s)
        if len(own):
            shift = (4 + BITS[s] * np.arange(COUNTS[s])).astype(np.uint64)
            out[place[own][:, None] + np.arange(COUNTS[s])] = (words[own][:, None] >> shift) & np.uint64((1 << BITS[s]) - 1)
    own = np.flatnonzero(selector == ESCAPE)
    if len(own):
        base = np.repeat(np.cumsum(escape_counts) - escape_counts, word_counts)[own]
        out[place[own]] = escapes[base + (words[own] >> np.uint64(4)).astype(np.int64)]
    starts = np.append(place, len(out))[np.cumsum(word_counts) - word_counts]
    from scriptorium.llm.common import ragged

    return out[ragged(starts, sizes)]


def encode_documents(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """One self-contained piece for each document: block table, words, escapes."""
    lengths = np.asarray(lengths, np.int64)
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    sizes = np.full(total, BLOCK, np.int64)
    last = np.cumsum(blocks)[blocks > 0] - 1
    sizes[last] = (lengths - (blocks - 1) * BLOCK)[blocks > 0]
    words, nw, escapes, ne = encode_blocks(ids, sizes)
    table = np.stack([sizes, nw, ne], axis=1).astype("<u4")
    word_end, escape_end, b, out = np.append(0, np.cumsum(nw)), np.append(0, np.cumsum(ne)), 0, []
    for k in blocks.tolist():
        e = b + k
        out.append(struct.pack("<I", k) + table[b:e].tobytes() + words[word_end[b] : word_end[e]].astype("<u8").tobytes() + escapes[escape_end[b] : escape_end[e]].astype("<u8").tobytes())
        b = e
    return out


def pack_file(doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray, pieces: list[bytes]) -> bytes:
    """A file: header, documents' directory, blocks' tables, words of all blocks, escapes.

    The header holds the numbers of documents, ids, blocks, words and escapes. The directory has
    each document's id, whether it has one, its number of ids and of blocks. The block table has
    ids, words and escapes of each block; their running sums are the blocks' offsets.
    """
    tables, words, escapes, blocks = [], [], [], []
    for p in pieces:
        (k,) = struct.unpack_from("<I", p)
        t = np.frombuffer(p, "<u4", 3 * k, 4).reshape(k, 3)
        cut = 4 + 12 * k
        mid = cut + 8 * int(t[:, 1].sum())
        tables.append(t)
        words.append(p[cut:mid])
        escapes.append(p[mid:])
        blocks.append(k)
    table = np.concatenate(tables) if tables else np.zeros((0, 3), "<u4")
    n_words, n_escapes = int(table[:, 1].sum()), int(table[:, 2].sum())
    head = MAGIC + struct.pack("<5q", len(doc_ids), int(np.sum(lengths)), len(table), n_words, n_escapes)
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(has_id, "u1").tobytes(), np.asarray(lengths, "<i8").tobytes(), np.asarray(blocks, "<u4").tobytes(), table.astype("<u4").tobytes(), *words, *escapes])


def unpack_file(data: bytes, together: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, has_id, lengths and ids of a file's documents, about `together` ids at a time.

    The block table's running sums give every run of documents its words and escapes at once.
    """
    if data[:8] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    d, _, b, w, e = struct.unpack_from("<5q", data, 8)
    at = 48

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, has_id, lengths, blocks = take("<i8", d), take("u1", d), take("<i8", d), take("<u4", d)
    table = take("<u4", 3 * b).reshape(b, 3).astype(np.int64)
    words, escapes = take("<u8", w), take("<u8", e)
    block_at = np.append(0, np.cumsum(blocks, dtype=np.int64))
    word_at, escape_at = np.append(0, np.cumsum(table[:, 1])), np.append(0, np.cumsum(table[:, 2]))
    id_at, i = np.append(0, np.cumsum(lengths)), 0
    while i < d:
        j = max(i + 1, int(np.searchsorted(id_at, id_at[i] + together, "right")) - 1)
        p, q = block_at[i], block_at[j]
        own = table[p:q]
        yield doc_ids[i:j], has_id[i:j].astype(bool), lengths[i:j], decode_blocks(words[word_at[p] : word_at[q]], own[:, 1], own[:, 0], escapes[escape_at[p] : escape_at[q]], own[:, 2])
        i = j
