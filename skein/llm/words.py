"""Vectorised words and shingles of many texts at once, for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """1, P, P**2, ... modulo 2**64, at least n of them."""
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 2 * len(_powers), 64), _P, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts of about CHUNK bytes; null is empty."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, in order; number of words of each text).

    A word is a run of bytes other than ASCII white space, A-Z lower-cased.
    """
    n = len(raw)
    docs = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begin[edges] |= inside[edges]
    starts = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(starts, offsets))
    if len(starts) == 0:
        return np.zeros(0, np.uint64), counts
    letters = raw[inside]
    if lower:
        letters = _LOWER[letters]
    # where each word starts among the bytes of words alone
    at = np.cumsum(inside)[starts] - 1
    lens = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, lens)
    terms = (letters.astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[place]
    return mix64(np.add.reduceat(terms, at) ^ (lens.astype(np.uint64) << np.uint64(40))), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each run of ``width`` words, number of them for each text).

    A text with fewer words has one: of all its words; one without words none.
    """
    n = len(words)
    many = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    if n == 0:
        return np.zeros(0, np.uint64), many
    padded = np.concatenate([words, np.zeros(width - 1, np.uint64)])
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    out = np.zeros(len(first), np.uint64)
    size = np.repeat(np.minimum(counts, width), many)
    for k in range(width):
        w = padded[first + k]
        if int(counts[counts > 0].min(initial=width)) < width:
            w = np.where(size > k, w, np.uint64(k + 1))
        out = (out + w) * _P
    return mix64(out), many
