"""Word shingles of Arrow text columns as 64-bit hashes, in numpy, without making Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLDEN, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASE = U(0xD6E8FEB86659FD93)

#: Bytes of texts hashed at once; a single longer text is hashed whole.
BLOCK_BYTES = 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with no visible structure (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


@dataclass
class Words:
    """Word hashes of some texts, one text after the other: those of text i are hashes[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    first: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more than texts). A null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes of text each, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, stop
        start = stop


def word_hashes(column: pa.Array) -> Words:
    """Hash of each word: a polynomial in its bytes, mixed with its length."""
    data, at = utf8(column)
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    text_starts = at[:-1][(at[:-1] < len(data))]
    begins[text_starts] = inside[text_starts]  # a text's first word does not continue the last one of the text before
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    letters = np.flatnonzero(inside)
    first_letter = np.searchsorted(letters, starts) if len(letters) < len(starts) * 2 else np.cumsum(inside)[starts] - 1
    lengths = np.diff(np.append(first_letter, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first_letter, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    sums = np.add.reduceat(_LETTER[data[letters]] * powers[place], first_letter)
    hashes = mix(sums + lengths.astype(np.uint64) * GOLDEN)
    return Words(hashes, np.searchsorted(starts, at))


@dataclass
class Shingles:
    """Hashed shingles: text index and hash of each, in order of texts."""

    text: np.ndarray
    hashes: np.ndarray


def shingle_hashes(words: Words, size: int = 5, short: bool = True) -> Shingles:
    """Each run of `size` words of a text. With `short`, a text with fewer words (but one) is one shingle of them all."""
    h, first = words.hashes, words.first
    counts = np.diff(first)
    rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = rolled * BASE + h[k : k + len(rolled)]
    n = np.maximum(counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    hashes = mix(rolled[begin] ^ U(size))
    if short and len(few := np.flatnonzero((counts > 0) & (counts < size))):
        extra = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            there = counts[few] > k
            extra[there] = extra[there] * BASE + h[first[few[there]] + k]
        extra = mix(extra ^ counts[few].astype(np.uint64))
        text, hashes = np.concatenate((text, few)), np.concatenate((hashes, extra))
        order = np.argsort(text, kind="stable")
        text, hashes = text[order], hashes[order]
    return Shingles(text, hashes)


def distinct(s: Shingles) -> tuple[Shingles, np.ndarray]:
    """Each shingle once a text, with how often it is there."""
    if not len(s.text):
        return s, np.zeros(0, np.int64)
    key = s.hashes + mix(s.text.astype(np.uint64) + U(1))
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    return Shingles(s.text[at], s.hashes[at]), n
