"""Hashes of words and of word shingles, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

#: A-Z become a-z; other ASCII characters but letters and digits become blanks.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finishing step: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: A-Z become a-z and white space a blank; everything else stays.
TO_TOKENS = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def word_spans(texts: list[bytes], letters: bytes = TO_WORDS) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined and translated, where each word starts and ends there, its 64-bit hash, and how many each text has."""
    data = b" ".join(texts).translate(letters)
    b = np.frombuffer(data, np.uint8)
    letter = b != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    limits = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    if not len(starts):
        return data, starts, ends, np.zeros(0, np.uint64), counts
    size = ends - starts
    at = np.flatnonzero(letter)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), BASE, np.uint64))
    h = np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * power[place], first)
    return data, starts, ends, mixed(h + size.astype(np.uint64)), counts


def word_hashes(texts: list[bytes], letters: bytes = TO_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, text after text, and how many words each text has."""
    return word_spans(texts, letters)[3:]


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``size`` words inside a text, and how many each text has.

    A text of fewer words, but not none, has one shingle of them all.
    """
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    room = np.repeat(np.minimum(counts, size), n)
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        h = h * BASE + np.where(room > k, padded[at + k] | np.uint64(1), np.uint64(0))
    return mixed(h), n


def slices_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of items whose sizes sum up to about ``most``, one item at least."""
    out, i, total = [], 0, 0
    for k, s in enumerate(sizes):
        if k > i and total + s > most:
            out.append((i, k))
            i, total = k, 0
        total += s
    return [*out, (i, len(sizes))] if sizes else []
