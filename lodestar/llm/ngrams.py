"""Hashed character n-grams of distinct words, vectorised over a whole vocabulary at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbatch import mix64, word_bytes


def bare_words(vocab: pa.Array) -> pa.Array:
    """Each distinct word without the marks and digits around and inside it, in lower case (may be empty)."""
    return pc.utf8_lower(pc.replace_substring_regex(vocab, r"[^\pL\pM]+", ""))


def gram_ids(words: pa.Array, lengths: tuple[int, ...], buckets: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of bytes of ``<word>``; ``whole``: also one for the word itself.

    Bytes rather than characters: the hash is the same for every batch, and a letter outside ASCII is a pair of bytes
    that n-grams see like any other two.
    """
    raw, bounds = word_bytes(words)
    n = len(words)
    size = np.diff(bounds)
    # Every word between a start and an end mark, so that n-grams know the edges of words.
    padded = np.empty(len(raw) + 2 * n, np.uint64)
    first = bounds[:-1] + 2 * np.arange(n)
    padded[first] = ord("<")
    padded[first + size + 1] = ord(">")
    padded[np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, size)] = raw
    owner = np.repeat(np.arange(n), size + 2)
    keep_word = size > 0
    out_word, out_bucket = [], []
    for k in lengths:
        if len(padded) < k:
            continue
        code = np.full(len(padded) - k + 1, k, np.uint64)
        for i in range(k):
            code = code * np.uint64(0x100000001B3) + padded[i : len(padded) - k + 1 + i]
        same = owner[: len(owner) - k + 1] == owner[k - 1 :]
        same &= keep_word[owner[: len(owner) - k + 1]]
        out_word.append(owner[: len(owner) - k + 1][same])
        out_bucket.append((mix64(code[same]) % np.uint64(buckets)).astype(np.int64))
    if whole and len(padded):
        powers = np.ones(int(size.max(initial=0)) + 2, np.uint64)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(powers), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(padded)) - np.repeat(first, size + 2)
        total = np.zeros(len(padded) + 1, np.uint64)
        np.cumsum(mix64(padded + np.uint64(1)) * powers[place], out=total[1:])
        code = total[first + size + 2] - total[first]
        out_word.append(np.flatnonzero(keep_word))
        out_bucket.append((mix64(code[keep_word]) % np.uint64(buckets)).astype(np.int64))
    if not out_word:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_word), np.concatenate(out_bucket)
