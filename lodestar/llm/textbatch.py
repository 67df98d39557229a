"""Vectorised word handling for Arrow batches of texts.

A batch of texts is split on ASCII white space in Arrow's C++ kernels and dictionary-encoded, so that
whatever depends on one word alone (its tokens, its n-grams, its weight) is computed once for each
distinct word of the batch and gathered back with numpy. Nothing here runs once per token in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held in exploded form at a time; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and what they hoard counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column without nulls (null: empty)."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about equally many bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.binary_length(texts_of(batch, name)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


class Words:
    """The words of a batch of texts: ``vocab`` (distinct), ``ids`` (one per word), ``offsets`` (by text)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        values = lists.flatten()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        keep = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
        if not keep.all():
            values = values.filter(pa.array(keep))
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        coded = values.dictionary_encode()
        self.vocab: pa.Array = coded.dictionary
        self.ids: np.ndarray = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets: np.ndarray = bounds
        self.counts: np.ndarray = np.diff(bounds)

    def doc_of(self) -> np.ndarray:
        """For each word the position of its text in the batch."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sum by text of a value that each distinct word has."""
        return segment_sums(per_word[self.ids], self.offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_bytes(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all distinct words, end to end, and where each begins (with a closing offset)."""
    if len(vocab) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = vocab.buffers()
    bounds = np.frombuffer(offsets, np.int32)[vocab.offset : vocab.offset + len(vocab) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(vocab) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(vocab: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each distinct word, as uint64."""
    import xxhash

    raw, bounds = word_bytes(vocab)
    data, ends = raw.tobytes(), bounds.tolist()
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(data[a:b], seed) for a, b in zip(ends, ends[1:])])
    return np.frombuffer(joined, dtype=">u8").astype(np.uint64)


def word_keys(vocab: pa.Array) -> np.ndarray:
    """`word_hashes` with seed 0, words of under 32 bytes lane by lane for all words together."""
    raw, bounds = word_bytes(vocab)
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    size = np.diff(bounds)
    order = np.argsort(-np.minimum(size, 32).astype(np.int8), kind="stable")  # by falling size: words with bytes left are a prefix
    long = int(np.count_nonzero(size >= 32))
    order, far = order[long:], order[:long]
    at, left = bounds[:-1][order], size[order]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    h = p5 + left.astype(np.uint64)
    for lane in range(3):
        n = int(np.count_nonzero(left >= 8 * (lane + 1)))
        h[:n] = turned(h[:n] ^ (turned(eight[at[:n] + 8 * lane] * p2, 31) * p1), 27) * p1 + p4
    at, left = at + left // 8 * 8, left % 8
    four = np.flatnonzero(left >= 4)
    h[four] = turned(h[four] ^ ((eight[at[four]] & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
    at, left = at + left // 4 * 4, left % 4
    for byte in range(3):
        one = np.flatnonzero(left > byte)
        h[one] = turned(h[one] ^ (padded[at[one] + byte].astype(np.uint64) * p5), 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    out = np.empty(len(size), np.uint64)
    out[order] = h ^ (h >> np.uint64(32))
    if long:
        out[far] = word_hashes(vocab.take(pa.array(far)))
    return out
