"""Packing (operator 2): first-fit decreasing with a tournament tree, in randomised groups of documents.

Every document becomes its token ids and an end id. A document longer than a sequence gives full pieces
and a rest; rests (and short documents) are packed within their group by first-fit decreasing. Groups are
dealt by a seeded hash of the document id, and there are as many as keep a group near ``group_docs``
documents, so a group's work stays bounded however large the table is. Only piece descriptions (a few
numbers) are shuffled, never tokens or texts.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for themselves,
also where one id holds a large part of the rows (the place among equal ids in its batch salts the group);
an empty table gives an empty one; other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Words, slices, texts_of
from .token_counts import word_encoder


class TournamentTree:
    """Room left in each open bin; the root knows the largest, so the first bin with enough room is a descent."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put ``size`` into the first bin that has room and return that bin."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        place = node - self.leaves
        while node > 1:
            node //= 2
            top = best[2 * node] if best[2 * node] >= best[2 * node + 1] else best[2 * node + 1]
            if best[node] == top:
                break
            best[node] = top
        return place


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ties are taken in the order given."""
    order = np.argsort(-sizes, kind="stable")
    tree = TournamentTree(max(1, len(sizes)), capacity)
    place = np.fromiter((tree.first_fit(s) for s in sizes[order].tolist()), np.int64, len(sizes))
    by_bin = np.argsort(place, kind="stable")
    ordered, bins = sizes[order][by_bin], place[by_bin]
    ends = np.cumsum(ordered)
    first = np.concatenate([[True], bins[1:] != bins[:-1]]) if len(bins) else np.zeros(0, bool)
    base = np.repeat((ends - ordered)[first], np.diff(np.concatenate([np.flatnonzero(first), [len(bins)]])))
    out_bin, out_offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    out_bin[order[by_bin]], out_offset[order[by_bin]] = bins, ends - ordered - base
    return out_bin, out_offset


def document_ids(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents end to end (each closed by ``end_id``), and where each begins."""
    words = Words(texts)
    encoder = word_encoder(path)
    start, length = encoder.encode(words.vocab)
    start, length = start[words.ids], length[words.ids]
    ends = np.cumsum(length)
    take = np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
    by_doc = np.concatenate([[0], ends])[words.offsets]
    tokens = np.diff(by_doc)
    bounds = by_doc + np.arange(len(by_doc))
    out = np.full(int(bounds[-1]), end_id, "<u4")
    out[np.arange(len(take)) + np.repeat(np.arange(len(tokens)), tokens)] = encoder.ids[take]
    return out, bounds


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_docs: int = 8192, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // group_docs))
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            ids, bounds = document_ids(tokenizer_path, texts_of(part, text_col), end_id)
            total = np.diff(bounds)
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), n)
            start = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, total[doc] - start)
            at = (bounds[:-1][doc] + start).tolist()
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at, length.tolist())]
            salt = pd.Series(part.column(0).to_pandas()).groupby(part.column(0).to_pandas(), dropna=False).cumcount().to_numpy()
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array(salt[doc].astype(np.int64))],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "salt"],
            )

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["deal", id_col, "start", "ids_crc32"], kind="stable")
        bins, offset = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        group = int(pdf["pack_group"].iloc[0])
        return pdf[[id_col, "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=(group << 32) + bins, offset=offset)

    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pieces, f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, salt long")
    rows = rows.withColumn("deal", F.xxhash64(F.lit(seed), F.col(id_col), F.col("salt")))
    rows = rows.withColumn("pack_group", F.pmod(F.col("deal"), F.lit(groups)))
    out = rows.groupBy("pack_group").applyInPandas(packed, f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out


def padding(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Sequences, tokens and padding of a packing (a sequence whose length is a power of two is not padded)."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.bit_count("used") == 1
    return used.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("used"))).alias("padding"))
