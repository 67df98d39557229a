"""Benchmark decontamination (operator 7): rare n-gram seeds, then Smith-Waterman alignment.

Words are compared without marks and in lower case. Each position of a benchmark item starts a seed: the shortest run
of words (2 to ``longest_seed``) that a document of mean length would hold by chance with at most ``chance``, judged by
the words' counts over all documents (counts of the words, not of the run, so that a passage which leaked often is
still rare). Documents are scanned for seeds in one narrow pass; around each hit the item is aligned with the words of
the document, and pairs whose score reaches ``least`` of the score of a full copy are given out.

An item without a rare run that is rare as a whole has its rarest run as seed, one of a single rare word that word.

How it scales: both passes over the documents are narrow; seeds are joined by a sorted table that every executor holds,
about 40 bytes a word of the benchmark. Items are handled in blocks of at most ``block_words`` words, so that table has a
fixed bound however large the benchmark is; a benchmark beyond it takes more passes. Nothing depends on how many
documents share a passage.

Defined cases: null or empty texts and items match nothing; an item that is not rare as a whole (a common word or two)
has no seed and is never found, as finding it would be no evidence; repeated rows and items are reported each for
themselves; empty tables give an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Words, mix64, slices, texts_of

MATCH, MISMATCH, GAP = 2, -1, -1


def plain_words(vocab: pa.Array) -> pa.Array:
    """Words in lower case without anything but letters and digits (may be empty)."""
    return pc.utf8_lower(pc.replace_substring_regex(vocab, r"[^\pL\pM\pN]+", ""))


class BenchmarkWords:
    """A bounded block of items: vocabulary (ids from 1 on) and each item as word ids."""

    def __init__(self, item_ids: pa.Array, texts: pa.Array):
        words = Words(texts)
        plain = plain_words(words.vocab)
        coded = plain.dictionary_encode()
        self.vocab = coded.dictionary
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1 if len(plain) else np.zeros(0, np.int64)
        empty = pc.binary_length(plain).to_numpy(zero_copy_only=False) == 0 if len(plain) else np.zeros(0, bool)
        ids[empty] = 0
        flat = ids[words.ids]
        self.item_ids = item_ids
        self.items = [w[w > 0] for w in np.split(flat, words.offsets[1:-1])] if len(item_ids) else []

    def document_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of documents (0: not of the benchmark; words without a letter or digit are left out), and offsets."""
        words = Words(texts)
        if not len(words.ids):
            return np.zeros(0, np.int64), words.offsets
        plain = plain_words(words.vocab)
        ids = pc.fill_null(pc.index_in(plain, value_set=self.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ids[pc.binary_length(plain).to_numpy(zero_copy_only=False) == 0] = -1
        flat = ids[words.ids]
        keep = flat >= 0
        return flat[keep], np.concatenate([[0], np.cumsum(keep)])[words.offsets]


def word_counts(docs: DataFrame, bench: BenchmarkWords, text_col: str) -> tuple[np.ndarray, int, int]:
    """Count of each benchmark word over all documents, of all words, and of documents."""
    size = len(bench.vocab) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_seen = np.zeros(size + 1, np.int64), 0
        for part in slices(batches, text_col):
            ids, _ = bench.document_words(texts_of(part, text_col))
            total[:size] += np.bincount(ids, minlength=size)
            docs_seen += part.num_rows
        total[size] = docs_seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size + 1, np.int64)
    for r in rows:
        total[r.word] = r.n
    return total[:size], int(total[:size].sum()), int(total[size])


def _codes(ids: np.ndarray, n: int) -> np.ndarray:
    code = np.full(max(0, len(ids) - n + 1), n, np.uint64)
    for k in range(n):
        code = mix64(code * np.uint64(0x100000001B3) + ids[k : k + len(code)].astype(np.uint64))
    return code


class Seeds:
    """For each seed length the sorted codes, a bit table that rules most positions out, and the (item, position) of each code."""

    TABLE = 1 << 20

    def __init__(self, bench: BenchmarkWords, counts: np.ndarray, words: int, docs: int, chance: float, longest: int):
        size = np.fromiter(map(len, bench.items), np.int64, len(bench.items))
        flat = np.concatenate([np.zeros(0, np.int64), *bench.items])
        first = np.cumsum(size) - size
        item = np.repeat(np.arange(len(size)), size)
        rest = (first + size)[item] - np.arange(len(flat))  # words from a position to the end of its item
        cum = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(counts, 0.5) / max(words, 1))[flat])])
        limit = np.log(chance) - np.log(max(1.0, words / max(docs, 1)))
        length = np.zeros(len(flat), np.int64)
        for n in range(longest, 1, -1):  # the shortest rare run stays
            at = np.flatnonzero(rest >= n)
            length[at[cum[at + n] - cum[at] <= limit]] = n
        seeded = np.zeros(len(size), bool)
        seeded[item[length > 0]] = True
        for i in np.flatnonzero(~seeded & (size > 0)).tolist():
            lo, hi = int(first[i]), int(first[i] + size[i])
            if cum[hi] - cum[lo] <= limit:
                n = min(longest, hi - lo)
                starts = np.arange(lo, hi - n + 1)
                length[starts[np.argmin(cum[starts + n] - cum[starts])]] = n
        self.by_length = []
        for n in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero(length == n)
            own = _codes(flat, n)[at]
            order = np.argsort(own, kind="stable")
            codes, start = np.unique(own[order], return_index=True)
            bits = np.zeros(self.TABLE, bool)
            bits[(codes & np.uint64(self.TABLE - 1)).astype(np.int64)] = True
            at = at[order]
            self.by_length.append((n, codes, bits, np.append(start, len(at)), item[at], at - first[item[at]]))

    def hits(self, ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, position in the item) of every seed in the documents' words."""
        for want, codes, bits, start, item, place in self.by_length:
            if len(ids) < want:
                continue
            at = np.flatnonzero(_runs(ids > 0, want))
            at = at[doc[at] == doc[at + want - 1]]
            own = np.full(len(at), want, np.uint64)
            for k in range(want):
                own = mix64(own * np.uint64(0x100000001B3) + ids[at + k].astype(np.uint64))
            maybe = bits[(own & np.uint64(self.TABLE - 1)).astype(np.int64)]
            at, own = at[maybe], own[maybe]
            found = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            real = codes[found] == own
            for p, c in zip(at[real].tolist(), found[real].tolist()):
                for k in range(start[c], start[c + 1]):
                    yield p, int(item[k]), int(place[k])


def _runs(ok: np.ndarray, n: int) -> np.ndarray:
    """Positions from which n in a row are ok."""
    out = ok[: len(ok) - n + 1].copy()
    for k in range(1, n):
        out &= ok[k : len(ok) - n + 1 + k]
    return out


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): score, and the words of the document [from, to)."""
    score, end = _best_end(item, words)
    if score <= 0:
        return 0, 0, 0
    _, back = _best_end(item[::-1], words[:end][::-1], score)
    return score, end - back, end


def _best_end(item: np.ndarray, words: np.ndarray, want: int | None = None) -> tuple[int, int]:
    """Largest score and where it ends first; each row of the table is one vector step (gaps by a running maximum)."""
    column = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    best, at = 0, 0
    for w in item.tolist():
        diagonal = row[:-1] + np.where(words == w, MATCH, MISMATCH)
        fresh = np.maximum(row + GAP, 0)
        np.maximum(fresh[1:], diagonal, out=fresh[1:])
        row = np.maximum.accumulate(fresh - GAP * column) + GAP * column
        top = int(row.max())
        if top > best:
            best, at = top, int(row.argmax())
            if want is not None and best >= want:
                break
    return best, at


class Matcher:
    """Finds the contaminated documents of a batch for one block of the benchmark."""

    def __init__(self, bench: BenchmarkWords, seeds: Seeds, least: float):
        self.bench, self.seeds, self.least = bench, seeds, least

    def find(self, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, word after the last) for each pair that reaches the bound; best alignment."""
        ids, offsets = self.bench.document_words(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        windows: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for p, item, j in self.seeds.hits(ids, doc):
            m = len(self.bench.items[item])
            d = int(doc[p])
            slack = m // 2 + 2
            windows[d, item].append((max(int(offsets[d]), p - j - slack), min(int(offsets[d + 1]), p - j + m + slack)))
        out, seen = [], {}
        for (d, item), spans in sorted(windows.items()):
            words = self.bench.items[item]
            full, best = MATCH * len(words), (0, 0, 0)
            for a, b in _merged(spans, 4 * len(words) + 64):
                key = item, ids[a:b].tobytes()
                if key not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    seen[key] = align(words, ids[a:b])
                score, lo, hi = seen[key]
                if score > best[0]:
                    best = score, a + lo - int(offsets[d]), a + hi - int(offsets[d])
                    if score >= full:
                        break
            if best[0] >= self.least * full:
                out.append((d, item, best[0] / full, best[1], best[2]))
        return out


def _merged(spans: list[tuple[int, int]], longest: int) -> list[tuple[int, int]]:
    """Overlapping windows as one, as long as that is no longer than ``longest``; windows within another go."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and b <= out[-1][1]:
            continue
        if out and a <= out[-1][1] and b - out[-1][0] <= longest:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def matchers(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, chance: float = 1e-5, longest_seed: int = 8, block_words: int = 10_000_000, item_col: str = "item_id", bench_col: str = "text", text_col: str = "text") -> list[Matcher]:
    """One matcher for each block of benchmark items (usually one)."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(bench_col), F.lit("")).alias("words"))
    total = items.agg(F.coalesce(F.sum(F.size(F.split("words", r"\s+"))), F.lit(0))).head()[0]
    blocks = max(1, -(-total // block_words))
    out = []
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).toArrow()
        block = block.sort_by([("item", "ascending"), ("words", "ascending")]).combine_chunks()
        bench = BenchmarkWords(*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in block.columns))
        if not bench.items:
            continue
        counts, words, n_docs = word_counts(docs, bench, text_col)
        out.append(Matcher(bench, Seeds(bench, counts, words, n_docs, chance, longest_seed), least))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """(doc id, item id, score, first_word, last_word): pairs whose alignment scores at least ``least`` of a full copy.

    Words are numbered within the document, without those that have neither letter nor digit.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, score double, first_word long, last_word long"
    out = None
    for matcher in matchers(docs, benchmark, item_col=item_col, text_col=text_col, **options):

        def found(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                rows = matcher.find(texts_of(part, text_col))
                if rows:
                    d, item, score, a, b = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), matcher.bench.item_ids.take(pa.array(item)), pa.array(score), pa.array(a, pa.int64()), pa.array([x - 1 for x in b], pa.int64())], names=[id_col, item_col, "score", "first_word", "last_word"])

        part = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text reaches the bound for no item; a narrow step."""
    blocks = matchers(docs, benchmark, text_col=text_col, **options)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = texts_of(part, text_col)
            keep = np.ones(part.num_rows, bool)
            for matcher in blocks:
                keep[[r[0] for r in matcher.find(texts)]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema) if blocks else docs
