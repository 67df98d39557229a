"""Language-model scoring (operator 8): a hierarchical Pitman-Yor model with sampled Chinese-restaurant seatings.

Contexts. The next token is predicted from the word before it, and every such word is a restaurant of its own, whatever its
count. Parents are ``classes`` class restaurants (by the last two bytes of the word before, one for the beginning of a
text). All class restaurants share one parent, whose customers are their tables, and its base measure is diffuse: its new
tables are words never seen. A restaurant's tables are customers of its parent throughout. The totals of at most ``words``
restaurants, those of the most frequent words (``Contexts``), are sent to every executor; the others are rows (`rest_of`) which
the tokens after their word meet in a join. Every count covers every training token.

Sampling. A sweep reseats all customers of each (context, word) one after another, given the parent's predictive
probability of the word and the tables of the restaurant from the sweep before; then those of the class restaurants, with
the new tables among them. Sweeps run for all words in parallel;
only totals by context are gathered between sweeps. Random numbers are hashes of (word, context, step, sweep), so a
task that is run again after a lost executor draws the same seating. Customers beyond the first ``exact_steps`` of a
cell are seated in growing groups with a normal draw for the number of new tables. The pull of a new table in a restaurant beyond
``words`` has its tables of the start (one for each of its words) instead of those of the sweep before; the predictive
probabilities have the drawn ones. Probabilities are averages over the
sweeps after ``burn_in``. Discounts come from the counts of counts of each level, strengths are parameters.

Scale. Cells (word, context, count) are summed before the shuffle and dealt out as compressed blocks. The class cells of the most
frequent words and their largest cells, ``frequent`` together, are sent to every executor; other tokens are dealt out
in blocks to where their word's row is or, for frequent words, their cell. Both ways look up the same numbers. Nothing is left out.
A word stands as its 64-bit hash.

Defined cases: a null, empty or white-space text is the end token alone; tokens unknown to the training side share the
probability of a new word; without training documents every token has the probability one of "new" and the base score
follows from N = V = 0; repeated rows and ids are scored each for themselves; an empty table gives an empty one; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import partitions_for, written
from .textbatch import Words, give_back, mix64, segment_sums, slices, texts_of, word_bytes, word_keys

#: Key of the end token.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


@dataclass
class Settings:
    classes: int = 64
    words: int = 1_000_000
    burn_in: int = 2
    samples: int = 2
    strength: float = 1.0
    class_strength: float = 1.0
    root_strength: float = 1.0
    frequent: int = 6_000_000
    exact_steps: int = 48


@dataclass
class Contexts:
    """The restaurants: classes first, then one for each of some words (sorted keys); ``parent`` is the class of each."""

    classes: int
    keys: np.ndarray
    parent: np.ndarray

    def __len__(self) -> int:
        return len(self.parent)

    def __reduce__(self):
        # Broadcasts lie on the disk of every executor: they are sent compressed.
        return _contexts, (self.classes, len(self.keys), _pack(_steps(self.keys)), len(self.parent), _pack(self.parent))

    def of(self, vocab: pa.Array, keys: np.ndarray) -> np.ndarray:
        """The restaurant for the token after each distinct word."""
        out = class_of(vocab, self.classes)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.classes + at, out)
        return out


def _contexts(classes: int, n: int, keys: bytes, m: int, parent: bytes) -> Contexts:
    return Contexts(classes, np.cumsum(_unpack(keys, n, 1)[0]).view(np.uint64), _unpack(parent, m, 1)[0].astype(np.int32))


@dataclass
class Totals:
    """Sums over the whole training side; those that a sweep changes are lists by sweep."""

    tokens: int = 0
    words: int = 0
    discount: float = 0.5
    class_discount: float = 0.5
    customers: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tables: list[np.ndarray] = field(default_factory=list)  # of each word's restaurant
    class_customers: list[np.ndarray] = field(default_factory=list)
    class_tables: list[np.ndarray] = field(default_factory=list)
    root_discounts: list[float] = field(default_factory=list)

    def __getstate__(self) -> dict:
        rows = [_pack(x) for x in (self.customers, *self.tables)]
        return self.__dict__ | {"customers": (len(self.customers), rows), "tables": None}

    def __setstate__(self, state: dict) -> None:
        n, rows = state["customers"]
        customers, *tables = (_unpack(x, n, 1)[0] for x in rows)
        self.__dict__ = state | {"customers": customers, "tables": [x.astype(np.int32) for x in tables]}


def class_of(vocab: pa.Array, classes: int) -> np.ndarray:
    """Class of each distinct word as a context: 1 .. classes - 1, by its last two bytes."""
    if not len(vocab):
        return np.zeros(0, np.int64)
    raw, bounds = word_bytes(vocab)
    last = raw[bounds[1:] - 1].astype(np.uint64)
    before = np.where(np.diff(bounds) > 1, raw[np.maximum(bounds[1:] - 2, 0)], 0).astype(np.uint64)
    return (mix64(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(classes - 1)).astype(np.int64) + 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, compressed by planes of bytes: what is small or sorted takes few bytes."""
    planes = np.empty((len(arrays), 8, len(arrays[0])), np.uint8)
    for plane, a in zip(planes, arrays):
        plane[:] = np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd", compression_level=1).compress(pa.py_buffer(planes), asbytes=True)


def _unpack(blob: bytes, n: int, columns: int) -> np.ndarray:
    """(columns, n) int64."""
    raw = pa.Codec("zstd").decompress(blob, decompressed_size=8 * n * columns, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n)
    return np.array(planes.transpose(0, 2, 1), order="C").view(np.int64).reshape(columns, n)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, the first from 0 (modulo 2^64); ``np.cumsum`` undoes it."""
    x = x.view(np.int64)
    return np.diff(x, prepend=x.dtype.type(0))


#: Rows that are dealt out by bucket: compressed arrays of ``n`` entries, of one kind.
DEALT = "bucket int, kind int, n int, blob binary"


def _dealt(bucket: list, kind: list, n: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "kind", "n", "blob"])


def _by_bucket(bucket: np.ndarray, kind: int, *arrays: np.ndarray, steps: int = 0) -> Iterator[tuple[int, int, int, bytes]]:
    """Deal rows out; array 0 is sorted within a bucket and goes as steps if ``steps``."""
    order = np.argsort(arrays[0]) if steps else np.arange(len(bucket))
    narrow = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket  # sorted by counting
    order = order[np.argsort(narrow[order], kind="stable")]
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(first, np.append(first[1:], len(bucket))):
        columns = [x[order[a:b]] for x in arrays]
        if steps:
            columns[0] = _steps(columns[0])
        yield int(bucket[a]), kind, int(b - a), _pack(*columns)


def token_stream(texts: pa.Array, contexts: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct tokens, sorted; id and context of every token (each text is closed by the end token); offsets."""
    words = Words(texts, lower=True)
    n, v = len(words.counts), len(words.vocab)
    own = word_keys(words.vocab)
    # Ids are in the order of keys, so that what is looked up by id meets sorted tables in their order.
    order = np.argsort(own)
    own = own[order]
    end = int(np.searchsorted(own, END))
    keys = np.insert(own, end, END)
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v) + (np.arange(v) >= end)
    offsets = words.offsets + np.arange(n + 1)
    ids = np.full(int(offsets[-1]), end, np.int64)
    ids[np.arange(len(words.ids)) + words.doc_of()] = rank[words.ids]
    after = np.insert(contexts.of(words.vocab.take(pa.array(order)), own), end, 0)
    context = np.concatenate([[0], after[ids[:-1]]]) if len(ids) else np.zeros(0, np.int64)
    context[offsets[:-1]] = 0
    return keys, ids, context, offsets


def choose_contexts(docs: DataFrame, settings: Settings, text_col: str, flush: int = 500_000) -> Contexts:
    """The words of all training texts whose totals every executor holds: the most frequent, at most ``words``; see `rest_of`."""

    parts = partitions_for(docs.sparkSession, docs.count(), 25_000)

    def summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys, sorted, their class and the sum of their counts."""
        key, of, n = np.concatenate(held, axis=1)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return (key[first], np.minimum.reduceat(of[order], first), np.add.reduceat(n[order], first)) if len(key) else (key, of, n)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, of, n = summed(held)
            held.clear()
            return _dealt(*map(list, zip(*_by_bucket((mix64(key.view(np.uint64)) % np.uint64(8 * parts)).astype(np.int32), 0, key, of, n, steps=1))))

        for part in slices(batches, text_col):
            words = Words(texts_of(part, text_col), lower=True)
            if len(words.vocab):
                held.append(np.array([word_keys(words.vocab).view(np.int64), class_of(words.vocab, settings.classes), np.bincount(words.ids, minlength=len(words.vocab))]))
            if sum(x.shape[1] for x in held) > flush:
                yield out()
        if held:
            yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for bucket, _, n, blob in zip(*(c.to_pylist() for c in b.columns)):
                by_bucket.setdefault(bucket, []).append((n, blob))
        for bucket in sorted(by_bucket):
            held = []
            for n, blob in by_bucket.pop(bucket):
                held.append(_unpack(blob, n, 3))
                held[-1][0] = np.cumsum(held[-1][0])
            key, of, n = summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of.astype(np.int16)), pa.array(n)], names=["key", "class", "n"])

    rows = docs.select(text_col).mapInArrow(counted, DEALT).repartition(parts, "bucket").mapInArrow(merged, "key long, class short, n long")
    rows = written(rows, "lm-words")
    bound = _bound(rows.groupBy(_scale("n").alias("b")).agg(F.count("*").alias("w"), F.min("n").alias("least")), settings.words)
    top = rows.filter(F.col("n") >= bound).select("key", "class").toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    parent = np.concatenate([np.arange(settings.classes), top["class"].to_numpy()[order]]).astype(np.int32)
    return Contexts(settings.classes, keys[order], parent)


def _scale(n):
    """Bin of a count in a histogram with a bounded number of bins."""
    n = F.col(n)
    return F.when(n < 1000, n).otherwise(F.floor(1000 + 200 * F.log(n / 1000.0))).cast("long")


def _bound(bins: DataFrame, most: int) -> int:
    """The least count of entries that weigh at most ``most`` together, from bins (b, w, least)."""
    total, bound = 0, 1 << 62
    for _, w, least in sorted(((r.b, r.w, r.least) for r in bins.collect()), reverse=True):
        total += w
        if total > most:
            break
        bound = least
    return bound


def _merge(keys: list[np.ndarray], contexts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells sorted by key and context, those of one summed."""
    key, context, count = np.concatenate(keys), np.concatenate(contexts), np.concatenate(counts)
    if not len(key):
        return key, context, count
    distinct, at = np.unique(key, return_inverse=True)
    width = int(context.max()) + 1
    code, n = _sums(at * width + context, count)
    return distinct[code // width], (code % width).astype(context.dtype), n


def _sums(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and the sum of their counts."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(count[order], first)


def rest_of(docs: DataFrame, contexts: Contexts, text_col: str, flush: int = 500_000) -> DataFrame:
    """The restaurants of all words beyond ``contexts``: key, class, n, followers (sorted), counts. Written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        contexts = shared.value
        out = lambda: pa.concat_tables(held).group_by(["key", "class", "follower"]).aggregate([("n", "sum")]).rename_columns(["key", "class", "follower", "n"]).combine_chunks().to_batches()
        for part in slices(batches, text_col):
            keys, ids, context, offsets = token_stream(texts_of(part, text_col), contexts)
            at = _after_rest(context, offsets, contexts)
            columns = [pa.array(keys[ids[at - 1]].view(np.int64)), pa.array(context[at].astype(np.int16)), pa.array(keys[ids[at]].view(np.int64)), pa.array(np.ones(len(at), np.int64))]
            held.append(pa.table(columns, names=["key", "class", "follower", "n"]))
            if sum(map(len, held)) > flush:
                yield from out()
                held.clear()
        if held:
            yield from out()

    rows = docs.select(text_col).mapInArrow(counted, "key long, class short, follower long, n long")
    rows = rows.repartition(partitions_for(docs.sparkSession, docs.count(), 25_000), "key").groupBy("key", "class", "follower").agg(F.sum("n").alias("n"))
    rows = rows.groupBy("key", "class").agg(F.sort_array(F.collect_list(F.struct("follower", "n"))).alias("c"))
    out = written(rows.select("key", "class", F.aggregate("c", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("n"), F.col("c.follower").alias("followers"), F.col("c.n").alias("counts")), "lm-rest")
    shared.destroy()
    return out


def _after_rest(context: np.ndarray, offsets: np.ndarray, contexts: Contexts) -> np.ndarray:
    """Places of the tokens after a word beyond ``contexts``."""
    plain = context < contexts.classes
    plain[offsets[:-1]] = False
    return np.flatnonzero(plain)


def count_cells(docs: DataFrame, contexts: Contexts, text_col: str, rest: DataFrame | None = None, flush: int = 1_500_000) -> DataFrame:
    """One row per word: key, n, contexts (ascending), counts. Written to the shared folder.

    With ``rest`` the restaurants of the other words are rows' lists rest_key, rest_class, rest_n, rest_start (their words at the
    start), where they seat the word twice or more; where once, its only table is a customer of the class. Without it the
    tokens after other words sit in the class restaurants themselves.
    """
    spark, m = docs.sparkSession, len(contexts)
    parts = partitions_for(spark, docs.count(), 25_000)
    shared = spark.sparkContext.broadcast(contexts)
    whole = rest is None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys of a slice's words, its cells (word, context), counts

        def out() -> pa.RecordBatch:
            distinct, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum([len(h[0]) for h in held])])
            code = np.concatenate([at[start + cell // m] * m + cell % m for start, (_, cell, _) in zip(starts, held)])
            code, count = _sums(code, np.concatenate([h[2] for h in held]))
            held.clear()
            key = distinct[code // m]
            bucket = (mix64(distinct) % np.uint64(8 * parts)).astype(np.int32)[code // m]
            return _dealt(*map(list, zip(*_by_bucket(bucket, 0, key.view(np.int64), code % m, count, steps=1))))

        for part in slices(batches, text_col):
            keys, ids, context, offsets = token_stream(texts_of(part, text_col), contexts)
            if not whole:
                kept = np.ones(len(ids), bool)
                kept[_after_rest(context, offsets, contexts)] = False
                ids, context = ids[kept], context[kept]
            cell, n = np.unique(ids * m + context, return_counts=True)
            if len(cell):
                held.append((keys, cell, n.astype(np.int64)))
            if sum(len(h[1]) for h in held) > flush:
                yield out()
        if held:
            yield out()

    def from_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _joined(batches, lists=(2,)):
            size = np.diff(b.column(2).offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), size)
            key, at = (b.column(i).to_numpy(zero_copy_only=False)[of] for i in (0, 1))
            word, n = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            bucket = (mix64(word.view(np.uint64)) % np.uint64(8 * parts)).astype(np.int32)
            once, more = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
            rows = [*_by_bucket(bucket[once], 0, word[once], at[once], n[once], steps=1), *_by_bucket(bucket[more], 1, word[more], key[more], at[more], n[more], size[of[more]], steps=1)]
            if rows:
                yield _dealt(*map(list, zip(*rows)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[tuple[int, int, bytes]]] = {}
        for b in batches:
            for bucket, kind, n, blob in zip(*(c.to_pylist() for c in b.columns)):
                by_bucket.setdefault(bucket, []).append((kind, n, blob))
        for bucket in sorted(by_bucket):
            cells, others = [np.zeros((3, 0), np.int64)], [np.zeros((5, 0), np.int64)]
            for kind, n, blob in by_bucket.pop(bucket):
                x = _unpack(blob, n, 5 if kind else 3)
                x[0] = np.cumsum(x[0])
                (others if kind else cells).append(x)
            word, context, n = np.concatenate(cells, axis=1)
            word, context, n = _merge([word.view(np.uint64)], [context], [n])
            more = np.concatenate(others, axis=1)
            more = more[:, np.lexsort((more[1], more[0].view(np.uint64)))]
            key = np.union1d(word, more[0].view(np.uint64))
            at, at_more = np.searchsorted(key, word), np.searchsorted(key, more[0].view(np.uint64))
            ends, ends_more = (pa.array(np.searchsorted(x, np.arange(len(key) + 1)).astype(np.int32)) for x in (at, at_more))
            total = np.bincount(at, n, len(key)) + np.bincount(at_more, more[3], len(key))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (context.astype(np.int32), n)] + [pa.ListArray.from_arrays(ends_more, pa.array(x)) for x in (more[1], more[2].astype(np.int16), more[3], more[4].astype(np.int32))]
            out = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(total.astype(np.int64)), *lists], names=["key", "n", "contexts", "counts", "rest_key", "rest_class", "rest_n", "rest_start"])
            for start in range(0, len(key), 2000):
                yield out.slice(start, 2000)

    dealt = docs.select(text_col).mapInArrow(counted, DEALT)
    if rest is not None:
        dealt = dealt.unionAll(rest.select("key", "class", "followers", "counts").mapInArrow(from_rest, DEALT))
    dealt = dealt.repartition(parts, "bucket")
    cells = written(dealt.mapInArrow(merged, "key long, n long, contexts array<int>, counts array<long>, rest_key array<long>, rest_class array<short>, rest_n array<long>, rest_start array<int>"), "lm-cells")
    shared.destroy()
    return cells


def _uniform(x: np.ndarray, step: int, sweep: int) -> np.ndarray:
    h = x + np.uint64((step * 0x9E3779B97F4A7C15 + sweep * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF)
    # `mix64` in place
    shifted = h >> np.uint64(30)
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        h ^= shifted
        h *= np.uint64(factor)
        np.right_shift(h, np.uint64(shift), out=shifted)
    h ^= shifted
    h >>= np.uint64(11)
    u = h.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def seat(count: np.ndarray, fresh: np.ndarray, discount: float, mark: np.ndarray, sweep: int, exact_steps: int) -> np.ndarray:
    """Tables after all customers of each cell have sat down one after another.

    ``fresh``: (strength + discount * tables of the restaurant) * parent's probability, the pull of a new table.
    """
    tables = np.ones(len(count))
    live = np.flatnonzero(count > 1)
    # By falling count: the cells that have customers left are a prefix.
    live = live[np.argsort(-count[live])]
    rising, pull, mark, t = count[live][::-1], fresh[live], mark[live], np.ones(len(live))
    seated, step = 1, 0
    while n := len(live) - int(np.searchsorted(rising, seated, side="right")):
        step += 1
        size = 1 if seated < exact_steps else max(1, seated // 8)
        u = _uniform(mark[:n], step, sweep)
        if size == 1:
            others = seated - discount * t[:n]
            np.maximum(others, 1e-12, out=others)
            others += pull[:n]
            t[:n] += u < pull[:n] / others
        else:
            left = np.minimum(rising[::-1][:n] - seated, size)
            p = pull[:n] / (pull[:n] + np.maximum(seated + (left - 1) / 2 - discount * t[:n], 1e-12))
            z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(mark[:n], step, sweep + 1_000_003))
            t[:n] += np.clip(np.rint(left * p + z * np.sqrt(left * p * (1 - p))), 0, left)
        seated += size
    tables[live] = t
    return tables


class Seating:
    """Replays the sweeps for a batch of words from the totals of earlier sweeps.

    Cells are the word's restaurants that have it; class cells are the classes that have it, by tokens of their own
    (``direct``) or by tables of their words' restaurants.
    """

    def __init__(self, batch: pa.RecordBatch, totals: Totals, settings: Settings, contexts: Contexts):
        self.totals, self.settings, self.contexts = totals, settings, contexts
        m = contexts.classes
        self.key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        self.n = batch.column(1).to_numpy(zero_copy_only=False)
        flat = lambda i: batch.column(i).flatten().to_numpy(zero_copy_only=False)
        words = lambda i: np.repeat(np.arange(len(self.key)), np.diff(batch.column(i).offsets.to_numpy()))
        context, count, word = flat(2).astype(np.int64), flat(3), words(2)
        self.rest_key, rest_class, rest_n, self.rest_start = (flat(i) for i in (4, 5, 6, 7))
        rest_word = words(4)
        code, at = np.unique(np.concatenate([word * m + contexts.parent[context], rest_word * m + rest_class]), return_inverse=True)
        own, of = np.flatnonzero(context >= m), slice(len(context), None)
        direct = context < m
        #: Cells of ``contexts`` are the first ``held``; those of other words' restaurants follow, with their class as context.
        self.held = len(own)
        self.word, self.context = np.concatenate([word[own], rest_word]), np.concatenate([context[own], rest_class.astype(np.int64)])
        self.count, self.above = np.concatenate([count[own], rest_n]), np.concatenate([at[own], at[of]])
        self.class_word, self.class_of = code // m, code % m
        self.class_offsets = np.searchsorted(self.class_word, np.arange(len(self.key) + 1))
        self.direct = np.bincount(at[: len(context)][direct], count[direct], len(code))
        which = np.concatenate([context[own].astype(np.uint64), mix64(self.rest_key.view(np.uint64))])
        self.mark = mix64(self.key[self.word] + which)
        self.class_mark = mix64(self.key[self.class_word] + self.class_of.astype(np.uint64))

    def customers(self, tables: np.ndarray) -> np.ndarray:
        """Customers of each class cell."""
        return self.direct + np.bincount(self.above, tables, len(self.direct))

    def root(self, class_tables: np.ndarray, sweep: int) -> np.ndarray:
        """The root's probability of each word, from the word's tables and the totals after ``sweep``."""
        customers = segment_sums(class_tables, self.class_offsets)
        return np.maximum(customers - self.totals.root_discounts[sweep], 1e-9) / (self.settings.root_strength + self.totals.class_tables[sweep].sum())

    def in_class(self, tables: np.ndarray, class_tables: np.ndarray, sweep: int) -> np.ndarray:
        """The class's probability of the word, for each class cell."""
        t, s = self.totals, self.settings.class_strength
        all_ = (s + t.class_customers[sweep])[self.class_of]
        own = np.maximum(self.customers(tables) - t.class_discount * class_tables, 0)
        return (own + (s + t.class_discount * t.class_tables[sweep])[self.class_of] * self.root(class_tables, sweep)[self.class_word]) / all_

    def sweeps(self, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(sweep, tables of each cell, of each class cell), from the start (one table each) to ``last``."""
        t, s = self.totals, self.settings
        tables, class_tables = np.ones(len(self.count)), np.ones(len(self.direct))
        yield 0, tables, class_tables
        for sweep in range(1, last + 1):
            pull = s.strength + t.discount * np.concatenate([t.tables[sweep - 1][self.context[: self.held]], self.rest_start])
            class_pull = (s.class_strength + t.class_discount * t.class_tables[sweep - 1])[self.class_of]
            root = self.root(class_tables, sweep - 1)
            new = seat(self.count, pull * self.in_class(tables, class_tables, sweep - 1)[self.above], t.discount, self.mark, sweep, s.exact_steps)
            class_tables = seat(self.customers(new), class_pull * root[self.class_word], t.class_discount, self.class_mark, sweep, s.exact_steps)
            tables = new
            yield sweep, tables, class_tables


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos > 0 else 0.5


def _joined(batches: Iterator[pa.RecordBatch], cells: int = 200_000, lists: tuple[int, ...] = (2, 4)) -> Iterator[pa.RecordBatch]:
    """Batches of words put together until their ``lists`` have ``cells`` entries: each costs steps or blocks, however small."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += sum(len(b.column(i).flatten()) for i in lists)
        if size > cells:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def gather_totals(cells: DataFrame, settings: Settings, contexts: Contexts, ranges: int = 32) -> Totals:
    """Run the sweeps; each gathers 2 x (contexts + classes) + 8 numbers, compressed, summed by ranges of them."""
    spark = cells.sparkSession
    totals, m, k = Totals(), len(contexts), contexts.classes
    size = 2 * (m + k) + 8
    width = -(-size // ranges)
    held = spark.sparkContext.broadcast(contexts)

    def dealt(out: np.ndarray) -> pa.RecordBatch:
        pieces = [(i, out[i * width : (i + 1) * width]) for i in range(ranges)]
        pieces = [(i, x) for i, x in pieces if x.any()]
        return _dealt([i for i, _ in pieces], [0] * len(pieces), [len(x) for _, x in pieces], [_pack(x) for _, x in pieces])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for i, _, n, blob in zip(*(c.to_pylist() for c in b.columns)):
                out[i] = out.get(i, 0) + _unpack(blob, n, 1)[0]
        if out:
            yield _dealt(list(out), [0] * len(out), [len(x) for x in out.values()], [_pack(x) for x in out.values()])

    for sweep in range(settings.burn_in + settings.samples + 1):
        sent = spark.sparkContext.broadcast(totals)

        def summed(batches: Iterator[pa.RecordBatch], sent=sent, sweep: int = sweep) -> Iterator[pa.RecordBatch]:
            out, contexts = np.zeros(size), held.value
            for b in _joined(batches):
                s = Seating(b, sent.value, settings, contexts)
                for _, tables, class_tables in s.sweeps(sweep):
                    pass
                h, customers, root = s.held, s.customers(tables), segment_sums(class_tables, s.class_offsets)
                out[:m] += np.bincount(s.context[:h], tables[:h], m)
                if sweep == 0:
                    out[m : 2 * m] += np.bincount(s.context[:h], s.count[:h], m)
                out[2 * m : 2 * m + k] += np.bincount(s.class_of, customers, k)
                out[2 * m + k : 2 * m + 2 * k] += np.bincount(s.class_of, class_tables, k)
                out[2 * m + 2 * k :] += [len(s.key), s.n.sum(), *((x == i).sum() for x in (s.count[:h], customers, root) for i in (1, 2))]
            yield dealt(out)

        got = np.zeros(size)
        for i, _, n, blob in zip(*(c.to_pylist() for c in cells.mapInArrow(summed, DEALT).repartition(ranges, "bucket").mapInArrow(added, DEALT).toArrow().columns)):
            got[i * width : i * width + n] = _unpack(blob, n, 1)[0]
        sent.destroy()
        give_back()
        words, tokens, *ones = got[2 * (m + k) :]
        if sweep == 0:
            totals.customers = got[m : 2 * m].astype(np.int64)
            totals.words, totals.tokens = int(words), int(tokens)
            totals.discount, totals.class_discount = _discount(*ones[:2]), _discount(*ones[2:4])
        totals.tables.append(got[:m].astype(np.int32))
        totals.class_customers.append(got[2 * m : 2 * m + k])
        totals.class_tables.append(got[2 * m + k : 2 * (m + k)])
        totals.root_discounts.append(_discount(*ones[4:]))
    held.destroy()
    return totals


class Predictive:
    """Averaged predictive probabilities from the totals of the kept sweeps."""

    def __init__(self, totals: Totals, settings: Settings, contexts: Contexts):
        self.totals, self.settings, self.contexts = totals, settings, contexts
        self.kept = list(range(settings.burn_in + 1, settings.burn_in + settings.samples + 1))
        t, s, c, m = totals, settings.strength, settings.class_strength, contexts.classes
        #: Weight that each restaurant gives to its parent, by kept sweep; a token whose context is a class is that class's own.
        self.back = np.array([(s + t.discount * t.tables[k]) / (s + t.customers) for k in self.kept])
        self.back[:, :m] = 1.0
        self.class_back = np.array([(c + t.class_discount * t.class_tables[k]) / (c + t.class_customers[k]) for k in self.kept])
        self.new = np.array([(settings.root_strength + t.root_discounts[k] * t.words) / (settings.root_strength + t.class_tables[k].sum()) for k in self.kept])

    @property
    def unknown(self) -> np.ndarray:
        """Probability of a new word, by context."""
        return self.new_word(np.arange(len(self.contexts)))

    def new_word(self, context: np.ndarray) -> np.ndarray:
        """Probability of a new word in each of some contexts."""
        return (self.back[:, context] * self.class_back[:, self.contexts.parent[context]] * self.new[:, None]).mean(0)

    def __reduce__(self):
        return Predictive, (self.totals, self.settings, self.contexts)

    def words(self, batch: pa.RecordBatch) -> tuple[Seating, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By kept sweep: the root's probabilities of the words, those of class cells, what cells of ``contexts`` add to their class's, tables."""
        s = Seating(batch, self.totals, self.settings, self.contexts)
        root, in_class, own, seated = [], [], [], []
        for sweep, tables, class_tables in s.sweeps(self.kept[-1]):
            if sweep in self.kept:
                root.append(s.root(class_tables, sweep))
                in_class.append(s.in_class(tables, class_tables, sweep))
                own.append(self.own(s.count[: s.held], tables[: s.held], s.context[: s.held]))
                seated.append(tables)
        return s, np.array(root), np.array(in_class), np.array(own), np.array(seated)

    def own(self, count: np.ndarray, tables: np.ndarray, context: np.ndarray) -> np.ndarray:
        """What cells add to their class's probability."""
        return np.maximum(count - self.totals.discount * tables, 0) / (self.settings.strength + self.totals.customers[context])

    def table(self, batch: pa.RecordBatch) -> tuple[Seating, np.ndarray]:
        """(words, contexts) probabilities."""
        s, root, in_class, own, _ = self.words(batch)
        out = np.zeros((len(s.key), len(self.contexts)))
        for k in range(len(self.kept)):
            by_class = root[k][:, None] * self.class_back[k]
            by_class[s.class_word, s.class_of] = in_class[k]
            p = by_class[:, self.contexts.parent] * self.back[k]
            p[s.word[: s.held], s.context[: s.held]] += own[k]
            out += p / len(self.kept)
        return s, out


def _find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``codes``, and whether they are there."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


class Lookup:
    """The rows of some words as sorted arrays: by word, by (word, class) and by (word, context)."""

    def __init__(self, rows: pa.Table, predictive: Predictive):
        contexts = predictive.contexts
        self.classes, self.contexts = contexts.classes, len(contexts)
        self.with_weights(predictive)
        samples = len(predictive.kept)
        rows = rows.take(np.argsort(rows["key"].to_numpy().view(np.uint64))).combine_chunks()
        self.keys, self.n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = lambda c: np.diff(rows[c].combine_chunks().offsets.to_numpy())
        word = np.arange(len(self.keys))
        narrow = lambda width: np.int32 if len(self.keys) * width < 1 << 31 else np.int64
        self.root = flat("root").reshape(-1, samples)
        self.class_codes = (np.repeat(word, sizes("classes")) * self.classes + flat("classes")).astype(narrow(self.classes))
        self.in_class = flat("in_class").reshape(-1, samples)
        self.codes = (np.repeat(word, sizes("contexts")) * self.contexts + flat("contexts")).astype(narrow(self.contexts))
        self.p = flat("p")

    def __getstate__(self) -> dict:
        state = {k: v for k, v in self.__dict__.items() if k not in ("back", "class_back", "parent")}
        return state | {k: (len(state[k]), state[k].dtype, _pack(_steps(state[k].astype(np.int64)))) for k in ("class_codes", "codes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {k: np.cumsum(_unpack(state[k][2], state[k][0], 1)[0]).astype(state[k][1]) for k in ("class_codes", "codes")}

    def with_weights(self, predictive: Predictive) -> Lookup:
        """After it was sent: what it shares with ``predictive``."""
        self.parent, self.back, self.class_back = predictive.contexts.parent, predictive.back, predictive.class_back
        return self

    def probabilities(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Averaged probability of each word (a place in ``keys``) in its context."""
        out = np.zeros(len(word))
        rest, own = np.ones(len(word), bool), np.flatnonzero(context >= self.classes)
        at, there = _find(self.codes, (word[own] * self.contexts + context[own]).astype(self.codes.dtype))
        out[own[there]] = self.p[at[there]]
        rest[own[there]] = False
        rest = np.flatnonzero(rest)
        out[rest] = (self.back[:, context[rest]] * self.parents(word[rest], context[rest])).mean(0)
        return out

    def parents(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """By sample: the probability of each word in the class of its context."""
        above = self.parent[context]
        at, there = _find(self.class_codes, (word * self.classes + above).astype(self.class_codes.dtype))
        out = self.root[word].T * self.class_back[:, above]
        out[:, there] = self.in_class[at[there]].T
        return out


class Sums:
    """Sums by document of what a task's tokens add: one entry for each document, however many pieces its tokens come in."""

    def __init__(self):
        self.ids, self.values, self.size = [], [], 0

    def add(self, row: np.ndarray, *values: np.ndarray) -> None:
        ids, at = np.unique(row, return_inverse=True)
        self.put(ids, np.array([np.bincount(at, x, len(ids)) for x in values]))

    def put(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Distinct documents and, by row, what is added to theirs."""
        self.ids.append(ids)
        self.values.append(values)
        self.size += len(ids)
        # Merged when the pieces have doubled what the first one has.
        if self.size > max(2 * len(self.ids[0]), 300_000):
            self._merge()

    def _merge(self) -> None:
        ids, at = np.unique(np.concatenate(self.ids), return_inverse=True)
        values = np.concatenate(self.values, axis=1)
        self.ids, self.values, self.size = [ids], [np.array([np.bincount(at, x, len(ids)) for x in values])], len(ids)

    def taken(self, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
        """All sums, at most ``rows`` at a time; none are left."""
        if self.size:
            self._merge()
            ids, values = self.ids[0], self.values[0]
            self.__init__()
            for a in range(0, len(ids), rows):
                yield ids[a : a + rows], *values[:, a : a + rows]


#: Kinds of what is dealt out for scoring: words' rows; cells of frequent words; tokens that are rare words, that are frequent
#: ones; tokens after words beyond the contexts, rare and frequent; sums by document.
ROWS, CELLS, RARE, FREQUENT, RARE_AFTER_REST, FREQUENT_AFTER_REST, SUMS = range(7)


def looked_up(b: pa.RecordBatch, predictive: Predictive, least: int = 0) -> pa.RecordBatch:
    """What `Lookup` needs of words' rows, with the cells of ``least`` customers or more."""
    samples = len(predictive.kept)
    s, root, in_class, own, _ = predictive.words(b)
    words = np.arange(len(s.key) + 1)
    h, class_ends = s.held, s.class_offsets
    cell = (own + predictive.back[:, s.context[:h]] * in_class[:, s.above[:h]]).mean(0)
    kept = np.flatnonzero(s.count[:h] >= least)
    ends = np.searchsorted(s.word[kept], words)
    lists = lambda x, e: pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(x))
    per_sample = lambda x, e: lists(x.T.ravel().astype(np.float32), e * samples)
    return pa.RecordBatch.from_arrays(
        [b.column(0), b.column(1), per_sample(root, words), lists(s.class_of.astype(np.int16), class_ends), per_sample(in_class, class_ends), lists(s.context[kept].astype(np.int32), ends), lists(cell[kept].astype(np.float32), ends)],
        names=["key", "n", "root", "classes", "in_class", "contexts", "p"],
    )


LOOKED_UP = "key long, n long, root array<float>, classes array<short>, in_class array<float>, contexts array<int>, p array<float>"


def frequent_rows(cells: DataFrame, predictive: Predictive, settings: Settings) -> tuple[Lookup, int, int]:
    """The lookup of the most frequent words (with their class cells) and of their largest cells, and the least counts of both."""
    held = 1 + F.least(F.size("contexts") + F.size("rest_key"), F.lit(settings.classes))
    bound = _bound(cells.groupBy(_scale("n").alias("b")).agg(F.sum(held).alias("w"), F.min("n").alias("least")), settings.frequent // 2)
    sent = cells.sparkSession.sparkContext.broadcast(predictive)
    m = settings.classes

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, count = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            n, w = np.unique(count[context >= m], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(w)], names=["n", "w"])

    frequent = cells.filter(F.col("n") >= bound)
    bins = frequent.select("contexts", "counts").mapInArrow(sizes, "n long, w long").groupBy(_scale("n").alias("b")).agg(F.sum("w").alias("w"), F.min("n").alias("least"))
    least = _bound(bins, settings.frequent // 2)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield looked_up(b, sent.value, least)

    lookup = Lookup(frequent.mapInArrow(rows, LOOKED_UP).toArrow(), predictive)
    sent.destroy()
    give_back()
    return lookup, bound, least


def rest_model(rest: DataFrame, cells: DataFrame, sent: Broadcast) -> DataFrame:
    """(key, n, followers, counts, seated): the restaurants beyond the contexts, with the tables by kept sweep where a word sits twice or more."""

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s, _, _, _, tables = sent.value[1].words(b)
            mine = tables[:, s.held :].T.astype(np.int32)
            ends = pa.array((np.arange(len(mine) + 1) * tables.shape[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(s.rest_key), pa.array(s.key[s.word[s.held :]].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(mine.ravel()))], names=["key", "follower", "tables"])

    tables = cells.filter(F.size("rest_key") > 0).mapInArrow(seated, "key long, follower long, tables array<int>")
    tables = tables.groupBy("key").agg(F.collect_list(F.struct("follower", "tables")).alias("seated"))
    return rest.select("key", "n", "followers", "counts").join(tables, "key", "left")


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 4000) -> Iterator[None]:
    """Within it, what is written has at most ``rows`` rows of an Arrow batch: a task holds a batch here and in its worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(rows if before <= 0 else min(rows, before)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def score_texts(docs: DataFrame, training: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``."""
    spark, settings = docs.sparkSession, settings or Settings()
    with _small_batches(spark):
        contexts = choose_contexts(training, settings, text_col)
        rest = rest_of(training, contexts, text_col)
        cells = count_cells(training, contexts, text_col, rest)
    totals = gather_totals(cells, settings, contexts)
    predictive = Predictive(totals, settings, contexts)
    samples, m = len(predictive.kept), len(contexts)
    log_all = math.log10(totals.tokens + 0.5 * (totals.words + 1))
    lookup, bound, least = frequent_rows(cells, predictive, settings)
    sent = spark.sparkContext.broadcast((lookup, predictive))
    del lookup
    give_back()
    parts = partitions_for(spark, docs.count(), 25_000)
    buckets = 2 * parts
    of_key = lambda key: (mix64(key) % np.uint64(buckets)).astype(np.int32)
    of_code = lambda code: of_key(code.astype(np.uint64))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, predictive = sent.value[0].with_weights(sent.value[1]), sent.value[1]
        held: list[pa.RecordBatch] = []

        def rows() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            bucket = of_key(t["key"].to_numpy().view(np.uint64))
            out = []
            for i in np.unique(bucket):
                mine = t.take(np.flatnonzero(bucket == i))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, mine.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(mine)
                out.append((int(i), ROWS, len(mine), sink.getvalue().to_pybytes()))
            return _dealt(*map(list, zip(*out)))

        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(1).to_numpy()
            rare, frequent = b.filter(pa.array(n < bound)), b.filter(pa.array(n >= bound))
            if rare.num_rows:
                held.append(rare)
                if sum(x.nbytes for x in held) > 24 << 20:
                    yield rows()
            if frequent.num_rows:
                s, _, _, _, tables = predictive.words(frequent)
                small = np.flatnonzero(s.count[: s.held] < least)
                code = np.searchsorted(known.keys, s.key)[s.word[small]] * m + s.context[small]
                out = list(_by_bucket(of_code(code), CELLS, code, s.count[small], *tables[:, small], steps=1))
                if out:
                    yield _dealt(*map(list, zip(*out)))
        if held:
            yield rows()

    carry = [F.col(c) for c in carried]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    names = ["row_id", id_col, *carried, "n_tokens", "k", "b", "s"]
    of_row = ", ".join(["row_id long", *(f"`{c}` {types[c]}" for c in (id_col, *carried)), "n_tokens long, k long, b double, s double"])

    def scored(batches: Iterator[pa.RecordBatch], block: int = 500_000) -> Iterator[pa.RecordBatch]:
        """Documents' rows with what is known here, and the other tokens, dealt out; bucket and row of a document need not agree."""
        known, predictive = sent.value[0].with_weights(sent.value[1]), sent.value[1]
        contexts = predictive.contexts
        base = np.log10(known.n + 0.5) - log_all
        k = 2 + len(carried)
        held: dict[int, list[list[np.ndarray]]] = {}
        fields: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for kind in sorted(held):
                columns = [np.concatenate(x) for x in zip(*held.pop(kind))]
                bucket = of_code(columns[0]) if kind in (FREQUENT, FREQUENT_AFTER_REST) else of_key(columns[0].view(np.uint64))
                rows = list(_by_bucket(bucket, kind, *columns, steps=1))
                if rows:
                    dealt = _dealt(*map(list, zip(*rows)))
                    yield pa.RecordBatch.from_arrays([*dealt.columns, *(pa.nulls(dealt.num_rows, t) for t in fields)], names=[*dealt.schema.names, *names])

        for part in slices(batches, text_col):
            keys, ids, context, offsets = token_stream(texts_of(part, text_col), contexts)
            row = np.repeat(part.column(0).to_numpy(), np.diff(offsets))
            place, hit = _find(known.keys, keys)
            # Looked up once for each distinct pair of the slice; a class other than 0 stands for a word beyond the contexts.
            cell, at = np.unique(ids * m + context, return_inverse=True)
            word, before = cell // m, cell % m
            listed, there = _find(known.codes, (place[word] * m + before).astype(known.codes.dtype))
            there &= hit[word]
            begin = np.flatnonzero(hit[word] & (before == 0))
            p = np.ones(len(cell))
            p[there] = known.p[listed[there]]
            p[begin] = known.probabilities(place[word[begin]], before[begin])
            there[begin] = True
            here, two = there[at], np.where(there, np.log10(p), 0.0)[at]
            del cell, at, word, before, listed, there, p
            place, hit = place[ids], hit[ids]
            after_rest = (context > 0) & (context < contexts.classes)
            one = np.zeros(len(ids))
            one[hit] = base[place[hit]]
            for kind, which in ((RARE, ~hit & ~after_rest), (RARE_AFTER_REST, ~hit & after_rest), (FREQUENT, hit & ~here & ~after_rest), (FREQUENT_AFTER_REST, hit & after_rest)):
                which = np.flatnonzero(which)
                first = [place[which] * m + context[which]] if kind in (FREQUENT, FREQUENT_AFTER_REST) else [keys[ids[which]].view(np.int64), context[which]]
                previous = [keys[ids[which - 1]].view(np.int64)] if kind in (RARE_AFTER_REST, FREQUENT_AFTER_REST) else []
                held.setdefault(kind, []).append([*first, row[which], *previous])
            del place, here, after_rest, row, first, previous, which
            own = [part.column(i) for i in range(k)]
            sums = [pa.array(np.diff(offsets)), pa.array(segment_sums(hit.astype(np.int64), offsets)), pa.array(segment_sums(one, offsets)), pa.array(segment_sums(two, offsets))]
            fields = [c.type for c in (*own, *sums)]
            bucket = pa.array((np.arange(part.num_rows) % buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([bucket, *(pa.nulls(part.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())), *own, *sums], names=["bucket", "kind", "n", "blob", *names])
            del keys, ids, context, hit, one, two
            if sum(len(x[0]) for kind in held.values() for x in kind) > block:
                yield from out()
        yield from out()

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col), *carry, F.col(text_col)).mapInArrow(scored, f"{DEALT}, {of_row}")

    found_names = [*names, "key", "follower", "q", "bucket", "kind", "n", "blob"]

    def met(batches: Iterator[pa.RecordBatch], piece: int = 250_000) -> Iterator[pa.RecordBatch]:
        """Tokens that were dealt out meet their word's row or their cell; blocks of sums by document, and tokens after words beyond the contexts."""
        known, predictive = sent.value[0].with_weights(sent.value[1]), sent.value[1]
        dealt: dict[int, list[tuple[int, bytes]]] = {}
        types = [pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        fields: list[pa.DataType] = []
        for b in batches:
            fields = [c.type for c in b.columns[4:]]
            documents = b.column(3).is_null()
            for kind, n, blob in zip(*(c.to_pylist() for c in b.filter(pc.invert(documents)).columns[1:4])):
                dealt.setdefault(kind, []).append((n, blob))
            b = b.filter(documents)
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[4:], *(pa.nulls(b.num_rows, t) for t in types[-7:])], names=found_names)

        def columns(kind: int, width: int) -> Iterator[np.ndarray]:
            """The tokens of a kind, about `piece` at a time."""
            held, size = [], 0
            for n, blob in dealt.pop(kind, []):
                x = _unpack(blob, n, width)
                x[0] = np.cumsum(x[0])
                held.append(x)
                size += n
                if size > piece:
                    yield np.concatenate(held, axis=1)
                    held, size = [], 0
            if held:
                yield np.concatenate(held, axis=1)

        summed = Sums()

        def sums(last: bool = False) -> Iterator[pa.RecordBatch]:
            if summed.size > 4 * piece or last:
                for ids, *values in summed.taken(4 * piece):
                    bucket = (mix64(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                    dealt = _dealt(*map(list, zip(*_by_bucket(bucket, SUMS, ids, *(x.view(np.int64) for x in values), steps=1))))
                    rows = out(np.zeros(dealt.num_rows, np.int64)).columns[: -len(DEALT.split(", "))]
                    yield pa.RecordBatch.from_arrays([*rows, *dealt.columns], names=found_names)

        def out(ids, key=None, follower=None, q=None) -> pa.RecordBatch:
            lists = None if q is None else pa.ListArray.from_arrays(pa.array((np.arange(len(ids) + 1) * samples).astype(np.int32)), pa.array(q.T.ravel().astype(np.float32)))
            values = [ids, *(None for _ in fields[1:]), key, follower, lists, *(None for _ in range(4))]
            return pa.RecordBatch.from_arrays([pa.nulls(len(ids), t) if x is None else pa.array(x, t) if isinstance(x, np.ndarray) else x for x, t in zip(values, [*fields, *types[-7:]])], names=found_names)

        tables = [looked_up(b, predictive) for _, blob in dealt.pop(ROWS, []) for b in pa.ipc.open_stream(blob) if b.num_rows]
        mine = Lookup(pa.Table.from_batches(tables), predictive) if tables else None

        def parents(key: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """For rare words: place, whether known, probability by sample in the class of the context."""
            place, hit = _find(mine.keys, key) if mine else (np.zeros(len(key), np.int64), np.zeros(len(key), bool))
            q = predictive.class_back[:, predictive.contexts.parent[context]] * predictive.new[:, None]
            if hit.any():
                q[:, hit] = mine.parents(place[hit], context[hit])
            return place, hit, q

        def bases(place: np.ndarray, hit: np.ndarray) -> np.ndarray:
            n = np.zeros(len(hit))
            if hit.any():
                n[hit] = mine.n[place[hit]]
            return np.log10(n + 0.5) - log_all

        for key, context, row in columns(RARE, 3):
            place, hit = _find(mine.keys, key.view(np.uint64)) if mine else (np.zeros(len(key), np.int64), np.zeros(len(key), bool))
            p = predictive.new_word(context)
            if hit.any():
                p[hit] = mine.probabilities(place[hit], context[hit])
            summed.add(row, hit, bases(place, hit), np.log10(p))
            yield from sums()
        for key, context, row, before in columns(RARE_AFTER_REST, 4):
            place, hit, q = parents(key.view(np.uint64), context)
            summed.add(row, hit, bases(place, hit), np.zeros(len(row)))
            yield from sums()
            yield out(row, key=before, follower=key, q=q)
        cells = [x for x in columns(CELLS, 2 + samples)]
        cells = np.concatenate(cells, axis=1) if cells else np.zeros((2 + samples, 0), np.int64)
        cells = cells[:, np.argsort(cells[0])]
        for code, row in columns(FREQUENT, 2):
            place, context = code // m, code % m
            p = (predictive.back[:, context] * known.parents(place, context)).mean(0)
            at, there = _find(cells[0], code)
            at = at[there]
            p[there] += np.mean([predictive.own(cells[1, at], cells[2 + k, at], context[there]) for k in range(samples)], axis=0)
            summed.add(row, np.zeros(len(row)), np.zeros(len(row)), np.log10(p))
            yield from sums()
        for code, row, before in columns(FREQUENT_AFTER_REST, 3):
            place, context = code // m, code % m
            yield out(row, key=before, follower=known.keys[place].view(np.int64), q=known.parents(place, context))
        yield from sums(last=True)

    words = cells.mapInArrow(model, DEALT).select(*(c.split()[0] for c in DEALT.split(", ")), *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[4:]))
    dealt = rows.unionAll(words).repartition(parts, "bucket")
    with _small_batches(spark):
        found = written(dealt.mapInArrow(met, f"{of_row}, key long, follower long, q array<float>, {DEALT}"), "lm-sums")

    def totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document from the blocks of its sums."""
        summed = Sums()
        for b in batches:
            for n, blob in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x = _unpack(blob, n, 4)
                summed.put(np.cumsum(x[0]), x[1:].view(np.float64))
        for ids, hit, base, score in summed.taken(100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.rint(hit).astype(np.int64)), pa.array(base), pa.array(score)], names=["row_id", "k", "b", "s"])

    # Tokens after words beyond the contexts meet the restaurant of the word before them.
    others = found.filter("q is not null").select("row_id", "key", "follower", "q").join(rest_model(rest, cells, sent), "key", "left")
    at = F.array_position("followers", F.col("follower")).cast("int") - 1
    others = others.withColumn("c", F.when(at >= 0, F.get("counts", at)).otherwise(0))
    others = others.withColumn("tables", F.when(F.col("c") > 1, F.get(F.filter("seated", lambda x: x["follower"] == F.col("follower")), F.lit(0))["tables"]))
    d, strength = totals.discount, settings.strength

    def through(k: int):
        own = F.greatest(F.col("c") - d * F.coalesce(F.get("tables", F.lit(k)), F.least("c", F.lit(1))), F.lit(0.0))
        all_tables = F.size("followers") + F.coalesce(F.aggregate("seated", F.lit(0), lambda t, x: t + F.get(x["tables"], F.lit(k)) - 1), F.lit(0))
        return own + (strength + d * all_tables) * F.get("q", F.lit(k))

    mean = lambda f: sum((f(k) for k in range(samples)), F.lit(0.0)) / samples
    p = F.when(F.col("n").isNull(), mean(lambda k: F.get("q", F.lit(k)))).otherwise(mean(through) / (strength + F.col("n")))
    sums = found.filter("q is null and blob is null").select(*(F.col(f"`{c}`") for c in names))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in sums.schema.fields[1:-1]]
    of_documents = found.filter("blob is not null").select("bucket", "kind", "n", "blob").repartition(parts, "bucket").mapInArrow(totalled, "row_id long, k long, b double, s double")
    sums = sums.unionAll(of_documents.select("row_id", *empty[:-2], "k", "b", "s")).unionAll(others.select("row_id", *empty, F.log10(p).alias("s"))).groupBy("row_id")
    out = sums.agg(*(F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in (id_col, *carried)), *(F.sum(c).alias(c) for c in ("n_tokens", "k", "b", "s")))
    return out.select(id_col, *carried, "n_tokens", F.col("k").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"), F.col("b").alias("base_score"), F.col("s").alias("score"))
