"""Toxicity (operator 1): non-negative positive-unlabelled learning of a linear classifier.

Confirmed toxic texts are the positives; the unlabelled texts are drawn from the whole training side, whatever their
labels (positives too: the risk estimator wants the marginal distribution there). The risk is that of Kiryo et al. (2017): with prior p, p R+(1) + max(0, R_u(0) - p R+(0)); where the
corrected negative risk falls below zero, a step is taken that raises it again, so the model does not learn the
unlabelled texts by heart. Features say whether a text has a hashed word, or words with a hashed beginning, once,
twice or more, or four times or more. The few with the largest evidence are kept.

Training reads a bounded sample (``positive_rows`` and ``unlabelled_rows``); the class prior comes from all labels
of the training side. Scoring is one narrow pass over whole texts with a weight table of fixed size.

Defined cases: a null or empty text has the score of a text without any feature; ids with several label rows count as
toxic if one row says so; without confirmed positives every score is 0; repeated rows get equal results; an empty table
gives an empty one; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import bare_words
from .textbatch import Words, mix64, slices, texts_of, word_bytes, word_hashes

#: Lengths in bytes of the beginnings of words that are features, beside whole words.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A feature counts once for each of these numbers of occurrences that a text reaches.
LEVELS = (1, 2, 4)


def word_features(words: pa.Array, buckets: int) -> np.ndarray:
    """(words x (1 + prefixes)) buckets: the whole word, then its beginnings (-1 where the word is no longer)."""
    raw, bounds = word_bytes(words)
    n, size = len(words), np.diff(bounds)
    out = np.full((n, 1 + len(PREFIXES)), -1, np.int64)
    state = np.full(n, 0x51ED270B, np.uint64)
    live = np.arange(n)
    for i in range(max(PREFIXES)):
        live = live[size[live] > i]
        state[live] = mix64(state[live] * np.uint64(0x100000001B3) + raw[bounds[live] + i].astype(np.uint64) + np.uint64(1))
        if i + 1 in PREFIXES:
            more = live[size[live] > i + 1]
            out[more, 1 + PREFIXES.index(i + 1)] = (mix64(state[more] ^ np.uint64(0xA5A5)) % np.uint64(buckets)).astype(np.int64)
    some = size > 0
    out[some, 0] = (word_hashes(words, 0x51ED)[some] % np.uint64(buckets)).astype(np.int64)
    return out


def document_features(texts: pa.Array, buckets: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a batch, ordered; feature = bucket * levels + level.

    ``keep`` marks the features that are wanted; words without any are passed over.
    """
    words = Words(texts)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words.ids):
        return none
    features = word_features(bare_words(words.vocab), buckets)
    if keep is not None:
        wanted = keep.reshape(buckets, len(LEVELS)).any(1)
        features[(features >= 0) & ~wanted[np.maximum(features, 0)]] = -1
    at = np.flatnonzero((features >= 0).any(1)[words.ids])
    pair, times = np.unique(words.doc_of()[at] * len(words.vocab) + words.ids[at], return_counts=True)
    doc, word = pair // len(words.vocab), pair % len(words.vocab)
    cells, counts = [], []
    for k in range(features.shape[1]):
        ok = features[word, k] >= 0
        cells.append(doc[ok] * buckets + features[word[ok], k])
        counts.append(times[ok])
    cell, where = np.unique(np.concatenate(cells), return_inverse=True)
    if not len(cell):
        return none
    count = np.bincount(where, np.concatenate(counts))
    doc, base = cell // buckets, (cell % buckets) * len(LEVELS)
    out = [(doc[count >= n], base[count >= n] + i) for i, n in enumerate(LEVELS)]
    doc, feature = np.concatenate([d for d, _ in out]), np.concatenate([f for _, f in out])
    if keep is not None:
        doc, feature = doc[keep[feature]], feature[keep[feature]]
    order = np.lexsort([feature, doc])
    return doc[order], feature[order]


class NonNegativePU:
    """A linear model on binary features with the non-negative risk estimator (sigmoid loss)."""

    def __init__(self, prior: float, features: int, rate: float = 0.02, decay: float = 1e-3, seed: int = 5):
        self.prior, self.rate, self.decay = prior, rate, decay
        self.w = np.zeros(features + 1)
        self.moments = np.zeros(features + 1), np.zeros(features + 1)
        self.rng = np.random.default_rng(seed)
        self.steps = 0

    @staticmethod
    def _rows(doc: np.ndarray, feature: np.ndarray, start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of some documents, numbered anew."""
        n = start[rows + 1] - start[rows]
        ends = np.cumsum(n)
        take = np.repeat(start[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.repeat(np.arange(len(rows)), n), feature[take]

    def margins(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.w[feature], n) + self.w[-1]

    def _gradient(self, doc: np.ndarray, feature: np.ndarray, n: int, side: float) -> tuple[float, np.ndarray]:
        """Mean of the sigmoid loss l(side * margin) = 1 / (1 + exp(side * margin)), and its gradient."""
        z = self.margins(doc, feature, n)
        loss = 1 / (1 + np.exp(np.clip(side * z, -30, 30)))
        slope = -side * loss * (1 - loss) / max(n, 1)
        g = np.zeros_like(self.w)
        g[:-1] = np.bincount(feature, slope[doc], len(self.w) - 1)
        g[-1] = slope.sum()
        return float(loss.mean()), g

    def fit(self, positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], epochs: int = 40, batch: int = 512) -> NonNegativePU:
        sides = []
        for doc, feature, n in (positive, unlabelled):
            sides.append((doc, feature, np.searchsorted(doc, np.arange(n + 1)), n))
        rounds = max(1, max(s[3] for s in sides) // batch)
        for _ in range(epochs * rounds):
            parts = []
            for doc, feature, start, n in sides:
                rows = self.rng.integers(n, size=min(batch, n))
                parts.append((*self._rows(doc, feature, start, rows), len(rows)))
            (rp1, gp1), (rp0, gp0), (ru0, gu0) = self._gradient(*parts[0], 1.0), self._gradient(*parts[0], -1.0), self._gradient(*parts[1], -1.0)
            negative = ru0 - self.prior * rp0
            g = self.prior * gp1 + gu0 - self.prior * gp0 if negative >= 0 else self.prior * gp0 - gu0
            self._step(g)
        return self

    def _step(self, g: np.ndarray) -> None:
        """Adam with decoupled weight decay."""
        self.steps += 1
        m, v = self.moments
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = m / (1 - 0.9**self.steps) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        self.w -= self.rate * move
        self.w[:-1] *= 1 - self.decay


def evidence(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """How much more often a feature is in positives than expected, as a signed root of the G statistic."""
    total, n = positive + unlabelled, n_positive + n_unlabelled
    expect = total * n_positive / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (positive * np.log(positive / expect) + unlabelled * np.log(unlabelled / (total - expect)))
    only = np.where(positive > 0, 2 * positive * np.log(np.maximum(positive, 1) / np.maximum(expect, 1e-12)), 0.0)
    g = np.where(unlabelled == 0, only, np.where(positive == 0, 0.0, g))
    return np.where(positive > expect, np.sqrt(np.maximum(g, 0)), 0.0)


class ToxicityModel:
    """A weight for each feature (zero: not kept) and an offset."""

    def __init__(self, buckets: int, weights: np.ndarray, offset: float):
        self.buckets, self.weights, self.offset = buckets, weights, offset
        self.keep = weights != 0

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, feature = document_features(texts, self.buckets, self.keep)
        z = np.bincount(doc, self.weights[feature], len(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sampled(ids: DataFrame, n: int, bound: int, id_col: str) -> DataFrame:
    return ids.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) < int(min(1.0, bound / max(n, 1)) * 1_000_000))


def fit_toxicity(docs: DataFrame, labels: DataFrame, positive_rows: int = 6000, unlabelled_rows: int = 12_000, features: int = 3000, buckets: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Train on a bounded sample of the rows of ``docs``; ``labels`` must hold rows of the training side only."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    sizes = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).head()
    width = buckets * len(LEVELS)
    nothing = ToxicityModel(buckets, np.zeros(width), -30.0)
    if not sizes.k:
        return nothing
    toxic = marks.filter("toxic = 1")
    # Both samples are bounded by parameters, so their ids can be sent to every executor.
    chosen = _sampled(toxic, sizes.k, positive_rows, id_col).select(F.col(id_col), F.lit(1).alias("toxic"))
    others = _sampled(docs.select(id_col), docs.count(), unlabelled_rows, id_col).select(F.col(id_col)).distinct().withColumn("toxic", F.lit(0))
    chosen = others.unionByName(chosen)
    if chosen.count() <= 2 * (positive_rows + unlabelled_rows):  # sure but for the chance of the sample
        chosen = F.broadcast(chosen)
    # One row for each id and side: rows that repeat an id many times must not enlarge the sample.
    rows = docs.select(F.col(id_col), F.col(text_col)).join(chosen, id_col).dropDuplicates([id_col, "toxic"]).select("toxic", text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((2, width), np.int64), np.zeros(2, np.int64)
        for part in slices(batches, text_col):
            side = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, feature = document_features(texts_of(part, text_col), buckets)
            total += np.bincount(side[doc] * width + feature, minlength=2 * width).reshape(2, width)
            seen += np.bincount(side, minlength=2)
        flat = np.concatenate([total.ravel(), seen])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["at", "n"])

    # As many numbers as there are features, whatever the number of rows.
    got = rows.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(2 * width + 2, np.int64)
    flat[got["at"].to_numpy()] = got["n"].to_numpy()
    n_side = flat[2 * width :]
    if not n_side.all():
        return nothing
    rank = evidence(flat[width : 2 * width], flat[:width], int(n_side[1]), int(n_side[0]))
    kept = np.argsort(-rank, kind="stable")[:features]
    kept = kept[rank[kept] > 4.5]
    place = np.full(width, -1)
    place[kept] = np.arange(len(kept))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            doc, feature = document_features(texts_of(part, text_col), buckets, place >= 0)
            start = np.searchsorted(doc, np.arange(part.num_rows + 1))
            cells = [np.sort(place[feature[a:b]]).astype(np.int32).tobytes() for a, b in zip(start, start[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.binary())], names=["toxic", "cells"])

    # At most positive_rows + unlabelled_rows rows of kept features.
    got = rows.mapInArrow(featured, "toxic int, cells binary").toArrow()
    sides: dict[int, list[np.ndarray]] = {1: [], 0: []}
    for side, cells in sorted(zip(got["toxic"].to_pylist(), got["cells"].to_pylist())):
        sides[side].append(np.frombuffer(cells, np.int32))

    def matrix(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64), len(lists)

    # The class prior: the share of toxic ones among all labelled ids.
    model = NonNegativePU(min(0.99, max(1e-3, sizes.k / sizes.n)), len(kept)).fit(matrix(sides[1]), matrix(sides[0]))
    weights = np.zeros(width)
    weights[kept] = model.w[:-1]
    return ToxicityModel(buckets, weights, float(model.w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each document; a narrow step."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            score = model.score(texts_of(part, text_col))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scored, f"`{id_col}` {id_type}, score double, predicted int")
