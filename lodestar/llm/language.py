"""Language identification (operator 6): the family first, then one-versus-one linear SVMs within the family.

Features are hashed character n-grams of words with their edges, as shares of a text's n-grams; a linear score of a
text is then the mean of its words' scores, so each distinct word of a batch is scored once and the whole text counts.
All machines are linear support vector machines, trained here with numpy on a bounded sample of labelled rows
(``fit_rows``, of which each language gives at most ``fit_rows`` / number of languages).

Defined cases: a null text or one without a letter is ``und`` with score 0; languages outside the table of families
form a family of their own; without training rows every text is ``und``; a family with one language needs no second
step; repeated rows get equal results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import bare_words, gram_ids
from .textbatch import Words, slices, texts_of

#: Families of languages (fixed values).
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ca", "ro", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "mt"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
GRAMS = (1, 2, 3, 4)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rate: float = 0.5, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights (the last is the offset) of a linear SVM: hinge loss and an L2 penalty, by averaged stochastic gradients.

    Each step takes as many rows of either class, so both weigh the same whatever their number of rows.
    """
    rng = np.random.default_rng(seed)
    sides = [np.flatnonzero(y > 0), np.flatnonzero(y <= 0)]
    w, mean, kept = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    per_epoch = max(1, max(map(len, sides)) // 32)
    for t in range(epochs * per_epoch):
        rows = np.concatenate([s[rng.integers(len(s), size=32)] for s in sides])
        sign = np.where(y[rows] > 0, 1.0, -1.0)
        part = x[rows]
        push = np.where(sign * (part @ w[:-1] + w[-1]) < 1, sign, 0.0) / len(rows)
        step = rate / (1 + t / 2000)
        w[:-1] += step * (push @ part - penalty * w[:-1])
        w[-1] += step * 0.01 * push.sum()
        if t >= per_epoch:
            mean += w
            kept += 1
    return mean / max(kept, 1)


class LanguageTree:
    """The machines of both steps: columns of one weight matrix (buckets x machines) and their offsets."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, buckets: int):
        self.buckets = buckets
        self.languages = sorted(set(langs.tolist()))
        family = np.array([FAMILY_OF.get(code, "other") for code in langs])
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(langs[family == f].tolist())) for f in self.families}
        self.scale = 1 / np.maximum(x.std(0), 1e-4)
        x = np.clip((x) * self.scale, 0, 8)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        self.machines: list[tuple[str, str, str]] = [("family", a, b) for a, b in itertools.combinations(self.families, 2)]
        self.machines += [(f, a, b) for f in self.families for a, b in itertools.combinations(self.members[f], 2)]
        columns = []
        for step, a, b in self.machines:
            of = family if step == "family" else langs
            rows = np.flatnonzero((of == a) | (of == b))
            columns.append(linear_svm(x[rows], np.where(of[rows] == a, 1, -1)))
        self.weights = np.array(columns).T if columns else np.zeros((buckets + 1, 0))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of rows of n-gram shares."""
        x = np.clip(x * self.scale, 0, 8)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        margins = x @ self.weights[:-1] + self.weights[-1]
        n = len(x)
        chance = 1 / (1 + np.exp(-np.clip(3 * margins, -30, 30)))
        family, certain = self._vote("family", self.families, chance, n)
        out, score = np.empty(n, object), np.zeros(n)
        for i, f in enumerate(self.families):
            rows = family == i
            pick, sure = self._vote(f, self.members[f], chance[rows], int(rows.sum()))
            out[rows] = np.array(self.members[f], object)[pick]
            score[rows] = certain[rows] * sure
        return out, score

    def _vote(self, step: str, names: list[str], chance: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The class that wins the most duels (sums of chances decide ties), and its weakest duel's chance."""
        if len(names) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        total, least = np.zeros((n, len(names))), np.ones((n, len(names)))
        for k, (s, a, b) in enumerate(self.machines):
            if s != step:
                continue
            p = chance[:, k]
            for name, q in ((a, p), (b, 1 - p)):
                i = names.index(name)
                total[:, i] += (q > 0.5) + q / (2 * len(names))
                least[:, i] = np.minimum(least[:, i], q)
        best = total.argmax(1)
        return best, least[np.arange(n), best]


def gram_shares(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x buckets) shares of n-grams, and whether each text has a letter."""
    words = Words(texts)
    bare = bare_words(words.vocab)
    word, bucket = gram_ids(bare, GRAMS, buckets)
    n_docs, n_words = len(words.counts), len(words.vocab)
    lettered = pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0 if n_words else np.zeros(0, bool)
    has = words.sums(lettered.astype(np.int64)) > 0 if n_words else np.zeros(n_docs, bool)
    x = np.zeros((n_docs, buckets), np.float32)
    if not len(word):
        return x, has
    # word -> grams as runs; every token adds its word's grams to its text: counts of (text, word) pairs first.
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    start = np.searchsorted(word, np.arange(n_words + 1))
    pair, times = np.unique(words.doc_of() * n_words + words.ids, return_counts=True)
    doc, w = pair // n_words, pair % n_words
    grams = start[w + 1] - start[w]
    step = 1 << 21
    ends = np.cumsum(grams)
    at = 0
    flat = x.reshape(-1)
    while at < len(pair):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        g = grams[at:to]
        e = np.cumsum(g)
        take = np.repeat(start[w[at:to]] - (e - g), g) + np.arange(int(e[-1]))
        lo = int(doc[at])
        cell = np.repeat(doc[at:to] - lo, g) * buckets + bucket[take]
        hi = int(doc[to - 1]) + 1
        flat[lo * buckets : hi * buckets] += np.bincount(cell, np.repeat(times[at:to], g), (hi - lo) * buckets)
        at = to
    return x / np.maximum(x.sum(1, keepdims=True), 1), has


def fit_language_tree(docs: DataFrame, fit_rows: int, buckets: int, lang_col: str, text_col: str, id_col: str) -> LanguageTree | None:
    """Train on a bounded sample: rows are taken by a hash of the id, each language at its own rate."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    each = max(1, fit_rows // len(sizes))
    rates = F.create_map(*[F.lit(v) for code, n in sizes.items() for v in (code, int(min(1.0, each / n) * 1_000_000))])
    taken = known.filter(F.pmod(F.xxhash64(F.lit("lang"), F.col(id_col)), F.lit(1_000_000)) < rates[F.col(lang_col)])
    # One row for each id: rows that repeat an id many times must not enlarge the sample.
    taken = taken.select(id_col, lang_col, text_col).dropDuplicates([id_col])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 1 << 20):
            x, has = gram_shares(texts_of(part, text_col), buckets)
            rows = [r.astype(np.float16).tobytes() for r in x[has]]
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(has)), pa.array(rows, pa.binary())], names=["lang", "x"])

    rows = taken.select(F.col(lang_col).alias("lang"), F.col(text_col)).mapInArrow(shares, "lang string, x binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "x"])
    x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(len(rows), buckets).astype(np.float32)
    return LanguageTree(x, rows["lang"].to_numpy(str), buckets)


def identify(docs: DataFrame, training: DataFrame, fit_rows: int = 6000, buckets: int = 2048, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each document; a narrow step with a model of fixed size.

    ``training`` has id, text and language; ``fit_rows`` bounds how many of its rows are learned from.
    """
    tree = fit_language_tree(training, fit_rows, buckets, lang_col, text_col, id_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 2 << 20):
            texts = texts_of(part, text_col)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if tree is not None:
                x, has = gram_shares(texts, buckets)
                if has.any():
                    lang[has], score[has] = tree.decide(x[has])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(predict, f"`{id_col}` {id_type}, lang_pred string, score double")


def known_language(docs: DataFrame, training: DataFrame, fit_rows: int = 6000, buckets: int = 2048, least_score: float = 0.2, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with at least ``least_score``; a narrow step.

    Without any training row, the rows whose text has a letter.
    """
    tree = fit_language_tree(training, fit_rows, buckets, lang_col, text_col, id_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 2 << 20):
            x, sure = gram_shares(texts_of(part, text_col), buckets)
            if tree is not None and sure.any():
                sure[sure] = tree.decide(x[sure])[1] >= least_score
            yield part.filter(pa.array(sure))

    return docs.mapInArrow(keep, docs.schema)
