"""Quality rules (operator 5): an isolation forest on rule statistics, with a threshold from labelled rows.

Rule statistics are computed for every whole text in one narrow pass. Each counts only by how far it lies beyond the
value that all but ``beyond`` of the good labelled rows stay below, so that what is usual among good texts does not
look unusual to the forest. An isolation forest is grown on a bounded sample (``fit_rows``) of labelled rows that pass
the base rules; random splits isolate unusual documents after few cuts, so a short mean path marks an anomaly. The
threshold on it comes from all such labelled rows: their scores are counted by label in a histogram, and it is the
score that parts good from bad best among those that keep at least ``keep_good`` of the good rows.

Defined cases: a null, empty or white-space text has no words (all statistics 0, base_failed, not kept); repeated
rows get equal results; without usable labels the forest is not grown and only the base rules decide; an empty
table gives an empty one; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textbatch import Words, segment_sums, slices, texts_of

#: The characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Rule statistics that the forest sees, each a share that does not depend on a text's length.
FEATURES = ["symbol_share", "upper_share", "bang_share", "dup_line_share", "repeat_share", "digit_share", "mean_word"]


def _class_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Characters of some kinds in each text, from prefix sums over the bytes of the batch."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    table = np.zeros(256, np.uint8)
    kinds = {"space": b" \t\n\v\f\r", "symbol": SYMBOLS.encode(), "bang": b"!", "digit": b"0123456789", "upper": bytes(range(65, 91))}
    for i, chars in enumerate(kinds.values()):
        table[list(chars)] |= 1 << i
    table[0x80:0xC0] |= 1 << 7  # continuation bytes
    marks = table[raw]
    out = {k: segment_sums(marks >> i & 1, bounds) for i, k in enumerate(kinds)}
    out["chars"] = np.diff(bounds) - segment_sums(marks >> 7 & 1, bounds)
    return out


def window_codes(ids: np.ndarray, size: int, bits: int = 21) -> np.ndarray:
    """One number for each run of three ids (each below ``size``), equal for equal runs only."""
    if size <= 1 << bits:
        return (ids[:-2] << 2 * bits) | (ids[1:-1] << bits) | ids[2:]
    # Pairs are numbered anew: there are fewer of them than positions, so a pair and an id fit into 63 bits.
    pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    return pair[:-1] * size + ids[2:]


def repeated_words(words: Words, window: int = 3, bits: int = 21) -> np.ndarray:
    """Words of each text that lie in a window of three words found twice or more in the text."""
    ids, counts, starts = words.ids, words.counts, words.offsets[:-1]
    out = np.zeros(len(counts), np.int64)
    if len(ids) < window:
        return out
    grams = window_codes(ids, len(words.vocab), bits)
    for i in np.flatnonzero(counts > window).tolist():
        a, n = int(starts[i]), int(counts[i])
        own = grams[a : a + n - window + 1]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if not same.any():
            continue
        again = np.zeros(len(own), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = again.copy()
        cover.resize(n)
        for k in range(1, window):
            cover[k : k + len(again)] |= again
        out[i] = cover.sum()
    return out


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x and x.strip(" \t\r\v\f")]
    return len(lines) - len(set(lines))


def _statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    words = Words(texts)
    kinds = _class_counts(texts)
    n = words.counts
    repeat = repeated_words(words)
    lines = np.fromiter((duplicate_lines(t) for t in texts.to_pylist()), np.int64, len(texts))
    breaks = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False)
    word_chars = kinds["chars"] - kinds["space"]
    per = lambda x, y: x / np.maximum(y, 1)
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": kinds["symbol"],
        "n_dup_lines": lines,
        "n_repeat_words": repeat,
        "symbol_share": per(kinds["symbol"], word_chars),
        "upper_share": per(kinds["upper"], word_chars),
        "bang_share": per(kinds["bang"], word_chars),
        "dup_line_share": per(lines, breaks + 1),
        "repeat_share": per(repeat, n),
        "digit_share": per(kinds["digit"], word_chars),
        "mean_word": per(word_chars, n),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts (long) and shares (double) of each whole text; a narrow step."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            s = _statistics(texts_of(part, text_col))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(s[c], pa.int64()) for c in COUNTS], *[pa.array(s[c], pa.float64()) for c in FEATURES]], names=[id_col, *COUNTS, *FEATURES])

    schema = f"`{id_col}` {id_type}, " + ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(measured, schema)


def _harmonic_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of uniformly random splits on subsamples; ``score`` is 2 ** -(mean path / expected path)."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A tree as arrays by node: feature (-1: leaf), cut, path length of a leaf; children of i are 2i+1, 2i+2."""
        size = (1 << self.depth + 1) - 1
        feature, cut, path = np.full(size, -1), np.zeros(size), np.zeros(size)
        stack = [(0, rows, 0)]
        while stack:
            node, part, depth = stack.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) <= 1 or not len(wide):
                path[node] = depth + _harmonic_path(len(part))
                continue
            f = int(rng.choice(wide))
            c = rng.uniform(low[f], high[f])
            feature[node], cut[node] = f, c
            left = part[:, f] < c
            stack += [(2 * node + 1, part[left], depth + 1), (2 * node + 2, part[~left], depth + 1)]
        return feature, cut, path

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, cut, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = rows[each, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** -(total / len(self.trees) / max(float(_harmonic_path(self.sample)), 1e-9))


class RuleModel:
    """The base rules, the forest (None: too few labelled rows) and its threshold."""

    def __init__(self, min_words: int, repeat_percent: int):
        self.min_words, self.repeat_percent = min_words, repeat_percent
        self.forest: IsolationForest | None = None
        self.usual, self.threshold = np.zeros(len(FEATURES)), 1.0

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """Scores of rows of FEATURES."""
        return self.forest.score(np.maximum(rows - self.usual, 0))

    def base_failed(self):
        return (F.col("n_words") < self.min_words) | (100 * F.col("n_repeat_words") > self.repeat_percent * F.col("n_words"))

    def keeps(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        """The verdict on statistics as numpy columns."""
        passed = (stats["n_words"] >= self.min_words) & (100 * stats["n_repeat_words"] <= self.repeat_percent * stats["n_words"])
        if self.forest is None or not len(passed):
            return passed
        return passed & (self.anomaly(np.column_stack([stats[c] for c in FEATURES])) < self.threshold)


def fit_rules(
    stats: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    keep_good: float = 0.99,
    beyond: float = 0.001,
    bins: int = 1000,
    min_words: int = 50,
    repeat_percent: int = 50,
    trees: int = 100,
    sample: int = 256,
    id_col: str = "doc_id",
    quality_col: str = "quality",
) -> RuleModel:
    """Grow the forest on a bounded sample of labelled rows and set its thresholds by all of them."""
    model = RuleModel(min_words, repeat_percent)
    # One label for each id, so that repeated label rows do not multiply documents; bad wins.
    marks = labels.filter(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(quality_col).cast("int").alias("good"))
    labelled = written(stats.filter(~model.base_failed()).join(marks, id_col).select("good", *FEATURES, F.xxhash64(F.lit("fit"), F.col(id_col)).alias("place")), "labelled-statistics")
    rows = labelled_rows(labelled, fit_rows)[:, 1:]
    if len(rows) < 2:
        return model
    usual = labelled.filter("good = 1").agg(*[F.percentile_approx(c, 1 - beyond, 100_000).alias(c) for c in FEATURES]).head()
    model.usual = np.array([usual[c] or 0.0 for c in FEATURES])
    model.forest = IsolationForest(np.maximum(rows - model.usual, 0), trees, sample)
    bin_of = F.floor(F.col("anomaly") * bins).cast("int").alias("bin")
    counts = _scored(labelled.select("good", *FEATURES), model, "good int").groupBy("good", bin_of).agg(F.count("*").alias("n")).collect()
    model.threshold = choose_threshold({(r.good, r.bin): r.n for r in counts}, bins, keep_good)
    return model


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, counts, base_failed, anomaly, threshold, kept) for each document.

    base_failed: fewer than ``min_words`` words, or over ``repeat_percent`` per cent of the words in repeated
    windows. kept: not base_failed, and an anomaly score below the threshold.
    """
    stats = written(rule_statistics(docs, id_col, text_col), "rule-statistics")
    model = fit_rules(stats, labels, id_col=id_col, **options)
    stats = stats.withColumn("base_failed", model.base_failed())
    carried = [id_col, *COUNTS, "base_failed"]
    if model.forest is None:
        scored = stats.select(*carried, F.lit(0.0).alias("anomaly"))
    else:
        id_type = docs.schema[id_col].dataType.simpleString()
        scored = _scored(stats.select(*carried, *FEATURES), model, f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean")
    return scored.withColumn("threshold", F.lit(model.threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(model.threshold)))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps; a narrow step once the model is fitted."""
    stats = written(rule_statistics(docs, id_col, text_col), "rule-statistics")
    model = fit_rules(stats, labels, id_col=id_col, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield part.filter(pa.array(model.keeps(_statistics(texts_of(part, text_col)))))

    return docs.mapInArrow(keep, docs.schema)


def labelled_rows(labelled: DataFrame, fit_rows: int) -> np.ndarray:
    """The forest's rows: a seeded sample of at most about ``fit_rows`` labelled ids (quality, then features)."""
    n = labelled.count()
    if not n:
        return np.zeros((0, 1 + len(FEATURES)))
    share = int(min(1.0, fit_rows / n) * 1_000_000)
    taken = labelled.filter(F.pmod("place", F.lit(1_000_000)) < share).dropDuplicates(["place"])
    pdf = taken.select(F.col("good").cast("double"), *FEATURES).toPandas()
    return pdf.sort_values(list(pdf.columns)).to_numpy(float)


def choose_threshold(counts: dict[tuple[int, int], int], bins: int, keep_good: float) -> float:
    """The score that best parts good from bad among those that keep ``keep_good`` of the good rows."""
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for (label, b), n in counts.items():
        (good if label else bad)[min(b, bins)] += n
    kept = np.cumsum(good) / max(good.sum(), 1)
    caught = 1 - np.cumsum(bad) / max(bad.sum(), 1)
    able = kept >= keep_good
    best = np.where(able, kept + caught, -1)
    return float((int(np.argmax(best)) + 1) / bins) if able.any() else 1.0


def _scored(rows: DataFrame, model: RuleModel, carried: str) -> DataFrame:
    """Replace the feature columns (the last ones) by the anomaly score."""
    k = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[-k:]])
            yield pa.RecordBatch.from_arrays([*b.columns[:-k], pa.array(model.anomaly(x))], names=[*b.schema.names[:-k], "anomaly"])

    return rows.mapInArrow(run, carried + ", anomaly double")
