"""Quality rules: gradient-boosted trees over document statistics, scored as flat node arrays.

Statistics are taken from whole texts. The trees are trained on labelled documents, at most ``TRAINING_ROWS`` of them drawn
by a hash of the id, with monotonic constraints: where a statistic counts defects, more of them never raise the score. All
trees lie in five arrays (feature, threshold, left, right, value), and a batch of documents walks down a tree level by level.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import pin
from .common import SPACES, two_columns

#: The bound on the labelled documents that the trees are trained on.
TRAINING_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 48
LEAST_LEAF = 10.0  # sum of hessians
RIDGE = 1.0
#: A document is kept from this probability on.
KEEP_FROM = 0.35
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, each with its constraint: -1 if more of it never raises the score, 0 if it is free.
FEATURES = {"log_words": 0, "mean_word": 0, "longest_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
            "same_next_share": -1, "distinct_share": 0, "upper_share": -1, "digit_share": 0, "bang_share": -1, "mark_share": 0,
            "words_per_line": 0, "bar_share": -1}


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of eight words that occur twice or more; ``ids`` are equal where words are.

    Windows get exact ids by doubling: those of two words from pairs of words, of four from pairs of those, and of eight.
    """
    width = 1
    while width < window:
        if len(ids) <= width:
            return 0
        pairs = ids[:-width].astype(np.int64) * (int(ids.max()) + 1) + ids[width:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        width *= 2
        if len(counts) == len(ids):
            return 0
    again = np.flatnonzero(counts[ids] > 1)
    marks = np.zeros(len(ids) + window, dtype=np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """(the counts, the features) of a whole text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    by_symbol = [text.count(c) for c in SYMBOLS]
    symbols = sum(by_symbol)
    seen, dups, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dups += line in seen
            seen.add(line)
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    repeats = repeated_words(ids) if n else 0
    upper = sum(1 for _ in filter(str.isupper, text)) if not text.islower() else 0
    digits = sum(map(text.count, "0123456789"))
    share = lambda k, of: k / of if of else 0.0
    features = [float(np.log1p(n)), share(chars, n), float(max(map(len, words), default=0)), share(symbols, chars), share(dups, lines),
                share(repeats, n), share(int((ids[1:] == ids[:-1]).sum()), n), share(len(number), n), share(upper, chars),
                share(digits, chars), share(text.count("!"), chars), share(text.count(".") + text.count(","), chars), share(n, lines),
                share(by_symbol[SYMBOLS.index("|")], chars)]
    return [n, chars, symbols, dups, repeats], features


class Trees:
    """Boosted trees as flat node arrays; a leaf's feature is -1 and it leads to itself."""

    def __init__(self, base: float):
        self.base, self.roots, self.depth = base, [], 1
        self.feature, self.threshold, self.left, self.right, self.value = ([] for _ in range(5))

    def add(self, value: float = 0.0) -> int:
        node = len(self.feature)
        for array, x in ((self.feature, -1), (self.threshold, np.inf), (self.left, node), (self.right, node), (self.value, value)):
            array.append(x)
        return node

    def freeze(self) -> "Trees":
        self.feature, self.left, self.right = (np.array(x, dtype=np.int32) for x in (self.feature, self.left, self.right))
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of features."""
        total, at = np.full(len(rows), self.base), np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root, dtype=np.int32)
            for _ in range(self.depth):
                low = rows[at, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(rows: np.ndarray, good: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boost logistic loss with histogram trees; one class alone, or no rows, gives a constant model.

    A constrained feature only takes splits whose left and right values are in order, and the middle of the two bounds
    everything below on either side, so the whole tree is monotonic in it.
    """
    share = float(good.mean()) if len(good) else 1.0
    model = Trees(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if 0 < share < 1:
        edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(rows.shape[1])]
        binned = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin, model.depth = np.full(len(good), model.base), depth
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            model.roots.append(_grow(model, binned, edges, p - good, p * (1 - p), np.arange(len(good)), signs, depth, rate, -8.0, 8.0, margin))
    return model.freeze()


def _value(g: np.ndarray, h: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(-g / (h + RIDGE), low, high)


def _gain(g: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
    return -(g * v + 0.5 * (h + RIDGE) * v * v)


def _grow(model: Trees, binned, edges, g, h, rows, signs, depth, rate, low, high, margin) -> int:
    sum_g, sum_h = g[rows].sum(), h[rows].sum()
    own = float(_value(sum_g, sum_h, low, high))
    node = model.add(own * rate)
    best = (1e-6, None)
    if depth:
        for j, e in enumerate(edges):
            if not len(e):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=len(e) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=len(e) + 1))[:-1]
            v_left, v_right = _value(left_g, left_h, low, high), _value(sum_g - left_g, sum_h - left_h, low, high)
            gain = _gain(left_g, left_h, v_left) + _gain(sum_g - left_g, sum_h - left_h, v_right) - _gain(sum_g, sum_h, own)
            fair = (left_h >= LEAST_LEAF / 10) & (sum_h - left_h >= LEAST_LEAF / 10) & (signs[j] * (v_right - v_left) >= 0)
            k = int(np.argmax(np.where(fair, gain, -np.inf)))
            if fair[k] and gain[k] > best[0]:
                best = (float(gain[k]), (j, k, float(v_left[k]), float(v_right[k])))
    if best[1] is None:
        margin[rows] += own * rate
        return node
    j, k, v_left, v_right = best[1]
    middle = (v_left + v_right) / 2
    bounds_left, bounds_right = (low, high), (low, high)
    if signs[j] < 0:
        bounds_left, bounds_right = (middle, high), (low, middle)
    elif signs[j] > 0:
        bounds_left, bounds_right = (low, middle), (middle, high)
    below = binned[rows, j] <= k
    model.feature[node], model.threshold[node] = j, float(edges[j][k])
    model.left[node] = _grow(model, binned, edges, g, h, rows[below], signs, depth - 1, rate, *bounds_left, margin)
    model.right[node] = _grow(model, binned, edges, g, h, rows[~below], signs, depth - 1, rate, *bounds_right, margin)
    return node


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t)[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("quality")], ["features", "quality"])

    return docs.mapInArrow(run, "features array<double>, quality int")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> Trees:
    """Train on at most ``rows`` labelled documents, drawn by a hash of their ids; labels that are null are left out."""
    drawn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        "doc_id IS NOT NULL AND quality IS NOT NULL")
    drawn = pin(drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows))
    docs = two_columns(df, id_col, text_col).join(F.broadcast(drawn), "doc_id")  # at most ``rows`` pairs of numbers
    found = _features(docs.select("text", "quality")).toArrow()
    x = np.array(found.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the order of arrival must not matter
    return train(x[order], found.column("quality").to_numpy()[order].astype(np.float64), list(FEATURES.values()))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS,
          keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A document fails the base rule with fewer than 20 words, or with over 30 % of its words in repeated windows; then it
    isn't kept. The others are kept if the trees give them ``keep_from`` or more. Null text has no words. Without labels all
    that pass the base rule are kept. Repeated rows give repeated results; an empty table gives no rows.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels, id_col, text_col, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            counts = np.array([c for c, _ in found], dtype=np.int64)
            score = model.value.score(np.array([f for _, f in found]))
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(counts[:, k]) for k in range(5)], pa.array(failed),
                 pa.array(~failed & (score >= keep_from)), pa.array(score)],
                ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return two_columns(df, id_col, text_col).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")
