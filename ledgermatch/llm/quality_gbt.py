"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a bounded sample of labelled documents come to the driver, where
numpy grows depth-limited trees on binned features for the logistic loss.  All
trees share one layout, complete binary trees in heap order, so the model is
three arrays, and a batch of documents descends all trees together, one level
per step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, split_remainder, text_hash, with_text_columns
from .textstats import COUNTS, batch_counts, with_counts

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000
SEED = 17
FEATURES = [
    "log_words", "word_length", "symbol_rate", "symbol_per_word", "dup_line_rate", "repeat_rate",
    "upper_rate", "digit_rate", "sign_rate", "distinct_rate", "words_per_line", "log_longest", "space_rate",
]


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES from rows of COUNTS."""
    c = {name: counts[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    out = [
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_symbols"] / words,
        c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_signs"] / chars, c["n_distinct_words"] / words, c["n_words"] / lines, np.log1p(c["longest_word"]),
        1 - c["word_chars"] / chars,
    ]
    return np.stack(out, axis=1)


@dataclass
class BoostedTrees:
    """``feature`` and ``threshold``: (trees, inner nodes) in heap order; ``value``: (trees, leaves); ``base``: log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.zeros((len(x), trees), dtype=np.int64)
        tree = np.arange(trees)[None, :]
        row = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        margin = self.base + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0
) -> BoostedTrees:
    """Newton boosting on per-feature quantile bins; a node that gains nothing sends all rows left."""
    inner = (1 << depth) - 1
    n = len(y)
    share = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return BoostedTrees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(n, base)
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            slot = node - first
            g_all = np.bincount(slot, grad, width)
            h_all = np.bincount(slot, hess, width)
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = slot * bins + binned[:, j]
                g = np.bincount(cell, grad, width * bins).reshape(width, bins).cumsum(axis=1)[:, : len(e)]
                h = np.bincount(cell, hess, width * bins).reshape(width, bins).cumsum(axis=1)[:, : len(e)]
                gain = g**2 / (h + l2) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + l2)
                gain -= (g_all**2 / (h_all + l2))[:, None]
                gain[(h < 0.5) | (h_all[:, None] - h < 0.5)] = -1
                cut = gain.argmax(axis=1)
                better = gain[np.arange(width), cut] > best
                best[better] = gain[better, cut[better]]
                feature[t, first : first + width][better] = j
                threshold[t, first : first + width][better] = e[cut[better]]
            split = threshold[t, node]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > split)
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + l2)
        margin += value[t, leaf]
    return BoostedTrees(feature, threshold, value, base)


def training_counts(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text"):
    """(counts, label) of at most ``max_rows`` labelled ids outside the held-out third, on the driver.

    A document with several labels counts with the largest; a repeated id with
    the text of the smallest hash; NULL ids and labels teach nothing.
    """
    usable = labels.filter((split_remainder(F.col("doc_id"), 3) != 1) & F.col(label_col).isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    chosen = hash_sample(usable, "doc_id", max_rows, SEED).toDF("_id", "_label")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), text_hash(text_col).alias("_hash"))
    counted = with_counts(texts.join(F.broadcast(chosen), "_id"), "_text", ["_id", "_label", "_hash"])
    one_each = counted.groupBy("_id", "_label").agg(*[F.min_by(c, "_hash").alias(c) for c in COUNTS])
    table = one_each.toPandas().sort_values("_id")
    return table[COUNTS].to_numpy(np.int64).reshape(-1, len(COUNTS)), table["_label"].to_numpy(np.float64)


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> BoostedTrees:
    counts, y = training_counts(docs, labels, "quality", max_rows, id_col, text_col)
    return fit_trees(features(counts), y)


def score_quality(docs: DataFrame, model: BoostedTrees, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score``, the probability of good quality, from the whole text alone.

    NULL counts as empty; every row, repeated or not, is scored on its own; an
    input column named ``score`` is replaced.
    """
    field = T.StructField("score", T.DoubleType())
    return with_text_columns(docs, text_col, [field], lambda texts: [model.score(features(batch_counts(texts)))], keep)
