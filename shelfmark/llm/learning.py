"""What the two classifiers share: a bounded labelled sample, boosted trees and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of labelled documents, max_rows of them about, picked by a hash of the id.

    An id that is labelled more than once has its largest label; null labels, ids and texts are left out.
    """
    labels = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
    share = min(1.0, max_rows / max(labels.count(), 1))
    picked = labels.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20))
    # The sample's size is bounded by max_rows, so its ids can be sent to every executor.
    texts = docs.select(id_col, text).where(F.col(text).isNotNull())
    return texts.join(F.broadcast(picked), id_col)


@dataclass
class Isotonic:
    """A non-decreasing map from raw scores to shares of label 1, linear between the pooled blocks."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def isotonic(raw: np.ndarray, positive: np.ndarray, rows: np.ndarray) -> Isotonic:
    """Pool adjacent violators over bins (raw score, sum of labels, rows); no rows give 0.5 throughout."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, p, n in zip(raw[order], positive[order], rows[order]):
        blocks.append([x * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    if not blocks:
        return Isotonic(np.zeros(1), np.full(1, 0.5))
    b = np.array(blocks)
    # One row of either label is added to each block, spread over the whole, so that no share is certain.
    return Isotonic(b[:, 0] / b[:, 2], np.clip((b[:, 1] + 0.5 / len(b)) / (b[:, 2] + 1 / len(b)), 0, 1))


@dataclass
class Trees:
    """Boosted trees of one depth: per tree and inner node a feature and a threshold, per leaf a value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:  # all rows are at one depth
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out


def boosted_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over histograms of quantile bins."""
    n, d = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n == 0:
        return Trees(0.0, feature, threshold, leaf)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(d)]
    code = np.stack([np.searchsorted(cuts[k], x[:, k]) for k in range(d)], axis=1)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            lo, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            for k in range(d):
                width = len(cuts[k]) + 1
                at = (node - lo) * width + code[:, k]
                left_g = np.cumsum(np.bincount(at, g, many * width).reshape(many, width), axis=1)
                left_h = np.cumsum(np.bincount(at, h, many * width).reshape(many, width), axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                if width > 1:
                    cut = gain[:, :-1].argmax(axis=1)
                    own = gain[np.arange(many), cut]
                    for m in np.flatnonzero(own > best):
                        best[m], feature[t, lo + m], threshold[t, lo + m] = own[m], k, cuts[k][cut[m]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        own = node - inner
        leaf[t] = -rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + ridge)
        score += leaf[t][own]
    return Trees(base, feature, threshold, leaf)
