"""Histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import STATISTICS, fold, with_statistics
from scanloom.session import settle

#: Part over whole, as inputs next to the logarithms of the sizes.
SHARES = (
    ("word_chars", "n_words"), ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
    ("n_distinct", "n_words"), ("n_runs", "n_words"), ("n_upper", "word_chars"), ("n_lower", "word_chars"),
    ("n_digits", "word_chars"), ("n_shouts", "n_words"), ("n_bars", "n_words"), ("n_stops", "n_words"),
    ("n_marks", "word_chars"), ("n_wide", "word_chars"), ("n_capitals", "n_distinct"), ("n_top", "n_words"),
    ("n_ended", "n_lines"), ("n_words", "n_lines"),
)
SIZES = ("n_bytes", "n_words", "n_lines")
N_FEATURES = len(SHARES) + len(SIZES)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Inputs of the trees, one row per document; a share of nothing is 0."""
    cols = [np.asarray(stats[a], float) / np.maximum(np.asarray(stats[b], float), 1) for a, b in SHARES]
    cols += [np.log1p(np.asarray(stats[a], float)) for a in SIZES]
    return np.stack(cols, 1) if len(cols[0]) else np.zeros((0, N_FEATURES))


@dataclass
class Forest:
    """Trees as flat arrays: node ``i`` goes to ``left[i]`` or ``left[i] + 1``; a leaf points at itself."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(self.left[at] == at, at, self.left[at] + right)
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
          shrink: float = 1.0, least: float = 20.0) -> Forest:
    """Boost ``trees`` trees on the logistic loss.

    Inputs are cut once into at most ``bins`` quantile bins; a split is sought in the per-bin sums of gradient and
    curvature only. ``least``: rows a leaf needs. Without rows, or with one class only, the forest is its prior.
    """
    n = len(y)
    prior = (y.sum() + 1) / (n + 2)
    start = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(N_FEATURES)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1) if n else np.zeros((0, N_FEATURES), int)
    margin = np.full(n, start)
    feature, threshold, left, value, roots = [], [], [], [], []

    def leaf(v: float = 0.0) -> int:
        feature.append(0), threshold.append(np.inf), left.append(len(left)), value.append(v)
        return len(left) - 1

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        root = leaf()
        roots.append(root)
        open_nodes, node_of = [root], np.zeros(n, int)
        for level in range(depth + 1):
            k = len(open_nodes)
            live = node_of >= 0
            at = node_of[live]
            g_sum = np.bincount(at, g[live], k)
            h_sum = np.bincount(at, h[live], k)
            for i, node in enumerate(open_nodes):
                value[node] = float(rate * g_sum[i] / (h_sum[i] + shrink))
            if level == depth:
                break
            best = [(1e-6, 0, 0)] * k
            for f in range(N_FEATURES):
                width = len(cuts[f]) + 1
                if width < 2:
                    continue
                key = at * width + binned[live, f]
                hist = [np.bincount(key, w, k * width).reshape(k, width).cumsum(1) for w in (g[live], h[live], None)]
                gl, hl, nl = (a[:, :-1] for a in hist)
                gt, ht, nt = (a[:, -1:] for a in hist)
                gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
                gain[(nl < least) | (nt - nl < least)] = -1
                for i, b in enumerate(gain.argmax(1)):
                    if gain[i, b] > best[i][0]:
                        best[i] = (gain[i, b], f, b)
            new_nodes, lookup = [], np.full((k, 2), -1)
            split_f, split_b = np.zeros(k, int), np.zeros(k, int)
            for i, (node, (gain, f, b)) in enumerate(zip(open_nodes, best)):
                if gain <= 1e-6:
                    continue
                feature[node], threshold[node] = f, float(cuts[f][b])
                left[node] = leaf()
                leaf()
                lookup[i] = len(new_nodes), len(new_nodes) + 1
                new_nodes += [left[node], left[node] + 1]
                split_f[i], split_b[i] = f, b
            rows = np.flatnonzero(live)
            right = binned[rows, split_f[at]] > split_b[at]
            node_of[rows] = lookup[at, right.astype(int)]
            open_nodes = new_nodes
            if not new_nodes:
                break
        margin += Forest(0.0, np.array([root]), np.array(feature), np.array(threshold), np.array(left), np.array(value), depth).margin(x)
    arrays = (np.array(roots, int), np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(value, float))
    return Forest(start, *arrays, depth)


def quality_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, max_rows: int = 60_000,
                       threshold: float = 0.3, **params) -> DataFrame:
    """Score every document between 0 and 1; higher means that ``label`` 1 is likelier.

    ``docs`` needs doc_id and text, ``labels`` doc_id and the label; other columns, lang and source too, are not
    used. Rows whose crc32(doc_id) is 0 modulo ``folds`` are held out. At most about ``max_rows`` labelled rows, chosen by
    a hash of the id, fit the trees (a documented bound). Repeated labels of one id count once, as their mean; NULL
    labels and NULL ids teach nothing. NULL and empty texts get the score of all-zero statistics; repeated rows are
    scored one by one; without any label all scores are one half.

    One pass over the texts writes their statistics; training and scoring read only those.
    """
    stats = settle(with_statistics(docs))
    return score(stats, fit(stats, labels, label, folds, max_rows, **params), folds, threshold)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, max_rows: int = 60_000, **params) -> Forest:
    """The forest for statistics and labels; see ``quality_classifier``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")) \
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    known = known.where(fold("doc_id", folds) != 0)
    share = min(1.0, 0.97 * max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = stats.dropDuplicates(["doc_id"]).join(chosen, "doc_id").select("y", *STATISTICS).toArrow()
    cols = {n: rows.column(n).to_numpy() for n in rows.column_names}
    x = features(cols)
    return train(x, np.asarray(cols["y"], float), **params)


def score(stats: DataFrame, forest: Forest, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``stats``."""
    def run(batches):
        for pdf in batches:
            got = forest.score(features({n: pdf[n].to_numpy() for n in STATISTICS}))
            yield pdf[["doc_id", "held_out"]].assign(score=got, predicted=(got >= threshold).astype("int32"))

    rows = stats.withColumn("held_out", fold("doc_id", folds) == 0).select("doc_id", "held_out", *STATISTICS)
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
