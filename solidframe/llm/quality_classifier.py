"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (lengths, character classes, repeats; see ``NAMES``) are computed from the bytes of
a batch at once. Trees are fitted to at most ``max_rows`` labelled rows, those with the smallest hash of
their id: each statistic is cut into up to 64 bins at its quantiles, gradients and hessians of the logistic
loss are summed into histograms, and every node takes the split with the largest gain. The trees are full to
their depth and flattened into arrays, so that a batch goes down all trees level by level by array lookups.

Only the bounded sample's statistics reach the driver, at most one row for each label of it. Scoring is a scan without a shuffle.

Cases: null and empty texts are scored from statistics of zero; null labels and labels without a document
are not learned from; repeated labels count each; of documents with one id that with the smallest statistics is learned from; with labels of one kind or none the score is their share,
0.5 without any; equal rows agree; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PLAIN, Words, column_bytes, materialize, runs_of_texts, spans_to_mask, window_hash

NAMES = (
    "log_words", "word_length", "word_length_deviation", "upper", "digits", "symbols", "punctuation", "non_ascii",
    "distinct_words", "repeated_windows", "repeated_lines", "words_per_line", "short_words", "long_words", "log_lines",
)
LINES = Words(b"\n", lower=False)
WINDOW = 5
SCORES = "doc_id long, score double"

_CLASSES = np.zeros((5, 256), bool)
for _k, _set in enumerate((range(65, 91), range(48, 58), b"#*$%&|<>", b".,;:!?'\"()-", range(0xC0, 0x100))):
    _CLASSES[_k, list(_set)] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text that stands in ``data`` at ``offsets``."""
    n = len(offsets) - 1
    words, starts, ends, firsts = PLAIN.cut(data, offsets)
    lines, _, _, line_firsts = LINES.cut(data, offsets)
    lengths = (ends - starts).astype(float)
    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[firsts])
    n_words, n_lines = np.diff(firsts), np.diff(line_firsts)
    per_word, size = np.maximum(n_words, 1), np.maximum(np.diff(offsets), 1)
    mean = sums(lengths) / per_word
    spread = np.sqrt(np.maximum(sums(lengths**2) / per_word - mean**2, 0))
    own = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    shares = [np.diff(np.concatenate([[0], np.cumsum(c[own], dtype=np.int64)])[at]) / size for c in _CLASSES]
    distinct, repeats, twice = np.zeros(n), np.zeros(n), np.zeros(n)
    windows = window_hash(words, WINDOW)
    for k in range(n):
        a, b = int(firsts[k]), int(firsts[k + 1])
        if b > a:
            distinct[k] = len(np.unique(words[a:b])) / (b - a)
        if b - a >= WINDOW:
            w = windows[a : b - WINDOW + 1]
            _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
            if len(counts) < len(w):
                repeats[k] = spans_to_mask(np.flatnonzero(counts[inverse] > 1), WINDOW, b - a).mean()
        c, d = int(line_firsts[k]), int(line_firsts[k + 1])
        if d > c + 1:
            twice[k] = 1 - len(np.unique(lines[c:d])) / (d - c)
    return np.column_stack([np.log1p(n_words), mean, spread, *shares, distinct, repeats, twice, n_words / np.maximum(n_lines, 1), sums(lengths <= 3) / per_word, sums(lengths > 12) / per_word, np.log1p(n_lines)])


class Trees:
    """Full binary trees of one depth in arrays: for each inner node a statistic and a bound, for each leaf a value."""

    def __init__(self, bias: float, depth: int, feature: np.ndarray, bound: np.ndarray, leaf: np.ndarray):
        self.bias, self.depth, self.feature, self.bound, self.leaf = bias, depth, feature, bound, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 10, shrink: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1."""
    n_inner = 2**depth - 1
    share = float(y.mean()) if len(y) else 0.5
    empty = np.zeros((0, n_inner))
    if not len(y) or not 0 < share < 1:
        bias = 0.0 if not len(y) else (20.0 if share else -20.0)
        return Trees(bias, depth, empty.astype(int), empty, np.zeros((0, n_inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cells = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    bias = float(np.log(share / (1 - share)))
    total = np.full(len(y), bias)
    features, bounds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, bound = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, choice = np.full(width, 1e-9), [(0, -1)] * width
            for f in range(x.shape[1]):
                key = (node - first) * bins + cells[:, f]
                sums = [np.bincount(key, w, width * bins).reshape(width, bins) for w in (g, h, None)]
                (gl, hl, nl), (ga, ha, na) = (np.cumsum(s, 1) for s in sums), (s.sum(1, keepdims=True) for s in sums)
                with np.errstate(invalid="ignore", divide="ignore"):
                    worth = gl**2 / (hl + shrink) + (ga - gl) ** 2 / (ha - hl + shrink) - ga**2 / (ha + shrink)
                worth[(nl < least) | (na - nl < least)] = -1
                worth[:, len(edges[f]) :] = -1
                top = worth.argmax(1)
                for k in np.flatnonzero(worth[np.arange(width), top] > gain):
                    gain[k], choice[k] = worth[k, top[k]], (f, int(top[k]))
            for k, (f, cell) in enumerate(choice):
                if cell >= 0:
                    feature[first + k], bound[first + k] = f, edges[f][cell]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > bound[node])
        at = node - n_inner
        leaf = rate * np.bincount(at, g, n_inner + 1) / (np.bincount(at, h, n_inner + 1) + shrink)
        total += leaf[at]
        features.append(feature), bounds.append(bound), leaves.append(leaf)
    return Trees(bias, depth, np.array(features), np.array(bounds), np.array(leaves))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        for a, b in runs_of_texts(offsets):
            yield batch.slice(a, b - a), statistics(data, offsets[a : b + 1])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, x in _each(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Trees for ``labels`` (doc_id, label: 0 or 1) from the texts of ``docs`` (doc_id, text).

    ``max_rows`` bounds the labelled rows that are learned from; with more, those with the smallest hashes.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("_h"))
    some = materialize(known.orderBy("_h", "doc_id", "label").limit(max_rows).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    # of documents that share an id one is taken, the same in every run, so no more rows than labels reach the driver
    described = own.mapInArrow(_described, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = described.join(some, "doc_id").collect()
    found = sorted((tuple(r["x"]), r["label"]) for r in rows for _ in range(r["n"]))  # the order of rows plays no part
    x = np.array([r for r, _ in found]).reshape(len(found), len(NAMES))
    return fit_trees(x, np.array([y for _, y in found], float))


def _score(model: Trees):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _each(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), SCORES)
