"""Quality by histogram gradient-boosted trees over document statistics.

The statistics of a text (`STATISTICS`) are cut into quantile bins; trees of fixed depth are grown
level by level on histograms of gradients, on a bounded sample (`sampling.SAMPLE_ROWS` labelled
rows). The trees are flattened into arrays (feature, threshold, leaf value, in heap order), and
every whole text is scored by stepping all rows of a batch down all trees at once with numpy.

Null and empty texts have zero statistics. Without labels of both kinds the score is their share of
label 1, or 0 without any label. Repeated rows are scored each on its own, rows without an id are scored and not learnt from,
and an empty table has no scores. Ties between splits go to the statistic that stands first and to its lowest threshold. Words of
a very long text are counted in blocks. Other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, pieces, raw_texts

TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 60, 4, 64, 0.2, 1.0, 2.0
STATISTICS = (
    "bytes", "words", "mean_word", "spread_word", "longest_word", "distinct_words", "top_word", "short_words", "upper", "digits", "punctuation",
    "symbols", "pipes", "non_ascii", "lines", "mean_line", "distinct_lines", "repeated_line_bytes", "closed_lines", "bare_tokens", "capital_words", "words_per_stop", "brackets",
)
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "punctuation": b".,;:!?'\"-", "symbols": b"#$%&*@^~+=\\_<>`", "pipes": b"|", "brackets": b"()[]{}/"}
_KIND = np.zeros(256, np.int64)
for _i, _bytes in enumerate(_CLASSES.values(), 1):
    _KIND[list(_bytes)] = _i
_KIND[128:] = len(_CLASSES) + 1
_LETTER = re.compile(rb"[0-9A-Za-z\x80-\xff]")


def statistics(raw: bytes) -> list[float]:
    """The text's `STATISTICS`; words are counted block by block, so memory is for distinct words and lines."""
    counts, sums = Counter(), np.zeros(len(_CLASSES) + 2, np.int64)
    for block in blocks(raw):
        counts.update(block.split())
        sums += np.bincount(_KIND[np.frombuffer(block, np.uint8)], minlength=len(_CLASSES) + 2)
    if not counts:
        return [0.0] * len(STATISTICS)
    size, n = len(raw), counts.total()
    kinds = sums / size
    share = dict(zip(_CLASSES, kinds[1:]))
    lengths, often = np.fromiter(map(len, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    mean = (lengths * often).sum() / n
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    rows = lines.total()
    stops = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    bare = sum(c for w, c in counts.items() if not _LETTER.search(w))
    capital = sum(c for w, c in counts.items() if 65 <= w[0] <= 90)
    return [
        float(size), float(n), mean, float(np.sqrt((often * (lengths - mean) ** 2).sum() / n)), float(lengths.max()), len(counts) / n, often.max() / n, often[lengths <= 2].sum() / n, share["upper"], share["digits"], share["punctuation"],
        share["symbols"], share["pipes"], kinds[-1], float(rows), size / rows, len(lines) / rows, sum(len(x) * (c - 1) for x, c in lines.items()) / size, sum(c for x, c in lines.items() if x.rstrip()[-1] in b".!?\"") / rows, bare / n, capital / n, n / (stops + 1), share["brackets"],
    ]


class Forest:
    """Trees as arrays in heap order: an inner node i of a tree goes to 2i + 1, or 2i + 2 above its threshold."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        if len(self.feature):
            tree, node = np.arange(len(self.feature))[:, None], np.zeros((len(self.feature), len(x)), np.int64)
            row = np.arange(len(x))[None, :]
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            logit = logit + self.value[tree, node - (2**DEPTH - 1)].sum(0)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts on the logistic loss; splits are found on histograms over quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin b: above edges[b - 1], up to edges[b]
    flat = bins + np.arange(width) * BINS
    inner = 2**DEPTH - 1
    features, thresholds, values = (np.zeros((TREES, k)) for k in (inner, inner, inner + 1))
    thresholds[:] = np.inf
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    logit = np.full(n, base)
    room = np.array([[b < len(e) for b in range(BINS)] for e in edges])
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            key = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            g, h = (np.bincount(key, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS).cumsum(2) for v in (slope, bend))
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
            gain[(h < LEAST_HESSIAN) | (total_h - h < LEAST_HESSIAN) | ~room[None]] = -np.inf
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            f, b = best // BINS, best % BINS
            at = first + np.arange(count)
            features[tree, at] = f
            thresholds[tree, at] = [edges[i][j] if ok else np.inf for i, j, ok in zip(f, b, good)]
            own = node - first
            node = 2 * node + 1 + (good[own] & (bins[np.arange(n), f[own]] > b[own]))
        leaf = node - inner
        values[tree] = -RATE * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + RIDGE)
        logit = logit + values[tree][leaf]
    return Forest(features.astype(np.int64), thresholds, values, base)


def _measure(keep: list[str], model=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = np.array([statistics(raw) for raw in raw_texts(batch.column("text"))])
            last = pa.array(model.value.scores(found)) if model else pa.array(found.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), last], [*keep, "score" if model else "found"])

    return run


def fit(sampled: DataFrame) -> Forest:
    """The forest of a sample with columns doc_id, y, text."""
    kind = sampled.schema["doc_id"].dataType.simpleString()
    rows = sampled.mapInArrow(_measure(["doc_id", "y"]), f"doc_id {kind}, y int, found array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.found))
    y = np.array([r.y for r in rows], float)
    if not 0 < y.sum() < len(y):
        none = np.zeros((0, 2**DEPTH))
        return Forest(none.astype(np.int64), none, none, 50.0 if y.sum() else -50.0)
    return grow(np.array([r.found for r in rows]), y)


def score(docs: DataFrame, model: Forest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score): 0 to 1, higher: label 1 likelier; a narrow map over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_measure(["key"], shared), f"key {kind}, score double").withColumnRenamed("key", key)
