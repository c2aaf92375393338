"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Training goes round the features in turn; each time a shallow tree fits the
gradient over the feature's bins and a little of it is added to the feature's table. Then the pairs of features whose
coarse grid explains most of what is left are boosted alike. A score is the sum of table entries, through a logistic.

Training rows are a sample of SAMPLE labelled documents at most, picked by a hash of their ids; features are computed by
Spark tasks, and only the sample's feature rows reach the driver.

Defined results: null and empty texts score as texts with all features 0; labels other than 0 and 1 and labels of
documents that don't exist teach nothing; without both labels every score is the share of 1 (0.5 without any); repeated
rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import tokens

#: The bound on labelled rows that the model is fitted on.
SAMPLE = 20_000
BINS = 32
ROUNDS = 120
RATE = 0.15
PAIRS = 8
PAIR_BINS = 8
PAIR_ROUNDS = 40

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "beyond_ascii", "line_ends", "distinct_words", "same_as_before", "distinct_pairs",
    "marked_ends", "double_marks", "bars", "short_words", "upper_words", "bytes_a_line", "common_word",
]

_codes = np.arange(256)
_UPPER = (_codes >= 65) & (_codes <= 90)
_DIGIT = (_codes >= 48) & (_codes <= 57)
_MARK = (_codes > 32) & (_codes < 127) & ~_UPPER & ~_DIGIT & ~((_codes >= 97) & (_codes <= 122))


def features(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
    """FEATURES of rows i to j-1."""
    n = j - i
    w = tokens.words(data, offsets, i, j, tokens.BLANK_SPLIT, fold=True)
    b, bounds = w.data, offsets[i : j + 1] - offsets[i]
    size = np.diff(bounds).astype(float)
    words, row = w.counts.astype(float), w.row

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[b])])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(size, 1)

    def of_words(marks: np.ndarray) -> np.ndarray:
        return np.bincount(row, marks, n) / np.maximum(words, 1)

    def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct values, and of the commonest."""
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])][: len(h)]
        begin = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, r[begin], np.diff(np.r_[begin, len(h)]))
        all_ = np.maximum(np.bincount(row, minlength=n), 1)
        return np.bincount(r[begin], minlength=n) / all_, most / all_

    lines = share(_codes == 10)
    if len(w.hash):
        last, before = b[w.end - 1], b[np.maximum(w.end - 2, w.start)]
        marked, double = _MARK[last], _MARK[last] & (last == before) & (w.end - w.start > 1)
        upper = _UPPER[b[w.start]] & _UPPER[before] & (w.end - w.start > 1)
        again = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])]
        pair_row, _, pairs = w.windows(2)
    else:
        marked = double = upper = again = np.zeros(0, bool)
        pair_row, pairs = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    distinct_words, common = distinct(w.hash, row)
    out = [
        np.log1p(size), np.log1p(words), of_words(w.end - w.start), share(_UPPER), share(_DIGIT), share(_MARK), share(_codes >= 0xC0), lines, distinct_words, of_words(again), distinct(pairs, pair_row)[0],
        of_words(marked), of_words(double), share(_codes == 0x7C), of_words(w.end - w.start <= 3), of_words(upper), np.log1p(size / (lines * size + 1)), common,
    ]
    return np.stack(out, 1)


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut of bins with gradients g and weights h, and the first bin after it."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(left_h < 1e-6) | (right_h < 1e-6)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values by bin of a tree of up to `leaves` leaves, grown at the best cut."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b]), p) for p, (a, b) in enumerate(parts)), default=(0.0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[2])
        parts += [(a, a + best[1]), (a + best[1], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels over a grid: the best cut of the rows, then of each side's columns."""
    _, cut = _split(g.sum(1), h.sum(1))
    out = np.zeros_like(g)
    for side in (slice(0, cut), slice(cut, None)):
        out[side] = _tree(g[side].sum(0), h[side].sum(0), 2)[None, :]
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0)
    share = y.mean()
    if not 0 < share < 1:
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    model = Model(float(np.log(share / (1 - share))))
    model.edges = [_edges(c, BINS) for c in x.T]
    model.coarse = [_edges(c, PAIR_BINS) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    total = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, bins in enumerate(at):
            g, h = slope()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins, g, size), np.bincount(bins, h, size))
            model.tables[k] += step
            total += step[bins]
    rough = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T)]
    sizes = [len(e) + 1 for e in model.coarse]
    g, h = slope()
    gains = []
    for a in range(len(rough)):
        for b in range(a):
            cell, cells = rough[a] * sizes[b] + rough[b], sizes[a] * sizes[b]
            gains.append((float((np.bincount(cell, g, cells) ** 2 / (np.bincount(cell, h, cells) + 1)).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    grids = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            g, h = slope()
            cell = rough[a] * sizes[b] + rough[b]
            shape = (sizes[a], sizes[b])
            step = RATE * _grid_tree(np.bincount(cell, g, sizes[a] * sizes[b]).reshape(shape), np.bincount(cell, h, sizes[a] * sizes[b]).reshape(shape))
            grids[a, b] += step
            total += step[rough[a], rough[b]]
    model.pairs = [(a, b, t) for (a, b), t in grids.items()]
    return model


def _feature_rows(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = tokens.buffers(batch.column("text"))
    return np.concatenate([np.zeros((0, len(FEATURES))), *(features(data, offsets, i, j) for i, j in tokens.slices(offsets))])


def train(docs: DataFrame, labels: DataFrame, rows, label: str, key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on the labelled rows that `rows` (a condition on the key) selects, at most `sample` of them, the least by hash of the key."""
    picked = labels.filter(rows & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("y")).orderBy(F.xxhash64(key), key).limit(sample)

    def run(batches):
        for batch in batches:
            x = _feature_rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y").cast(pa.float64())], ["x", "y"])

    # broadcast: `sample` rows of 12 bytes at most
    found = docs.select(key, "text").join(F.broadcast(picked), key).select("text", "y").mapInArrow(run, "x array<double>, y double").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = found.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of FEATURES * BINS and PAIRS * PAIR_BINS**2 numbers

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sent.value.score(_feature_rows(batch)))], [key, "score"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")
