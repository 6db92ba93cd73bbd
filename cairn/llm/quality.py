"""Text quality by a generalised additive model with pairwise interactions.

Features are counts and shares of a whole text. Boosting goes round and round over the
features: each turn fits one shallow tree on one feature's bins to the current residuals
and adds it, shrunk, to that feature's lookup table. The pairs of features whose residual
grids promise most are boosted in the same way afterwards. A score is the sum of one
table entry a feature and one a pair: vectorised bin look-ups and additions.

Training reads at most `sample_rows` labelled documents, those of the smallest id
hashes; scoring reads every text whole. Only the text makes features.

Defined results: null and empty texts have features like any other (all zero) and get a
score; labels that are null or have no document are left out and the smallest of
repeated ones counts; without labels of both classes all scores are the base rate (0.5
without any); a table without rows gives none; repeated rows are scored each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import runtime, vec
from cairn.llm.linear import sigmoid

FEATURES = ["words", "chars_a_word", "word_spread", "upper", "digits", "symbols", "bangs", "bars", "stops", "non_ascii", "repeated_next", "distinct_words", "repeated_lines", "line_length", "short_words", "symbol_words"]


def _class_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT = _class_table(bytes(range(65, 91))), _class_table(b"0123456789")
_SYMBOL, _STOP = _class_table(b"#$%&*@^~<>{}[]\\=+_"), _class_table(b".,;:?")
_NOT_SPACE = ~_class_table(b" \t\r\n\x0b\x0c")
_NOT_LINE = ~_class_table(b"\n")


def features(col: pa.Array) -> np.ndarray:
    """(texts, FEATURES) of a block."""
    n = len(col)
    data, off = vec.raw(col)
    size = np.maximum(np.diff(off), 1)

    def share(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[data])])[off]) / size

    s, e, d = vec.spans(data, off, _NOT_SPACE)
    h = vec.span_hashes(data, s, e)
    words = np.bincount(d, minlength=n)
    some = np.maximum(words, 1)
    length = (e - s).astype(float)
    mean = np.bincount(d, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(d, length**2, n) / some - mean**2, 0))
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    distinct = np.bincount(vec.distinct(h, d)[1], minlength=n)
    ends_in_symbol = _SYMBOL[data[e - 1]] if len(e) else np.zeros(0, bool)
    ls, le, ld = vec.spans(data, off, _NOT_LINE)
    lines = np.maximum(np.bincount(ld, minlength=n), 1)
    different = np.bincount(vec.distinct(vec.span_hashes(data, ls, le), ld)[1], minlength=n)
    return np.column_stack(
        [
            np.log1p(words), mean, spread, share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_class_table(b"!")), share(_class_table(b"|")), share(_STOP), share(_class_table(bytes(range(128, 256)))),
            np.bincount(d, same, n) / some, distinct / some, np.maximum(np.bincount(ld, minlength=n) - different, 0) / lines, np.log1p(np.diff(off) / lines), np.bincount(d, length <= 2, n) / some, np.bincount(d, ends_in_symbol, n) / some,
        ]
    )


@dataclass
class Gam:
    """Bin edges and lookup tables; score = sigmoid(intercept + tables + pair tables)."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: int = 1  # fine bins of a coarse one
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for i, j, t in self.pairs:
            z += t[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return sigmoid(z)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: float) -> np.ndarray:
    """Values of a tree over ordered bins with gradient sums g and curvature sums h."""
    out = np.full(len(g), g.sum() / (h.sum() + l2))
    if depth == 0 or len(g) < 2:
        return out
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + l2) + rg**2 / (rh + l2), -1.0)
    k = int(np.argmax(gain))
    if gain[k] <= g.sum() ** 2 / (h.sum() + l2) + 1e-9:
        return out
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1, l2, least), _tree(g[k + 1 :], h[k + 1 :], depth - 1, l2, least)])


def _grid_tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: float) -> np.ndarray:
    """The same over a grid of two features: each split cuts the rectangle along one of them."""
    out = np.full(g.shape, g.sum() / (h.sum() + l2))
    if depth == 0:
        return out
    best, cut = g.sum() ** 2 / (h.sum() + l2) + 1e-9, None
    for axis in (0, 1):
        lg, lh = np.cumsum(g.sum(axis=1 - axis))[:-1], np.cumsum(h.sum(axis=1 - axis))[:-1]
        if len(lg):
            rg, rh = g.sum() - lg, h.sum() - lh
            gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + l2) + rg**2 / (rh + l2), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, cut = gain[k], (axis, k + 1)
    if cut is None:
        return out
    axis, k = cut
    for part in ((slice(None, k), slice(k, None)) if axis == 0 else ((slice(None), slice(None, k)), (slice(None), slice(k, None)))):
        out[part] = _grid_tree(g[part], h[part], depth - 1, l2, least)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, n_bins: int = 64, coarse_bins: int = 16, rate: float = 0.1, l2: float = 1.0, least: float = 2.0) -> Gam:
    model = Gam()
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    model.intercept = float(np.log(base / (1 - base)))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.coarse = n_bins // coarse_bins
    model.edges = [np.unique(np.quantile(x[:, k], np.arange(1, n_bins) / n_bins)) for k in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(z)
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            r, w = residuals()
            step = rate * _tree(np.bincount(b[:, k], r, len(t)), np.bincount(b[:, k], w, len(t)), 2, l2, least)
            t += step
            z += step[b[:, k]]
    c = b // model.coarse
    side = coarse_bins

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * side + c[:, j], v, side * side).reshape(side, side)

    r, w = residuals()
    promise = []
    for i in range(x.shape[1]):
        for j in range(i):
            g, h = grid(i, j, r), grid(i, j, w)
            promise.append((-float((_grid_tree(g, h, 2, l2, least) * g).sum()), i, j))
    model.pairs = [(i, j, np.zeros((side, side))) for _, i, j in sorted(promise)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            r, w = residuals()
            step = rate * _grid_tree(grid(i, j, r), grid(i, j, w), 3, l2, least)
            t += step
            z += step[c[:, i], c[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> Gam:
    """A model from at most sample_rows labelled documents. Hold rows out by filtering labels."""
    runtime.ship(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    picked = runtime.hash_sample(known, "id", sample_rows)
    # At most sample_rows rows are broadcast.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, col in vec.blocks(vec.text_column(batch)):
                x = features(col)
                yield pa.record_batch([batch.column(0).slice(i, len(col)), batch.column(2).slice(i, len(col)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "y", "x"])

    got = sorted(rows.select("id", "text", "y").mapInArrow(run, "id long, y int, x binary").collect(), key=lambda r: r["id"])
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float64).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher: label 1 likelier)."""
    runtime.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, col in vec.blocks(vec.text_column(batch)):
                yield pa.record_batch([batch.column(0).slice(i, len(col)), pa.array(sent.value.score(features(col)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
