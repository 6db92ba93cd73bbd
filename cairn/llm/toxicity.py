"""Toxicity categories by a classifier chain of linear models.

A text is the set of its hashed words and word beginnings. Categories have an order, and
there is a logistic model for each: those that come later also read the probabilities of
the earlier ones. While they are trained, those probabilities come from out-of-fold
models, so a later model doesn't learn from answers that an earlier one has seen.

Training reads at most `sample_rows` labelled documents (half of them, at most, of the
last category, the rest others, each taken by the smallest hash of the id) and keeps the
`n_features` features that tell most about any category. Scoring reads all documents
whole, block by block; the model that executors get is of that bounded size.

A label needs the last category only. Where an earlier one is unknown, that category's
model learns from other documents and gives this one a probability like any other.

Defined results: null and empty texts and those without words get the model's base rate;
labels without a document or without a last category teach nothing; of repeated labels of
a document the largest counts; without any usable label nothing is toxic; a table without
rows gives none; each row is scored and rejected by its own text, also where ids repeat
or are null; extra columns are ignored in scores and stay in filtered tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import runtime, vec
from cairn.llm.linear import fit_logistic, sigmoid

PREFIXES = (4, 5, 6, 7, 8)  # bytes of the beginnings of longer words
FOLDS = 5


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different features of each text of a block: 32-bit hashes and documents."""
    import pyarrow.compute as pc

    data, off = vec.raw(pc.utf8_lower(col))
    s, e, d = vec.spans(data, off)
    hs, ds = [vec.span_hashes(data, s, e)], [d]
    for k in PREFIXES:
        long = e - s > k
        hs.append(vec.mix(vec.span_hashes(data, s[long], s[long] + k) + np.uint64(k)))
        ds.append(d[long])
    h, d = np.concatenate(hs), np.concatenate(ds)
    key = np.sort((d.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)


@dataclass
class Chain:
    """The features kept (sorted), and for each category weights over them and over earlier categories' log odds."""

    names: list[str]
    kept: np.ndarray
    weights: list[np.ndarray]
    intercepts: list[float]
    threshold: float = 0.5

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.kept >> np.uint32(12)] = True

    def probabilities(self, h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        """(n, categories) for the features h of documents d."""
        some = np.flatnonzero(self.seen[h >> np.uint32(12)])
        h, d = h[some], d[some]
        at = np.minimum(np.searchsorted(self.kept, h), max(len(self.kept) - 1, 0))
        ok = self.kept[at] == h if len(self.kept) else np.zeros(len(h), bool)
        at, d = at[ok], d[ok]
        out = np.zeros((n, len(self.names)))
        for c, (w, b) in enumerate(zip(self.weights, self.intercepts, strict=True)):
            z = b + np.bincount(d, weights=w[at].astype(np.float64), minlength=n)
            for j in range(c):
                z += w[len(self.kept) + j] * _log_odds(out[:, j])
            out[:, c] = sigmoid(z)
        return out


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p)).astype(np.float32)


def select(docs_features: list[np.ndarray], y: np.ndarray, n_features: int, least: int = 3) -> np.ndarray:
    """The features with the largest likelihood ratio statistic for any category, among the documents for which it is known."""
    if not docs_features:
        return np.zeros(0, np.uint32)
    h, of = np.unique(np.concatenate(docs_features), return_inverse=True)
    rows = np.repeat(np.arange(len(y)), [len(x) for x in docs_features])
    n = np.bincount(of, minlength=len(h)).astype(float)
    best = np.zeros(len(h))
    for c in range(y.shape[1]):
        known = ~np.isnan(y[:, c])
        p = y[known, c].mean() if known.any() else 0
        if 0 < p < 1:
            own = known[rows]
            m = np.bincount(of[own], minlength=len(h)).astype(float)
            pos = np.bincount(of[own], weights=y[rows[own], c], minlength=len(h))
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(pos > 0, pos * np.log(pos / (m * p)), 0) + np.where(m > pos, (m - pos) * np.log((m - pos) / (m * (1 - p))), 0)
            best = np.maximum(best, g)
    best[n < least] = 0
    top = np.argsort(-best, kind="stable")[:n_features]
    return np.sort(h[top[best[top] > 2]])


def fit_chain(docs_features: list[np.ndarray], y: np.ndarray, fold: np.ndarray, names: list[str], n_features: int = 1500) -> Chain:
    """y: (documents, categories) of 0 and 1, or nan where a category is unknown; fold: a number below FOLDS for each document."""
    kept = select(docs_features, y, n_features)
    x = np.zeros((len(y), len(kept) + len(names)), np.float32)
    for i, h in enumerate(docs_features):
        at = np.searchsorted(kept, h)
        ok = at < len(kept)
        x[i, at[ok][kept[at[ok]] == h[ok]]] = 1
    weights, intercepts = [], []
    own = np.zeros(len(y))
    for c in range(len(names)):
        width = len(kept) + c
        known = ~np.isnan(y[:, c])
        own = np.zeros(len(y))
        for f in range(FOLDS):
            others = known & (fold != f)
            w, b = fit_logistic(x[others, :width], y[others, c])
            own[fold == f] = sigmoid(x[fold == f, :width] @ w + b)
        w, b = fit_logistic(x[known, :width], y[known, c])
        weights.append(w)
        intercepts.append(b)
        x[:, width] = _log_odds(own)
    return Chain(names, kept, weights, intercepts, _threshold(own, y[:, -1]) if len(y) else 1.0)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of out-of-fold probabilities with the best F0.5, between 0.3 and 0.9: precision weighs double, so clean documents stay."""
    cuts = np.arange(30, 91) / 100
    hit = np.array([((p >= t) & (y == 1)).sum() for t in cuts], float)
    said = np.array([(p >= t).sum() for t in cuts], float)
    score = 1.25 * hit / np.maximum(0.25 * max(y.sum(), 1) + said, 1)
    return float(cuts[int(np.argmax(score))])


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, Column]], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, n_features: int = 1500) -> Chain:
    """A chain from labelled documents. categories: names and conditions over the columns of labels, in order; the last is that for which documents are rejected."""
    runtime.ship(docs.sparkSession)
    names = [n for n, _ in categories]
    marks = [F.max(c.cast("int")).alias(f"c{i}") for i, (_, c) in enumerate(categories)]
    last = f"c{len(names) - 1}"
    known = labels.groupBy(F.col(id_col).alias("id")).agg(*marks).filter(f"id IS NOT NULL AND {last} IS NOT NULL")
    picked = []
    for value, n in ((1, sample_rows // 2), (0, sample_rows - sample_rows // 2)):
        picked += runtime.hash_sample(known.filter(F.col(last) == value), "id", n).collect()
    wanted = docs.sparkSession.createDataFrame([(r["id"], [r[f"c{i}"] for i in range(len(names))]) for r in picked], "id long, y array<int>")
    # At most sample_rows rows are broadcast.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, col in vec.blocks(vec.text_column(batch)):
                h, d = features(col)
                cuts = np.searchsorted(d, np.arange(len(col) + 1))
                yield pa.record_batch([batch.column(0).slice(i, len(col)), batch.column(2).slice(i, len(col)), pa.array([h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["id", "y", "h"])

    got = sorted(rows.select("id", "text", "y").mapInArrow(run, "id long, y array<int>, h binary").collect(), key=lambda r: r["id"])
    y = np.array([[np.nan if v is None else v for v in r["y"]] for r in got], np.float32).reshape(len(got), len(names))
    fold = np.array([zlib.crc32(str(r["id"]).encode()) % FOLDS for r in got], np.int64)
    return fit_chain([np.frombuffer(r["h"], np.uint32) for r in got], y, fold, names, n_features)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, p_<category> for each category, toxic (does the last reach the chain's threshold?)."""
    runtime.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for i, col in vec.blocks(vec.text_column(batch)):
                p = model.probabilities(*features(col), len(col))
                yield pa.record_batch([batch.column(0).slice(i, len(col)), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(p[:, -1] >= model.threshold)], names=["doc_id", *names, "toxic"])

    schema = "doc_id long, " + ", ".join(f"`{n}` double" for n in names) + ", toxic boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def label_categories() -> list[tuple[str, Column]]:
    """The chain over `labels`, whose toxic column knows no finer kinds: abuse within prose, abuse within junk, and any."""
    toxic = F.col("toxic") == 1
    return [("abusive_prose", toxic & (F.col("quality") == 1)), ("abusive_junk", toxic & (F.col("quality") == 0)), ("toxic", toxic)]


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text a chain trained on labels rejects; all columns stay. Rows are scored and filtered in one pass: nothing is shuffled or joined."""
    chain = train(docs, labels, label_categories(), id_col, text_col, **options)
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def clean(col: pa.Array) -> np.ndarray:
        p = sent.value.probabilities(*features(col), len(col))
        return p[:, -1] < sent.value.threshold

    return runtime.filtered(docs, text_col, clean)
