"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. An n-gram's
vector binds its letters' vectors, each rotated by its place, by multiplication. A text
is the sum (the bundle) of its n-grams' vectors, and a language's prototype is the sum
of its texts' bundles, each scaled to unit length so that long texts don't outweigh
others. A text gets the language whose prototype has the largest cosine with it.

Prototypes are learned from all documents that the caller passes: each block of texts
adds to one vector a language, so what reaches the driver is a few vectors a task.
Whole texts are read. Letters are lower-cased; anything else is a word boundary.

Defined results: texts without letters (null and empty among them) are `und` with score
0; without any prototype every text is; equal cosines go to the first language in order
of names; a null language teaches nothing; a table without rows gives none; repeated
rows count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import runtime, vec

DIMENSIONS, GRAM = 512, 3
UNKNOWN = "und"
ROWS = 64


@lru_cache(1 << 16)
def letter(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a letter: a fixed function of its code point."""
    bits = vec.mix(np.uint64(code) * np.uint64(1 << 20) + np.arange(dimensions, dtype=np.uint64))
    return np.where(bits >> np.uint64(63), 1, -1).astype(np.int8)


def gram_counts(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's letters, its n-grams as numbers in base (letters + 1) whose digit 0 is a word boundary, and the n-grams' texts."""
    low = pc.utf8_lower(col)
    codes = np.frombuffer("".join(f"\n{t}\n" for t in low.to_pylist()).encode("utf-32-le"), np.uint32)
    off = np.concatenate([[0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 2)])
    known = np.unique(codes)
    letters = known[[chr(c).isalpha() for c in known.tolist()]]
    at = np.minimum(np.searchsorted(letters, codes), max(len(letters) - 1, 0))
    number = np.where(letters[at] == codes, at + 1, 0) if len(letters) else np.zeros(len(codes), np.int64)
    keep = number > 0
    keep[1:] |= number[:-1] > 0  # one boundary after each word
    keep[off[:-1]] = True  # and one before the first
    doc = np.repeat(np.arange(len(col)), np.diff(off))[keep]
    number = number[keep]
    base, n = len(letters) + 1, max(len(number) - GRAM + 1, 0)
    key = np.zeros(n, np.int64)
    for k in range(GRAM):
        key = key * base + number[k : n + k]
    same = doc[:n] == doc[GRAM - 1 :]
    return letters, key[same], doc[:n][same]


def gram_vectors(letters: np.ndarray, keys: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of n-grams (rows): letters rotated by their places and multiplied."""
    table = np.stack([letter(0, dimensions), *(letter(int(c), dimensions) for c in letters)])
    out, base = np.ones((len(keys), dimensions), np.int8), len(letters) + 1
    for place in range(GRAM):
        keys, digit = np.divmod(keys, base)
        out *= np.roll(table, place, axis=1)[digit]
    return out.astype(np.float32)


def bundles(col: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bundles, have they letters?) of a block's texts, ROWS at a time."""
    letters, keys, text = gram_counts(col)
    if (len(letters) + 1) ** GRAM <= 1 << 22:
        present = np.bincount(keys, minlength=1) > 0
        found, gram = np.flatnonzero(present), (np.cumsum(present) - 1)[keys]
    else:
        found, gram = np.unique(keys, return_inverse=True)
    vectors = gram_vectors(letters, found, dimensions)
    for lo in range(0, len(col), ROWS):
        n = min(ROWS, len(col) - lo)
        a, z = np.searchsorted(text, [lo, lo + n])
        # The group's own n-grams only: a rare script elsewhere in the block costs it nothing.
        used = np.flatnonzero(np.bincount(gram[a:z], minlength=len(found)))
        rank = np.zeros(len(found), np.int64)
        rank[used] = np.arange(len(used))
        counts = np.bincount((text[a:z] - lo) * len(used) + rank[gram[a:z]], minlength=n * len(used)).reshape(n, len(used))
        yield lo, counts.astype(np.float32) @ vectors[used], np.bincount(text[a:z] - lo, minlength=n) > 0


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each language, from all rows of docs."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, col in vec.blocks(vec.text_column(batch)):
                for lo, x, _ in bundles(col, dimensions):
                    own, unit = langs[i + lo : i + lo + len(x)], _unit(x).astype(np.float64)
                    for lang in set(own):
                        sums[lang] = sums.get(lang, 0) + unit[own == lang].sum(axis=0)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, v binary")
    # Vectors of a language are added up in slices by position: a sum for each of `dimensions`, whatever the number of tasks.
    each = rows.mapInArrow(_positions(dimensions), "lang string, k int, x double").groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in each:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["k"]] = round(r["x"], 6)  # the order of additions doesn't show
    return {k: out[k] for k in sorted(out)}


def _positions(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.record_batch([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.frombuffer(v, np.float64))], names=["lang", "k", "x"])

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the cosine, 0 if it is negative)."""
    runtime.ship(docs.sparkSession)
    names = np.array([*prototypes, UNKNOWN], object)
    dimensions = len(next(iter(prototypes.values()))) if prototypes else DIMENSIONS
    table = _unit(np.stack([*prototypes.values(), np.zeros(dimensions)])).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for batch in batches:
            for i, col in vec.blocks(vec.text_column(batch)):
                best, score = np.full(len(col), len(names) - 1), np.zeros(len(col))
                for lo, x, some in bundles(col, dimensions):
                    cosine = _unit(x) @ table[:-1].T
                    if cosine.shape[1]:
                        best[lo : lo + len(x)][some] = cosine.argmax(axis=1)[some]
                        score[lo : lo + len(x)][some] = np.clip(cosine.max(axis=1), 0, 1)[some]
                yield pa.record_batch([batch.column(0).slice(i, len(col)), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
