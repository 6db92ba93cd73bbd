"""Vectorised text work over Arrow string columns: whole blocks of documents at once.

A block is a run of at most BLOCK_ROWS documents of about BLOCK_BYTES; a longer document is a block of
its own, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 4096
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in ((0, _P), (1, _P_INV)):
            a = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow[0][:n], _pow[1][:n]


def text_column(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(col.cast(pa.large_string()), "")


def blocks(col: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of the column, each slice of about block_bytes."""
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(col):
        base = ends[i - 1] if i else 0
        j = min(max(i + 1, int(np.searchsorted(ends, base + block_bytes, "right"))), i + BLOCK_ROWS)
        yield i, col.slice(i, j - i)
        i = j


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _WORD[ord(_a) : ord(_b) + 1] = True


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of bytes marked in table; runs end at the end of a text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = table[data]
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = w[cut]
    ends[cut - 1] = w[cut - 1]
    s = np.flatnonzero(begins)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(off, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by differences of one running polynomial sum."""
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    return mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents, starts and ends of the lower-cased words: runs of letters, digits and non-ASCII characters."""
    data, off = raw(pc.utf8_lower(col))
    s, e, d = spans(data, off)
    return span_hashes(data, s, e), d, s, e


def word_shingles(col: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of k words; a text of 1 to k - 1 words has one shingle, one without words none."""
    h, d, _, _ = words(col)
    per = np.bincount(d, minlength=len(col))
    short = (per > 0) & (per < k)
    parts_h, parts_d = [], []
    if len(h) >= k:
        g = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            g = (g * _P) + h[j : len(h) - k + 1 + j]
        ok = d[: len(g)] == d[k - 1 :]
        parts_h.append(mix(g[ok]))
        parts_d.append(d[: len(g)][ok])
    if short.any():
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        for i in np.flatnonzero(short):
            x = np.uint64(len(h[first[i] : first[i] + per[i]]))
            for v in h[first[i] : first[i] + per[i]]:
                with np.errstate(over="ignore"):
                    x = x * _P + v
            parts_h.append(mix(np.array([x], np.uint64)))
            parts_d.append(np.array([i]))
    if not parts_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts_h), np.concatenate(parts_d)


def distinct(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of each document of a block, cut to 52 bits and sorted by document: hashes, documents, counts."""
    key = np.sort((d.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return key & np.uint64((1 << 52) - 1), (key >> np.uint64(52)).astype(np.int64), counts
