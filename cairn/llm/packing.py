"""Packing token ids into windows of bounded length by best-fit decreasing.

Overlong documents are cut into full windows first; what is left of each is a tail.
Only lengths matter to the packing, and there are at most `window` different ones, so
the exact global best-fit-decreasing plan is made from the histogram of lengths: a
segment tree over remaining capacity finds the tightest open window for each length,
and equal windows are kept as runs. The plan's size depends on `window`, not on the
data. Pieces then get their places by their rank within their length. A length is ranked
in parts of about PART pieces, as many as its count needs, so that a length that most
pieces share (the full windows, as a rule) is ranked by as many tasks; a piece's part
comes from its document and its place, so one very long document is in many parts.

Defined results: null and empty texts hold the end id alone; a table without rows gives
no pieces; repeated ids are packed as often as they come; equal lengths are placed in
order of (part, id, start); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import runtime
from cairn.llm.tokens import encoded

PART = 250_000


class CapacityTree:
    """A segment tree over remaining capacities: which is the least that is open and large enough?"""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.size + capacity
        self.open[i] = int(is_open)
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.size + least
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan: (length, first rank, pieces, first window, pieces a window, offset) runs.

    Of the pieces of a length, those of rank first + j lie in window first window +
    j // pieces a window, at offset + (j % pieces a window) * length.
    """
    tree, runs = CapacityTree(window), {c: [] for c in range(window + 1)}
    plan, opened = [], 0

    def put(capacity: int, base: int, n: int) -> None:
        if capacity and n:
            runs[capacity].append((base, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, fit = window, window // length
                base, n = opened, -(-left // fit)
                opened += n
            else:
                fit = capacity // length
                base, n = runs[capacity].pop()
                tree.set(capacity, bool(runs[capacity]))
            full = min(n, left // fit)
            rest = left - full * fit if full < n else 0
            placed = full * fit + rest
            plan.append((length, rank, placed, base, fit, window - capacity))
            put(capacity - fit * length, base, full)
            if rest:
                put(capacity - rest * length, base + full, 1)
            put(capacity, base + full + (rest > 0), n - full - (rest > 0))
            rank, left = rank + placed, left - placed
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Full windows and tails of every document: doc_id, start, length, ids_crc32, doc_tokens [, ids binary]."""
    runtime.ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in encoded(batches, tokenizer, "doc_id", "text", end_id):
            rows = []
            for key, x in zip(keys, ids, strict=True):
                for at in range(0, len(x), 4 * window):
                    piece = x[at : at + 4 * window]
                    rows.append((key, at // 4, len(piece) // 4, zlib.crc32(piece), len(x) // 4, *[piece] * with_ids))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(types)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def _ranks_before(counted: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(length, part, pieces of the length in earlier parts) from (length, part, pieces)."""
    out, at = [], {}
    for length, part, n in sorted(counted):
        out.append((length, part, at.get(length, 0)))
        at[length] = at.get(length, 0) + n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, part: int = PART) -> DataFrame:
    """One row per piece: the columns of token_pieces(), sequence_id, and the offset there."""
    spark = docs.sparkSession
    pieces = runtime.written(token_pieces(docs, tokenizer, end_id, window, id_col, text_col, with_ids), "pieces")
    # At most `window` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = spark.createDataFrame([(k, -(-n // part)) for k, n in counts.items()], "length long, parts long")
    pieces = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.col("parts"))).drop("parts")
    # A row for about `part` pieces, and `window` more.
    before = spark.createDataFrame(_ranks_before([tuple(r) for r in pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()]), "length long, part long, ranks_before long")
    plan = spark.createDataFrame(best_fit_decreasing(counts, window), "length long, first_rank long, pieces long, first_window long, fit long, base long")
    order = [F.col("doc_id"), F.col("start"), *([] if with_ids else [F.col("ids_crc32")])]
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("ranks_before"))
    j = F.col("rank") - F.col("first_rank")
    placed = ranked.join(F.broadcast(plan), "length").filter((j >= 0) & (j < F.col("pieces")))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    return placed.select(*kept, (F.col("first_window") + F.floor(j / F.col("fit"))).cast("long").alias("sequence_id"), (F.col("base") + F.pmod(j, F.col("fit")) * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """The packed windows themselves: sequence_id, n_tokens, ids array<long> padded to the window, except at a power of two. Needs pack(..., with_ids=True); each window holds at most `window` pieces."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in r["pieces"]), "<u4").astype(np.int64)
                n = len(ids)
                full = n if n & (n - 1) == 0 else window
                rows.append((r["sequence_id"], n, np.concatenate([ids, np.full(full - n, pad_id, np.int64)])))
            yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["sequence_id", "n_tokens", "ids"])

    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return grouped.mapInArrow(build, "sequence_id long, n_tokens long, ids array<long>")
