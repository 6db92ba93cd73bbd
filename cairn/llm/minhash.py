"""Near-duplicate groups by ProbMinHash over word shingles.

Each document is the bag of its five-word shingles. ProbMinHash gives each shingle a
Poisson process whose rate is its weight: its points arrive at exponential distances and
fall on random registers, each register keeps the shingle of its earliest point, and a
process ends as soon as its next point is later than every register (early termination).
Two signatures agree in a register with the probability Jaccard similarity of the
weighted documents. Bands of a signature are the buckets.

A document has two signatures: one in which a shingle weighs 1 + ln(its count), and one
in which all weigh 1, whose probability Jaccard is the Jaccard similarity of the sets.
They are the same for a text without repeats, and use the same buckets. Links are
verified by the sets, so the second signature alone bounds what can be missed; the first
adds texts whose repeated parts agree.

Every pair of a bucket is covered. Members are linked to the bucket's least member, and
up to SMALL members are compared among themselves. Links are filtered by their whole
signatures and then verified exactly: the shingle sets' Jaccard similarity must reach
the threshold. Of a larger bucket, pairs that these links already connect need nothing
more; if its members are in several components, it is cut into blocks of bounded rows and
bytes, and each block meets each other one in a task of its own, which verifies the pairs
of different components and returns at most the links that join them. A pair that
shares several buckets is compared in the first. Groups are the connected components of
all links.

Copies with the same shingle set are folded into their least document first, so a group
of copies of any size is one member of its buckets.

Defined results: texts without words (null and empty among them) are groups of their
own; texts of fewer than k words have one shingle, the whole text; an id that repeats
gives one row, and if its texts differ it is in the group with the smallest name of
theirs; rows without an id are left out; a table without rows gives none; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import runtime, vec
from cairn.llm.components import components

BANDS, ROWS = 20, 4
SMALL = 8
# Blocks of a large bucket: 16 of at least LEAST rows, more where they would exceed MOST rows or BLOCK_BYTES of shingles.
LEAST, MOST, BLOCK_BYTES = 256, 4096, 16 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def probminhash(h: np.ndarray, d: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of n documents from their different elements: the winning element of each register, 0 for empty documents."""
    at = np.full(n * m, np.inf)
    won = np.zeros(n * m, np.uint64)
    element, scale, x = vec.mix(h), 1.0 / weights, np.zeros(len(h))
    point = np.zeros(1, np.uint64)
    while len(element):
        point += GOLDEN
        u = vec.mix(element + point)
        x = x - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * scale
        register = d * m + (((vec.mix(u) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(at, register, x)
        first = at[register] == x
        won[register[first]] = element[first]
        live = x < at.reshape(n, m).max(1)[d]
        element, d, scale, x = element[live], d[live], scale[live], x[live]
    return won.reshape(n, m)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands): a number for each band, which tells the bands apart."""
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        out = vec.mix(out * GOLDEN + sig[:, r::rows])
    return out


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bands * rows
        for batch in batches:
            ids = batch.column(0)
            for i, col in vec.blocks(vec.text_column(batch)):
                n = len(col)
                h, d, count = vec.distinct(*vec.word_shingles(col, k))
                sig = probminhash(h, d, np.ones(len(h)), n, m)
                size = np.bincount(d, minlength=n)
                digest = []
                for salt in (1, 2):
                    x = np.zeros(n, np.uint64)
                    np.add.at(x, d, vec.mix(h ^ np.uint64(salt)))
                    digest.append(x.view(np.int64))
                # The weighted signature differs from the other only where shingles repeat.
                again = np.zeros(n, bool)
                again[d[count > 1]] = True
                own, number = again[d], np.cumsum(again) - 1
                weighted = iter(_band_keys(probminhash(h[own], number[d[own]], 1 + np.log(count[own]), int(again.sum()), m), bands, rows).view(np.int64))
                band = _band_keys(sig, bands, rows)
                low = np.ascontiguousarray(sig.astype(np.uint8))
                yield pa.record_batch(
                    [ids.slice(i, n), pa.array(size, pa.int32()), *map(pa.array, digest), pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())), pa.array([next(weighted) if x else None for x in again.tolist()], pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary())],
                    names=["doc_id", "size", "d1", "d2", "bands", "weighted", "low"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, col in vec.blocks(vec.text_column(batch)):
                h, d, _ = vec.distinct(*vec.word_shingles(col, k))
                cuts = np.searchsorted(d, np.arange(len(col) + 1))
                yield pa.record_batch([ids.slice(i, len(col)), pa.array([h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    return run


def _alike(floor: float):
    """Links whose signatures agree often enough for verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                ok = (x == y).mean(1) >= floor
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, out = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b))
                both = len(x) + len(y) - len(np.union1d(x, y))
                out.append(both / (len(x) + len(y) - both))
            s = np.array(out)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"]).filter(pa.array(s >= threshold))

    return run


def candidate_links(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), a < b, within buckets (all pairs of small ones, stars of large ones), and the members of large buckets: key, doc_id."""
    buckets = reps.select("doc_id", F.explode(F.when(F.col("weighted").isNull(), F.col("bands")).otherwise(F.array_union("bands", "weighted"))).alias("key"))
    stars = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).filter("n > 1")
    shared = runtime.written(buckets.join(stars, "key"), "shared")
    few = shared.filter(F.col("n").between(3, SMALL)).select("key", "doc_id")
    pairs = few.select("key", F.col("doc_id").alias("a")).join(few.select("key", F.col("doc_id").alias("b")), "key").filter("a < b").select("a", "b")
    links = runtime.written(shared.filter("doc_id != least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).union(pairs).distinct(), "candidates")
    large = runtime.written(shared.filter(F.col("n") > SMALL).select("key", "doc_id"), "large")
    runtime.drop(shared)
    return links, large


def _joining(threshold: float, floor: float):
    """Links that join different components within a pair of blocks (or one block); see the head of the module."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("doc_id")
        n, key = group.num_rows, group.column("key")[0].as_py()
        ids, block, comp = (group.column(c).to_numpy() for c in ("doc_id", "block", "component"))
        out_a, out_b = [], []
        own = np.unique(comp, return_inverse=True)[1]
        if own.max() > 0:
            cells = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            size = np.array([len(x) for x in cells])
            cut = np.concatenate([[0], np.cumsum(size)])
            names, flat = np.unique(np.concatenate(cells), return_inverse=True)
            held = np.zeros(len(names), bool)
            low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(n, -1)
            # The buckets of both signatures, and which of them come before this one. Equal keys are keys of one band.
            sides = [np.array(group.column("bands").to_pylist(), np.int64)]
            if group.column("weighted").null_count < n:
                sides.append(np.array([w or u for w, u in zip(group.column("weighted").to_pylist(), sides[0].tolist(), strict=True)], np.int64))
            before = [x < key for x in sides]
            one = block.min() == block.max()
            for i in range(n - 1):
                j = np.arange(i + 1, n)
                j = j[(own[j] != own[i]) & (one | (block[j] != block[i]))]
                j = j[np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i])]
                for x, first in zip(sides, before, strict=True):
                    for y in sides:
                        j = j[~((x[j] == y[i]) & first[j]).any(1)]
                j = j[(low[j] == low[i]).mean(1) >= floor]
                if not len(j):
                    continue
                mine = flat[cut[i] : cut[i + 1]]
                held[mine] = True
                if 2 * len(j) > n:
                    both = np.add.reduceat(held[flat], cut[:-1], dtype=np.int64)[j]
                else:
                    both = np.array([np.count_nonzero(held[flat[cut[x] : cut[x + 1]]]) for x in j])
                held[mine] = False
                for x in j[both / (size[j] + size[i] - both) >= threshold]:
                    if own[x] != own[i]:
                        out_a.append(ids[i])
                        out_b.append(ids[x])
                        own[own == own[x]] = own[i]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def joining_links(large: DataFrame, named: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float, floor: float) -> DataFrame:
    """Verified links (a, b) between members of large buckets that `named` (node, component) leaves in different components."""
    # Written, so that Spark splits the hot keys of the joins.
    at = large.join(reps.select("doc_id", "size"), "doc_id").join(named.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    at = runtime.written(at.select("key", "doc_id", "size", F.coalesce("component", "doc_id").alias("component")), "placed")
    open_ = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    rows = F.least(F.greatest(F.col("n") / 16, F.lit(LEAST)), F.lit(MOST))
    cuts = F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    dealt = at.join(open_.select("key", cuts.alias("cuts")), "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    dealt = runtime.written(dealt.select("key", "doc_id", "component", "block", "cuts"), "dealt")
    full = dealt.join(reps.select("doc_id", "low", "bands", "weighted"), "doc_id").join(sets, "doc_id")
    met = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = met.select("key", "i", "j", "doc_id", "component", "block", "low", "bands", "weighted", "shingles").groupBy("key", "i", "j").applyInArrow(_joining(threshold, floor), "a long, b long")
    found = runtime.written(found.distinct(), "joining")
    runtime.drop(at, dealt)
    return found


def near_duplicate_groups(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its group), class_size, kept (is it that least one?)."""
    runtime.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    sigs = runtime.written(docs.mapInArrow(_signatures(k, bands, rows), "doc_id long, size int, d1 long, d2 long, bands array<long>, weighted array<long>, low binary"), "signatures")
    # Written, so that the join below is one of two plain exchanges, whose hot keys Spark splits over tasks.
    folded = runtime.written(sigs.filter("size > 0").groupBy("d1", "d2", "size").agg(F.min("doc_id").alias("rep")), "folded")
    member = sigs.filter("size > 0").join(folded, ["d1", "d2", "size"])
    reps = runtime.written(member.filter("doc_id = rep").select("doc_id", "size", "bands", "weighted", "low").dropDuplicates(["doc_id"]), "reps")
    links, large = candidate_links(reps)
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("size").alias(f"n{c}"), F.col("low").alias(f"low{c}"))
    near = links.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    # 8 standard deviations of an estimate from all registers.
    floor = max(0.0, threshold - 8 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5)
    near = runtime.written(near.select("a", "b", "lowa", "lowb").mapInArrow(_alike(floor), "a long, b long"), "near")
    ends = near.select(F.explode(F.array("a", "b")).alias("doc_id")).union(large.select("doc_id")).distinct()
    # Texts are shuffled once, to a hash join: they needn't be sorted, whatever the number of linked documents.
    sets = runtime.written(docs.join(ends.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "sets")
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    pairs = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    verified = runtime.written(pairs.mapInArrow(_verify(threshold), "a long, b long, similarity double"), "links")
    first = runtime.written(components(verified), "components")
    joining = joining_links(large, first, reps, sets, threshold, floor)
    # Stars of the components stand for the links that made them.
    named = components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).union(joining)) if joining.head(1) else first
    lone = sigs.filter("size = 0").select("doc_id", F.col("doc_id").alias("rep"))
    everyone = member.select("doc_id", "rep").union(lone)
    classed = runtime.written(everyone.join(named.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("class_id")), "classes")
    runtime.drop(sigs, folded, reps, links, large, near, sets, verified, first, joining)
    sizes = runtime.written(classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "sizes")
    return classed.join(sizes, "class_id").select("doc_id", "class_id", "class_size", F.expr("doc_id = class_id").alias("kept"))


def near_dedup(docs: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-duplicates of a smaller id; rows with a null id stay."""
    gone = near_duplicate_groups(docs, threshold, k, id_col=id_col, text_col=text_col).filter("not kept").select(F.col("doc_id").alias("__gone_id"))
    return docs.join(gone, docs[id_col] == gone["__gone_id"], "left_anti")
