"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Texts and items are normalised to lower-case letters and digits with single spaces. An
item of m characters that occurs with at most k edits leaves m + 1 - q - k q of its
q-grams on diagonals that differ by at most k. So shared q-grams are counted in diagonal
bands of width 2 k that overlap by k, every such occurrence lies whole in one of them,
and only bands that reach that count are aligned: a banded alignment of the whole item
against the region gives the least number of edits. Every position of a text is read;
texts are scanned in windows that overlap by more than the largest region. Where q-grams
are so common that their places would fill the memory, the window is halved, then the
items are.

An item of fewer than min_chars normalised characters has an edit budget of 0: it must
stand in the text as it is, between word borders. An item of more than part_chars is cut
at words into parts of about that size that overlap by half, each with a budget of its
own, so a text that holds only some of a long item is found as well.

The benchmark is read in blocks of at most BLOCK_CHARS characters (a longer item is a
block of its own), so what executors hold of it is bounded however many items there are.

Defined results: null and empty texts hold nothing; an item without letters or digits,
null or empty names no passage and matches nothing; equal items all match, and one that
repeats with its id matches once; repeated documents match each; overlapping regions of
one document and part are one row, that with the fewest edits, then the first; extra
columns are ignored in hits and stay in filtered tables, where each row is judged by its
own text, also where ids repeat or are null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import runtime, vec

Q = 8
BLOCK_CHARS = 2_000_000
WINDOW = 500_000
MIN_CHARS, PART_CHARS = 32, 600
EXPAND = 1 << 20  # places of shared q-grams that are looked at together
_SHIFT = np.uint64(42)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normalise(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts as code points, the n + 1 offsets into them, and for each its place in its own text."""
    low = pc.utf8_lower(col)
    chars = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32)
    off = np.concatenate([[0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ascii_word = ((chars >= 48) & (chars < 58)) | ((chars >= 97) & (chars < 123))
    word = ascii_word | ((chars >= 0xC0) & ~((chars >= 0x2000) & (chars < 0x2070)) & (chars != 0x3000))
    keep = word.copy()
    keep[1:] |= word[:-1]
    begins = off[:-1][off[:-1] < len(chars)]
    keep[begins] = word[begins]
    at = np.flatnonzero(keep)
    new = np.concatenate([[0], np.cumsum(keep)])[off]
    return np.where(word, chars, 32)[at].astype(np.uint32), new, at - np.repeat(off[:-1], np.diff(new))


def grams(chars: np.ndarray) -> np.ndarray:
    """The Q = 8 characters from each place as one number; characters are folded to 8 bits, which can only add hits."""
    b = (chars ^ (chars >> np.uint32(8))).astype(np.uint8).astype(np.uint64)
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    for k in (1, 2, 4):
        b = b[:-k] | (b[k:] << np.uint64(8 * k))
    return b


def parts_of(t: np.ndarray, part_chars: int) -> list[np.ndarray]:
    """A long item cut before words into parts of part_chars characters, at most, that overlap by about half; others whole."""
    if len(t) <= part_chars:
        return [t]
    words = np.concatenate([[0], np.flatnonzero(t == 32) + 1, [len(t) + 1]])
    out, at = [], 0
    while True:
        end = int(words[max(np.searchsorted(words, at + part_chars + 1, "right") - 1, 0)])
        if end <= at:  # one word of more characters than a part
            end = min(at + part_chars, len(t)) + 1
        out.append(t[at : end - 1])
        if end > len(t):
            return out
        half = int(words[max(np.searchsorted(words, at + part_chars // 2, "right") - 1, 0)])
        at = half if half > at else end - 1 if t[end - 1 : end] != 32 else end


class Index:
    """The q-grams of a block of items, with their places, and the hashes of its short items."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float, min_chars: int = MIN_CHARS, part_chars: int = PART_CHARS):
        texts = [normalise(pa.array([t or ""], pa.large_string()))[0] for _, t in items]
        trimmed = {(i, (t[:-1] if len(t) and t[-1] == 32 else t).tobytes()) for (i, _), t in zip(items, texts, strict=True) if len(t)}
        all_items = [(i, np.frombuffer(t, np.uint32)) for i, t in sorted(trimmed, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]
        least = max(Q, min_chars)
        self.shorts = [(i, t) for i, t in all_items if len(t) < least]
        cut = [(i, k, p) for i, t in all_items if len(t) >= least for k, p in enumerate(parts_of(t, max(part_chars, 2 * least)))]
        self._set([(i, t) for i, _, t in cut], [k for _, k, _ in cut], max_edits)
        self.short_keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(t) for _, t in self.shorts}):
            own = [k for k, (_, t) in enumerate(self.shorts) if len(t) == n]
            h = np.array([vec.span_hashes(self.shorts[k][1], np.array([0]), np.array([n]))[0] for k in own], np.uint64)
            order = np.argsort(h, kind="stable")
            self.short_keys[n] = (h[order], np.array(own)[order])

    def _set(self, items: list[tuple[int, np.ndarray]], parts: list[int], max_edits: float) -> None:
        self.items, self.parts, self.max_edits = items, parts, max_edits
        self.halves: list[Index] = []
        m = np.array([len(t) for _, t in self.items], np.int64)
        self.m, self.edits = m, np.minimum((max_edits * m).astype(np.int64), (m - Q) // Q)
        self.least = m + 1 - Q - self.edits * Q
        self.band = np.maximum(self.edits, 1)
        self.reach = int((m + 4 * self.band).max(initial=1)) + Q
        g = [grams(t) for _, t in self.items]
        all_grams = np.concatenate([*g, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = np.concatenate([*map(np.arange, map(len, g)), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(all_grams, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(all_grams[order], return_index=True)
        self.first = np.append(self.first, len(all_grams))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys * _SPREAD) >> _SHIFT] = True

    def _halves(self) -> list[Index]:
        if not self.halves:
            mid = len(self.items) // 2
            for a, z in ((0, mid), (mid, len(self.items))):
                half = Index.__new__(Index)
                half._set(self.items[a:z], self.parts[a:z], self.max_edits)
                half.reach = self.reach
                self.halves.append(half)
        return self.halves

    def exact(self, chars: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, short item, start) of every place where a short item stands between word borders."""
        out: list[tuple[int, int, int]] = []
        if not self.short_keys or not len(chars):
            return out
        begins = np.flatnonzero(chars != 32)
        begins = begins[np.isin(begins, off[:-1]) | (chars[begins - 1] == 32)]
        doc = np.searchsorted(off, begins, "right") - 1
        for n, (keys, own) in self.short_keys.items():
            s, d = begins, doc
            ends = s + n
            fits = ends <= off[d + 1]
            fits[fits] &= (ends[fits] == off[d[fits] + 1]) | (chars[np.minimum(ends[fits], len(chars) - 1)] == 32)
            s, d = s[fits], d[fits]
            h = vec.span_hashes(chars, s, s + n)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                for x in own[lo[k] : hi[k]].tolist():
                    if np.array_equal(self.shorts[x][1], chars[s[k] : s[k] + n]):
                        out.append((int(d[k]), x, int(s[k])))
        return out

    def regions(self, chars: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands with enough shared q-grams; doc tells the documents apart. Some bands may come twice, on grids that are shifted."""
        g = grams(chars)
        at = np.flatnonzero(self.seen[(g * _SPREAD) >> _SHIFT])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        hit = (self.keys[k] == g[at]) & (doc[at] == doc[at + Q - 1])
        at, k = at[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        if n.sum() > EXPAND and (len(chars) > 4 * self.reach or len(self.items) > 1):
            return self._regions_by_halves(chars, doc)
        where = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, at = self.item[where], np.repeat(at, n)
        # Places of different documents are moved apart, so that no band holds two of them.
        diagonal = at + doc[at] * self.reach - self.place[where] + self.reach
        band = diagonal // self.band[item]
        keys = np.concatenate([item << 44 | band, item << 44 | (band - 1)])
        key = np.sort(keys)
        if not len(key):
            return key, key
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count, key = np.diff(np.append(first, len(key))), key[first]
        key = key[count >= self.least[key >> 44]]
        # The lemma is about different q-grams of the item, and so about different places of the text.
        for at_hit in (self.place[where], at):
            k = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
            own = np.flatnonzero(key[k] == keys) if len(key) else np.zeros(0, np.int64)
            pairs = np.unique(k[own] << 32 | at_hit[own % len(at_hit)])
            key = key[np.bincount(pairs >> 32, minlength=len(key)) >= self.least[key >> 44]]
        item, band = key >> 44, key & ((1 << 44) - 1)
        return item, band * self.band[item] - self.reach


    def _regions_by_halves(self, chars: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(chars) > 4 * self.reach:
            mid = len(chars) // 2
            parts = [(0, self.regions(chars[: mid + self.reach], doc[: mid + self.reach])), (mid, self.regions(chars[mid:], doc[mid:]))]
            return np.concatenate([item for _, (item, _) in parts]), np.concatenate([diagonal + shift for shift, (_, diagonal) in parts])
        a, b = self._halves()
        (i, x), (j, y) = a.regions(chars, doc), b.regions(chars, doc)
        return np.concatenate([i, j + len(a.items)]), np.concatenate([x, y])


def least_edits(items: list[np.ndarray], texts: list[np.ndarray], leads: list[int], width: int, most: np.ndarray) -> np.ndarray:
    """Edits of the best occurrence of each item on `width` diagonals of its text, all pairs at once; more than `most` where there is none. Places outside a text match nothing."""
    rows = max(map(len, items))
    p = np.zeros((len(items), rows), np.uint32)
    t = np.full((len(items), rows + width), 0xFFFFFFFF, np.uint32)
    for i, (x, y, lead) in enumerate(zip(items, texts, leads, strict=True)):
        p[i, : len(x)] = x
        t[i, lead : lead + len(y)] = y[: rows + width - lead]
    m = np.array([len(x) for x in items])
    steps, out, live = np.arange(width, dtype=np.int16), np.full(len(items), 1 << 14), np.arange(len(items))
    cost = np.zeros((len(items), width), np.int16)
    for i in range(rows):
        cell = cost + (t[:, i : i + width] != p[:, i : i + 1])
        np.minimum(cell[:, :-1], cost[:, 1:] + 1, out=cell[:, :-1])
        cell -= steps
        np.minimum.accumulate(cell, axis=1, out=cell)
        cost = cell + steps
        done = m[live] == i + 1
        if done.any() or i % 16 == 15:
            best = cost.min(axis=1)
            out[live[done]] = best[done]
            keep = ~done & (best <= most[live])
            if not keep.all():
                live, cost, t, p = live[keep], cost[keep], t[keep], p[keep]
                if not len(live):
                    break
    return out


def banded_alignment(item: np.ndarray, text: np.ndarray, width: int, lead: int = 0) -> tuple[int, int, int]:
    """(edits, start, end) of the best occurrence of the whole item on `width` diagonals of text, the first of them -lead.

    Cell b of row i pairs item place i with text place i + b - lead; each cell also
    carries the place at which its path began.
    """
    big, n = 1 << 20, len(text)
    steps = np.arange(width)
    place = steps - lead
    padded = np.full(max(lead + n, len(item) + width) + 1, 0xFFFFFFFF, np.uint32)
    padded[lead : lead + n] = text
    cost, begin = np.where((place >= 0) & (place <= n), 0, big), place.copy()
    for i, c in enumerate(item):
        cell = cost + (padded[i : i + width] != c)
        skip = np.append(cost[1:] + 1, big)
        up = skip < cell
        cell, came = np.where(up, skip, cell), np.where(up, np.append(begin[1:], n), begin)
        cell = np.where((place + i + 1 >= 0) & (place + i + 1 <= n), cell, big)
        slope = cell - steps
        best = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == best, steps, 0))
        cost, begin = np.where(place + i + 1 <= n, best + steps, big), came[source]
    b = int(np.argmin(cost))
    return int(cost[b]), int(begin[b]), len(item) + b - lead


def scan(index: Index, chars: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, place in index.items, start, end, edits) of all occurrences in a block of normalised texts; short items come after the others."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    found = [(d, len(index.items) + k, s - int(off[d]), s - int(off[d]) + len(index.shorts[k][1]), 0) for d, k, s in index.exact(chars, off)]
    for lo in range(0, max(len(chars), 1), WINDOW):
        hi = min(len(chars), lo + WINDOW + index.reach)
        base = int(doc[lo]) if hi > lo else 0
        local = doc[lo:hi] - base
        near = []
        for item, diagonal in zip(*index.regions(chars[lo:hi], local), strict=True):
            m, w = int(index.m[item]), int(index.band[item])
            # The diagonal still holds document * reach: the document is the one whose places fit.
            d = _document(int(diagonal), m + 2 * w, index.reach, off - lo, base)
            if d is not None:
                first = int(diagonal) - (d - base) * index.reach + lo
                a, z = max(int(off[d]), first), min(int(off[d + 1]), first + m + 3 * w)
                near.append((int(item), d, a, z, a - first, 3 * w + 1))
        near.sort(key=lambda x: x[5])
        for n in range(0, len(near), 512):
            some = near[n : n + 512]
            items, most = [index.items[x[0]][1] for x in some], np.array([index.edits[x[0]] for x in some])
            edits = least_edits(items, [chars[x[2] : x[3]] for x in some], [x[4] for x in some], some[-1][5], most)
            for k in np.flatnonzero(edits <= most):
                item, d, a, z, lead, width = some[k]
                e, s, t = (0, *_exact(items[k], chars[a:z])) if edits[k] == 0 else banded_alignment(items[k], chars[a:z], width, lead)
                if e <= most[k]:
                    found.append((d, item, a + s - int(off[d]), a + t - int(off[d]), e))
    return _merged(found)


def _exact(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The first place of an item that text holds as it is."""
    data, wanted = text.tobytes(), item.tobytes()
    at = data.find(wanted)
    while at % 4:
        at = data.find(wanted, at + 1)
    return at // 4, at // 4 + len(item)


def _document(diagonal: int, length: int, reach: int, off: np.ndarray, base: int) -> int | None:
    """The document of a band: the only one whose shifted places meet it."""
    shifted = off[:-1] + (np.arange(len(off) - 1) - base) * reach
    d = int(np.searchsorted(shifted, diagonal + length, "right")) - 1
    while d >= 0 and off[d + 1] - off[d] == 0:
        d -= 1
    return d if d >= 0 and off[d + 1] + (d - base) * reach > diagonal else None


def _merged(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    out: list[tuple[int, int, int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (x[0], x[1], x[2])):
        if out and out[-1][:2] == x[:2] and x[2] < out[-1][3]:
            if x[4] < out[-1][4]:
                out[-1] = x
        else:
            out.append(x)
    return out


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, one on the driver at a time."""
    items = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    n = -(-2 * size // block_chars) or 1
    for k in range(n):
        block: list[tuple[int, str]] = []
        held = 0
        for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toLocalIterator():
            if block and held + len(r["t"]) > block_chars:
                yield block
                block, held = [], 0
            block.append((r["i"], r["t"]))
            held += len(r["t"])
        if block:
            yield block


_indexes: dict[str, Index] = {}  # the one in use, by worker process


class _Block:
    """A block of items as tasks get it: the index is made once a worker process."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], *options):
        self.name, self.items, self.options = uuid.uuid4().hex, spark.sparkContext.broadcast(items), options

    def index(self) -> Index:
        if self.name not in _indexes:
            _indexes.clear()
            _indexes[self.name] = Index(self.items.value, *self.options)
        return _indexes[self.name]


def contaminated(docs: DataFrame, items: DataFrame, max_edits: float = 0.1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per occurrence: doc_id, item_id, start_char, end_char (in the text as it is), edits, item_chars, part (of a long item, from 0; item_chars are then the part's).

    max_edits: the edit budget as a share of the normalised characters; at most what
    leaves one shared q-gram.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_char long, end_char long, edits int, item_chars int, part int"
    types = [pa.int64()] * 4 + [pa.int32()] * 3

    def over(block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = block.index()
            named = [(i, len(t), k) for (i, t), k in zip(index.items, index.parts, strict=True)] + [(i, len(t), 0) for i, t in index.shorts]
            for batch in batches:
                ids = batch.column(0)
                for i, col in vec.blocks(vec.text_column(batch)):
                    chars, off, place = normalise(col)
                    rows = []
                    for d, item, s, e, edits in scan(index, chars, off):
                        p = place[off[d] + s : off[d] + e]
                        own, size, part = named[item]
                        rows.append((ids[i + d].as_py(), own, int(p[0]), int(p[-1]) + 1, edits, size, part))
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "start_char", "end_char", "edits", "item_chars", "part"])

        return docs.mapInArrow(run, schema)

    out = None
    for block in item_blocks(items, item_id, item_text, block_chars):
        hits = over(_Block(spark, block, max_edits, min_chars, part_chars))
        out = hits if out is None else out.union(hits)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, max_edits: float = 0.1, min_chars: int = MIN_CHARS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay. Rows are scanned and filtered in one pass a block of items: nothing is shuffled or joined."""

    def cleaned(rows: DataFrame, block: _Block) -> DataFrame:
        def clean(col: pa.Array) -> np.ndarray:
            chars, off, _ = normalise(col)
            keep = np.ones(len(col), bool)
            keep[[x[0] for x in scan(block.index(), chars, off)]] = False
            return keep

        return runtime.filtered(rows, text_col, clean)

    for block in item_blocks(items, item_id, item_text, block_chars):
        docs = cleaned(docs, _Block(docs.sparkSession, block, max_edits, min_chars, part_chars))
    return docs
