"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

A byte-level BPE with the usual splitting pattern never merges across a space that a
non-space character follows, so a text's ids are those of its pieces, cut there. Each
different piece goes through the library once a block and is then looked up. For any
other tokenizer whole texts are encoded.

Ids are those of the library's defaults: the string of an added token (such as
<|endoftext|>) that stands in a text becomes that token's id. Texts are cut around such
strings, and what lies between them is encoded as texts of its own, as the library does.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r" (?=\S)")
_PUNCTUATION = string.punctuation
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    MEMO_ENTRIES = 200_000
    MEMO_CHARS = 64
    JOIN = 4096

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        # Texts can be cut around an added token only if it takes nothing of its neighbours, and pieces that are joined by spaces never make one.
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added)
        self.by_pieces = plain and spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.added_pattern = "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.bytes_of = np.zeros(self.vocabulary, np.int64)  # byte-level: a character of a token stands for a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.memo: dict[str, bytes] = {}  # pieces without the space that they begin with
        self.older: dict[str, bytes] = {}  # the generation before, looked up when memo has no entry
        self.bare: dict[str, bytes] = {}  # runs that follow a line end
        self.tails: dict[str, bytes] = {"": b""}  # punctuation
        self.line_end = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces that follow a space, many of them as one text; their ids part where their bytes do."""
        out: list[bytes] = []
        for lo in range(0, len(pieces), self.JOIN):
            some = pieces[lo : lo + self.JOIN]
            joined = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in some), np.int64, len(some)))
            at = np.cumsum(self.bytes_of[ids])
            cut = np.searchsorted(at, ends)
            if at[-1] != ends[-1] or (at[cut] != ends).any():
                out += self._encode([" " + p for p in some])
                continue
            data, cut = ids.tobytes(), ((cut + 1) * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *cut], cut, strict=False)]
        return out

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Pieces that follow a space, from the memo where it has them."""
        if len(self.memo) + len(self.bare) > self.MEMO_ENTRIES:
            self.memo, self.older, self.bare = {}, self.memo, {}
        out = list(map(self.memo.get, runs))
        gone = [k for k, x in enumerate(out) if x is None]
        fresh = []
        for k in gone:
            x = out[k] = self.older.get(runs[k])
            if x is None:
                fresh.append(k)
            else:
                self.memo[runs[k]] = x
        for k, x in zip(fresh, self._encode_pieces([runs[k] for k in fresh]), strict=True):
            out[k] = x
            if len(runs[k]) <= self.MEMO_CHARS:
                self.memo[runs[k]] = x
        return out

    def _lines(self, pieces: list[str]) -> list[bytes]:
        """Pieces that follow a space and hold line ends or anything else. A run of letters or digits, the punctuation after it and a line end between two such are parted by the pattern anyway."""
        parted, whole = [], []
        for k, p in enumerate(pieces):
            lines = [(x.rstrip(_PUNCTUATION), x) for x in p.split("\n")]
            if all(core.isalpha() or core.isascii() and core.isdigit() for core, _ in lines):
                parted.append((k, [(core, x[len(core) :]) for core, x in lines]))
            else:
                whole.append(k)
        out: list[bytes] = [b""] * len(pieces)
        for k, x in zip(whole, self._encode_pieces([pieces[k] for k in whole]), strict=True):
            out[k] = x
        heads = self._runs([x[0][0] for _, x in parted])
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        for memo, new in ((self.bare, {c for _, x in parted for c, _ in x[1:]}), (self.tails, {t for _, x in parted for _, t in x})):
            new = list(new.difference(memo))
            memo.update(zip(new, self._encode(new), strict=True))
        for head, (k, x) in zip(heads, parted, strict=True):
            y = head + self.tails[x[0][1]]
            for core, tail in x[1:]:
                y += self.line_end + self.bare[core] + self.tails[tail]
            out[k] = y
        return out

    def encode_block(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after another, and the n + 1 offsets into them."""
        if not self.by_pieces or not len(col):
            return _joined(self._encode(col.to_pylist()))
        holds = np.zeros(len(col), bool)
        for x in self.added:
            holds |= pc.match_substring(col, x).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._encode_plain(col)
        # Parts of a text alternate: what lies between added tokens, and these.
        texts = [re.split(f"({self.added_pattern})", t) if h else [t] for t, h in zip(col.to_pylist(), holds.tolist(), strict=True)]
        ids, cut = self._encode_plain(pa.array([x for t in texts for x in t[::2]], pa.large_string()))
        between = (ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True))
        return _joined([b"".join(next(between) if k % 2 == 0 else self.added[x] for k, x in enumerate(t)) for t in texts])

    def _encode_plain(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        n = len(col)
        parts = pc.split_pattern(col, " ")
        off = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        at, off, pieces = words.indices.to_numpy(), off - off[0], words.dictionary
        # A space before white space or the end is no place to cut: such texts are cut by the rule.
        odd = pc.match_substring_regex(pieces, r"^(\s|\pZ|[\x0b\x0c\x1c-\x1f\x85]|$)").to_numpy(zero_copy_only=False)
        hit = odd[at]
        hit[off[:-1]] = False
        odd_texts: dict[int, bytes] = {}
        for d in np.unique(np.searchsorted(off, np.flatnonzero(hit), "right") - 1).tolist():
            cut = _CUT.split(col[d].as_py())
            odd_texts[d] = self._encode([cut[0]])[0] + b"".join(self._lines(cut[1:]))
        # A piece is a run and the punctuation after it, or else looked at by itself.
        core = pc.utf8_rtrim(pieces, _PUNCTUATION)
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
        runs = core.filter(pa.array(plain)).dictionary_encode()
        tails = _after(pieces, core).filter(pa.array(plain)).dictionary_encode()
        others = pieces.filter(pa.array(~plain))
        entries = self._runs(runs.dictionary.to_pylist())
        a = len(entries)
        entries += self._encode(tails.dictionary.to_pylist()) + [b""]
        b = len(entries)
        entries += self._lines(others.to_pylist())
        c = len(entries)
        entries += self._encode(words.dictionary.take(pa.array(at[off[:-1]])).to_pylist())
        ids, cut = _joined(entries)
        # A block's ids are counted in 32 bits: it has fewer characters than that.
        first_of, second_of = np.empty(len(pieces), np.int32), np.full(len(pieces), b - 1, np.int32)
        first_of[plain], second_of[plain] = runs.indices.to_numpy(), a + tails.indices.to_numpy()
        first_of[~plain] = b + np.arange(len(others))
        where = np.empty((len(at), 2), np.int32)
        where[:, 0], where[:, 1] = first_of[at], second_of[at]
        where[off[:-1], 0], where[off[:-1], 1] = c + np.arange(n), b - 1
        where = where.ravel()
        size = np.diff(cut).astype(np.int32)[where]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        flat = ids[np.repeat((cut[:-1][where] - ends[:-1]).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)]
        ends = ends[2 * off]
        if not odd_texts:
            return flat, ends
        return _joined([odd_texts[d] if d in odd_texts else flat[ends[d] : ends[d + 1]].tobytes() for d in range(n)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_block(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _after(whole: pa.Array, start: pa.Array) -> pa.Array:
    """What follows `start` in each of `whole`, which begins with it; punctuation, so one byte a character."""
    n = pc.subtract(pc.binary_length(whole), pc.binary_length(start)).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(n)])
    ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)[1:]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if off[-1] else np.zeros(0, np.uint8)
    take = np.repeat(ends - n - off[:-1], n) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes()))


def _joined(each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each], dtype=np.int64)])


def encoded(batches: Iterator[pa.RecordBatch], path: str, id_col: str, text_col: str, end_id: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids of documents, their token bytes with the end id) by blocks."""
    from cairn.llm import vec

    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(id_col))
        for i, block in vec.blocks(vec.text_column(batch, text_col), 4 << 20):
            ids, ends = enc.encode_block(block)
            yield keys.slice(i, len(block)).to_pylist(), [ids[a:b].tobytes() + end for a, b in zip(ends[:-1], ends[1:], strict=True)]
