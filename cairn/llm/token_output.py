"""Token ids as sharded binary files: one shared zstandard dictionary, one frame a document.

Layout below the output folder:

* ``dictionary-<hash>.zdict``: trained on chunks of serialised id arrays, picked by hash
  from all positions of a bounded sample of documents; empty where the sample is too
  small to train on, which the manifest says (``dictionary_trained``);
* ``shard-PPPPPPP-NNNN.ctok``: frames in ascending document order, then the index (an
  Arrow stream of doc_id, start, offset, size, n_tokens), then a JSON trailer with the
  dictionary hash, the id width and the index place, its length, and a magic word;
* ``manifest.json``: the shards in order with the number of tokens before each and the
  first and last id. It is written last, so a folder without it is not a corpus.

Each frame decodes alone: a document is read with the trailer, the index and one range.
Tasks take ranges of ids whose number follows the bytes of all texts, and close a shard
at ROLL_BYTES of frames or ROLL_DOCS documents, so an index in memory is bounded. Shards
are written under temporary names and renamed; a task that runs again after a lost
executor writes the same files again.

Defined results: null text is empty and gives the end id alone; a null id sorts first;
repeated ids are kept, next to each other, in the order of a hash of their texts; a
table without rows gives a manifest without shards; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import runtime, vec
from cairn.llm.tokens import encoded, encoder

MAGIC = b"CTOK0001"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])


RANGE_BYTES = 64 << 20
ROLL_BYTES, ROLL_DOCS = 64 << 20, 250_000


def train_dictionary(docs: DataFrame, tokenizer: str, sample_docs: int, sample_chunks: int, chunk_bytes: int, dictionary_bytes: int, dtype: str) -> bytes:
    """A dictionary from docs (doc_id, text): the documents of the smallest id hashes are encoded whole, and of their ids' chunks those of the smallest hashes train it; empty if they are too few."""
    some = runtime.hash_sample(docs.select("doc_id").distinct(), "doc_id", sample_docs)
    # At most sample_docs ids are broadcast; of an id that repeats one text counts.
    picked = docs.join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, col in vec.blocks(vec.text_column(batch)):
                for key, x in zip(batch.column(0).slice(i, len(col)).to_pylist(), encoder(tokenizer).encode(col.to_pylist()), strict=True):
                    data = np.frombuffer(x, "<u4").astype(dtype).tobytes()
                    chunks = [data[a : a + chunk_bytes] for a in range(0, len(data), chunk_bytes)]
                    yield pa.record_batch([pa.array([zlib.crc32(f"{key}:{n}".encode()) for n in range(len(chunks))], pa.int64()), pa.array(chunks, pa.binary())], names=["h", "chunk"])

    samples = [bytes(r["chunk"]) for r in picked.mapInArrow(cut, "h long, chunk binary").orderBy("h", "chunk").limit(sample_chunks).collect()]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if d:
        d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)


class _Writer:
    """One shard under a temporary name."""

    def __init__(self, out_dir: str, file: str, compressor: zstandard.ZstdCompressor, head: dict):
        self.fs, self.path = runtime.open_fs(f"{out_dir}/{file}")
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.file, self.compressor, self.head = file, compressor, head
        self.meta: tuple[list, ...] = ([], [], [], [], [])
        self.at = self.tokens = 0

    def put(self, key: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        frame = self.compressor.compress(np.frombuffer(ids, "<u4").astype(self.head["dtype"]).tobytes())
        self.out.write(frame)
        for column, x in zip(self.meta, (key, self.tokens, self.at, len(frame), n), strict=True):
            column.append(x)
        self.at, self.tokens = self.at + len(frame), self.tokens + n

    def full(self, roll_bytes: int, roll_docs: int) -> bool:
        return self.at >= roll_bytes or len(self.meta[0]) >= roll_docs

    def close(self) -> dict:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, INDEX) as w:
            w.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(self.meta, INDEX.types, strict=True)], schema=INDEX))
        index = sink.getvalue().to_pybytes()
        trailer = json.dumps(self.head | {"index_offset": self.at, "index_bytes": len(index), "docs": len(self.meta[0]), "tokens": self.tokens}).encode()
        self.out.write(index + trailer + struct.pack("<Q", len(trailer)) + MAGIC)
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return {"file": self.file, "docs": len(self.meta[0]), "tokens": self.tokens, "frame_bytes": self.at, "first": self.meta[0][0], "last": self.meta[0][-1]}


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3, sample_docs: int = 1000, sample_chunks: int = 2000, chunk_bytes: int = 4096, dictionary_bytes: int = 65536, range_bytes: int = RANGE_BYTES, roll_bytes: int = ROLL_BYTES, roll_docs: int = ROLL_DOCS) -> dict:
    """Writes all documents in ascending id order and returns the manifest. range_bytes: texts of one task, about; the session's shuffle partitions are the least number of tasks."""
    spark = docs.sparkSession
    runtime.ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dtype = "<u2" if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    dictionary = train_dictionary(docs, tokenizer, sample_docs, sample_chunks, chunk_bytes, dictionary_bytes, dtype)
    digest = hashlib.sha256(dictionary).hexdigest()
    name = f"dictionary-{digest[:16]}.zdict"
    runtime.write_file(f"{out_dir}/{name}", dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, compressor, head = TaskContext.get().partitionId(), _compressor(dictionary, level), {"dictionary": digest, "dtype": dtype}
        done: list[dict] = []
        out = None
        for keys, ids in encoded(batches, tokenizer, "doc_id", "text", end_id):
            for key, x in zip(keys, ids, strict=True):
                if out is not None and out.full(roll_bytes, roll_docs):
                    done.append(out.close())
                    out = None
                out = out or _Writer(out_dir, f"shard-{part:07d}-{len(done):04d}.ctok", compressor, head)
                out.put(key, x)
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("docs", "tokens", "frame_bytes", "first", "last"))]))

    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    order = ["doc_id", F.xxhash64("text")]
    found = docs.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, "file string, docs long, tokens long, frame_bytes long, first long, last long").collect()
    manifest = {"dictionary": name, "dictionary_sha256": digest, "dictionary_trained": bool(dictionary), "end_id": end_id, "dtype": dtype, "shards": []}
    base = 0
    for r in sorted(found, key=lambda r: r["file"]):
        manifest["shards"].append(r.asDict() | {"start": base})
        base += r["tokens"]
    runtime.write_file(f"{out_dir}/manifest.json", json.dumps(manifest).encode())
    return manifest


class Shard:
    """One open shard: its index in memory, its frames read by range."""

    def __init__(self, out_dir: str, file: str, dictionary: bytes):
        fs, path = runtime.open_fs(f"{out_dir}/{file}")
        self.file = fs.open_input_file(path)
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{file} is not a token shard")
        self.head = json.loads(self.file.read_at(length, size - 16 - length))
        if self.head["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{file} was written with another dictionary")
        self.index = pa.ipc.open_stream(self.file.read_at(self.head["index_bytes"], self.head["index_offset"])).read_all()
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=d)

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.decompressor.decompress(frame), self.head["dtype"]).astype("<u4")

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of one document, by one range read."""
        keys = self.index["doc_id"]
        without, keys = keys.null_count, keys.drop_null().to_numpy()
        i = int(np.searchsorted(keys, doc_id))
        if i == len(keys) or keys[i] != doc_id:
            raise KeyError(doc_id)
        row = self.index.slice(without + i, 1).to_pylist()[0]
        return self.ids(self.file.read_at(row["size"], row["offset"]))

    def documents(self, rows: int = 1000) -> Iterator[tuple[dict, np.ndarray]]:
        """All documents in order, frames read in runs."""
        for batch in self.index.to_batches(rows):
            for lo in range(0, batch.num_rows, rows):
                meta = batch.slice(lo, rows).to_pylist()
                base = meta[0]["offset"]
                data = self.file.read_at(meta[-1]["offset"] + meta[-1]["size"] - base, base)
                for m in meta:
                    yield m, self.ids(data[m["offset"] - base : m["offset"] - base + m["size"]])


def read_tokens(spark: SparkSession, out_dir: str, with_ids: bool = True) -> DataFrame:
    """Reads every shard back: doc_id, start, n_tokens, ids_crc32 [, ids]. The crc is that of the ids as unsigned 32-bit integers."""
    runtime.ship(spark)
    manifest = json.loads(runtime.read_file(f"{out_dir}/manifest.json"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = runtime.read_file(f"{out_dir}/{manifest['dictionary']}")
        for batch in batches:
            for file, base in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                rows: list = []
                held = 0
                for m, ids in Shard(out_dir, file, dictionary).documents():
                    rows.append((m["doc_id"], base + m["start"], len(ids), zlib.crc32(ids.tobytes()), *[ids] * with_ids))
                    held += len(ids) * with_ids + 8
                    if held > 1 << 20:
                        yield to_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield to_batch(rows)

    def to_batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        return pa.record_batch([pa.array(c, pa.int64()) if k < 4 else pa.array([x.astype(np.int64) for x in c], pa.list_(pa.int64())) for k, c in enumerate(cols)], names=names[: len(cols)])

    shards = [(s["file"], s["start"]) for s in manifest["shards"]]
    return spark.createDataFrame(shards, "file string, start long").repartition(max(1, len(shards))).mapInArrow(read, schema)


def read_document(out_dir: str, doc_id: int) -> np.ndarray:
    """One document by its id, without Spark; the first of those that share the id."""
    manifest = json.loads(runtime.read_file(f"{out_dir}/manifest.json"))
    dictionary = runtime.read_file(f"{out_dir}/{manifest['dictionary']}")
    # The shards are in order, and all that hold a null id only have no last one.
    known = [s for s in manifest["shards"] if s["last"] is not None]
    i = bisect.bisect_left([s["last"] for s in known], doc_id)
    if i == len(known):
        raise KeyError(doc_id)
    return Shard(out_dir, known[i]["file"], dictionary).document(doc_id)
