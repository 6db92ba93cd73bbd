"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by page id. The bounds of the ranges are exact: payload bytes
are counted on a grid of ids that is refined where a cell holds more than a range may,
and neighbouring cells are put together up to RANGE_BYTES. So bounds, and with them all
files, depend on the pages alone, not on how the input lies in files or tasks. Rows that
share one id (or have none) and hold more than a range may are cut by their digests. A file
holds records of one range and is closed when its compressed size reaches `roll_bytes`;
each record is a gzip member of its own, without times. Headers, lengths and digests are
made anew from the payload. Of equal payloads of at least `revisit_bytes` the page with
the largest id is the response and the others are revisits that name it. Which they are
is decided on ids and digests; the payloads move once, to their range, where the marks of
revisits meet them. A task writes under temporary names and renames at the end;
``manifest.json`` lists the files with their digests, is written last, and is all that
readers go by.

Defined results: null html is an empty payload; a null url leaves its header out;
control characters in a url are percent-encoded; a null id sorts first and is never a
response to others; rows that repeat an id are written each; a table without rows gives
a manifest without files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import runtime

VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"
# Of at most MOST_RANGES ranges, each of at least RANGE_BYTES payload bytes; GRID cells are counted at a time.
RANGE_BYTES, MOST_RANGES, GRID = 64 << 20, 16_384, 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))] if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _url(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1_hex: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit (payload None) of page refers_to."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _url(url)), ("WARC-Payload-Digest", digest),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", record_id(refers_to) if revisit else None), ("X-Page-ID", None if page_id is None else str(page_id)), ("X-Refers-To-Page-ID", str(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, http + (payload or b""))


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Cell(NamedTuple):
    """Ids from first to last: cell number (first - low) div width of a grid that begins at low. bytes: what its payloads hold; a cell that is refined has the grid of the next level instead."""

    first: int
    last: int
    level: int
    low: int
    width: int
    bytes: int
    finer: int | None = None

    @property
    def number(self) -> int:
        return (self.first - self.low) // self.width


def _number(low: Column, width: Column) -> Column:
    big = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", big(F.col("page_id")) - big(low), big(width))


def id_cells(heads: DataFrame, range_bytes: int, grid: int = GRID) -> list[Cell]:
    """The cells that hold any of heads (page_id, size), in order: a grid over all ids, refined until no cell of several ids holds more than range_bytes."""
    r = heads.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    if r["low"] is None:
        return []
    out: list[Cell] = []
    todo = [(0, r["low"], r["high"])]
    # One pass for each heavy cell: few, as each holds more bytes than a range.
    while todo:
        level, low, high = todo.pop()
        width = (high - low) // grid + 1
        rows = heads.filter(F.col("page_id").between(low, high)).groupBy(_number(F.lit(low), F.lit(width)).alias("c")).agg(F.sum("size").alias("n")).collect()
        for c, n in map(tuple, rows):
            a, z = low + c * width, min(high, low + (c + 1) * width - 1)
            heavy = n > range_bytes and z > a
            out.append(Cell(a, z, level, low, width, n, (z - a) // grid + 1 if heavy else None))
            if heavy:
                todo.append((level + 1, a, z))
    return sorted(out)


def id_ranges(cells: list[Cell], range_bytes: int) -> list[list[Cell]]:
    """The cells of each range: neighbours together up to range_bytes."""
    out: list[list[Cell]] = []
    held = 0
    for x in cells:
        if x.finer is None:
            if not out or held + x.bytes > range_bytes:
                out.append([])
                held = 0
            out[-1].append(x)
            held += x.bytes
    return out


def with_range(rows: DataFrame, cells: list[Cell], ranges: list[list[Cell]], range_bytes: int, without_id: int = 0) -> tuple[DataFrame, int]:
    """rows with range, the number of their page_id's range from 1 (0 without an id), by a look-up a level of the grid, and slice, the part of an id that holds more than a range; and how many there are of both. without_id: bytes of rows without an id."""
    spark, number = rows.sparkSession, {x: k for k, own in enumerate(ranges, 1) for x in own}
    parts = lambda n: max(1, -(-n // range_bytes))
    top = next((x for x in cells if x.level == 0), Cell(0, 0, 0, 0, 1, 0))
    out = rows.withColumns({"__low": F.lit(top.low).cast("long"), "__width": F.lit(top.width).cast("decimal(38,0)"), "range": F.lit(None).cast("long"), "__parts": F.lit(None).cast("long")})
    for level in range(max((x.level for x in cells), default=-1) + 1):
        # A row for each cell: bounded by the grid and the number of ranges.
        of = [(x.low, x.number, number.get(x), parts(x.bytes) if x.first == x.last else 1, x.first, None if x.finer is None else Decimal(x.finer)) for x in cells if x.level == level]
        table = spark.createDataFrame(of, "__a long, __c long, __r long, __p long, __b long, __w decimal(38,0)")
        found = out.withColumn("__n", F.when(F.col("range").isNull(), _number(F.col("__low"), F.col("__width")))).join(F.broadcast(table), (F.col("__low") == F.col("__a")) & (F.col("__n") == F.col("__c")), "left")
        out = found.select(*rows.columns, F.coalesce("__b", "__low").alias("__low"), F.coalesce("__w", "__width").alias("__width"), F.coalesce("range", "__r").alias("range"), F.coalesce("__p", "__parts").alias("__parts"))
    head = F.conv(F.substring("sha1", 1, 8), 16, 10).cast("long")
    cut = F.shiftright(head * F.coalesce("__parts", F.lit(parts(without_id))), 32)
    many = sum(parts(x.bytes) - 1 for x in cells if x.first == x.last) + parts(without_id) + len(ranges)
    return out.select(*rows.columns, F.coalesce("range", F.lit(0)).alias("range"), cut.alias("slice")), many


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_bytes: int, range_bytes: int) -> tuple[DataFrame, int]:
    """page_id, sha1, mark, url, payload, size, refers_to, range, slice: the records (mark 1), and before each revisit its mark (0) with refers_to; and the number of ranges."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    heads = runtime.written(rows.select("page_id", "size", "sha1"), "heads")
    large = heads.filter(F.col("size") >= revisit_bytes)
    groups = large.groupBy("sha1", "size").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND first_id IS NOT NULL")
    marks = large.join(groups, ["sha1", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "sha1", F.lit(0).alias("mark"), F.col("first_id").alias("refers_to")).distinct()
    total, without_id = (x or 0 for x in heads.agg(F.sum("size"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first())
    range_bytes = max(range_bytes, -(-total // MOST_RANGES))
    cells = id_cells(heads, range_bytes)
    records = rows.select("page_id", "sha1", F.lit(1).alias("mark"), "url", "payload", "size")
    return with_range(records.unionByName(marks, allowMissingColumns=True), cells, id_ranges(cells, range_bytes), range_bytes, without_id)


def write_warc(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, roll_bytes: int = 64 << 20, range_bytes: int = RANGE_BYTES, level: int = 6, date: str = DATE, software: str = "cairn") -> dict:
    """Writes all pages and returns the manifest. range_bytes: payload bytes of a range, at least."""
    spark = pages.sparkSession
    runtime.ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = runtime.open_fs(out_dir)
        fs.create_dir(root, recursive=True)
        done, out, info, files = [], None, {}, 0
        marked: tuple = ()

        def close() -> None:
            out.close()
            done.append(info | {"sha256": info["sha256"].hexdigest()})

        def put(data: bytes) -> None:
            out.write(data)
            info["sha256"].update(data)
            info["bytes"] += len(data)

        for batch in batches:
            for r in batch.to_pylist():
                if r["mark"] == 0:
                    marked = (r["page_id"], r["sha1"], r["refers_to"])
                    continue
                refers_to = marked[2] if marked[:2] == (r["page_id"], r["sha1"]) else None
                if out is None or info["bytes"] >= roll_bytes or info["range"] != (r["range"], r["slice"]):
                    files = files + 1 if out is not None and info["range"] == (r["range"], r["slice"]) else 0
                    if out is not None:
                        close()
                    name = f"part-{r['range']:05d}-{r['slice']:05d}-{files:05d}.warc.gz"
                    info = {"file": name, "range": (r["range"], r["slice"]), "tmp": f"{root}/{name}.{uuid.uuid4().hex}.tmp", "bytes": 0, "records": 0, "sha256": hashlib.sha256(), "first": r["page_id"]}
                    out = fs.open_output_stream(info["tmp"], compression=None)
                    about = f"software: {software}\r\nformat: WARC File Format 1.1\r\n".encode()
                    put(_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], about), level))
                payload = None if refers_to is not None else r["payload"].encode()
                put(_member(page_record(r["page_id"], r["url"], payload, r["size"], r["sha1"], refers_to, date), level))
                info["records"] += 1
                info["last"] = r["page_id"]
        if out is not None:
            close()
        for x in done:
            fs.move(x["tmp"], f"{root}/{x['file']}")
        if done:
            names = ["file", "records", "bytes", "sha256", "first", "last"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([x[n] for x in done], t) for n, t in zip(names, types, strict=True)], names=names)

    rows, ranges = plan_records(pages, id_col, url_col, html_col, revisit_bytes, range_bytes)
    # Files are named by range, so it doesn't matter which task writes which.
    placed = rows.repartitionByRange(ranges, "range", "slice").sortWithinPartitions("range", "slice", "page_id", "sha1", "mark", "url")
    made = placed.mapInArrow(write, "file string, records long, bytes long, sha256 string, first long, last long")
    manifest = {"files": sorted((r.asDict() for r in made.collect()), key=lambda r: r["file"])}
    runtime.write_file(f"{out_dir}/manifest.json", json.dumps(manifest).encode())
    return manifest


def records(path: str, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, one gzip member at a time."""
    fs, p = runtime.open_fs(path)
    with fs.open_input_stream(p, compression=None) as f:
        data = f.read(chunk)
        while data:
            d, parts = zlib.decompressobj(31), []
            while True:
                parts.append(d.decompress(data))
                if d.eof:
                    data = d.unused_data or f.read(chunk)
                    break
                data = f.read(chunk)
                if not data:
                    raise ValueError(f"{path} ends inside a record")
            member = b"".join(parts)
            head, _, rest = member.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"{path} holds something else than WARC/1.1 records")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            block = rest[: int(fields["Content-Length"])]
            if fields.get("WARC-Block-Digest") != _sha1(block):
                raise ValueError(f"{path}: a block doesn't have its digest")
            yield fields, block


def read_warc(spark: SparkSession, out_dir: str, with_payload: bool = False) -> DataFrame:
    """Reads the archives of a manifest: page_id, payload_bytes, payload_digest, record_type, refers_to [, url, payload].

    Sizes and digests of responses are those of the payloads found, and must be those that
    the headers say; of revisits they are what the headers say.
    """
    runtime.ship(spark)
    manifest = json.loads(runtime.read_file(f"{out_dir}/manifest.json"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"] * with_payload]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string(), pa.binary()] * with_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for fields, block in records(f"{out_dir}/{file}"):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    if fields["WARC-Type"] == "response":
                        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{file}: a payload doesn't have its digest")
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                    rows.append((number("X-Page-ID"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), *([fields.get("WARC-Target-URI"), payload] if with_payload else [])))
                    held += 200 + len(payload) * with_payload
                    if held > 4 << 20:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    files = [(x["file"],) for x in manifest["files"]]
    return spark.createDataFrame(files, "file string").repartition(max(1, len(files))).mapInArrow(read, schema)
