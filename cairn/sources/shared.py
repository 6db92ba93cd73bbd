"""The shared working folder: written tables and files that must outlive a task.

Everything goes below ``spark.checkpoint.dir``, which all executors of a cluster see.
Lost executors are harmless: a table is committed by Spark's own writer, and files
written by tasks appear under their final names only by a rename.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that don't already find it."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    sc = spark.sparkContext
    if getattr(sc, "_cairn_shipped", False):
        return
    import io
    import tempfile
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "cairn").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    path = Path(tempfile.mkdtemp(prefix="cairn-")) / "cairn.zip"
    path.write_bytes(buf.getvalue())
    sc.addPyFile(str(path))  # the driver serves it to executors
    sc._cairn_shipped = True


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/cairn-shared"
    return base.rstrip("/")


_made: dict[str, int] = {}  # folders made by scratch() that are still there, and the process that made them


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when this process ends, if not before."""
    ship(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = os.getpid()
    return path


def _delete(path: str) -> None:
    fs, p = open_fs(path)
    if fs.get_file_info(p).type != pafs.FileType.NotFound:
        fs.delete_dir(p)


@atexit.register
def _sweep() -> None:
    for path, pid in list(_made.items()):
        if pid == os.getpid():
            with contextlib.suppress(OSError, pa.ArrowException):
                _delete(path)


@contextlib.contextmanager
def cleaned(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Removes at its end all folders that were made inside, but for those of tables put into the list that it gives."""
    before, out = set(_made), list(keep)
    try:
        yield out
    finally:
        for path in set(_made) - before - {t._cairn_path for t in out}:
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._cairn_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it, by the scheme of the path."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def write_file(path: str, data: bytes) -> None:
    """A whole file under its final name or none: written beside it, then renamed."""
    fs, p = open_fs(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    tmp = f"{p}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, p)


def read_file(path: str) -> bytes:
    fs, p = open_fs(path)
    with fs.open_input_stream(p) as f:
        return f.read()
