"""What the text operators share: samples, filters, and the shared working folder of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import cleaned, drop, open_fs, read_file, remove, scratch, ship, work_dir, write_file, written  # noqa: F401


def hash_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most n rows, those of the smallest id hashes. Rows are thinned to about twice as many before they are sorted, so that what tasks send doesn't grow with their number."""
    count = df.count()
    h = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 31))
    if count > 2 * n:
        df = df.filter(h < int((1 << 31) * 2 * n / count))
    return df.orderBy(h, id_col).limit(n)


def filtered(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs for whose text keep() is true, with all columns as they are. keep gets blocks of texts, null as empty."""
    from cairn.llm import vec

    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
            for i, block in vec.blocks(col):
                yield batch.slice(i, len(block)).filter(pa.array(keep(block)))

    return docs.mapInArrow(run, docs.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
