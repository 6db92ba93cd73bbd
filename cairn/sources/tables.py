"""Reading: fixed schemas, several files, hash samples, pinned versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from cairn.functions.numbers import sampled
from cairn.operators.tables import Table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_declared(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """Files by a declared schema, never inferred: a column that a file lacks is null."""
    return spark.read.schema(schema).parquet(*paths)


def find_files(spark: SparkSession, folder: str, name: str) -> list[str]:
    """`name.parquet`, `name-NNN.parquet` and `name/*.parquet`, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for pattern in (f"{name}.parquet", f"{name}-[0-9]*.parquet", f"{name}/*.parquet"):
        found += [str(s.getPath()) for s in fs.globStatus(path(f"{folder}/{pattern}")) or []]
    if not found:
        raise FileNotFoundError(f"{folder}/{name}")
    return sorted(found)


def read_sampled(df: DataFrame, user_col: str, fraction: float, columns: list[str], where: Column | None = None, seed: int = 0) -> DataFrame:
    """Whole histories of a hash sample of users, projected and filtered at the scan."""
    from pyspark.sql import functions as F

    out = df.filter(sampled(F.col(user_col), fraction, seed))
    return (out if where is None else out.filter(where)).select(*columns)


class Snapshot:
    """The versions of several tables, resolved once: every read of a run sees the same data."""

    def __init__(self, tables: dict[str, Table]):
        self.tables = tables
        self.versions = {name: t.version() for name, t in tables.items()}

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.tables[name].read(self.versions[name])
        return df.select(*columns) if columns else df


def run_sql(spark: SparkSession, text: str, **names: str) -> DataFrame:
    """A statement with {name} replaced by identifiers, for files of SQL."""
    for v in names.values():
        if not all(x.isidentifier() for x in v.split(".")):
            raise ValueError(f"{v!r} is no identifier")
    return spark.sql(text.format(**names))


def scalar(df: DataFrame):
    row = df.first()
    return None if row is None else row[0]


def vocabulary_size(dictionary: DataFrame, id_col: str) -> int:
    """Largest id + 1, at least 3: padding, unseen and one more."""
    from pyspark.sql import functions as F

    return max((scalar(dictionary.agg(F.max(id_col))) or 0) + 1, 3)
