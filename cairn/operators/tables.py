"""Versioned Parquet tables: merges, appends, dictionaries, manifests. No table format is needed.

A table is a folder of data folders, version files and numbered manifests; the manifest
of the largest number is the current one. A write makes new files only and ends with a
new manifest, which appears whole by a rename: readers see whole versions, a run that
fails anywhere leaves the table as it was, and of two writers that started from the same
manifest the second fails. Version numbers are never given twice, so a pinned version
stays what it was for as long as vacuum() leaves it.

A table of `buckets` is dealt by a hash of its keys: a merge reads and writes only the
buckets that its updates fall into, and the new version takes the others as they are.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaChanged(ValueError):
    pass


class Conflict(RuntimeError):
    """Another writer committed first."""


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str | None = None, buckets: int = 0, by: list[str] | None = None):
        self.spark, self.path, self.buckets, self.by = spark, path.rstrip("/"), buckets, by or []
        self.declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        found = self._fs().globStatus(self._path("manifest-*.json")) or []
        return sorted(int(str(x.getPath().getName())[9:-5]) for x in found)

    def _text(self, name: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def manifest(self) -> dict:
        """versions (in order), next (the number of the next version) and number (the manifest's own)."""
        numbers = self._numbers()
        if not numbers:
            return {"versions": [], "next": 0, "number": 0}
        return json.loads(self._text(f"manifest-{numbers[-1]:010d}.json")) | {"number": numbers[-1]}

    def version(self) -> str | None:
        versions = self.manifest()["versions"]
        return versions[-1] if versions else None

    def exists(self) -> bool:
        return self.version() is not None

    def read(self, version: str | None = None) -> DataFrame:
        """The current version, or a pinned one."""
        v = version or self.version()
        if v is None:
            if self.declared is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], self.declared)
        m = self.manifest_of(v)
        return self._read(m["parts"], T.StructType.fromJson(m["schema"]))

    def _read(self, parts: list[str], schema: T.StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def note(self) -> dict:
        """What the writer of the current version noted with it."""
        v = self.version()
        return self.manifest_of(v).get("note", {}) if v else {}

    def near(self, updates: DataFrame) -> DataFrame:
        """The stored rows of the buckets that updates fall into; all rows of a table without buckets."""
        hit, _ = self._touched(updates)
        return self._read(hit, T.StructType.fromJson(self.manifest_of(self.version())["schema"]))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets))

    def _touched(self, updates: DataFrame) -> tuple[list[str], list[str]]:
        parts = self.manifest_of(self.version())["parts"]
        if not self.buckets:
            return parts, []
        # At most `buckets` numbers.
        hit = {r["b"] for r in updates.select(self._bucket().alias("b")).distinct().collect()}
        mine = lambda p: int(p.rsplit("=", 1)[1]) in hit
        return [p for p in parts if mine(p)], [p for p in parts if not mine(p)]

    def manifest_of(self, version: str) -> dict:
        return json.loads(self._text(f"{version}.json"))

    def _put(self, name: str, text: str, replace: bool = False) -> None:
        """A whole file under its name or none. Without replace the name must be free."""
        fs, tmp, final = self._fs(), self._path(f"{name}.{uuid.uuid4().hex}.tmp"), self._path(name)
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if replace and fs.exists(final):
            fs.delete(final, False)
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise Conflict(f"{self.path}/{name} is there already")

    def _commit(self, df: DataFrame, parts: list[str], after: dict | None = None, note: dict | None = None) -> None:
        m = after or self.manifest()
        v = f"v{m['next']:06d}"
        # A version file that a failed commit left behind is of no manifest: it goes.
        self._put(f"{v}.json", json.dumps({"parts": parts, "schema": df.schema.jsonValue(), "note": note or {}}), replace=True)
        self._swap(m, [*m["versions"], v], m["next"] + 1)

    def _swap(self, before: dict, versions: list[str], following: int) -> None:
        self._put(f"manifest-{before['number'] + 1:010d}.json", json.dumps({"versions": versions, "next": following}))

    def _write(self, df: DataFrame, rows_per_file: int | None = None) -> list[str]:
        """The new data folders: one, or one a bucket."""
        part = f"data-{uuid.uuid4().hex}"
        if self.buckets:
            df = df.withColumn("__b", self._bucket()).repartition("__b")
        w = df.write.option("compression", "zstd")
        if rows_per_file:
            w = w.option("maxRecordsPerFile", rows_per_file)
        if not self.buckets:
            w.parquet(f"{self.path}/{part}")
            return [part]
        w.partitionBy("__b").parquet(f"{self.path}/{part}")
        found = self._fs().globStatus(self._path(f"{part}/__b=*")) or []
        return sorted(f"{part}/{x.getPath().getName()}" for x in found)

    def overwrite(self, df: DataFrame, rows_per_file: int | None = None, note: dict | None = None) -> None:
        self._commit(df, self._write(df, rows_per_file), note=note)

    def append(self, df: DataFrame) -> None:
        v = self.version()
        old = self.manifest_of(v)["parts"] if v else []
        self._commit(df, [*old, *self._write(df)])

    def merge(self, updates: DataFrame, keys: list[str], on_schema_change: str = "fail", newer: str | None = None, note: dict | None = None) -> None:
        """Rows of updates replace those of the same keys. newer: only where this column is larger than the stored one's.

        on_schema_change: fail, append_new_columns (old rows get nulls), or
        sync_all_columns (columns that updates lack go, too).
        """
        if not self.exists():
            self.overwrite(updates, note=note)
            return
        before = self.manifest()
        hit, rest = self._touched(updates)
        old = self._read(hit, T.StructType.fromJson(self.manifest_of(before["versions"][-1])["schema"]))
        if set(old.columns) != set(updates.columns):
            if on_schema_change == "fail":
                raise SchemaChanged(sorted(set(old.columns) ^ set(updates.columns)))
            if on_schema_change == "sync_all_columns":
                old = old.select([c for c in old.columns if c in updates.columns])
        if newer:
            stored = old.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(newer).alias("__newer"))
            same = [updates[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
            updates = updates.join(stored, same, "left").filter(F.col("__newer").isNull() | (F.col(newer) > F.col("__newer"))).select(updates.columns)
        kept = old.join(updates.select(*[F.col(k).alias(f"__{k}") for k in keys]), [old[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
        merged = kept.unionByName(updates, allowMissingColumns=True)
        self._commit(merged, [*rest, *self._write(merged)], before, note)

    def high_water(self, column: str, default):
        """The largest stored value of a column, or the default for an empty table."""
        if not self.exists():
            return default
        top = self.read().agg(F.max(column)).first()[0]
        return default if top is None else top

    def compact(self, files: int) -> None:
        self.overwrite(self.read().repartition(files))

    def vacuum(self, keep: int = 1) -> None:
        """Removes what the last `keep` versions don't read, and older manifests."""
        m = self.manifest()
        kept, gone = m["versions"][-keep:], m["versions"][:-keep]
        used = {p for v in kept for p in self.manifest_of(v)["parts"]}
        old = {p for v in gone for p in self.manifest_of(v)["parts"]} - used
        self._swap(m, kept, m["next"])
        for name in [*old, *(f"{v}.json" for v in gone), *(f"manifest-{n:010d}.json" for n in self._numbers() if n <= m["number"])]:
            self._fs().delete(self._path(name), True)


def assign_ids(values: DataFrame, column: str, known: DataFrame, id_col: str, first: int = 2) -> DataFrame:
    """(id_col, column) for values that `known` lacks: numbered after its largest id in sorted order."""
    from cairn.operators.ordering import global_number

    fresh = values.select(column).filter(F.col(column).isNotNull()).distinct().join(known.select(column), column, "left_anti")
    top = known.agg(F.max(id_col)).first()[0]
    return global_number(fresh, [F.col(column)], id_col, (top or first - 1) + 1).select(id_col, column)


def extend_dictionary(table: Table, values: DataFrame, column: str, id_col: str) -> None:
    """An append-only dictionary: ids that were given never change."""
    known = table.read() if table.exists() else values.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, T.LongType()), values.schema[column]]))
    fresh = assign_ids(values, column, known, id_col)
    if not fresh.isEmpty():
        table.append(fresh)


def changed_only(items: DataFrame, stored: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Items that are new or whose content hash is another."""
    s = stored.select(F.col(key).alias("__k"), F.col(hash_col).alias("__h"))
    return items.join(s, items[key] == s["__k"], "left").filter(~F.col(hash_col).eqNullSafe(F.col("__h"))).select(items.columns)


def gone_keys(items: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return stored.select(key).join(items.select(key), key, "left_anti")


def publish(table: Table, df: DataFrame, expected_rows: int | None = None, **fields) -> dict:
    """Data first, then a card with the row count; refuses when counts differ."""
    rows = df.count()
    if expected_rows is not None and rows != expected_rows:
        raise ValueError(f"{rows} rows instead of {expected_rows}")
    table.overwrite(df)
    card = {"rows": rows, "columns": df.columns, "version": table.version(), **fields}
    table._put("card.json", json.dumps(card | {"sha256": hashlib.sha256(json.dumps(card, sort_keys=True).encode()).hexdigest()}), replace=True)
    return card


def check_card(table: Table, columns: list[str]) -> DataFrame:
    """The published version, after its card was found to fit: the columns asked for, the version, and the row count."""
    card = json.loads(table._text("card.json"))
    digest = card.pop("sha256")
    if digest != hashlib.sha256(json.dumps(card, sort_keys=True).encode()).hexdigest():
        raise ValueError("the card was changed")
    missing = set(columns) - set(card["columns"])
    if missing:
        raise ValueError(f"columns {sorted(missing)} aren't published")
    df = table.read(card["version"])
    if df.count() != card["rows"]:
        raise ValueError("rows differ from the card")
    return df.select(*columns)


def cached(spark: SparkSession, path: str, key: str, build, refresh: bool = False) -> DataFrame:
    """A result kept as a table by key, built when it isn't there or is to be refreshed."""
    table = Table(spark, f"{path.rstrip('/')}/{key}")
    if refresh or not table.exists():
        table.overwrite(build())
    return table.read()
