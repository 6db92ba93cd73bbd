"""Structured Streaming forms of the incremental operators, for Parquet folders read with availableNow.

Each sink has its own checkpoint, so each consumes every row once, even after a run that
failed half way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.tables import Table


def source(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def first_seen(stream: DataFrame, ts: str, keys: list[str], late: str = "3 days") -> DataFrame:
    """The first copy of each key within the time that late data are waited for; state is bounded by it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def weekly_counts(stream: DataFrame, ts: str, by: str, positive: str, late: str = "3 days") -> DataFrame:
    """Positives and rows by key and ISO week, from Monday."""
    week = F.window(F.col(ts), "7 days", startTime="4 days")
    return stream.withWatermark(ts, late).groupBy(by, week.alias("w")).agg(F.count_if(positive).alias("positives"), F.count(F.lit(1)).alias("reviews")).select(by, F.col("w.start").cast("date").alias("week_start"), "positives", "reviews")


def session_counts(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(F.col(ts), gap)
    return stream.withWatermark(ts, late).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merge_into(stream: DataFrame, table: Table, keys: list[str], checkpoint: str, newer: str | None = None, order: list | None = None) -> StreamingQuery:
    """Each micro-batch is merged by keys; the last of a batch's rows for a key counts (by `order`, or any)."""

    def put(batch: DataFrame, _: int) -> None:
        from cairn.operators.ordering import top_per_group

        rows = top_per_group(batch, keys, order or [F.lit(1)], 1, "__r").drop("__r")
        if not rows.isEmpty():
            table.merge(rows, keys, newer=newer)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_ledger(stream: DataFrame, table: Table, keys: list[str], order: list, checkpoint: str) -> StreamingQuery:
    """An append-only ledger: of each key only the first row ever gets in."""

    def put(batch: DataFrame, _: int) -> None:
        from cairn.operators.ordering import top_per_group

        rows = top_per_group(batch, keys, order, 1, "__r").drop("__r")
        if table.exists():
            rows = rows.join(table.read().select(*keys), keys, "left_anti")
        if not rows.isEmpty():
            table.append(rows)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, table: Table, key: str, counts: list[str], checkpoint: str) -> StreamingQuery:
    """Stateful totals by key: what a batch adds is put on top of the stored state, and only the buckets of touched keys are read and written. A batch that is run again after a failure adds nothing: its number is noted with the version."""

    def put(batch: DataFrame, number: int) -> None:
        add = batch.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])
        if table.exists():
            if table.note().get("batch", -1) >= number:
                return
            old = table.near(add).select(key, *[F.col(c).alias(f"__{c}") for c in counts])
            add = add.join(old, key, "left").select(key, *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in counts])
        if not add.isEmpty():
            table.merge(add, [key], note={"batch": number})

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
