"""Queries that run a stream to its end over the given tables and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.tables import Table
from cairn.plans.registry import query
from cairn.sources.shared import scratch as shared
from cairn.sources.tables import read
from cairn.streaming import incremental as I


def _events(spark: SparkSession, d: str) -> DataFrame:
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    schema = read(spark, d, "events").schema
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(files).isDirectory():
        return I.source(spark, f"{d}/events.parquet", schema)
    # A stream reads folders: of this one only the file of that name.
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _run(stream: DataFrame, mode: str, out: str) -> None:
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query("stream_first_seen", "I02 I05 I12 I18", "SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_id, event_type, user_id FROM events) GROUP BY ALL")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    out = shared(spark, "first-seen")
    e = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "event_type", "user_id", "ts")
    _run(I.first_seen(e, "ts", ["event_id"], "60 days"), "append", out)
    return spark.read.parquet(f"{out}/data").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_weekly_counts", "I06 A08 K11", "SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, CAST(count_if(value > 10) AS BIGINT) AS positives, count(*) AS reviews FROM events GROUP BY ALL")
def stream_weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling ISO weeks; each update of a window replaces what the table holds of it."""
    out = shared(spark, "weekly")
    e = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("good", F.col("value") > 10)
    table = Table(spark, f"{out}/table", buckets=16, by=["user_id"])

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.merge(batch, ["user_id", "week_start"])

    I.weekly_counts(e, "ts", "user_id", "good").writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query("stream_running_counts", "I01 I03 K01 K02 A15", "SELECT user_id, CAST(count_if(value > 10) AS BIGINT) AS good, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark: SparkSession, d: str) -> DataFrame:
    out = shared(spark, "running")
    e = _events(spark, d).select("user_id", F.when(F.col("value") > 10, 1).otherwise(0).cast("long").alias("good"), F.lit(1).cast("long").alias("n"))
    table = Table(spark, f"{out}/table", buckets=16, by=["user_id"])
    I.running_counts(e, table, "user_id", ["good", "n"], f"{out}/checkpoint").awaitTermination()
    return table.read().select("user_id", "good", "n")


@query("merged_table", "K05 K01 K03 K06 K07 K08 K12 I10 I11 S05", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v, CASE WHEN c_custkey % 3 = 0 THEN 'new' END AS note FROM customer""")
def merged_table(spark: SparkSession, d: str) -> DataFrame:
    """A table written, merged with new columns, compacted, and read at its last version."""
    table = Table(spark, shared(spark, "merged"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    table.overwrite(c, rows_per_file=1000)
    table.merge(c.filter("id % 3 = 0").select("id", (F.col("v") + 1).alias("v"), F.lit("new").alias("note")), ["id"], on_schema_change="append_new_columns")
    table.compact(2)
    table.vacuum()
    return table.read()
