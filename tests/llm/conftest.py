import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_docs(spark):
    """The smallest documents table with nulls, empty texts, a repeated row, a text that is longer than a block of any operator, and columns with odd names."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "x"), (9004, " \n "), (9005, "wort " * 450_000 + ". Released under the MIT License."), (9006, "a row that is there twice"), (9006, "a row that is there twice")], "doc_id long, text string")
    more = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    return docs.union(more).withColumn("hash", F.lit(1)).withColumn("key", F.lit("k"))
