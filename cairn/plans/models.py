"""The review model over the given tables: raw reviews, first copies, the ledger, weekly and cumulative counts.

Line items of orders stand for scraped reviews (their ids repeat), parts for games,
customers for users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.numbers import laplace_ratio, monday
from cairn.sources.tables import read

FIRST_TIME = "1970-01-01"


def raw_reviews(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("game_id"),
        (F.col("l_returnflag") != "R").alias("is_positive"),
        F.col("o_orderdate").alias("reviewed_at"),
        F.col("l_shipdate").cast("date").alias("scrape_date"),
        "l_suppkey",
        "l_extendedprice",
    )


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """The first-seen copy of each review."""
    w = Window.partitionBy("review_id").orderBy("scrape_date", "game_id", "l_suppkey", "l_extendedprice", "is_positive")
    return raw_reviews(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("review_id", "user_id", "game_id", "is_positive", "reviewed_at", "scrape_date")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """The first review of each user and game."""
    w = Window.partitionBy("user_id", "game_id").orderBy("reviewed_at", "review_id")
    return reviews(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "scrape_date")


def cumulative_counts(events: DataFrame) -> DataFrame:
    """One row per game and second with events, counts through it, and a 1970 row with none."""
    per = events.groupBy("game_id", F.col("reviewed_at").alias("ts")).agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("n"))
    w = Window.partitionBy("game_id").orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    counts = per.withColumns({"row": F.struct("ts", F.sum("p").over(upto).alias("positives"), F.sum("n").over(upto).alias("negatives")), "first": F.row_number().over(w) == 1})
    zero = F.lit(0).cast("long")
    base = F.struct(F.lit(FIRST_TIME).cast("timestamp_ntz").alias("ts"), zero.alias("positives"), zero.alias("negatives"))
    return counts.select("game_id", F.explode(F.when(F.col("first"), F.array(base, F.col("row"))).otherwise(F.array("row"))).alias("x")).select("game_id", "x.ts", "x.positives", "x.negatives")


def features(events: DataFrame) -> DataFrame:
    return cumulative_counts(events).withColumn("ratio", laplace_ratio(F.col("positives"), F.col("negatives")))


def weekly(events: DataFrame) -> DataFrame:
    return events.groupBy("game_id", monday(F.col("reviewed_at")).alias("week_start")).agg(F.count_if("is_positive").alias("positives"), F.count(F.lit(1)).alias("reviews"))


def activity(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("is_positive").alias("positives"), F.max("reviewed_at").alias("newest"))


def games(spark: SparkSession, d: str) -> DataFrame:
    """Parts as games, with the fields that parts lack made from their numbers."""
    p = read(spark, d, "part")
    key, size, words = F.col("p_partkey"), F.col("p_size"), F.split("p_name", " ")
    release = F.date_add(F.lit("1991-01-01").cast("date"), (key * 37 % 3650).cast("int"))
    return p.select(
        key.alias("game_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("developer"), F.col("p_type").alias("genre"), F.concat(F.array_distinct(words), F.array(F.concat(F.lit("z"), (size % 5).cast("string")))).alias("tags"),
        F.transform(F.concat(F.array_distinct(words), F.array(F.lit("z"))), lambda x, i: ((size + 1) * (i + 1) * 7 % 31).cast("long")).alias("weights"), F.array((size % 6).cast("int")).alias("descriptors"),
        (size <= 3).alias("is_free"), F.when(size <= 3, 0.0).otherwise(F.col("p_retailprice") / 100).alias("price"), (size == 50).alias("coming_soon"), F.when(size % 9 == 0, "Coming soon").otherwise(F.date_format(release, "MMM d, yyyy")).alias("release"),
    )


#: The same as common table expressions, for the oracles.
SQL = """
raw AS (SELECT l_orderkey * 10 + l_linenumber AS review_id, o_custkey AS user_id, l_partkey AS game_id, l_returnflag <> 'R' AS is_positive,
        o_orderdate AS reviewed_at, CAST(l_shipdate AS DATE) AS scrape_date, l_suppkey, l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
reviews AS (SELECT review_id, user_id, game_id, is_positive, reviewed_at, scrape_date FROM raw
            QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY scrape_date, game_id, l_suppkey, l_extendedprice, is_positive) = 1),
ledger AS (SELECT review_id, user_id, game_id, is_positive, reviewed_at FROM reviews
           QUALIFY row_number() OVER (PARTITION BY user_id, game_id ORDER BY reviewed_at, review_id) = 1),
counts AS (SELECT game_id, ts, CAST(sum(p) OVER w AS BIGINT) AS positives, CAST(sum(n) OVER w AS BIGINT) AS negatives
           FROM (SELECT game_id, reviewed_at AS ts, count_if(is_positive) AS p, count_if(NOT is_positive) AS n FROM ledger GROUP BY ALL)
           WINDOW w AS (PARTITION BY game_id ORDER BY ts ROWS UNBOUNDED PRECEDING)
           UNION ALL SELECT DISTINCT game_id, TIMESTAMP '1970-01-01', 0, 0 FROM ledger),
features AS (SELECT *, (positives + 1.0) / (positives + negatives + 2.0) AS ratio FROM counts),
weekly AS (SELECT game_id, CAST(date_trunc('week', reviewed_at) AS DATE) AS week_start, CAST(count_if(is_positive) AS BIGINT) AS positives, count(*) AS reviews FROM ledger GROUP BY ALL),
games AS (SELECT p_partkey AS game_id, p_name AS name, p_brand AS developer, p_type AS genre, list_concat(w, ['z' || (p_size % 5)]) AS tags,
        list_transform(range(1, len(w) + 2), lambda i: (p_size + 1) * i * 7 % 31) AS weights, [p_size % 6] AS descriptors, p_size <= 3 AS is_free, CASE WHEN p_size <= 3 THEN 0.0 ELSE p_retailprice / 100 END AS price, p_size = 50 AS coming_soon,
        CASE WHEN p_size % 9 = 0 THEN NULL ELSE DATE '1991-01-01' + CAST(p_partkey * 37 % 3650 AS INTEGER) END AS released
        FROM (SELECT *, list_transform(list_filter(list_zip(string_split(p_name, ' '), range(1, 99)), lambda z: z[1] IS NOT NULL AND list_position(string_split(p_name, ' '), z[1]) = z[2]), lambda z: z[1]) AS w FROM part)),
activity AS (SELECT user_id, count(*) AS reviews, CAST(count_if(is_positive) AS BIGINT) AS positives, max(reviewed_at) AS newest FROM ledger GROUP BY user_id)
"""


def with_model(sql: str) -> str:
    return f"WITH {SQL}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {SQL} {sql}"
