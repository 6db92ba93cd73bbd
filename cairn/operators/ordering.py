"""Global numbering, top-k, deterministic samples and permutations."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.numbers import draw
from cairn.sources.shared import written


def global_number(df: DataFrame, order: list[Column], out: str, start: int = 1, partitions: int | None = None) -> DataFrame:
    """Rows numbered by a total order, without sending them to one task.

    Rows are range-partitioned and numbered inside; the driver sees one count a
    partition, whose running sum gives each partition its start. Ties in the order get
    any of their numbers. The ranged rows are written between the two passes, so that both
    see the same ranges, whatever executors are lost.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    bases, total = [], start
    for part, k in counts:
        bases.append((part, total))
        total += k
    base = spark.createDataFrame(bases, "__part int, __base long")
    w = Window.partitionBy("__part").orderBy(*order)
    return placed.join(F.broadcast(base), "__part").withColumn(out, (F.row_number().over(w) - 1 + F.col("__base")).cast("long")).drop("__part", "__base")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their place from 1; Spark keeps k a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def top_scores(scores: DataFrame, user: str, item: str, score: str, k: int, digits: int | None = None) -> DataFrame:
    """The best k items of each user, ties to the lowest item; scores rounded first if digits is given."""
    s = F.round(score, digits) if digits is not None else F.col(score)
    return top_per_group(scores.withColumn(score, s), [user], [F.col(score).desc(), F.col(item)], k)


def hash_order(id_col: str, seed: int) -> list[Column]:
    return [draw(F.col(id_col), seed), F.col(id_col)]


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer): those whose ids draw the smallest numbers."""
    return df.orderBy(*hash_order(id_col, seed)).limit(n)


def cap_per_group(df: DataFrame, by: str, id_col: str, cap: int, seed: int = 0) -> DataFrame:
    return top_per_group(df, [by], hash_order(id_col, seed), cap, "__n").drop("__n")


def permuted(df: DataFrame, id_col: str, column: str, seed: int = 0, within: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """df with one column's values dealt out anew: over all rows, or within groups. The values stay the same as a bag."""
    if within:
        by = Window.partitionBy(*within)
        a = df.withColumn("__p", F.row_number().over(by.orderBy(*(order or [id_col]))))
        b = df.select(*within, F.col(column).alias("__v"), F.row_number().over(by.orderBy(*hash_order(id_col, seed))).alias("__p"))
        return a.join(b, [*within, "__p"]).withColumn(column, F.col("__v")).select(df.columns)
    a = global_number(df, [F.col(id_col)], "__p")
    b = global_number(df.select(F.col(column).alias("__v"), id_col), hash_order(id_col, seed), "__p").select("__v", "__p")
    return a.join(b, "__p").withColumn(column, F.col("__v")).select(df.columns)


def balanced_bins(weights: list[tuple[int, float]], n: int) -> dict[int, int]:
    """Longest processing time first: each item, heaviest first, goes to the lightest bin. For plans on the driver."""
    heap = [(0.0, k) for k in range(n)]
    out = {}
    for item, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        out[item] = k
        heapq.heappush(heap, (load + w, k))
    return out


def merged_buckets(counts: Column, least: int) -> Column:
    """Bucket numbers for an ordered array of counts: neighbours are merged until each bucket has `least` (the last may have fewer)."""
    step = lambda s, x: F.struct(
        F.when(s["held"] >= least, x).otherwise(s["held"] + x).alias("held"),
        F.when(s["held"] >= least, s["bucket"] + 1).otherwise(s["bucket"]).alias("bucket"),
        F.concat(s["out"], F.array(F.when(s["held"] >= least, s["bucket"] + 1).otherwise(s["bucket"]))).alias("out"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("bucket"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(counts, zero, step, lambda s: s["out"])


def running_sum(df: DataFrame, order: list[Column], values: list[str], partitions: int | None = None) -> DataFrame:
    """df with `<value>_before` for each value: its sum over all rows earlier in a total order, by ranges and one sum a range."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "summed")
    sums = sorted(tuple(r) for r in placed.groupBy("__part").agg(*[F.sum(F.col(v).cast("double")).alias(v) for v in values]).collect())
    bases, held = [], [0.0] * len(values)
    for part, *add in sums:
        bases.append((part, *held))
        held = [a + b for a, b in zip(held, add, strict=True)]
    base = spark.createDataFrame(bases, "__part int, " + ", ".join(f"`__{v}` double" for v in values))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(base), "__part")
    for v in values:
        out = out.withColumn(f"{v}_before", F.coalesce(F.sum(F.col(v).cast("double")).over(w), F.lit(0.0)) + F.col(f"__{v}"))
    return out.drop("__part", *[f"__{v}" for v in values])


def weighted_pick(rows: DataFrame, id_col: str, items: DataFrame, item: str, weight: str, seed: int = 0, a_slot: int = 256) -> DataFrame:
    """rows with an item each, drawn with probability in proportion to a non-negative integer weight.

    Items lie one after another on a line, each as long as its weight; a row's draw is a
    point on it. Line and points are cut into slots, as many as there are `a_slot` items, so
    the range join is one on slots; an item that is longer than a slot lies in several.
    """
    slots = items.count() // a_slot + 1
    line = running_sum(items.filter(F.col(weight) > 0), [F.col(item)], [weight]).withColumn("__hi", F.col(f"{weight}_before") + F.col(weight))
    total = items.agg(F.sum(weight).cast("double").alias("__total"))
    at = lambda x: F.least(F.floor(x * slots / F.col("__total")), F.lit(slots - 1))
    line = line.join(F.broadcast(total)).withColumn("__slot", F.explode(F.sequence(at(F.col(f"{weight}_before")), at(F.col("__hi")))))
    point = F.floor((draw(F.col(id_col), seed) * F.col("__total")) / F.lit(1_000_003))
    placed = rows.join(F.broadcast(total)).withColumn("__x", point).withColumn("__slot", at(F.col("__x")))
    hit = placed.join(line.select("__slot", F.col(item).alias("__item"), F.col(f"{weight}_before").alias("__lo"), "__hi"), "__slot").filter("__x >= __lo AND __x < __hi")
    return hit.select(*rows.columns, F.col("__item").alias(item))
