"""Queries around publishing and serving: lookups, plans of work, gates, sweeps, documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.operators import models, ordering
from cairn.operators import rules as R
from cairn.plans import models as M
from cairn.plans.registry import query
from cairn.sources.tables import read, run_sql

S = SparkSession


@query("sql_text", "S13 S14 S15 S16 K04 G03", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 10")
def sql_text(spark: S, d: str) -> DataFrame:
    """A statement with table names filled in, over views."""
    read(spark, d, "customer").createOrReplaceTempView("v_customer")
    read(spark, d, "nation").createOrReplaceTempView("v_nation")
    return run_sql(spark, "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 10", c="v_customer", n="v_nation")


@query("capped_users", "F17", M.with_model("SELECT user_id, game_id FROM ledger WHERE user_id IN (SELECT user_id FROM activity WHERE reviews <= 40)"))
def capped_users(spark: S, d: str) -> DataFrame:
    """Without the users of more than 40 reviews, who may be machines."""
    e = M.ledger(spark, d)
    return e.join(M.activity(e).filter("reviews <= 40").select("user_id"), "user_id", "left_semi").select("user_id", "game_id")


@query("weighted_partners", "T19", M.with_model("""
WITH c AS (SELECT game_id, count(*) AS w FROM ledger GROUP BY 1), l AS (SELECT game_id, sum(w) OVER (ORDER BY game_id) - w AS lo, sum(w) OVER (ORDER BY game_id) AS hi FROM c), p AS (SELECT o_orderkey, floor(((((o_orderkey % 1000003) * 2654435761 + 97 * 9 + 12345) % 1000003) * (SELECT sum(w) FROM c)::DOUBLE) / 1000003) AS x FROM orders)
SELECT o_orderkey, game_id FROM p JOIN l ON x >= lo AND x < hi"""))
def weighted_partners(spark: S, d: str) -> DataFrame:
    """A game for each order, popular ones more often."""
    c = M.ledger(spark, d).groupBy("game_id").agg(F.count(F.lit(1)).alias("w"))
    return ordering.weighted_pick(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", c, "game_id", "w", seed=9)


@query("merged_weeks", "T25", """
WITH RECURSIVE w AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n, row_number() OVER (ORDER BY CAST(date_trunc('month', o_orderdate) AS DATE)) AS i FROM orders GROUP BY 1),
r AS (SELECT i, m, n AS held, 0 AS bucket FROM w WHERE i = 1 UNION ALL SELECT w.i, w.m, CASE WHEN r.held >= 500 THEN w.n ELSE r.held + w.n END, CASE WHEN r.held >= 500 THEN r.bucket + 1 ELSE r.bucket END FROM r JOIN w ON w.i = r.i + 1)
SELECT m AS month, bucket FROM r""")
def merged_weeks(spark: S, d: str) -> DataFrame:
    """Months merged in order until each bucket has 500 orders; one row a month is folded, not the orders."""
    w = read(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    one = w.agg(F.array_sort(F.collect_list(F.struct("m", "n"))).alias("x"))
    return one.select(F.explode(F.arrays_zip(F.col("x.m").alias("m"), ordering.merged_buckets(F.col("x.n"), 500).alias("b"))).alias("z")).select(F.col("z.m").alias("month"), F.col("z.b").alias("bucket"))


@query("work_plan", "I19 T24 J34 I17", """
WITH c AS (SELECT c_custkey AS id, count(o_orderkey) AS stored, max(o_orderdate) AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT id, stored, CASE WHEN stored = 0 THEN 'new' WHEN stored >= 20 THEN 'capped' ELSE 'pending' END AS state, greatest(0, least(10, 20 - stored)) AS budget, CAST(ceil((greatest(0, least(10, 20 - stored)) + 1) / 5.0) AS BIGINT) AS requests FROM c""")
def work_plan(spark: S, d: str) -> DataFrame:
    """What is left to fetch for each key, and in how many requests."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("stored"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    budget = F.greatest(F.lit(0), F.least(F.lit(10), 20 - F.col("stored")))
    return c.select("id", "stored", F.when(F.col("stored") == 0, "new").when(F.col("stored") >= 20, "capped").otherwise("pending").alias("state"), budget.alias("budget"), F.ceil((budget + 1) / 5).alias("requests"))


@query("work_bins", "T23", """
WITH RECURSIVE c AS (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS customers, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS i FROM customer GROUP BY 1),
r AS (SELECT CAST(0 AS BIGINT) AS i, [0.0::DOUBLE, 0.0, 0.0, 0.0] AS loads, CAST(NULL AS BIGINT) AS worker UNION ALL
  SELECT c.i, list_transform(range(1, 5), lambda k: CASE WHEN k = list_position(loads, list_min(loads)) THEN loads[k] + c.customers ELSE loads[k] END), CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT) FROM r JOIN c ON c.i = r.i + 1)
SELECT nation, worker, customers FROM r JOIN c USING (i)""")
def work_bins(spark: S, d: str) -> DataFrame:
    """Nations dealt to 4 workers, the heaviest first to the lightest worker; a plan over 25 rows, on the driver."""
    n = [(r["c_nationkey"], float(r["n"])) for r in read(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).collect()]
    bins = ordering.balanced_bins(n, 4)
    return spark.createDataFrame([(k, bins[k], w) for k, w in n], "nation int, worker int, customers double")


_RANKS = """
WITH a AS (SELECT o_custkey AS g, o_orderkey, o_orderpriority = '1-URGENT' AS rel, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS p1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS p2 FROM orders WHERE o_orderdate >= greatest(TIMESTAMP '1994-01-01', TIMESTAMP '1995-01-01')),
t AS (SELECT g, min(p1) FILTER (rel) AS p1, min(p2) FILTER (rel) AS p2 FROM a GROUP BY g), m AS (SELECT round(avg(CASE WHEN p1 < 3 THEN 1.0 ELSE 0 END), 6) AS champion, round(avg(CASE WHEN p2 < 3 THEN 1.0 ELSE 0 END), 6) AS candidate FROM t)
SELECT champion, candidate, CASE WHEN candidate <= 0.1 THEN 'not above the baseline' WHEN candidate > champion + 0.01 THEN 'better than the champion' ELSE 'gain too small' END AS decision FROM m"""


@query("promotion_report", "E21 E30 E23", _RANKS)
def promotion_report(spark: S, d: str) -> DataFrame:
    """Two orders of the same lists on the rows after both cutoffs, and what the gate says."""
    start = F.greatest(F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1995-01-01").cast("timestamp_ntz"))
    u = Window.partitionBy("o_custkey")
    a = read(spark, d, "orders").filter(F.col("o_orderdate") >= start).withColumns({"p1": F.row_number().over(u.orderBy(F.col("o_totalprice").desc(), "o_orderkey")) - 1, "p2": F.row_number().over(u.orderBy(F.col("o_orderdate").desc(), "o_orderkey")) - 1})
    first = lambda p: F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col(p))).alias(p)
    hit = lambda p: F.round(F.avg(F.coalesce(F.col(p) < 3, F.lit(False)).cast("double")), 6)
    row = a.groupBy("o_custkey").agg(first("p1"), first("p2")).agg(hit("p1").alias("champion"), hit("p2").alias("candidate"))
    return row.withColumn("decision", R.promotion(F.col("candidate"), F.col("champion"), F.lit(0.1), 0.01))


@query("rollback_version", "", """
SELECT CAST(o_orderkey AS BIGINT) AS version FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 1""")
def rollback_version(spark: S, d: str) -> DataFrame:
    """Of a history of decisions the promoted version before the current one: the second newest."""
    h = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(2)
    return h.orderBy("o_orderdate", "o_orderkey").limit(1).select(F.col("o_orderkey").alias("version"))


@query("beta_sweep", "N18 N19", """
WITH b AS (SELECT unnest([0.0, 0.25, 1.0]) AS beta), s AS (SELECT beta, o_custkey AS g, o_orderpriority = '1-URGENT' AS rel, row_number() OVER (PARTITION BY beta, o_custkey ORDER BY o_totalprice + beta * (o_orderkey % 100) * 4096 DESC, o_orderkey) - 1 AS p FROM orders, b), t AS (SELECT beta, g, min(p) FILTER (rel) AS p, count(*) > 10 AS long FROM s GROUP BY ALL)
SELECT beta, long, count(*) AS n, round(avg(CASE WHEN p < 3 THEN 1.0 ELSE 0 END), 6) AS recall_3 FROM t GROUP BY ALL""")
def beta_sweep(spark: S, d: str) -> DataFrame:
    """recall@3 for several weights of a second score, by the length of the list; one pass for all weights."""
    o = read(spark, d, "orders").withColumn("beta", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(1.0))))
    score = F.col("o_totalprice") + F.col("beta") * (F.col("o_orderkey") % 100) * 4096
    s = o.withColumn("p", F.row_number().over(Window.partitionBy("beta", "o_custkey").orderBy(score.desc(), "o_orderkey")) - 1)
    t = s.groupBy("beta", "o_custkey").agg(F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("p"))).alias("p"), (F.count(F.lit(1)) > 10).alias("long"))
    return t.groupBy("beta", "long").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col("p") < 3, F.lit(False)).cast("double")), 6).alias("recall_3"))


@query("game_cards", "P22 K28 H31 P21", M.with_model("""
SELECT p_partkey AS game_id, p_name || ' | ' || p_brand || ' | ' || split_part(p_name, ' ', 1) AS card, coalesce(n, 0) AS reviews, coalesce(datediff('day', first_at, TIMESTAMP '1996-01-01') BETWEEN 0 AND 900, false) AS young
FROM part LEFT JOIN (SELECT game_id, count(*) AS n, min(reviewed_at) AS first_at FROM ledger GROUP BY 1) ON game_id = p_partkey"""))
def game_cards(spark: S, d: str) -> DataFrame:
    c = M.ledger(spark, d).groupBy("game_id").agg(F.count(F.lit(1)).alias("reviews"), F.min("reviewed_at").alias("first_at"))
    words = F.split("p_name", " ")
    p = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"), F.concat_ws(" | ", "p_name", "p_brand", F.array_join(F.slice(words, 1, 1), ",")).alias("card"))
    days = F.datediff(F.lit("1996-01-01").cast("date"), F.col("first_at").cast("date"))
    return p.join(c, "game_id", "left").select("game_id", "card", F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce(days.between(0, 900), F.lit(False)).alias("young"))


@query("attention_users", "V41 O07 Z13")
def attention_users(spark: S, d: str) -> DataFrame:
    """Users from the last 8 items of their histories through one attention layer and a dense layer with fixed weights."""
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 200).alias("user_id"), "vec_id", "embedding")
    lists = ordering.top_per_group(e, ["user_id"], [F.col("vec_id").desc()], 8).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "embedding"))), lambda x: x["embedding"]).alias("h"))
    rng = np.random.default_rng(0)
    wq, wk, wv, w = (rng.normal(size=(64, 16)) / 8 for _ in range(4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, here = np.zeros((b.num_rows, 8, 64)), np.zeros((b.num_rows, 8), bool)
            for i, h in enumerate(b.column(1).to_pylist()):
                x[i, : len(h)], here[i, : len(h)] = h, True
            y = models.tower(models.attention_summary(x, here, wq, wk, wv), [(w[:16], np.zeros(16))])
            yield pa.record_batch([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["user_id", "vector"])

    return lists.mapInArrow(run, "user_id long, vector array<double>")


@query("recency_columns", "H18 V05 G04 G05", M.with_model("""
WITH n AS (SELECT max(reviewed_at) AS t FROM ledger), g AS (SELECT game_id, count(*) FILTER (reviewed_at > t - INTERVAL 90 DAY) AS last90, min(reviewed_at) AS first_at, any_value(t) AS t FROM ledger, n GROUP BY 1)
SELECT game_id, CASE WHEN ((game_id % 1000003) * 2654435761 + 97 * 6 + 12345) % 1000003 < 100000 THEN 0 ELSE round(ln(1 + last90) * 0.1, 6) END AS recent, round(ln(1 + datediff('day', first_at, t)) * 0.1, 6) AS age FROM g"""))
def recency_columns(spark: S, d: str) -> DataFrame:
    """Recency features, a tenth of which are dropped by a hash."""
    e = M.ledger(spark, d)
    g = e.join(F.broadcast(e.agg(F.max("reviewed_at").alias("t")))).groupBy("game_id").agg(F.count_if(F.col("reviewed_at") > F.col("t") - F.expr("interval 90 days")).alias("last90"), F.min("reviewed_at").alias("first_at"), F.max("t").alias("t"))
    dropped = N.draw(F.col("game_id"), 6) < 100_000
    return g.select("game_id", F.when(dropped, 0.0).otherwise(F.round(F.log1p("last90") * 0.1, 6)).alias("recent"), F.round(F.log1p(F.datediff("t", "first_at")) * 0.1, 6).alias("age"))


@query("published_catalog", "K20 K21 K22 K05 S05 S11 O09 K09", """
SELECT p_partkey AS row_id, octet_length(encode(p_name)) AS bytes, CAST(coalesce(sum(octet_length(encode(p_name))) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM part WHERE p_size <= 45""")
def published_catalog(spark: S, d: str) -> DataFrame:
    """The items to serve with the places of their names in one run of bytes, published with a card and checked against it when read."""
    from cairn.operators.tables import Table, check_card, publish
    from cairn.sources.shared import scratch as shared

    names = read(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("row_id"), F.octet_length("p_name").cast("long").alias("bytes"))
    placed = ordering.running_sum(names, [F.col("row_id")], ["bytes"]).select("row_id", "bytes", F.col("bytes_before").cast("long").alias("byte_offset"))
    table = Table(spark, shared(spark, "catalog"))
    publish(table, placed, title="catalog")
    return check_card(table, ["row_id", "bytes", "byte_offset"])
