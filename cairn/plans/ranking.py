"""Point-in-time histories, splits, retrieval, ranking features, metrics and analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.operators import metrics as E
from cairn.operators import ordering, pit, retrieval
from cairn.plans import models as M
from cairn.plans.registry import query
from cairn.sources.tables import read

S = SparkSession
T0 = "1996-01-01"


def _t(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _orders(spark: S, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("ts"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("history_before", "H10 H11 H13 H20 H26 H28 R16", M.with_model("""
WITH pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reviewed_at, review_id) AS n FROM ledger WHERE is_positive),
k AS (SELECT l.review_id, l.user_id, max(p.n) AS upto FROM ledger l LEFT JOIN pos p ON p.user_id = l.user_id AND p.reviewed_at < l.reviewed_at GROUP BY ALL)
SELECT k.review_id, coalesce(string_agg(CAST(p.game_id + 2 AS VARCHAR), '|' ORDER BY p.n DESC), '') AS recent, count(p.n) > 0 AS warm FROM k LEFT JOIN pos p ON p.user_id = k.user_id AND p.n <= k.upto AND p.n > k.upto - 5 GROUP BY k.review_id"""))
def history_before(spark: S, d: str) -> DataFrame:
    """The last 5 liked games strictly before each review, newest first."""
    e = M.ledger(spark, d).withColumn("game_id", F.col("game_id") + N.FIRST_ID)  # 0 is padding
    h = pit.history(e.select("review_id", "user_id", "reviewed_at"), e.filter("is_positive"), "user_id", "reviewed_at", "game_id", 5, tie="review_id")
    real = F.filter("history", lambda x: x != 0)
    return h.select("review_id", F.array_join(real.cast("array<string>"), "|").alias("recent"), (F.size(real) > 0).alias("warm"))


@query("reviewed_before", "J21", M.with_model("""
SELECT r.review_id, coalesce(string_agg(DISTINCT CAST(e.game_id AS VARCHAR), '|' ORDER BY CAST(e.game_id AS VARCHAR)), '') AS games FROM ledger r LEFT JOIN ledger e ON e.user_id = r.user_id AND e.reviewed_at < r.reviewed_at AND e.game_id <> r.game_id GROUP BY 1"""))
def reviewed_before(spark: S, d: str) -> DataFrame:
    e = M.ledger(spark, d)
    out = pit.events_before(e, e.withColumn("game_id", F.col("game_id").cast("string")), "user_id", "reviewed_at", "game_id", "review_id", target="game_id")
    return out.select("review_id", F.array_join("items", "|").alias("games"))


@query("positives_after", "J22 J32 V25", M.with_model("""
SELECT r.review_id, count(DISTINCT e.game_id) AS n_after, CAST(coalesce(sum(DISTINCT e.game_id), 0) AS BIGINT) AS sum_after FROM ledger r LEFT JOIN ledger e ON e.user_id = r.user_id AND e.reviewed_at > r.reviewed_at AND e.game_id <> r.game_id AND e.is_positive GROUP BY 1"""))
def positives_after(spark: S, d: str) -> DataFrame:
    e = M.ledger(spark, d)
    out = pit.totals_before(e, e.filter("is_positive"), "user_id", "reviewed_at", "game_id", "review_id", target="game_id", after=True)
    return out.select("review_id", F.col("n").alias("n_after"), F.col("total").alias("sum_after"))


@query("previous_language", "J23", """
SELECT e.event_id, (SELECT arg_max(p.event_type, p.ts) FROM events p WHERE p.user_id = e.user_id AND floor(epoch(p.ts)) < floor(epoch(e.ts)) AND p.event_type <> 'view') AS previous FROM events e""")
def previous_language(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return pit.previous_value(e, "user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")), "previous").select("event_id", "previous")


@query("splits", "H14 H15 E23 T31", """
WITH r AS (SELECT o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders),
c AS (SELECT max(ts) FILTER (i = CAST(floor(n * 0.8) AS BIGINT) + 1) AS t1, max(ts) FILTER (i = CAST(floor(n * 0.9) AS BIGINT) + 1) AS t2, max(ts) AS newest FROM r)
SELECT o_orderkey, CASE WHEN o_orderdate < t1 THEN 'train' WHEN o_orderdate < t2 THEN 'validation' ELSE 'test' END AS by_share, CASE WHEN o_orderdate < newest - INTERVAL 42 DAY THEN 'train' WHEN o_orderdate < newest - INTERVAL 14 DAY THEN 'validation' ELSE 'test' END AS by_weeks FROM orders, c""")
def splits(spark: S, d: str) -> DataFrame:
    """Rows split by their share of all rows, and by weeks back from the newest."""
    r = ordering.global_number(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], "i")
    n = r.agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("newest"))
    r = r.join(F.broadcast(n))
    pick = lambda q: F.max(F.when(F.col("i") == F.floor(F.col("n") * q) + 1, F.col("o_orderdate")))
    cuts = r.agg(pick(0.8).alias("t1"), pick(0.9).alias("t2"))
    at, back = F.col("o_orderdate"), lambda k: F.col("newest") - F.expr(f"interval {k} days")
    return r.join(F.broadcast(cuts)).select("o_orderkey", F.when(at < F.col("t1"), "train").when(at < F.col("t2"), "validation").otherwise("test").alias("by_share"), F.when(at < back(42), "train").when(at < back(14), "validation").otherwise("test").alias("by_weeks"))


@query("catalog_at", "H16 H17 A18 K21", M.with_model("""
SELECT game_id, arg_max(positives, ts) AS positives, arg_max(negatives, ts) AS negatives, max(ts) AS as_of FROM features WHERE ts < TIMESTAMP '1996-01-01' AND game_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 45 OR p_retailprice > 1900) GROUP BY game_id"""))
def catalog_at(spark: S, d: str) -> DataFrame:
    """Each game's latest features strictly before a time, excluded games left out."""
    f = M.features(M.ledger(spark, d)).filter(F.col("ts") < _t(T0))
    bad = read(spark, d, "part").filter("p_size > 45 OR p_retailprice > 1900").select(F.col("p_partkey").alias("game_id"))
    return f.groupBy("game_id").agg(F.max_by("positives", "ts").alias("positives"), F.max_by("negatives", "ts").alias("negatives"), F.max("ts").alias("as_of")).join(bad, "game_id", "left_anti")


@query("snapshot_lists", "H25 H29 J31 I20 E20", M.with_model("""
SELECT user_id, count(*) FILTER (reviewed_at < TIMESTAMP '1996-01-01') AS seen, count(*) FILTER (reviewed_at >= TIMESTAMP '1996-01-01' AND reviewed_at < TIMESTAMP '1996-07-01' AND is_positive) AS relevant FROM ledger GROUP BY user_id
HAVING count(*) FILTER (reviewed_at < TIMESTAMP '1996-01-01') > 0 AND count(*) FILTER (reviewed_at >= TIMESTAMP '1996-01-01' AND reviewed_at < TIMESTAMP '1996-07-01' AND is_positive) > 0"""))
def snapshot_lists(spark: S, d: str) -> DataFrame:
    """Users active before a time who liked something new in the half year after it."""
    e = M.ledger(spark, d)
    before, after = F.col("reviewed_at") < _t(T0), (F.col("reviewed_at") >= _t(T0)) & (F.col("reviewed_at") < _t("1996-07-01")) & F.col("is_positive")
    sets = e.groupBy("user_id").agg(F.collect_set(F.when(before, F.col("game_id"))).alias("s"), F.collect_set(F.when(after, F.col("game_id"))).alias("r"))
    return sets.select("user_id", F.size("s").cast("long").alias("seen"), F.size(F.array_except("r", "s")).cast("long").alias("relevant")).filter("seen > 0 AND relevant > 0")


@query("query_groups", "H23 H24", M.with_model("""
WITH f AS (SELECT *, min(reviewed_at) FILTER (is_positive) OVER (PARTITION BY user_id) AS first_liked FROM ledger)
SELECT review_id, user_id, CASE WHEN reviewed_at < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS part FROM f WHERE is_positive AND first_liked < reviewed_at AND reviewed_at >= TIMESTAMP '1996-01-01'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ((review_id % 1000003) * 2654435761 + 97 * 4 + 12345) % 1000003, review_id) <= 4"""))
def query_groups(spark: S, d: str) -> DataFrame:
    """Liked games after a time by users who had liked one before, at most 4 a user."""
    e = M.ledger(spark, d).withColumn("first_liked", F.min(F.when(F.col("is_positive"), F.col("reviewed_at"))).over(Window.partitionBy("user_id")))
    warm = e.filter(F.col("is_positive") & (F.col("first_liked") < F.col("reviewed_at")) & (F.col("reviewed_at") >= _t(T0)))
    return ordering.cap_per_group(warm, "user_id", "review_id", 4, seed=4).select("review_id", "user_id", F.when(F.col("reviewed_at") < _t("1997-01-01"), "train").otherwise("test").alias("part"))


_EMB_SQL = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"


@query("nearest_items", "T13 J30 V03 G07 Z06", f"""
WITH e AS ({_EMB_SQL}) SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_dot_product(q.v, i.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, i.v) DESC, i.vec_id) AS rank
FROM e q JOIN e i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""")
def nearest_items(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    out = retrieval.dense_top_k(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 10, exclude_self=True)
    return out.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query("recommend_top_k", "T01 T02 T09 T10 V06", f"""
WITH e AS ({_EMB_SQL}), m AS (SELECT label, k, avg(v[k]) AS x FROM e, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL), q AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY k) AS v FROM m GROUP BY label),
s AS (SELECT query_id, vec_id AS item_id, list_dot_product(q.v, e.v) AS s FROM q JOIN e ON e.label <> q.query_id)
SELECT query_id, item_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM s QUALIFY rank <= 20""")
def recommend_top_k(spark: S, d: str) -> DataFrame:
    """Mean vectors of groups as users, items of the group itself excluded."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("query_id"))
    mean = e.select("query_id", F.posexplode("vector").alias("k", "x")).groupBy("query_id", "k").agg(F.avg("x").alias("x"))
    users = mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("vector"))
    out = retrieval.dense_top_k(users, e.select("item_id", "vector"), 20, exclude=e.select("query_id", "item_id"))
    return out.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query("popular_items", "T06 V04 O02", M.with_model("""
SELECT game_id, n, row_number() OVER (ORDER BY n DESC, game_id) AS rank, round(n / max(n) OVER (), 4) AS score FROM (SELECT game_id, count(*) AS n FROM ledger WHERE is_positive GROUP BY 1) ORDER BY n DESC, game_id LIMIT 50"""))
def popular_items(spark: S, d: str) -> DataFrame:
    counts = M.ledger(spark, d).filter("is_positive").groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return retrieval.popular(counts, "game_id", "n", 50).select("game_id", "n", "rank", "score")


@query("online_top_k", "T04", """
WITH s AS (SELECT o_custkey AS user_id, o_orderkey AS item, round(ln(o_totalprice), 4) AS score FROM orders)
SELECT user_id, item, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 5""")
def online_top_k(spark: S, d: str) -> DataFrame:
    """Scores rounded before they are ranked, ties to the lowest item."""
    s = _orders(spark, d).select("user_id", "item", F.log("o_totalprice").alias("score"))
    return ordering.top_scores(s, "user_id", "item", "score", 5, digits=4)


@query("rerank_and_blend", "T11 T30 O08 O20 T35", """
WITH a AS (SELECT o_custkey AS user_id, o_orderkey AS item, CASE WHEN o_orderkey % 9 <> 0 THEN -o_orderkey % 97 END AS second, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY second DESC NULLS LAST, rank) AS new_rank FROM a WHERE rank <= 10)
SELECT user_id, item, rank, new_rank, row_number() OVER (PARTITION BY user_id ORDER BY new_rank * 0.25 + rank * 0.75, rank) AS blend_rank FROM b""")
def rerank_and_blend(spark: S, d: str) -> DataFrame:
    top = ordering.top_per_group(_orders(spark, d), ["user_id"], [F.col("o_totalprice").desc(), F.col("item")], 10)
    second = top.withColumn("second", F.when(F.col("item") % 9 != 0, -F.col("item") % 97))
    return retrieval.blended(retrieval.rerank(second, "user_id", "rank", "second"), "user_id", "new_rank", "rank", 0.25).select("user_id", "item", "rank", "new_rank", "blend_rank")


@query("list_overlap", "T12 E07", """
WITH a AS (SELECT o_custkey AS u, o_orderkey AS i FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5), b AS (SELECT o_custkey AS u, o_orderkey AS i FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5)
SELECT count(*) AS users, round(avg(o), 6) AS overlap_5 FROM (SELECT a.u, count(b.i) / count(*) AS o FROM a LEFT JOIN b USING (u, i) GROUP BY 1)""")
def list_overlap(spark: S, d: str) -> DataFrame:
    o = _orders(spark, d)
    a = ordering.top_per_group(o, ["user_id"], [F.col("o_totalprice").desc(), F.col("item")], 5)
    b = ordering.top_per_group(o, ["user_id"], [F.col("ts").desc(), F.col("item")], 5)
    return retrieval.overlap(a, b, "user_id", "item", 5)


@query("retrieval_features", "V09", """
WITH a AS (SELECT o_custkey AS g, o_orderkey AS item, o_totalprice AS s, row_number() OVER w AS rank, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top, min(o_totalprice) OVER (PARTITION BY o_custkey) AS low FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT g, item, rank, round(1 - (rank - 1) / nullif(n - 1, 0), 6) AS percentile, round((s - top) / nullif(top - low, 0), 6) AS gap FROM a""")
def retrieval_features(spark: S, d: str) -> DataFrame:
    """Rank, percentile and gap of scores in a group: none depends on the scores' scale."""
    g = Window.partitionBy("user_id")
    a = _orders(spark, d).select("user_id", "item", F.col("o_totalprice").alias("s")).withColumn("rank", F.row_number().over(g.orderBy(F.col("s").desc(), "item"))).withColumns({"n": F.count(F.lit(1)).over(g), "top": F.max("s").over(g), "low": F.min("s").over(g)})
    return a.select(F.col("user_id").alias("g"), "item", F.col("rank").cast("long").alias("rank"), F.round(1 - F.try_divide(F.col("rank") - 1, F.col("n") - 1), 6).alias("percentile"), F.round(F.try_divide(F.col("s") - F.col("top"), F.col("top") - F.col("low")), 6).alias("gap"))


@query("tag_affinity", "V12 V13 V39", M.with_model("""
WITH h AS (SELECT user_id, game_id FROM ledger WHERE is_positive QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY reviewed_at DESC, review_id DESC) <= 20), t AS (SELECT p_partkey AS game_id, p_brand, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part),
tw AS (SELECT *, 1 / sqrt(count(*) OVER (PARTITION BY game_id)) AS w FROM t), pr AS (SELECT user_id, tag, sum(w) AS w FROM h JOIN tw USING (game_id) GROUP BY ALL), pn AS (SELECT user_id, sqrt(sum(w * w)) AS norm FROM pr GROUP BY 1), c AS (SELECT user_id, game_id FROM ledger WHERE NOT is_positive),
cs AS (SELECT c.user_id, c.game_id, sum(pr.w * tw.w) AS s FROM c JOIN tw ON tw.game_id = c.game_id JOIN pr ON pr.user_id = c.user_id AND pr.tag = tw.tag GROUP BY ALL), bh AS (SELECT user_id, p_brand, count(*) AS k FROM h JOIN part ON p_partkey = game_id GROUP BY ALL), bn AS (SELECT user_id, count(*) AS n FROM h GROUP BY 1)
SELECT c.user_id, c.game_id, round(coalesce(s, 0) / norm, 6) AS cosine, round(coalesce(k, 0) / bn.n, 6) AS brand_share FROM c JOIN pn USING (user_id) JOIN bn USING (user_id) JOIN part ON p_partkey = c.game_id LEFT JOIN cs USING (user_id, game_id) LEFT JOIN bh ON bh.user_id = c.user_id AND bh.p_brand = part.p_brand"""))
def tag_affinity(spark: S, d: str) -> DataFrame:
    """Cosine of candidates' tags with the tag profile of a history, and the history's share of the candidate's brand; all sparse."""
    e = M.ledger(spark, d)
    p = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"), "p_brand", "p_name")
    h = ordering.top_per_group(e.filter("is_positive"), ["user_id"], [F.col("reviewed_at").desc(), F.col("review_id").desc()], 20).select("user_id", "game_id")
    tags = F.array_distinct(F.split("p_name", " "))
    tw = p.select("game_id", F.explode(tags).alias("tag"), (1 / F.sqrt(F.size(tags))).alias("w"))
    profile = h.join(tw, "game_id").groupBy("user_id", "tag").agg(F.sum("w").alias("pw"))
    norm = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("norm"))
    c = e.filter("NOT is_positive").select("user_id", "game_id")
    s = c.join(tw, "game_id").join(profile, ["user_id", "tag"]).groupBy("user_id", "game_id").agg(F.sum(F.col("w") * F.col("pw")).alias("s"))
    hb = h.join(p, "game_id").groupBy("user_id", "p_brand").agg(F.count(F.lit(1)).alias("k"))
    n = h.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = c.join(norm, "user_id").join(n, "user_id").join(p, "game_id").join(s, ["user_id", "game_id"], "left").join(hb, ["user_id", "p_brand"], "left")
    return out.select("user_id", "game_id", F.round(F.coalesce("s", F.lit(0.0)) / F.col("norm"), 6).alias("cosine"), F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6).alias("brand_share"))


@query("ranking_metrics", "E01 E04 E05", """
WITH a AS (SELECT o_custkey AS g, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS p, o_orderpriority FROM orders), t AS (SELECT g, min(p) FILTER (o_orderpriority = '1-URGENT') AS p, count(*) > 10 AS warm FROM a GROUP BY g)
SELECT warm, count(*) AS n, round(avg(CASE WHEN p < 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN p < 1 THEN 1 / log2(p + 2) ELSE 0 END), 6) AS ndcg_1, round(avg(CASE WHEN p < 1 THEN 1 / (p + 1) ELSE 0 END), 6) AS mrr_1,
 round(avg(CASE WHEN p < 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN p < 10 THEN 1 / log2(p + 2) ELSE 0 END), 6) AS ndcg_10, round(avg(CASE WHEN p < 10 THEN 1 / (p + 1) ELSE 0 END), 6) AS mrr_10 FROM t GROUP BY warm""")
def ranking_metrics(spark: S, d: str) -> DataFrame:
    a = _orders(spark, d).withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("o_totalprice").desc(), "item")) - 1)
    t = a.groupBy("user_id").agg(F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("p"))).alias("p"), (F.count(F.lit(1)) > 10).alias("warm"))
    return E.single_target(t, "p", [1, 10], ["warm"])


@query("list_metrics", "E08", """
WITH a AS (SELECT o_custkey AS g, o_orderstatus = 'F' AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders), b AS (SELECT *, sum(CAST(rel AS INT)) OVER (PARTITION BY g ORDER BY r) AS h FROM a WHERE r <= 5 AND n > 0),
c AS (SELECT g, sum(CAST(rel AS INT)) AS k, max(n) AS n, sum(CASE WHEN rel THEN h / r ELSE 0 END) AS ap FROM b GROUP BY g) SELECT count(*) AS groups, round(avg(k / 5), 6) AS precision, round(avg(k / least(5, n)), 6) AS recall, round(avg(ap / least(5, n)), 6) AS map FROM c""")
def list_metrics(spark: S, d: str) -> DataFrame:
    u = Window.partitionBy("user_id")
    a = _orders(spark, d).select("user_id", (F.col("o_orderstatus") == "F").alias("rel"), F.row_number().over(u.orderBy(F.col("o_totalprice").desc(), "item")).alias("r"), F.count_if(F.col("o_orderstatus") == "F").over(u).alias("n"))
    return E.list_metrics(a, "user_id", "r", "rel", "n", 5)


@query("group_auc", "E06", """
SELECT count(*) AS groups, round(avg(a), 6) AS auc FROM (SELECT p.o_custkey, avg(CASE WHEN p.s > n.s THEN 1 WHEN p.s = n.s THEN 0.5 ELSE 0 END) AS a FROM (SELECT o_custkey, floor(o_totalprice / 50000) AS s FROM orders WHERE o_orderstatus = 'F') p JOIN (SELECT o_custkey, floor(o_totalprice / 50000) AS s FROM orders WHERE o_orderstatus <> 'F') n USING (o_custkey) GROUP BY 1)""")
def group_auc(spark: S, d: str) -> DataFrame:
    return E.group_auc(_orders(spark, d).select("user_id", F.floor(F.col("o_totalprice") / 50000).alias("s"), (F.col("o_orderstatus") == "F").alias("l")), "user_id", "s", "l")


@query("auc_and_spearman", "E16 E17 N07", """
WITH r AS (SELECT o_orderstatus = 'F' AS l, rank() OVER (ORDER BY floor(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY floor(o_totalprice / 1000)) - 1) / 2.0 AS a, rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) + (count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) - 1) / 2.0 AS b FROM orders)
SELECT count(*) AS n, round((sum(a) FILTER (l) - count(*) FILTER (l) * (count(*) FILTER (l) + 1) / 2) / (count(*) FILTER (l) * count(*) FILTER (NOT l)), 6) AS auc, round(corr(a, b), 6) AS spearman FROM r""")
def auc_and_spearman(spark: S, d: str) -> DataFrame:
    o = _orders(spark, d).select(F.floor(F.col("o_totalprice") / 1000).alias("s"), F.col("ts").cast("date").alias("day"), (F.col("o_orderstatus") == "F").alias("l"))
    return E.spearman(o, "s", "day").join(F.broadcast(E.auc(o, "s", "l"))).select("n", "auc", "spearman")


@query("gini_and_coverage", "E12 E13 E15 E26 E27", M.with_model("""
WITH c AS (SELECT p_partkey, count(game_id) AS n FROM part LEFT JOIN ledger ON game_id = p_partkey GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n, p_partkey) AS i, count(*) OVER () AS k FROM c)
SELECT round(sum((2 * i - k - 1) * n) / (max(k) * sum(n)), 6) AS gini, round(avg(CASE WHEN n > 20 THEN 1.0 ELSE 0 END), 6) AS coverage FROM r"""))
def gini_and_coverage(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "part").select(F.col("p_partkey").alias("game_id")).join(M.ledger(spark, d).groupBy("game_id").agg(F.count(F.lit(1)).alias("n")), "game_id", "left").fillna(0, ["n"])
    return E.gini(c, "n").join(F.broadcast(c.agg(F.round(F.avg((F.col("n") > 20).cast("double")), 6).alias("coverage"))))


@query("list_concentration", "E15 E28 E32", """
WITH a AS (SELECT o_custkey AS u, o_orderpriority AS i FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5), c AS (SELECT i, count(DISTINCT u) AS reach, count(*) AS n FROM a GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, i LIMIT 2)
SELECT (SELECT count(DISTINCT u) FROM a) AS users, (SELECT count(*) FROM c) AS distinct_items, round((SELECT max(reach) FROM t) / (SELECT count(DISTINCT u) FROM a), 6) AS top_reach, round((SELECT sum(n) FROM t) / (SELECT count(*) FROM a), 6) AS head_share""")
def list_concentration(spark: S, d: str) -> DataFrame:
    a = ordering.top_per_group(_orders(spark, d), ["user_id"], [F.col("o_totalprice").desc(), F.col("item")], 5)
    return E.concentration(a, "user_id", "o_orderpriority", top=2)


@query("embedding_health", "", f"""
WITH e AS ({_EMB_SQL}), s AS (SELECT k, sum(v[k]) AS x FROM e, (SELECT unnest(range(1, 65)) AS k) GROUP BY k), n AS (SELECT count(*) AS n FROM e) SELECT round((sum(x * x) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS mean_cosine FROM s, n""")
def embedding_health(spark: S, d: str) -> DataFrame:
    """The mean cosine of all pairs of unit vectors, from the length of their sum."""
    e = read(spark, d, "embeddings")
    s = e.select(F.posexplode("embedding").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("double")).alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return s.join(F.broadcast(n)).select(F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


@query("user_concentration", "N01 A36", """
WITH c AS (SELECT user_id, event_type AS l, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, CAST(sum(c) AS BIGINT) AS n, arg_min(l, (-c, l)) AS top, round(max(p), 6) AS top_share, round(-sum(p * log2(p)), 6) AS entropy, round(pow(2, -sum(p * log2(p))), 6) AS effective FROM p GROUP BY 1""")
def user_concentration(spark: S, d: str) -> DataFrame:
    return E.entropy(read(spark, d, "events"), "user_id", "event_type")


@query("profile_fit", "N03 N12", M.with_model("""
WITH t AS (SELECT review_id, user_id, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM ledger JOIN part ON p_partkey = game_id), n AS (SELECT user_id, count(*) AS n FROM ledger GROUP BY 1), k AS (SELECT user_id, tag, count(*) AS k FROM t GROUP BY ALL)
SELECT review_id, round(avg((k - 1) / nullif(n - 1, 0)), 6) AS fit FROM t JOIN k USING (user_id, tag) JOIN n USING (user_id) GROUP BY 1"""))
def profile_fit(spark: S, d: str) -> DataFrame:
    """How well a game's tags fit the user's other games: the game itself is subtracted from the counts."""
    tags = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag"))
    e = M.ledger(spark, d)
    t = e.join(tags, "game_id").select("review_id", "user_id", "tag")
    k = t.groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("k"))
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return t.join(k, ["user_id", "tag"]).join(n, "user_id").groupBy("review_id").agg(F.round(F.avg(F.try_divide((F.col("k") - 1).cast("double"), (F.col("n") - 1).cast("double"))), 6).alias("fit"))


@query("lag_similarity", "N04 N05 W16 W17 U08", M.with_model("""
WITH s AS (SELECT user_id, row_number() OVER w - 1 AS pos, list_distinct(string_split(p_name, ' ')) AS t, lag(list_distinct(string_split(p_name, ' ')), 1) OVER w AS t1, lag(list_distinct(string_split(p_name, ' ')), 2) OVER w AS t2, lag(list_distinct(string_split(p_name, ' ')), 3) OVER w AS t3
FROM ledger JOIN part ON p_partkey = game_id WINDOW w AS (PARTITION BY user_id ORDER BY reviewed_at, review_id)), f AS (SELECT * FROM s WHERE pos >= 3), u AS (SELECT 1 AS lag, t, t1 AS o FROM f UNION ALL SELECT 2, t, t2 FROM f UNION ALL SELECT 3, t, t3 FROM f)
SELECT lag, count(*) AS n, round(avg(len(list_intersect(t, o)) / len(list_distinct(list_concat(t, o)))), 6) AS similarity FROM u GROUP BY lag"""))
def lag_similarity(spark: S, d: str) -> DataFrame:
    """Similarity of a game's tags with those of the k-th game before it, on the same games for every k."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"), F.array_distinct(F.split("p_name", " ")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("reviewed_at", "review_id")
    s = M.ledger(spark, d).join(p, "game_id").withColumn("pos", F.row_number().over(w) - 1)
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("t", k).over(w).alias("o")) for k in (1, 2, 3)])
    u = s.withColumn("lags", lags).filter("pos >= 3").select("t", F.explode("lags").alias("x"))
    return u.groupBy("x.lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(N.jaccard(F.col("t"), F.col("x.o"))), 6).alias("similarity"))


@query("early_and_late", "N08 Y14", M.with_model("""
WITH f AS (SELECT *, min(reviewed_at) OVER (PARTITION BY game_id) AS first_at FROM ledger), a AS (SELECT *, reviewed_at < first_at + INTERVAL 365 DAY AS early FROM f)
SELECT game_id, count(*) FILTER (early) AS n_early, count(*) FILTER (NOT early) AS n_late, round(avg(CAST(is_positive AS INT)) FILTER (early) - avg(CAST(is_positive AS INT)) FILTER (NOT early), 6) AS diff, round(least(365 / greatest(datediff('day', min(first_at), TIMESTAMP '1999-01-01'), 1), 1), 6) AS expected FROM a GROUP BY 1"""))
def early_and_late(spark: S, d: str) -> DataFrame:
    f = M.ledger(spark, d).withColumn("first_at", F.min("reviewed_at").over(Window.partitionBy("game_id"))).withColumn("early", F.col("reviewed_at") < F.col("first_at") + F.expr("interval 365 days"))
    rate = lambda c: F.avg(F.when(c, F.col("is_positive").cast("int")))
    days = F.datediff(F.lit("1999-01-01").cast("date"), F.min("first_at").cast("date"))
    return f.groupBy("game_id").agg(F.count_if("early").alias("n_early"), F.count_if(~F.col("early")).alias("n_late"), F.round(rate(F.col("early")) - rate(~F.col("early")), 6).alias("diff"), F.round(F.least(365 / F.greatest(days, F.lit(1)), F.lit(1.0)), 6).alias("expected"))


@query("cluster_lift", "V33 T35", """
WITH t AS (SELECT p_brand AS cluster, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part), c AS (SELECT cluster, tag, count(*) AS c FROM t GROUP BY ALL), s AS (SELECT p_brand AS cluster, count(*) AS size FROM part GROUP BY 1), o AS (SELECT tag, count(*) / (SELECT count(*) FROM part) AS o FROM t GROUP BY 1)
SELECT cluster, tag, round((c / size) / o, 6) AS lift FROM c JOIN s USING (cluster) JOIN o USING (tag) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round((c / size) / o, 6) DESC, tag) <= 3""")
def cluster_lift(spark: S, d: str) -> DataFrame:
    p = read(spark, d, "part")
    t = p.select(F.col("p_brand").alias("cluster"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag"))
    c, s = t.groupBy("cluster", "tag").agg(F.count(F.lit(1)).alias("c")), p.groupBy(F.col("p_brand").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    o = c.groupBy("tag").agg(F.sum("c").alias("o")).join(F.broadcast(p.agg(F.count(F.lit(1)).alias("all"))))
    lift = c.join(s, "cluster").join(o, "tag").select("cluster", "tag", F.round((F.col("c") / F.col("size")) / (F.col("o") / F.col("all")), 6).alias("lift"))
    return ordering.top_per_group(lift, ["cluster"], [F.col("lift").desc(), F.col("tag")], 3).drop("rank")


@query("user_documents", "O11 O21 K14 X12", """
WITH a AS (SELECT o_custkey AS u, o_orderkey AS i, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT u AS user_id, string_agg(i || ':' || r, ',' ORDER BY r) AS items, count(*) AS n, substr(sha256(u || '|' || string_agg(CAST(i AS VARCHAR), ',' ORDER BY r)), 1, 32) AS content FROM a WHERE r <= 5 GROUP BY u""")
def user_documents(spark: S, d: str) -> DataFrame:
    """A document per user: its list by rank, and a hash of what is visible (scores aren't)."""
    from cairn.functions.text import content_hash

    top = ordering.top_per_group(_orders(spark, d), ["user_id"], [F.col("o_totalprice").desc(), F.col("item")], 5)
    docs = top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("l"))
    items = F.array_join(F.transform("l", lambda x: F.concat(x["item"].cast("string"), F.lit(":"), x["rank"].cast("string"))), ",")
    return docs.select("user_id", items.alias("items"), F.size("l").cast("long").alias("n"), content_hash(F.col("user_id"), F.array_join(F.col("l.item").cast("array<string>"), ",")).alias("content"))


@query("fallback_lists", "O04", M.with_model("""
SELECT c_custkey AS user_id, coalesce(a.reviews, 0) AS reviews, CASE WHEN a.reviews >= 30 THEN 'own' ELSE 'popular' END AS source FROM customer LEFT JOIN activity a ON a.user_id = c_custkey"""))
def fallback_lists(spark: S, d: str) -> DataFrame:
    """Users with enough reviews get their own list, others the popular one."""
    a = M.activity(M.ledger(spark, d)).select("user_id", "reviews")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(a, "user_id", "left")
    return c.select("user_id", F.coalesce("reviews", F.lit(0)).alias("reviews"), F.when(F.col("reviews") >= 30, "own").otherwise("popular").alias("source"))


@query("answer_checks", "O13", """
WITH a AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS x, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, n, len(list_filter(range(1, n + 1), lambda i: NOT list_contains(x, i))) AS missing, n - len(list_distinct(x)) AS duplicated, len(list_filter(list_distinct(x), lambda i: i > n)) AS unknown FROM a""")
def answer_checks(spark: S, d: str) -> DataFrame:
    """Is a list a permutation of 1..n? What is missing, repeated or unknown."""
    a = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"), F.count(F.lit(1)).alias("n"))
    want = F.sequence(F.lit(1), F.col("n").cast("int"))
    return a.select("l_orderkey", "n", F.size(F.array_except(want, F.col("x"))).cast("long").alias("missing"), (F.col("n") - F.size(F.array_distinct("x"))).alias("duplicated"), F.size(F.array_except(F.col("x"), want)).cast("long").alias("unknown"))
