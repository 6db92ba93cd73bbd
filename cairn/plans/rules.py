"""Queries of rules: suitable games, explanations, cursors, gates, resolution of names, lists to serve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.operators import ordering
from cairn.operators import rules as R
from cairn.plans import models as M
from cairn.plans.registry import query
from cairn.sources.shared import scratch
from cairn.sources.tables import read, read_declared

S = SparkSession


@query("suitable_games", "F19 F20 F21 F23 F24 F25 S10 X08", M.with_model("""
WITH v AS (SELECT *, list_sum(list_transform(list_zip(tags, weights), lambda z: CASE WHEN z[1] IN ('small', 'z1') THEN z[2] ELSE 0 END)) AS own, list_sum(weights) AS total,
  list_max(list_transform(list_zip(tags, weights), lambda z: CASE WHEN z[1] IN ('small', 'z1') THEN z[2] ELSE 0 END)) AS own_top, list_max(weights) AS top FROM games),
a AS (SELECT *, regexp_matches(name, '(?i)\\b(?:cold|hot\\w*)\\b') AS by_name, genre IN ('PROMO') AS by_genre, list_contains(descriptors, 3) AS by_descriptor,
  coalesce(own / nullif(total, 0) >= 0.17 OR (own / nullif(total, 0) >= 0.10 AND own_top > 0 AND own_top >= top), false) AS by_votes, game_id IN (SELECT game_id FROM ledger WHERE reviewed_at < TIMESTAMP '1994-01-01') AS reviewed FROM v)
SELECT game_id, by_name, by_genre, by_votes, by_descriptor, by_name OR by_genre OR by_votes OR by_descriptor OR coming_soon AS excluded, reviewed OR coalesce(released < DATE '1996-01-01', false) AS looks_released, CAST(year(released) AS INTEGER) AS year FROM a"""))
def suitable_games(spark: S, d: str) -> DataFrame:
    """Games for adults by four signs (marked with stand-in words), those not released, and those that look released."""
    g = M.games(spark, d).withColumn("released", N.release_date(F.col("release")))
    seen = M.ledger(spark, d).filter(F.col("reviewed_at") < F.lit("1994-01-01").cast("timestamp_ntz")).select("game_id").distinct().withColumn("reviewed", F.lit(True))
    genres, words, tags = F.array("genre"), ["cold", r"hot\w*"], ["small", "z1"]
    is_adult = R.adult(F.col("name"), genres, F.col("tags"), F.col("weights"), F.col("descriptors"), words, ["PROMO"], tags)
    return g.join(seen, "game_id", "left").select(
        "game_id", R.adult_name(F.col("name"), words).alias("by_name"), R.adult_genres(genres, ["PROMO"]).alias("by_genre"), R.adult_votes(F.col("tags"), F.col("weights"), tags).alias("by_votes"), F.array_contains("descriptors", 3).alias("by_descriptor"),
        (is_adult | F.col("coming_soon")).alias("excluded"), R.looks_released(F.col("released"), F.col("reviewed"), F.lit("1996-01-01").cast("date")).alias("looks_released"), F.year("released").alias("year"),
    )


@query("explanations", "O14 O15 O16 X05", M.with_model("""
WITH c AS (SELECT a.*, b.name AS n1, b.developer AS d1, b.genre AS g1, b.tags AS t1, e.name AS n2, e.developer AS d2, e.genre AS g2, e.tags AS t2 FROM games a JOIN games b ON b.game_id = (a.game_id * 7 + 3) % (SELECT count(*) FROM part) JOIN games e ON e.game_id = (a.game_id * 11 + 5) % (SELECT count(*) FROM part)),
x AS (SELECT *, CASE game_id % 4 WHEN 0 THEN 'You will like ' || upper(name) || '!' WHEN 1 THEN 'Much like  ' || n1 || ', only better.' WHEN 2 THEN 'A fine choice for you.' ELSE repeat('word ', 30) || n1 END AS text FROM c),
r AS (SELECT *, CASE WHEN length(n2) > length(n1) THEN n2 ELSE n1 END AS l1, CASE WHEN length(n2) > length(n1) THEN n1 ELSE n2 END AS l2, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS low FROM x),
s AS (SELECT *, regexp_replace(regexp_replace(low, '\\b' || lower(l1) || '\\b', ' ', 'g'), '\\b' || lower(l2) || '\\b', ' ', 'g') AS rest FROM r)
SELECT game_id, CASE WHEN length(text) > 120 THEN 'too long' WHEN regexp_matches(rest, '\\b' || lower(name) || '\\b') THEN 'names the candidate'
  WHEN NOT list_bool_or(list_transform(list_filter(list_concat(list_concat([n1, n2, developer, d1, d2, genre, g1, g2], tags), list_concat(t1, t2)), lambda t: length(t) >= 3), lambda t: regexp_matches(low, '\\b' || lower(t) || '\\b'))) THEN 'not grounded' END AS problem,
  CASE WHEN d1 = developer THEN 'Because you liked ' || n1 || ', from the same studio (' || d1 || ').' WHEN g1 = genre THEN 'Because you liked ' || n1 || ', which is also ' || g1 || '.' WHEN d2 = developer THEN 'Because you liked ' || n2 || ', from the same studio (' || d2 || ').'
  WHEN g2 = genre THEN 'Because you liked ' || n2 || ', which is also ' || g2 || '.' ELSE 'Because you liked ' || n1 || '.' END AS template FROM s"""))
def explanations(spark: S, d: str) -> DataFrame:
    """Texts for a candidate and two liked games: what is wrong with them, and what the data alone would say."""
    g = M.games(spark, d).select("game_id", F.struct("name", F.array("developer").alias("developers"), F.array("genre").alias("genres"), "tags").alias("game"))
    n = g.agg(F.count(F.lit(1)).alias("n"))
    a = g.join(F.broadcast(n)).withColumns({"k1": (F.col("game_id") * 7 + 3) % F.col("n"), "k2": (F.col("game_id") * 11 + 5) % F.col("n")})
    by = lambda k: g.select(F.col("game_id").alias(k), F.col("game").alias(f"g{k}"))
    c = a.join(by("k1"), "k1").join(by("k2"), "k2").withColumn("liked", F.array("gk1", "gk2"))
    own, one = F.col("game.name"), F.col("gk1.name")
    kind = F.col("game_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("You will like "), F.upper(own), F.lit("!"))).when(kind == 1, F.concat(F.lit("Much like  "), one, F.lit(", only better."))).when(kind == 2, "A fine choice for you.").otherwise(F.concat(F.repeat(F.lit("word "), 30), one))
    return c.withColumn("text", text).select("game_id", R.explanation_problem(F.col("text"), F.col("game"), F.col("liked"), 120).alias("problem"), R.template_explanation(F.col("game"), F.col("liked")).alias("template"))


_CURSORS = """
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 800000000 + c_custkey END AS oldest, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS complete, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 7 * 60 END AS total,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 25 END AS stored, ['pending', 'scraped', 'unavailable', 'failed', 'pending'][c_custkey % 5 + 1] AS status, c_custkey % 4 AS attempts FROM customer),
f AS (SELECT o_custkey AS id, CAST(epoch(min(o_orderdate)) AS BIGINT) AS found_oldest, count(DISTINCT o_orderkey) AS found FROM orders GROUP BY 1),
j AS (SELECT * FROM c LEFT JOIN f USING (id))"""


@query("cursor_states", "K29 K30 K31 K32 I14 I15 I16 F26 A41", _CURSORS + """
SELECT id, oldest IS NOT NULL AND NOT coalesce(complete, false) AS pending, CAST(CASE WHEN oldest IS NULL OR coalesce(complete, false) THEN 0 WHEN stored IS NULL THEN 10 ELSE greatest(0, least(10, 20 - stored)) END AS BIGINT) AS budget,
  CASE WHEN oldest IS NULL AND complete IS NULL THEN found_oldest ELSE oldest END AS seeded_oldest, CASE WHEN oldest IS NULL AND complete IS NULL THEN CASE WHEN found IS NULL THEN true ELSE found >= coalesce(total, 0) END ELSE complete END AS seeded_complete,
  CASE WHEN complete AND oldest IS NOT NULL AND coalesce(stored, found, 0) < 22 AND total IS NOT NULL AND total - coalesce(found, 0) > greatest(100, floor(total * 0.01)) THEN coalesce(found, 0) END AS reopened,
  CASE WHEN status = 'scraped' THEN 'pending' ELSE status END AS requeued, CASE WHEN attempts + 1 >= 3 AND status = 'pending' THEN 'failed' ELSE status END AS failed, attempts + 1 AS attempts FROM j""")
def cursor_states(spark: S, d: str) -> DataFrame:
    """Decisions over cursors and what was found for them: pending, budget, seeding, opening again, queueing again, failing."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(
        k.alias("id"), F.when(k % 3 != 0, 800_000_000 + k).alias("oldest"), F.when(k % 4 == 1, False).when(k % 4 != 0, True).alias("complete"), F.when(k % 11 != 0, k % 7 * 60).alias("total"), F.when(k % 6 != 0, k % 25).alias("stored"),
        F.get(F.array(*map(F.lit, ["pending", "scraped", "unavailable", "failed", "pending"])), (k % 5).cast("int")).alias("status"), (k % 4).alias("attempts"),
    )
    f = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(N.seconds(F.min("o_orderdate")).alias("found_oldest"), F.countDistinct("o_orderkey").alias("found"))
    j = c.join(f, "id", "left")
    oldest, complete, stored, found, total = (F.col(x) for x in ("oldest", "complete", "stored", "found", "total"))
    pending = R.backfill_pending(oldest, complete)
    seeded_oldest, seeded_complete = R.seeded(oldest, complete, F.col("found_oldest"), found, total)
    status, attempts = R.after_failure(F.col("status"), F.col("attempts"), 3)
    return j.select(
        "id", pending.alias("pending"), R.backfill_budget(pending, stored, 10, 20).alias("budget"), seeded_oldest.alias("seeded_oldest"), seeded_complete.alias("seeded_complete"), R.reopened(oldest, complete, stored, found, total, 22).alias("reopened"),
        R.requeued(F.col("status")).alias("requeued"), status.alias("failed"), attempts.alias("attempts"),
    )


@query("publication_due", "K10", """
SELECT n_nationkey, n_nationkey % 3 = 0 OR n_nationkey % 3 = 1 OR TIMESTAMP '1996-01-08' - INTERVAL 7 DAY >= TIMESTAMP '1996-01-12' - n_nationkey * INTERVAL 1 DAY AS due FROM nation""")
def publication_due(spark: S, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    stored = F.when(n % 3 == 1, "another").when(n % 3 == 2, "games")
    at = F.lit("1996-01-12").cast("timestamp_ntz") - F.make_dt_interval(n)
    return read(spark, d, "nation").select("n_nationkey", R.publish_due(stored, F.lit("games"), at, F.lit("1996-01-08").cast("timestamp_ntz"), 7).alias("due"))


@query("gates", "E21 E22 E24", """
WITH c AS (SELECT s_suppkey AS pair, s_nationkey AS run, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE (s_suppkey * 7 % 100) / 100 END AS reach, (s_suppkey * 31 % 100) / 100 AS recall, (s_suppkey * 17 % 100) / 100 AS ndcg FROM supplier),
r AS (SELECT n_nationkey AS run, n_nationkey % 2 = 0 AS changed, (n_nationkey * 13 % 100) / 100 AS reach, (n_nationkey * 29 % 50) / 100 AS new_recall, (n_nationkey * 11 % 40) / 100 AS old_recall, (n_nationkey * 7 % 10) / 10 AS new_ceiling, (n_nationkey * 3 % 10) / 10 AS old_ceiling, 0.5 AS recall, 0.1 AS ndcg FROM nation),
b AS (SELECT * FROM c WHERE reach IS NULL OR reach <= 0.6 QUALIFY row_number() OVER (PARTITION BY run ORDER BY recall DESC, ndcg DESC, pair) = 1),
x AS (SELECT r.*, b.pair, CASE WHEN r.changed AND r.reach > 0.6 THEN 'one item in too many lists' WHEN r.changed AND NOT r.new_recall > r.old_recall + 0.001 THEN 'retrieval not better' WHEN r.changed AND r.new_ceiling < r.old_ceiling THEN 'ceiling fell'
  WHEN b.pair IS NULL THEN 'every challenger floods' WHEN b.recall > r.recall + 0.002 AND b.ndcg >= r.ndcg THEN 'better' ELSE 'final lists not better' END AS reason FROM r LEFT JOIN b USING (run)),
h AS (SELECT run, pair, pair AS ts FROM c), l AS (SELECT run, max_by(pair, ts) AS now FROM h GROUP BY run),
k AS (SELECT h.run, max_by(h.pair, h.ts) AS back FROM h JOIN l ON l.run = h.run AND h.pair <> l.now GROUP BY h.run)
SELECT x.run, CASE WHEN reason = 'better' THEN pair END AS winner, reason, CASE WHEN new_recall <= 0.05 THEN 'not above the baseline' WHEN x.run % 5 = 0 THEN 'first champion' WHEN new_recall > old_recall + 0.01 THEN 'better than the champion' ELSE 'gain too small' END AS single, back FROM x LEFT JOIN k ON k.run = x.run""")
def gates(spark: S, d: str) -> DataFrame:
    """Pairs against the serving pair of each run, one candidate against its champion, and the pair to go back to."""
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    part = lambda c, m, k: ((c * m % k) / F.lit(100 if k > 10 else 10)).cast("double")
    c = read(spark, d, "supplier").select(s.alias("pair"), F.col("s_nationkey").alias("run"), F.when(s % 13 != 0, part(s, 7, 100)).alias("reach"), part(s, 31, 100).alias("recall"), part(s, 17, 100).alias("ndcg"))
    r = read(spark, d, "nation").select(n.alias("run"), (n % 2 == 0).alias("changed"), part(n, 13, 100).alias("reach"), part(n, 29, 50).alias("new_recall"), part(n, 11, 40).alias("old_recall"), part(n, 7, 10).alias("new_ceiling"), part(n, 3, 10).alias("old_ceiling"), F.lit(0.5).alias("recall"), F.lit(0.1).alias("ndcg"))
    single = R.promotion(F.col("new_recall"), F.when(F.col("run") % 5 != 0, F.col("old_recall")), F.lit(0.05), 0.01)
    back = R.rollback(c.select("run", "pair", F.col("pair").alias("at"), F.lit("promote").alias("action")), "run", "at", "action", "pair").withColumnRenamed("pair", "back")
    return R.pair_promotion(r, c, 0.6, 0.001, 0.002).join(r.select("run", single.alias("single")), "run").join(back, "run", "left")


@query("games_resolved", "J08 J10 J11 U03 H04", """
WITH first AS (SELECT p_partkey AS game_id, lower(p_name) AS key, p_size AS score, p_retailprice AS price, 1 AS batch FROM part WHERE p_partkey % 3 <> 0),
stored AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, price DESC, game_id) = 1),
scrapes AS (SELECT p_partkey AS game_id, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' II' ELSE p_name END AS name, p_size + p_partkey % 2 AS score, p_retailprice AS price, 2 AS batch FROM part WHERE p_partkey % 4 <> 0),
fresh AS (SELECT s.game_id, coalesce(t.key, lower(s.name)) AS key, s.score, s.price, s.batch FROM scrapes s LEFT JOIN stored t USING (game_id)),
w AS (SELECT * FROM (SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE game_id NOT IN (SELECT game_id FROM fresh)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, price DESC, game_id) = 1)
SELECT w.game_id, w.key, w.batch, coalesce(s.name, p.p_name) AS name, l.n IS NOT NULL AS sold FROM w JOIN part p ON p.p_partkey = w.game_id LEFT JOIN scrapes s ON s.game_id = w.game_id AND s.batch = w.batch
LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_partkey = w.game_id""")
def games_resolved(spark: S, d: str) -> DataFrame:
    """One game a name over two batches: a stored game keeps its key when it is renamed, and new rows compete with the winners so far."""
    p = read(spark, d, "part")
    key, best = F.col("p_partkey"), [F.col("score").desc(), F.col("price").desc(), F.col("game_id")]
    first = p.filter(key % 3 != 0).select(key.alias("game_id"), F.lower("p_name").alias("key"), F.col("p_size").alias("score"), F.col("p_retailprice").alias("price"), F.lit(1).alias("batch"))
    stored = ordering.top_per_group(first, ["key"], best, 1).drop("rank")
    scrapes = p.filter(key % 4 != 0).select(key.alias("game_id"), F.when(key % 5 == 0, F.concat("p_name", F.lit(" II"))).otherwise(F.col("p_name")).alias("name"), (F.col("p_size") + key % 2).cast("int").alias("score"), F.col("p_retailprice").alias("price"), F.lit(2).alias("batch"))
    fresh = scrapes.join(stored.select("game_id", F.col("key").alias("known")), "game_id", "left").select("game_id", F.coalesce("known", F.lower("name")).alias("key"), "score", "price", "batch")
    w = ordering.top_per_group(fresh.unionByName(stored.join(fresh, "game_id", "left_anti")), ["key"], best, 1)
    sold = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("game_id"), F.lit(True).alias("hit")).distinct()
    out = w.join(p.select(key.alias("game_id"), "p_name"), "game_id").join(scrapes.select("game_id", "batch", F.col("name").alias("scraped")), ["game_id", "batch"], "left").join(sold, "game_id", "left")
    return out.select("game_id", "key", "batch", F.coalesce("scraped", "p_name").alias("name"), F.col("hit").isNotNull().alias("sold"))


@query("encoded_tags", "J12 A06 R05 S26 R11", M.with_model("""
WITH t AS (SELECT game_id, unnest(tags) AS tag, unnest(weights) AS weight FROM games), lkp AS (SELECT tag, row_number() OVER (ORDER BY tag) + 1 AS id FROM (SELECT DISTINCT tag FROM t WHERE tag <> 'z4')),
top AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY weight DESC, tag) AS r FROM t)
SELECT game_id, string_agg(coalesce(CAST(id AS VARCHAR), '1'), '|' ORDER BY r) AS ids, string_agg(tag, '|' ORDER BY r) AS tags, max(id) FILTER (r = 1) AS first_id FROM top LEFT JOIN lkp USING (tag) WHERE r <= 2 GROUP BY game_id"""))
def encoded_tags(spark: S, d: str) -> DataFrame:
    """The two heaviest tags of each game, encoded by one row that holds the whole dictionary; unknown ones are 1. The dictionary is numbered and counted first: only one of at most 100,000 names is made a map, a larger one is joined."""
    t = M.games(spark, d).select("game_id", F.explode(F.arrays_zip("tags", "weights")).alias("x")).select("game_id", F.col("x.tags").alias("tag"), F.col("x.weights").alias("weight"))
    names = ordering.global_number(t.filter("tag <> 'z4'").select("tag").distinct(), [F.col("tag")], "id", 2)
    top = ordering.top_per_group(t, ["game_id"], [F.col("weight").desc(), F.col("tag")], 2)
    lists = top.groupBy("game_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    if names.count() > 100_000:
        known = top.join(names, "tag", "left").groupBy("game_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("id", F.lit(N.UNSEEN).cast("long")).alias("id")))), lambda x: x["id"]).alias("ids"))
        out = lists.join(known, "game_id")
    else:
        maps = names.agg(F.map_from_entries(F.collect_list(F.struct("tag", "id"))).alias("m"))
        out = lists.crossJoin(F.broadcast(maps)).withColumn("ids", N.encode(F.col("tags"), F.col("m")))
    first = F.get("ids", F.lit(0))
    return out.select("game_id", F.array_join(F.col("ids").cast("array<string>"), "|").alias("ids"), F.array_join("tags", "|").alias("tags"), F.when(first > N.UNSEEN, first).alias("first_id"))


@query("touched_weeks", "J13 I06 I07", M.with_model("""
WITH t AS (SELECT DISTINCT game_id, CAST(date_trunc('week', reviewed_at) AS DATE) AS week_start FROM reviews WHERE scrape_date >= (SELECT max(scrape_date) - 30 FROM reviews)),
c AS (SELECT DISTINCT game_id FROM t) SELECT l.game_id, CAST(date_trunc('week', reviewed_at) AS DATE) AS week_start, CAST(count_if(is_positive) AS BIGINT) AS positives, count(*) AS reviews, t.week_start IS NOT NULL AS touched
FROM ledger l JOIN c ON c.game_id = l.game_id LEFT JOIN t ON t.game_id = l.game_id AND t.week_start = CAST(date_trunc('week', reviewed_at) AS DATE) GROUP BY ALL"""))
def touched_weeks(spark: S, d: str) -> DataFrame:
    """The weeks of games that a new batch touches are counted anew, and all others of these games come out again."""
    r = M.reviews(spark, d)
    since = r.agg(F.date_sub(F.max("scrape_date"), 30).alias("since"))
    t = r.join(F.broadcast(since)).filter("scrape_date >= since").select("game_id", N.monday(F.col("reviewed_at")).alias("week_start")).distinct()
    weeks = M.weekly(M.ledger(spark, d)).join(t.select("game_id").distinct(), "game_id", "left_semi")
    return weeks.join(t.withColumn("hit", F.lit(True)), ["game_id", "week_start"], "left").select("game_id", "week_start", "positives", "reviews", F.col("hit").isNotNull().alias("touched"))


@query("json_lines", "K17 K19 K12 S28 S01 S02", """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, round(c_acctbal, 1) AS balance, c_custkey % 3 <> 0 AS has_name FROM customer""")
def json_lines(spark: S, d: str) -> DataFrame:
    """Documents as compressed lines of JSON without nulls, written over what a prefix held, and read by a declared schema."""
    folder = scratch(spark, "json-lines")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.round("c_acctbal", 1).alias("balance"))
    for part in (c.limit(3), c):
        part.select(F.to_json(F.struct(*part.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").option("compression", "gzip").text(folder)
    found = spark.read.text(folder).select(F.from_json("value", "user_id long, name string, balance double").alias("x"), F.contains("value", F.lit('"name"')).alias("has_name"))
    return found.select("x.*", "has_name")


@query("declared_reviews", "S01 S02 S03 S12", "SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS note FROM orders")
def declared_reviews(spark: S, d: str) -> DataFrame:
    """A scan by a declared schema: columns by name, one that the files lack is null, and others aren't read."""
    return read_declared(spark, [f"{d}/orders.parquet"], "o_orderkey long, o_custkey long, note string")


@query("dense_index", "A10 Q05 K26 S22", M.with_model("""
SELECT count(*) AS n, min(reviews) > 0 AS active, CAST(count(*) AS BIGINT) AS high, true AS dense, min(user_id) FILTER (rn = 7) AS seventh FROM (SELECT *, row_number() OVER (ORDER BY reviews DESC, user_id) AS rn FROM activity)"""))
def dense_index(spark: S, d: str) -> DataFrame:
    """Are users numbered 1..n without gaps and repeats? And who is the seventh?"""
    i = ordering.global_number(M.activity(M.ledger(spark, d)), [F.col("reviews").desc(), F.col("user_id")], "idx")
    dense = (F.min("idx") == 1) & (F.max("idx") == F.count(F.lit(1))) & (F.countDistinct("idx") == F.count(F.lit(1)))
    return i.agg(F.count(F.lit(1)).alias("n"), (F.min("reviews") > 0).alias("active"), F.max("idx").alias("high"), dense.alias("dense"), F.max(F.when(F.col("idx") == 7, F.col("user_id"))).alias("seventh"))


@query("user_lists", "O01 O05 T33 T07 T08", """
WITH a AS (SELECT o_custkey AS u, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), own AS (SELECT u, string_agg(i, ',' ORDER BY r) FILTER (r <= 3) AS items FROM a WHERE n >= 5 GROUP BY u),
pop AS (SELECT string_agg(i, ',' ORDER BY p DESC, i) AS items FROM (SELECT o_orderkey AS i, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)), m AS (SELECT max(c_custkey) AS top FROM customer),
q AS (SELECT c_custkey AS user_idx, least(greatest(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 - 1 END, 3), 1), 3) AS k FROM customer UNION ALL SELECT c_custkey + 1000000, 3 FROM customer WHERE c_custkey < 5)
SELECT user_idx, CASE WHEN user_idx > m.top THEN 'unknown' WHEN own.u IS NULL THEN 'popular' ELSE 'personalized' END AS source, CASE WHEN user_idx <= m.top THEN array_to_string(string_split(coalesce(own.items, pop.items), ',')[1:k], ',') END AS items FROM q CROSS JOIN m CROSS JOIN pop LEFT JOIN own ON own.u = q.user_idx""")
def user_lists(spark: S, d: str) -> DataFrame:
    """A user's list by rank, the popular one for users without, nothing beyond the last number; limits are clamped to 1..3."""
    o = read(spark, d, "orders")
    joined = lambda c: F.transform(F.array_sort(c), lambda x: x["i"].cast("string"))
    top = ordering.top_per_group(o.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))).filter("n >= 5"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    own = top.groupBy(F.col("o_custkey").alias("user_idx")).agg(joined(F.collect_list(F.struct("rank", F.col("o_orderkey").alias("i")))).alias("own"))
    pop = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(3).agg(joined(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("i")))).alias("pop"))
    c = read(spark, d, "customer").select("c_custkey")
    asked = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 7 - 1)
    q = c.select(F.col("c_custkey").alias("user_idx"), F.least(F.greatest(F.coalesce(asked, F.lit(3)), F.lit(1)), F.lit(3)).cast("int").alias("k")).union(c.filter("c_custkey < 5").select(F.col("c_custkey") + 1_000_000, F.lit(3)))
    x = q.join(own, "user_idx", "left").join(F.broadcast(pop)).join(F.broadcast(c.agg(F.max("c_custkey").alias("top"))))
    known = F.col("user_idx") <= F.col("top")
    return x.select("user_idx", F.when(~known, "unknown").when(F.col("own").isNull(), "popular").otherwise("personalized").alias("source"), F.when(known, F.array_join(F.slice(F.coalesce("own", "pop"), F.lit(1), F.col("k")), ",")).alias("items"))
