"""Queries of records, states, search, groups and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.functions import text as X
from cairn.operators import contracts as C
from cairn.operators import metrics as E
from cairn.operators import ordering, pit
from cairn.operators import rules as R
from cairn.operators.tables import Table
from cairn.plans import models as M
from cairn.plans.registry import query
from cairn.plans.training import _draw
from cairn.sources.shared import scratch
from cairn.sources.shared import written as staged
from cairn.sources.tables import find_files, read, read_declared

S = SparkSession


def _t(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("search_index", "K23 K24 K25 F16 T34", M.with_model("""
SELECT game_id, name, n AS reviews, row_number() OVER (ORDER BY n DESC, game_id) AS place FROM (SELECT g.game_id, nullif(trim(name), '') AS name, (SELECT count(*) FROM ledger l WHERE l.game_id = g.game_id) AS n FROM games g WHERE NOT coming_soon) WHERE name IS NOT NULL AND length(name) >= 10 ORDER BY n DESC, game_id LIMIT 100"""))
def search_index(spark: S, d: str) -> DataFrame:
    """The hundred most reviewed games that have a name of ten letters and are out, written as lines of JSON and read back."""
    n = M.ledger(spark, d).groupBy("game_id").agg(F.count(F.lit(1)).alias("reviews"))
    g = M.games(spark, d).filter("NOT coming_soon").select("game_id", X.blank_to_null(F.col("name")).alias("name")).filter("name IS NOT NULL AND char_length(name) >= 10")
    top = g.join(n, "game_id", "left").fillna(0, ["reviews"]).orderBy(F.col("reviews").desc(), "game_id").limit(100)
    folder = scratch(spark, "search-index")
    top.withColumn("place", F.row_number().over(Window.orderBy(F.col("reviews").desc(), "game_id"))).write.option("compression", "gzip").json(folder)
    return spark.read.schema("game_id long, name string, reviews long, place int").json(folder)


@query("running_state", "J07 K13 K02", M.with_model("""
WITH old AS (SELECT game_id, count(*) AS n, CAST(count_if(is_positive) AS BIGINT) AS p FROM ledger WHERE reviewed_at < TIMESTAMP '1997-01-01' GROUP BY 1), new AS (SELECT game_id, count(*) AS n, CAST(count_if(is_positive) AS BIGINT) AS p FROM ledger WHERE reviewed_at >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT game_id, coalesce(old.n, 0) + coalesce(new.n, 0) AS reviews, coalesce(old.p, 0) + coalesce(new.p, 0) AS positives, CASE WHEN new.n IS NULL THEN 'unchanged' WHEN old.n IS NULL THEN 'new' ELSE 'changed' END AS state FROM old FULL JOIN new USING (game_id)"""))
def running_state(spark: S, d: str) -> DataFrame:
    """Stored totals, and a batch put on top of them: only rows that change are written, the others stay."""
    e = M.ledger(spark, d)
    count = lambda df: df.groupBy("game_id").agg(F.count(F.lit(1)).alias("reviews"), F.count_if("is_positive").alias("positives"))
    cut = F.col("reviewed_at") < _t("1997-01-01")
    table = Table(spark, scratch(spark, "totals"), buckets=16, by=["game_id"])
    table.overwrite(count(e.filter(cut)).withColumn("state", F.lit("unchanged")))
    stored = table.read().select("game_id", F.col("reviews").alias("r0"), F.col("positives").alias("p0"))
    add = count(e.filter(~cut)).join(stored, "game_id", "left")
    table.merge(add.select("game_id", (F.col("reviews") + F.coalesce("r0", F.lit(0))).alias("reviews"), (F.col("positives") + F.coalesce("p0", F.lit(0))).alias("positives"), F.when(F.col("r0").isNull(), "new").otherwise("changed").alias("state")), ["game_id"])
    return table.read()


@query("record_rules", "P08 P11 P14 P17 P23 X03", M.with_model("""
WITH r AS (SELECT p_partkey AS game_id, CASE WHEN p_size % 3 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS final, p_size <= 10 AS free, p_size, p_name, p_brand FROM part), n AS (SELECT game_id, count(*) AS n FROM ledger GROUP BY 1)
SELECT r.game_id, CASE WHEN final IS NOT NULL THEN round(final / 100, 2) WHEN free THEN 0.0 END AS price, free OR coalesce(final, 1) = 0 AS costs_nothing, CASE WHEN coalesce(n, 0) < 1 THEN NULL WHEN n < 5 THEN '01-04' WHEN n < 10 THEN '05-09' WHEN n < 20 THEN '10-19' WHEN n < 50 THEN '20-49' ELSE '50+' END AS bucket,
  array_to_string([x || ':' || w FOR x, w IN list_zip(g.tags, g.weights) IF x <> 'z4'], '|') AS known_tags, array_to_string([trim(split_part(p_name, ' ', 1)), trim(p_brand)], '|') AS languages FROM r JOIN games g USING (game_id) LEFT JOIN n USING (game_id)""".replace("[x || ':' || w FOR x, w IN list_zip(g.tags, g.weights) IF x <> 'z4']", "list_transform(list_filter(list_zip(g.tags, g.weights), lambda z: z[1] <> 'z4'), lambda z: z[1] || ':' || z[2])")))
def record_rules(spark: S, d: str) -> DataFrame:
    """What records become: prices in cents or none, classes of counts, tags whose names are known with their weights, languages out of a line of HTML."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"), F.when(F.col("p_size") % 3 == 0, F.round(F.col("p_retailprice") * 100).cast("long")).alias("final"), (F.col("p_size") <= 10).alias("free"), "p_name", "p_brand")
    n = M.ledger(spark, d).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    x = p.join(M.games(spark, d).select("game_id", "tags", "weights"), "game_id").join(n, "game_id", "left")
    names = F.transform("tags", lambda t: F.when(t != "z4", t))
    known = F.transform(N.zip_weights(names, F.col("weights")), lambda w: F.concat(w["name"], F.lit(":"), w["weight"].cast("string")))
    html = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("<strong>*</strong>, "), F.col("p_brand"), F.lit(" , <br><strong>*</strong>languages with full audio"))
    k = F.col("n")
    return x.select(
        "game_id", F.when(F.col("final").isNotNull(), F.round(F.col("final") / 100, 2)).when(F.col("free"), 0.0).alias("price"), (F.col("free") | (F.coalesce("final", F.lit(1)) == 0)).alias("costs_nothing"),
        F.when(k < 5, "01-04").when(k < 10, "05-09").when(k < 20, "10-19").when(k < 50, "20-49").when(k >= 50, "50+").alias("bucket"), F.array_join(known, "|").alias("known_tags"), F.array_join(X.language_list(html), "|").alias("languages"),
    )


@query("late_dimension", "I04 K06", M.with_model("""
SELECT review_id, game_id, CASE WHEN game_id % 3 <> 0 AND reviewed_at < TIMESTAMP '1996-01-01' THEN 1 WHEN reviewed_at < TIMESTAMP '1998-01-01' THEN 2 ELSE 3 END AS batch FROM ledger"""))
def late_dimension(spark: S, d: str) -> DataFrame:
    """Events wait for their game: each batch releases those whose game is known by then and that the ledger lacks."""
    e = staged(M.ledger(spark, d).select("review_id", "game_id", "reviewed_at"), "events")
    games = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"))
    ledger = Table(spark, scratch(spark, "ledger"), "review_id long, game_id long, batch int")
    for batch, until, known in ((1, "1996-01-01", games.filter("game_id % 3 <> 0")), (2, "1998-01-01", games), (3, "9999-01-01", games)):
        ready = e.filter(F.col("reviewed_at") < _t(until)).join(known, "game_id", "left_semi").join(ledger.read().select("review_id"), "review_id", "left_anti")
        ledger.append(ready.select("review_id", "game_id", F.lit(batch).alias("batch")))
    return ledger.read()


@query("liked_pairs", "J27 J33 N11", M.with_model(f"""
WITH s AS (SELECT review_id, game_id AS a, lag(game_id) OVER (PARTITION BY user_id ORDER BY reviewed_at, review_id) AS b FROM ledger WHERE is_positive), c AS (SELECT game_id, count(*) AS w FROM ledger WHERE is_positive GROUP BY 1), l AS (SELECT game_id, sum(w) OVER (ORDER BY game_id) - w AS lo, sum(w) OVER (ORDER BY game_id) AS hi FROM c),
p AS (SELECT review_id, a, b, floor(({_draw("review_id", 9)} * (SELECT sum(w) FROM c)::DOUBLE) / 1000003) AS x FROM s WHERE b IS NOT NULL), k AS (SELECT 'liked' AS kind, a, b FROM p UNION ALL SELECT 'drawn', a, game_id FROM p JOIN l ON x >= lo AND x < hi)
SELECT kind, count(*) AS pairs, round(avg(len(list_intersect(g.tags, h.tags)) / len(list_distinct(list_concat(g.tags, h.tags)))), 6) AS tags, round(avg(CASE WHEN g.developer = h.developer THEN 1.0 ELSE 0 END), 6) AS developer FROM k JOIN games g ON g.game_id = a JOIN games h ON h.game_id = b GROUP BY kind"""))
def liked_pairs(spark: S, d: str) -> DataFrame:
    """Games liked one after another, against partners drawn by popularity: how much more do they share?"""
    e = M.ledger(spark, d).filter("is_positive")
    s = e.select("review_id", F.col("game_id").alias("a"), F.lag("game_id").over(Window.partitionBy("user_id").orderBy("reviewed_at", "review_id")).alias("b")).filter("b IS NOT NULL")
    drawn = ordering.weighted_pick(s.select("review_id", "a"), "review_id", e.groupBy("game_id").agg(F.count(F.lit(1)).alias("w")), "game_id", "w", seed=9)
    k = s.select(F.lit("liked").alias("kind"), "a", "b").unionByName(drawn.select(F.lit("drawn").alias("kind"), "a", F.col("game_id").alias("b")))
    side = lambda c: M.games(spark, d).select(F.col("game_id").alias(c), F.col("tags").alias(f"t{c}"), F.col("developer").alias(f"d{c}"))
    x = k.join(side("a"), "a").join(side("b"), "b")
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(N.jaccard(F.col("ta"), F.col("tb"))), 6).alias("tags"), F.round(F.avg((F.col("da") == F.col("db")).cast("double")), 6).alias("developer"))


@query("observed_and_null", "N02", M.with_model(f"""
WITH a AS (SELECT *, row_number() OVER (ORDER BY review_id) AS p FROM ledger), b AS (SELECT game_id AS g, row_number() OVER (ORDER BY {_draw("review_id", 1)}, review_id) AS p FROM ledger), z AS (SELECT user_id, 'observed' AS kind, game_id FROM ledger UNION ALL SELECT user_id, 'null', g FROM a JOIN b USING (p)),
s AS (SELECT kind, user_id, p_brand, count(*) AS c FROM z JOIN part ON p_partkey = game_id GROUP BY ALL), u AS (SELECT kind, user_id, sum(c) AS n, max(c) / sum(c) AS share FROM s GROUP BY ALL),
q AS (SELECT *, n >= 30 AS many, row_number() OVER (PARTITION BY kind, n >= 30 ORDER BY share, user_id) - 1 AS i, count(*) OVER (PARTITION BY kind, n >= 30) AS k FROM u), p95 AS (SELECT many, share AS cut FROM q WHERE kind = 'null' AND i = CAST(floor(0.95 * (k - 1)) AS BIGINT))
SELECT many, count(*) AS users, round(avg(share), 6) AS share, round(avg(CASE WHEN share > cut THEN 1.0 ELSE 0 END), 6) AS above FROM q JOIN p95 USING (many) WHERE kind = 'observed' GROUP BY many"""))
def observed_and_null(spark: S, d: str) -> DataFrame:
    """Are users more concentrated on a developer than if all games were dealt out anew? The share of them above the null's 95th percentile, by how much they reviewed."""
    e = staged(M.ledger(spark, d).select("review_id", "user_id", "game_id"), "ledger")
    z = e.withColumn("kind", F.lit("observed")).unionByName(ordering.permuted(e, "review_id", "game_id", seed=1).withColumn("kind", F.lit("null")))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"), "p_brand")
    c = z.join(p, "game_id").groupBy("kind", "user_id", "p_brand").agg(F.count(F.lit(1)).alias("c"))
    u = staged(c.groupBy("kind", "user_id").agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("share")).withColumn("many", F.col("n") >= 30), "shares")
    # Shares are fractions of small numbers, so few are different: the percentile comes from their counts.
    null = u.filter("kind = 'null'")
    counts = null.groupBy("many", "share").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("many").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"before": F.coalesce(F.sum("k").over(w), F.lit(0)), "all": F.sum("k").over(Window.partitionBy("many"))})
    cut = placed.filter(F.col("before") <= F.floor(0.95 * (F.col("all") - 1))).groupBy("many").agg(F.max("share").alias("cut"))
    return u.filter("kind = 'observed'").join(F.broadcast(cut), "many").groupBy("many").agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("share"), 6).alias("share"), F.round(F.avg((F.col("share") > F.col("cut")).cast("double")), 6).alias("above"))


@query("past_and_future", "N14", M.with_model("""
WITH p AS (SELECT game_id, count_if(is_positive AND reviewed_at < TIMESTAMP '1996-01-01') AS p0, count_if(reviewed_at < TIMESTAMP '1996-01-01') AS n0, count_if(is_positive AND reviewed_at >= TIMESTAMP '1996-01-01') AS p1, count_if(reviewed_at >= TIMESTAMP '1996-01-01') AS n1 FROM ledger GROUP BY 1),
r AS (SELECT game_id, (p0 + 8.0) / (n0 + 10) AS a, p1 / n1 AS b, CASE WHEN n0 >= 10 THEN 'many' ELSE 'few' END AS known FROM p WHERE n0 > 0 AND n1 > 0)
SELECT known, count(*) AS games, round(avg(a), 6) AS past, round(avg(b), 6) AS future, round(avg(abs(a - b)), 6) AS off FROM r GROUP BY known"""))
def past_and_future(spark: S, d: str) -> DataFrame:
    """How well a smoothed ratio of the past tells that of the future, by how much is known."""
    early, good = F.col("reviewed_at") < _t("1996-01-01"), F.col("is_positive")
    p = M.ledger(spark, d).groupBy("game_id").agg(F.count_if(good & early).alias("p0"), F.count_if(early).alias("n0"), F.count_if(good & ~early).alias("p1"), F.count_if(~early).alias("n1")).filter("n0 > 0 AND n1 > 0")
    r = p.select(N.prior_ratio(F.col("p0"), F.col("n0")).alias("a"), (F.col("p1") / F.col("n1")).alias("b"), F.when(F.col("n0") >= 10, "many").otherwise("few").alias("known"))
    return r.groupBy("known").agg(F.count(F.lit(1)).alias("games"), F.round(F.avg("a"), 6).alias("past"), F.round(F.avg("b"), 6).alias("future"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("off"))


@query("candidate_groups", "V26 V19 R12 T18 T29 H27", M.with_model(f"""
WITH pop AS (SELECT game_id FROM ledger WHERE is_positive GROUP BY 1 ORDER BY count(*) DESC, game_id LIMIT 8), q AS (SELECT review_id, user_id, game_id AS target, reviewed_at AS t FROM ledger WHERE is_positive AND {_draw("review_id", 12)} < 700000),
c AS (SELECT q.*, game_id FROM q CROSS JOIN pop UNION SELECT q.*, target FROM q), k AS (SELECT c.* FROM c WHERE game_id = target OR NOT EXISTS (SELECT 1 FROM ledger l WHERE l.user_id = c.user_id AND l.is_positive AND l.reviewed_at > c.t AND l.game_id = c.game_id))
SELECT review_id, k.game_id, k.game_id = target AS label, row_number() OVER (PARTITION BY review_id ORDER BY {_draw("review_id * 31 + k.game_id", 13)}, k.game_id) - 1 AS position, len(list_filter(g.tags, lambda x: x IN ('small', 'large', 'z1'))) AS hot FROM k JOIN games g ON g.game_id = k.game_id"""))
def candidate_groups(spark: S, d: str) -> DataFrame:
    """Groups for a ranker from a hash sample of the liked reviews: popular games and the target, what the user likes later left out, in an order of its own for each group, with chosen tags counted in long form."""
    e = staged(M.ledger(spark, d), "ledger")
    pop = e.filter("is_positive").groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "game_id").limit(8).agg(F.collect_list("game_id").alias("pop"))
    q = e.filter("is_positive").filter(N.draw(F.col("review_id"), 12) < 700_000)
    later = pit.events_before(q, e.filter("is_positive"), "user_id", "reviewed_at", "game_id", "review_id", target="game_id", after=True)
    c = q.join(later, "review_id").join(F.broadcast(pop)).select("review_id", F.col("game_id").alias("target"), F.explode(F.array_union(F.array_except("pop", "items"), F.array("game_id"))).alias("game_id"))
    tags = M.games(spark, d).select("game_id", F.explode("tags").alias("tag")).filter(F.col("tag").isin("small", "large", "z1")).groupBy("game_id").agg(F.count(F.lit(1)).alias("hot"))
    order = N.draw(F.col("review_id") * 31 + F.col("game_id"), 13)
    place = F.row_number().over(Window.partitionBy("review_id").orderBy(order, "game_id")) - 1
    return c.join(tags, "game_id", "left").select("review_id", "game_id", (F.col("game_id") == F.col("target")).alias("label"), place.cast("long").alias("position"), F.coalesce("hot", F.lit(0)).alias("hot"))


@query("recent_users", "Y13 A40", M.with_model("""
WITH n AS (SELECT max(reviewed_at) - INTERVAL 60 DAY AS since FROM ledger), g AS (SELECT DISTINCT user_id FROM ledger, n WHERE reviewed_at > since UNION SELECT user_id FROM activity WHERE reviews >= 40) SELECT user_id, reviews, newest > (SELECT since FROM n) AS recent FROM g JOIN activity USING (user_id)"""))
def recent_users(spark: S, d: str) -> DataFrame:
    """The users of the last 60 days before the newest row and those with many reviews, each once."""
    a = M.activity(M.ledger(spark, d))
    since = a.agg((F.max("newest") - F.expr("interval 60 days")).alias("since"))
    x = a.join(F.broadcast(since)).withColumn("recent", F.col("newest") > F.col("since"))
    return x.filter("recent").union(x.filter("reviews >= 40")).select("user_id", "reviews", "recent").distinct()


@query("metric_rows", "E28 E29 E32", """
WITH a AS (SELECT o_orderpriority = '1-URGENT' AS rel, o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS q FROM orders),
t AS (SELECT 'price' AS model, g, min(p) FILTER (rel) AS p FROM a GROUP BY g UNION ALL SELECT 'newest', g, min(q) FILTER (rel) FROM a GROUP BY g), m AS (SELECT model, avg(CASE WHEN p < 3 THEN 1.0 ELSE 0 END) AS recall_3, avg(CASE WHEN p < 3 THEN 1 / log2(p + 2) ELSE 0 END) AS ndcg_3, avg(CASE WHEN p < 3 THEN 1 / (p + 1) ELSE 0 END) AS mrr_3 FROM t GROUP BY model)
SELECT model, name, round(value, 6) AS value FROM (SELECT model, unnest(['recall_3', 'ndcg_3', 'mrr_3']) AS name, unnest([recall_3, ndcg_3, mrr_3]) AS value FROM m)""")
def metric_rows(spark: S, d: str) -> DataFrame:
    """Several models' metrics on the same lists, one row a metric."""
    u = Window.partitionBy("o_custkey")
    places = F.array(*[F.struct(F.lit(name).alias("model"), (F.row_number().over(u.orderBy(c.desc(), "o_orderkey")) - 1).alias("p")) for name, c in (("price", F.col("o_totalprice")), ("newest", F.col("o_orderdate")))])
    a = read(spark, d, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("rel"), places.alias("x")).select("o_custkey", "rel", F.explode("x").alias("x"))
    t = a.groupBy("x.model", "o_custkey").agg(F.min(F.when(F.col("rel"), F.col("x.p"))).alias("p"))
    names = ["recall_3", "ndcg_3", "mrr_3"]
    return E.single_target(t, "p", [3], ["model"]).select("model", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("name", "value"))


@query("record_contracts", "Q06 Q07", M.with_model("""
SELECT 'price_range' AS rule, count(*) AS violations FROM games WHERE price < 0 OR price > 19 UNION ALL SELECT 'aligned', count(*) FROM games WHERE len(tags) <> len(weights) UNION ALL SELECT 'tag_count', count(*) FROM games WHERE len(tags) NOT BETWEEN 3 AND 20
UNION ALL SELECT 'weights', count(*) FROM games WHERE list_min(weights) < 0 OR list_max(weights) = 0 UNION ALL SELECT 'descriptors', count(*) FROM games WHERE NOT list_bool_and(list_transform(descriptors, lambda x: x BETWEEN 1 AND 5))
UNION ALL SELECT 'release', count(*) FROM games WHERE released IS NULL UNION ALL SELECT 'monday', count(*) FROM weekly WHERE isodow(week_start) <> 1 UNION ALL SELECT 'counts', count(*) FROM weekly WHERE positives > reviews OR reviews < 1"""))
def record_contracts(spark: S, d: str) -> DataFrame:
    """Contracts of rows: ranges, aligned lists, lengths, members, dates; how many rows break each."""
    g, w = staged(M.games(spark, d).withColumn("released", N.release_date(F.col("release"))), "games"), M.weekly(M.ledger(spark, d))
    return C.summary({
        "price_range": C.violations(g, "price >= 0 AND price <= 19"), "aligned": C.unaligned(g, "tags", "weights"), "tag_count": C.violations(g, "size(tags) BETWEEN 3 AND 20"), "weights": C.violations(g, "array_min(weights) >= 0 AND array_max(weights) > 0"),
        "descriptors": C.violations(g, "forall(descriptors, x -> x BETWEEN 1 AND 5)"), "release": C.nulls(g, "released"), "monday": C.violations(w, "weekday(week_start) = 0"), "counts": C.violations(w, "positives <= reviews AND reviews >= 1"),
    })


@query("chunks", "T22", """
WITH c AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n, c_nationkey FROM customer) SELECT c_custkey, c_nationkey, i * least(n, greatest(2, CAST(ceil(n / 7) AS BIGINT))) // n AS chunk FROM c""")
def chunks(spark: S, d: str) -> DataFrame:
    """Balanced chunks of at most seven, at least two a nation if it has so many."""
    u = Window.partitionBy("c_nationkey")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", (F.row_number().over(u.orderBy("c_custkey")) - 1).alias("i"), F.count(F.lit(1)).over(u).alias("n"))
    return c.select("c_custkey", "c_nationkey", F.floor(F.col("i") * F.least(F.col("n"), F.greatest(F.lit(2), F.ceil(F.col("n") / 7))) / F.col("n")).alias("chunk"))


@query("prompts", "O18 E25", M.with_model("""
WITH x AS (SELECT game_id, 'Name: ' || name || chr(10) || 'Genre: ' || genre || chr(10) || 'Tags: ' || array_to_string(tags[1:2], ', ') AS t FROM games) SELECT game_id, t AS prompt, sha256('{"game_id":' || game_id || ',"prompt":"' || replace(t, chr(10), '\\n') || '"}') AS fingerprint FROM x"""))
def prompts(spark: S, d: str) -> DataFrame:
    """Texts for a prompt from a game's fields, and the fingerprint of what was asked."""
    t = F.concat_ws("\n", F.concat(F.lit("Name: "), "name"), F.concat(F.lit("Genre: "), "genre"), F.concat(F.lit("Tags: "), F.array_join(F.slice("tags", 1, 2), ", ")))
    return M.games(spark, d).select("game_id", t.alias("prompt")).withColumn("fingerprint", F.sha2(F.to_json(F.struct("game_id", "prompt")), 256))


@query("artifact_store", "K34 E31 V27", """
WITH h AS (SELECT n_regionkey AS run, n_nationkey AS at_, n_nationkey % 3 AS pair, CASE WHEN n_nationkey % 4 = 0 THEN 'evaluate' ELSE 'promote' END AS action FROM nation), l AS (SELECT * FROM h WHERE action = 'promote'),
now AS (SELECT run, max_by(pair, at_) AS pair FROM l GROUP BY run), b AS (SELECT l.run, max_by(l.pair, at_) AS back FROM l JOIN now ON now.run = l.run AND l.pair <> now.pair GROUP BY l.run)
SELECT now.run, now.pair AS live, back, now.pair <> 2 AS usable FROM now LEFT JOIN b ON b.run = now.run""")
def artifact_store(spark: S, d: str) -> DataFrame:
    """An append-only history of decisions over stored pairs, written in two runs: what is live, what it would go back to, and whether the stored pair fits the schema that serving asks for."""
    h = read(spark, d, "nation").select(F.col("n_regionkey").alias("run"), F.col("n_nationkey").alias("at"), (F.col("n_nationkey") % 3).alias("pair"), F.when(F.col("n_nationkey") % 4 == 0, "evaluate").otherwise("promote").alias("action"))
    history, pairs = Table(spark, scratch(spark, "history")), Table(spark, scratch(spark, "pairs"))
    pairs.overwrite(spark.createDataFrame([(0, "v2"), (1, "v2"), (2, "v1")], "pair int, schema string"))
    for part in (h.filter("at < 12"), h.filter("at >= 12")):
        history.append(part)
    now = history.read().filter("action = 'promote'").groupBy("run").agg(F.max_by("pair", "at").alias("live"))
    back = R.rollback(history.read(), "run", "at", "action", "pair").withColumnRenamed("pair", "back")
    stored = pairs.read().select(F.col("pair").alias("live"), (F.col("schema") == "v2").alias("usable"))
    return now.join(back, "run", "left").join(stored, "live", "left").select("run", "live", "back", F.coalesce("usable", F.lit(False)).alias("usable"))


@query("several_files", "S07", "SELECT o_custkey % 3 AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def several_files(spark: S, d: str) -> DataFrame:
    """A table in `name.parquet`, `name-NNN.parquet` and `name/`, found and read as one."""
    folder = scratch(spark, "files")
    o = read(spark, d, "orders").select("o_custkey", "o_totalprice")
    for k, name in enumerate(("o.parquet", "o-001.parquet", "o/part.parquet")):
        o.filter(F.col("o_custkey") % 3 == k).write.parquet(f"{folder}/{name}")
    found = read_declared(spark, find_files(spark, folder, "o"), "o_custkey long, o_totalprice double")
    return found.groupBy((F.col("o_custkey") % 3).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
