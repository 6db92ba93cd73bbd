"""Relational queries: staging, filters, joins, aggregations, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.functions import text as X
from cairn.operators import ordering, pit
from cairn.plans import models as M
from cairn.plans.registry import query
from cairn.sources.shared import written as staged
from cairn.sources.tables import read, read_sampled

S = SparkSession


@query("interactions_asof", "S04 J01 J02 J03 H01 H02 H03 A03 A04 W07 W08 U01 U02 Z01", M.with_model("""
SELECT l.review_id, l.user_id, l.game_id, l.is_positive, f.positives, f.negatives, round(f.ratio, 6) AS ratio
FROM (SELECT *, reviewed_at - INTERVAL 1 MICROSECOND AS before FROM ledger) l ASOF LEFT JOIN features f ON l.game_id = f.game_id AND l.before >= f.ts"""))
def interactions_asof(spark: S, d: str) -> DataFrame:
    """Reviews with their game's features as of strictly before. The ledger is written once: both sides read it."""
    events = staged(M.ledger(spark, d), "ledger")
    out = pit.asof_join(events, M.features(events), "game_id", "reviewed_at", "ts", ["positives", "negatives", "ratio"])
    return out.select("review_id", "user_id", "game_id", "is_positive", "positives", "negatives", F.round("ratio", 6).alias("ratio"))


@query("interactions_asof_sliced", "J01 J02 U01 A04", M.with_model("""
SELECT l.review_id, round(f.ratio, 6) AS ratio
FROM (SELECT *, reviewed_at - INTERVAL 1 MICROSECOND AS before FROM ledger) l ASOF LEFT JOIN features f ON l.game_id = f.game_id AND l.before >= f.ts"""))
def interactions_asof_sliced(spark: S, d: str) -> DataFrame:
    """The same by slices of 90 days, for keys that hold a large part of all rows."""
    events = staged(M.ledger(spark, d), "ledger")
    return pit.asof_join(events, M.features(events), "game_id", "reviewed_at", "ts", ["ratio"], slice_seconds=90 * N.DAY).select("review_id", F.round("ratio", 6).alias("ratio"))


@query("staging_reviews", "S08 P01 P02 P05 P06 P07 P19 F01 F02 G01 Y01 Y12", """
SELECT event_id AS review_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS game_id, value > 10 AS is_positive,
       coalesce(nullif(lower(trim(event_type)), ''), 'none') AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS reviewed_s, date_trunc('second', ts) AS reviewed_at,
       CAST(ts AS DATE) AS scrape_date, TIMESTAMP '2026-01-01' AS batch_at
FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND epoch(ts) > 0""")
def staging_reviews(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events").filter("event_id IS NOT NULL AND user_id IS NOT NULL").filter(N.seconds(F.col("ts")) > 0)
    s = N.seconds(F.col("ts"))
    return e.select(
        F.col("event_id").alias("review_id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("game_id"), F.coalesce(F.col("value") > 10, F.lit(False)).alias("is_positive"),
        F.coalesce(F.nullif(X.lower_trimmed(F.col("event_type")), F.lit("")), F.lit("none")).alias("kind"), s.alias("reviewed_s"), F.timestamp_seconds(s).cast("timestamp_ntz").alias("reviewed_at"),
        F.col("ts").cast("date").alias("scrape_date"), F.lit("2026-01-01").cast("timestamp_ntz").alias("batch_at"),
    )


@query("staging_games", "P04 P03 P12 P18 P20 F03 R01 R02 R03 R06 R08 R09 X01", """
WITH g AS (SELECT p_partkey AS game_id, nullif(trim(p_name), '') AS name, p_brand, p_type, p_size, p_retailprice, string_split(p_name, ' ') AS words FROM part)
SELECT game_id, name, array_to_string(list_distinct_ordered, '|') AS tags, len(list_distinct_ordered) AS n_tags, coalesce(words[1], '?') AS first_tag,
       array_to_string([x || ':' || CAST(i * 10 AS VARCHAR) FOR x, i IN list_distinct_ordered], '|') AS weighted,
       CASE WHEN p_size = 0 THEN 'free' WHEN p_retailprice < 1000 THEN 'a <1000' WHEN p_retailprice < 1500 THEN 'b <1500' ELSE 'c 1500+' END AS band,
       TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_no, least(greatest(p_size, 5), 40) AS size_clipped, p_retailprice >= 0 AS priced
FROM (SELECT *, list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: list_position(words, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM g)
WHERE coalesce(p_type, 'game') <> 'none' AND name IS NOT NULL""")
def staging_games(spark: S, d: str) -> DataFrame:
    g = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"), X.blank_to_null(F.col("p_name")).alias("name"), "p_brand", "p_type", "p_size", "p_retailprice", F.split("p_name", " ").alias("words"))
    tags = N.clean_array(F.col("words"))
    weighted = N.zip_weights(tags, F.transform(tags, lambda x, i: (i + 1) * 10))
    band = F.when(F.col("p_size") == 0, "free").when(F.col("p_retailprice") < 1000, "a <1000").when(F.col("p_retailprice") < 1500, "b <1500").otherwise("c 1500+")
    return g.filter((F.coalesce("p_type", F.lit("game")) != "none") & F.col("name").isNotNull()).select(
        "game_id", "name", F.array_join(tags, "|").alias("tags"), F.size(tags).cast("long").alias("n_tags"), N.first_or(F.col("words"), "?").alias("first_tag"),
        F.array_join(F.transform(weighted, lambda w: F.concat(w["name"], F.lit(":"), w["weight"].cast("string"))), "|").alias("weighted"), band.alias("band"),
        F.expr("try_cast(substr(p_brand, 7) AS int)").alias("brand_no"), N.clamp(F.col("p_size"), 5, 40).alias("size_clipped"), (F.col("p_retailprice") >= 0).alias("priced"),
    )


@query("json_records", "P09 P10 R18 R20", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(regexp_extract('note ' || props || ' end', '"k": *([0-9]+)', 1) AS BIGINT) AS k_embedded,
       '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' AS doc FROM events""")
def json_records(spark: S, d: str) -> DataFrame:
    """Nested JSON to columns, an object found inside text, and records to JSON."""
    e = read(spark, d, "events").withColumn("o", F.from_json("props", "k long"))
    inside = F.from_json(F.regexp_extract(F.concat(F.lit("note "), "props", F.lit(" end")), r"(\{.*\})", 1), "k long")
    return e.select("event_id", F.col("o.k").alias("k"), inside["k"].alias("k_embedded"), F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))).alias("doc"))


@query("html_text", "X02 X04 X09 P21", """
WITH t AS (SELECT page_id, url, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS c FROM t)
SELECT page_id, md5(c) AS clean_md5, length(c) AS n_chars, length(c) >= 30 AS long_enough, md5(CASE WHEN length(c) <= 80 THEN c ELSE regexp_replace(substr(c, 1, 79), '\\s+\\S*$', '') || '…' END) AS cut_md5, concat_ws(' | ', url, CAST(length(c) AS VARCHAR)) AS line FROM c""")
def html_text(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "pages").select("page_id", "url", X.clean_html(F.col("html")).alias("c"))
    n = F.char_length("c").cast("long")
    return c.select("page_id", F.md5("c").alias("clean_md5"), n.alias("n_chars"), (n >= 30).alias("long_enough"), F.md5(X.truncate_words(F.col("c"), 80)).alias("cut_md5"), F.concat_ws(" | ", "url", n.cast("string")).alias("line"))


@query("text_predicates", "X06 X07 X13 X14 X15 X11 X12 F13 K14", """
SELECT p_partkey, regexp_matches(lower(p_name), '\\b(green|red)\\b') AS by_name, contains(' ' || regexp_replace(p_name, '[^0-9a-zA-Z]+', ' ', 'g') || ' ', ' ' || regexp_replace(split_part(p_name, ' ', 2), '[^0-9a-zA-Z]+', ' ', 'g') || ' ') AS has_second,
       list_has_any(string_split(p_name, ' '), ['blue', 'cyan']) AS any_tag, CASE lower(p_brand) WHEN 'brand#11' THEN 2 WHEN 'brand#12' THEN 3 WHEN 'brand#13' THEN 4 ELSE 1 END AS code,
       regexp_matches(substr(p_brand, 7), '^[0-9]+$') AS numeric_brand, substr(sha256(p_name || '|' || p_brand), 1, 32) AS hash, lower(p_type) AS folded FROM part""")
def text_predicates(spark: S, d: str) -> DataFrame:
    p = read(spark, d, "part")
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    return p.select(
        "p_partkey", F.col("p_name").rlike(r"(?i)\b(green|red)\b").alias("by_name"), X.contains_word(F.col("p_name"), second).alias("has_second"), F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("blue"), F.lit("cyan"))).alias("any_tag"),
        X.code_in(F.col("p_brand"), ["brand#11", "brand#12", "brand#13"]).alias("code"), F.substr("p_brand", F.lit(7)).rlike("^[0-9]+$").alias("numeric_brand"), X.content_hash(F.col("p_name"), F.col("p_brand")).alias("hash"), X.fold(F.col("p_type")).alias("folded"),
    )


@query("fuzzy_search", "X17", """
SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'sma'))) > 0
AND len(list_filter(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'widgit') OR levenshtein(w, 'widgit') <= 1)) > 0""")
def fuzzy_search(spark: S, d: str) -> DataFrame:
    return read(spark, d, "part").filter(X.fuzzy_all(F.col("p_name"), "sma widgit")).select("p_partkey", "p_name")


def _hmac_sql(key: bytes) -> str:
    pad = lambda x: bytes(b ^ x for b in key.ljust(64, b"\0")).hex()
    inner = f"sha256(unhex('{pad(0x36)}') || encode(CAST(c_custkey AS VARCHAR)))"
    return f"sha256(unhex('{pad(0x5C)}') || unhex({inner}))"


@query("user_hashes", "X10 K33 X16 K20", f"""
WITH n AS (SELECT c_nationkey, CAST(coalesce(sum(sum(strlen(c_name))) OVER (ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM customer GROUP BY 1)
SELECT c_custkey, CAST(CAST('0x' || substr({_hmac_sql(b"key")}, 1, 16) AS UBIGINT) >> 1 AS BIGINT) AS user_hash, "offset" FROM customer JOIN n USING (c_nationkey)""")
def user_hashes(spark: S, d: str) -> DataFrame:
    """Keyed 63-bit pseudonyms, and byte offsets of packed names."""
    w = Window.orderBy("c_nationkey").rowsBetween(Window.unboundedPreceding, -1)
    by_nation = read(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.octet_length("c_name")).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
    c = read(spark, d, "customer").join(F.broadcast(by_nation.select("c_nationkey", "offset")), "c_nationkey")
    return c.select("c_custkey", X.keyed_hash63(F.col("c_custkey").cast("string"), b"key").alias("user_hash"), "offset")


@query("dates", "Y02 Y03 Y04 Y05 Y06 Y07 Y08 Y09 Y10 Y11 Y15 A23", """
SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, isodow(date_trunc('week', o_orderdate)) = 1 AS is_monday, CAST(floor((datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3) / 7.0) AS INTEGER) AS week,
       DATE '1970-01-01' + CAST(7 * floor((datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3) / 7.0) - 3 AS INTEGER) AS week_day, CAST(floor(epoch(o_orderdate) / 604800) AS INTEGER) AS thursday_week,
       CAST(o_orderdate AS DATE) - 3 AS earlier, CAST(o_orderdate AS DATE) AS parsed, CAST(o_orderdate AS DATE) AS parsed_long, CAST(NULL AS DATE) AS unparsed, CAST(datediff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
       round(epoch(o_orderdate - TIMESTAMP '1995-06-17 12:00:00') / 86400, 6) AS gap, datediff('month', DATE '1992-01-01', date_trunc('month', o_orderdate)) + 1 AS months FROM orders""")
def dates(spark: S, d: str) -> DataFrame:
    o, day = read(spark, d, "orders"), F.col("o_orderdate").cast("date")
    return o.select(
        "o_orderkey", N.monday(F.col("o_orderdate")).alias("monday"), N.is_monday(N.monday(F.col("o_orderdate"))).alias("is_monday"), N.iso_week(day).alias("week"), N.week_start(N.iso_week(day)).alias("week_day"), N.thursday_week(F.col("o_orderdate")).alias("thursday_week"),
        F.date_sub(day, 3).alias("earlier"), N.release_date(F.date_format("o_orderdate", "d MMM, yyyy"), long_months=False).alias("parsed"), N.release_date(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("parsed_long"), N.release_date(F.lit("Coming soon")).alias("unparsed"),
        F.datediff(day, F.lit("1995-06-17").cast("date")).alias("days"), F.round(N.days_between(F.col("o_orderdate"), F.lit("1995-06-17 12:00:00").cast("timestamp_ntz")), 6).alias("gap"),
        F.size(F.sequence(F.lit("1992-01-01").cast("date"), day, F.expr("interval 1 month"))).cast("long").alias("months"),
    )


@query("arithmetic", "Z02 Z03 Z04 Z07 Z08 Z11 Z12 Z13 P16", """
SELECT p_partkey, round((p_size + 8.0) / (p_size + 20 + 10), 6) AS bayes, round(ln(1 + p_size), 6) AS log1p, round(log2(1 + p_size), 6) AS log2, round(p_retailprice / 7, 4) AS rounded, round((p_size - avg(p_size) OVER ()) / greatest(stddev_pop(p_size) OVER (), 1e-9), 6) AS z,
       greatest(0, least(10, 40 - p_size)) AS budget, p_size >= 40 - greatest(1, 2) AS exhausted, CASE WHEN p_size < 45 THEN p_size END AS not_sentinel, p_size IS NOT NULL AS known, greatest(p_size - 25, 0) AS relu FROM part""")
def arithmetic(spark: S, d: str) -> DataFrame:
    s = F.col("p_size")
    return N.with_zscore(read(spark, d, "part"), "p_size", "z").select(
        "p_partkey", F.round(N.prior_ratio(s, s + 20), 6).alias("bayes"), F.round(F.log1p(s), 6).alias("log1p"), F.round(F.log2(s + 1), 6).alias("log2"), F.round(F.col("p_retailprice") / 7, 4).alias("rounded"), F.round("z", 6).alias("z"),
        F.greatest(F.lit(0), F.least(F.lit(10), 40 - s)).alias("budget"), (s >= 40 - F.greatest(F.lit(1), F.lit(2))).alias("exhausted"), F.when(s < 45, s).alias("not_sentinel"), s.isNotNull().alias("known"), F.greatest(s - 25, F.lit(0)).alias("relu"),
    )


@query("array_functions", "R04 R05 R10 R14 R15 R16 R17 R19 F10 F22 Z05 Z06 U08 R13", """
WITH t AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(n)), '|') AS sorted, array_to_string(list_transform(n, lambda x: CASE WHEN x <= 3 THEN x + 10 ELSE 1 END), '|') AS encoded, array_to_string([CAST(x + 10 AS VARCHAR) FOR x IN n IF x <= 3], '|') AS decoded,
       round(q[1] / list_sum(q), 6) AS share, CAST(list_sum(list_transform(list_distinct(n), lambda x: 1 << x)) AS BIGINT) AS mask, list_contains(n, 2) AS has_two, array_to_string(list_concat(n[1:5], list_transform(range(greatest(5 - len(n), 0)), lambda i: 0)), '|') AS padded,
       round(q[1] / sqrt(list_sum(list_transform(q, lambda x: x * x))), 6) AS unit, round(list_sum(list_transform(q, lambda x: x * x)), 4) AS dot, round(len(list_intersect(n, [1, 2, 9])) / len(list_distinct(list_concat(n, [1, 2, 9]))), 6) AS jaccard, len(n) > 0 AS filled FROM t""")
def array_functions(spark: S, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.col("r.l_linenumber").alias("n"), F.col("r.l_quantity").alias("q"))
    ids = F.create_map(*[F.lit(x).cast("int") if k == 0 else F.lit(x).cast("long") for i in (1, 2, 3) for k, x in enumerate((i, i + 10))])
    three = F.array(*[F.lit(x).cast("int") for x in (1, 2, 9)])
    mask = N.bitmask(F.col("n"))
    return t.select(
        "l_orderkey", F.array_join(N.sorted_distinct(F.col("n")).cast("array<string>"), "|").alias("sorted"), F.array_join(N.encode(F.col("n"), ids).cast("array<string>"), "|").alias("encoded"), F.array_join(N.decode(F.col("n"), ids).cast("array<string>"), "|").alias("decoded"),
        F.round(F.get(N.normalised(F.col("q")), F.lit(0)), 6).alias("share"), mask.alias("mask"), N.has_bit(mask, 2).alias("has_two"), F.array_join(N.padded(F.col("n").cast("array<bigint>"), 5).cast("array<string>"), "|").alias("padded"),
        F.round(F.get(N.unit(F.col("q")), F.lit(0)), 6).alias("unit"), F.round(N.dot(F.col("q"), F.col("q")), 4).alias("dot"), F.round(N.jaccard(F.col("n"), three), 6).alias("jaccard"), (F.size("n") > 0).alias("filled"),
    )


@query("dedup_reviews", "W01 W14 A11", M.with_model("SELECT review_id, user_id, game_id, is_positive, scrape_date FROM reviews"))
def dedup_reviews(spark: S, d: str) -> DataFrame:
    return M.reviews(spark, d).select("review_id", "user_id", "game_id", "is_positive", "scrape_date")


@query("ledger_pairs", "W03 U06 I05 J06", M.with_model("SELECT * FROM ledger"))
def ledger_pairs(spark: S, d: str) -> DataFrame:
    return M.ledger(spark, d)


@query("first_language", "W02 H07", """
SELECT review_id, language FROM (SELECT l_orderkey * 10 + l_linenumber AS review_id, nullif(l_linestatus || l_returnflag, 'OR') AS language, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, language) = 1""")
def first_language(spark: S, d: str) -> DataFrame:
    """Of copies with a language, the first."""
    t = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), F.nullif(F.concat("l_linestatus", "l_returnflag"), F.lit("OR")).alias("language"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return ordering.top_per_group(t.filter("language IS NOT NULL"), ["review_id"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "language")], 1).select("review_id", "language")


@query("games_by_name", "W04 W05 W06 W09 W10 W13 H05 H06", """
WITH s AS (SELECT p_partkey AS game_id, lower(first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS brand_first, lower(p_name) AS name_key, p_name, nullif(p_size, 1) AS score, p_retailprice FROM part),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY score DESC NULLS LAST, p_retailprice DESC NULLS LAST, game_id) = 1)
SELECT game_id, name_key, p_name AS name, score, brand_first FROM w""")
def games_by_name(spark: S, d: str) -> DataFrame:
    """One game per name: the best score, then price, then the lowest id."""
    whole = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = read(spark, d, "part").select(F.col("p_partkey").alias("game_id"), F.lower(F.first("p_name").over(whole)).alias("brand_first"), F.lower("p_name").alias("name_key"), F.col("p_name").alias("name"), F.nullif(F.col("p_size"), F.lit(1)).alias("score"), "p_retailprice")
    w = ordering.top_per_group(s, ["name_key"], [F.col("score").desc_nulls_last(), F.col("p_retailprice").desc_nulls_last(), F.col("game_id")], 1)
    return w.select("game_id", "name_key", "name", "score", "brand_first")


@query("cumulative_counts", "A01 A02 W24 I03", M.with_model("SELECT * FROM counts"))
def cumulative_counts(spark: S, d: str) -> DataFrame:
    return M.cumulative_counts(M.ledger(spark, d))


@query("weekly_popularity", "A08 A22 I06 H22", M.with_model("SELECT * FROM weekly"))
def weekly_popularity(spark: S, d: str) -> DataFrame:
    return M.weekly(M.ledger(spark, d))


@query("popularity_before_week", "Z14 W25 W26 H18 H21 V05", M.with_model("""
SELECT game_id, week_start, CAST(coalesce(sum(reviews) OVER four, 0) AS BIGINT) AS last4, CAST(coalesce(sum(reviews) OVER thirteen, 0) AS BIGINT) AS last13, CAST(coalesce(sum(positives) OVER past, 0) AS BIGINT) AS positives_before,
       round((coalesce(sum(positives) OVER past, 0) + 1.0) / (coalesce(sum(reviews) OVER past, 0) + 2.0), 6) AS ratio, round(ln(1 + coalesce(sum(reviews) OVER four, 0)) * 0.1, 6) AS recency
FROM (SELECT *, datediff('day', DATE '1969-12-29', week_start) // 7 AS week FROM weekly)
WINDOW four AS (PARTITION BY game_id ORDER BY week RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING), thirteen AS (PARTITION BY game_id ORDER BY week RANGE BETWEEN 13 PRECEDING AND 1 PRECEDING), past AS (PARTITION BY game_id ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def popularity_before_week(spark: S, d: str) -> DataFrame:
    """Counts of the last 4 and 13 weeks and of all before, each without the week itself."""
    w = M.weekly(M.ledger(spark, d)).withColumn("week", N.iso_week(F.col("week_start")))
    by = Window.partitionBy("game_id").orderBy("week")
    total = lambda c, n: F.coalesce(F.sum(c).over(by.rangeBetween(n, -1)), F.lit(0))
    past = Window.unboundedPreceding
    return w.select("game_id", "week_start", total("reviews", -4).alias("last4"), total("reviews", -13).alias("last13"), total("positives", past).alias("positives_before"), F.round((total("positives", past) + 1.0) / (total("reviews", past) + 2.0), 6).alias("ratio"), F.round(F.log1p(total("reviews", -4)) * 0.1, 6).alias("recency"))


@query("user_index", "A09 W12 H08", M.with_model("SELECT user_id, reviews, positives, row_number() OVER (ORDER BY reviews DESC, user_id) AS user_idx FROM activity"))
def user_index(spark: S, d: str) -> DataFrame:
    """Users numbered by activity from 1, without a single-task window."""
    return ordering.global_number(M.activity(M.ledger(spark, d)), [F.col("reviews").desc(), F.col("user_id")], "user_idx").select("user_id", "reviews", "positives", "user_idx")


@query("dictionary_ids", "W11 J15 I08 I09 H09 S29 S30 S31 R07 J14 F12 G02", "SELECT value, row_number() OVER (ORDER BY value) + 1 AS id FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part)")
def dictionary_ids(spark: S, d: str) -> DataFrame:
    from cairn.operators.tables import assign_ids

    values = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("value"))
    known = spark.createDataFrame([], "id long, value string")
    return assign_ids(values, "value", known, "id").select("value", "id")


@query("lookback_window", "F04 F05 A05 I01 I02", "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) >= (SELECT coalesce(max(CAST(ts AS DATE)), DATE '1970-01-01') - 3 FROM events)")
def lookback_window(spark: S, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "ts")
    top = e.agg(F.coalesce(F.max(F.col("ts").cast("date")), F.lit("1970-01-01").cast("date")).alias("top"))
    return e.join(F.broadcast(top)).filter(F.col("ts").cast("date") >= F.date_sub("top", 3)).drop("top")


@query("semi_and_anti", "F06 F07 F11 F14 F15 J05 J20 S19 S20 S21", """
SELECT c_custkey, 'has' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)
UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def semi_and_anti(spark: S, d: str) -> DataFrame:
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    has = c.join(o.filter("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")
    return has.withColumn("kind", F.lit("has")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("none")))


@query("exists_or_newer", "F08 J16", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def exists_or_newer(spark: S, d: str) -> DataFrame:
    """A disjunction of a watermark and a membership, by one left join with a flag."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit")).distinct()
    return o.join(c, "o_custkey", "left").filter((F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")) | F.col("hit").isNotNull()).select("o_orderkey")


@query("changed_rows", "F09 J09 K15 K18 U07 U09 I10 J34", """
WITH old AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 10 <> 0), new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 11 <> 0)
SELECT id, CASE WHEN o.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM new n LEFT JOIN old o USING (id) WHERE o.id IS NULL OR n.v IS DISTINCT FROM o.v
UNION ALL SELECT id, 'delete' FROM old WHERE id NOT IN (SELECT id FROM new)""")
def changed_rows(spark: S, d: str) -> DataFrame:
    """Inserts, updates and deletes between a stored and a new state."""
    from cairn.operators.tables import changed_only, gone_keys

    c = read(spark, d, "customer")
    h = lambda t: t.withColumn("h", X.content_hash(F.col("v")))
    old = h(c.filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")))
    new = h(c.filter("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("v")))
    known = old.select("id", F.lit("update").alias("action"))
    changed = changed_only(new, old, "id", "h").join(known, "id", "left").select("id", F.coalesce("action", F.lit("insert")).alias("action"))
    return changed.unionByName(gone_keys(new, old, "id").select("id", F.lit("delete").alias("action")))


@query("price_bands", "A28 A29 A33 A34 A36", """
WITH g AS (SELECT *, CASE WHEN p_retailprice < 1100 THEN 'a' WHEN p_retailprice < 1400 THEN 'b' ELSE 'c' END AS band FROM part)
SELECT band, count(*) AS games, CAST(sum(p_size) AS BIGINT) AS total, round(median(p_size), 6) AS med, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS sd, round(sum(p_size * p_retailprice) / sum(p_retailprice), 6) AS weighted, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       array_to_string(list(p_name ORDER BY p_retailprice DESC, p_partkey)[1:4], ',') AS top FROM g GROUP BY band""")
def price_bands(spark: S, d: str) -> DataFrame:
    g = read(spark, d, "part").withColumn("band", F.when(F.col("p_retailprice") < 1100, "a").when(F.col("p_retailprice") < 1400, "b").otherwise("c"))
    top = ordering.top_per_group(g, ["band"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 4, "r").groupBy("band").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_name"))), lambda x: x["p_name"]), ",").alias("top"))
    out = g.groupBy("band").agg(F.count(F.lit(1)).alias("games"), F.sum("p_size").alias("total"), F.round(F.median("p_size"), 6).alias("med"), F.round(F.avg("p_size"), 6).alias("mean"), F.round(F.stddev_samp("p_size"), 6).alias("sd"), F.round(F.sum(F.col("p_size") * F.col("p_retailprice")) / F.sum("p_retailprice"), 6).alias("weighted"))
    return out.withColumn("share", F.round(F.col("games") / F.sum("games").over(Window.partitionBy(F.lit(0))), 6)).join(top, "band")


@query("pivot_by_condition", "A26 A31 A12 A13 A14 A25", """
SELECT l_partkey AS game_id, count_if(l_shipdate < TIMESTAMP '1995-01-01') AS n_before, count_if(l_shipdate >= TIMESTAMP '1995-01-01') AS n_after, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first_at,
       round(avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS diff FROM lineitem GROUP BY 1""")
def pivot_by_condition(spark: S, d: str) -> DataFrame:
    t = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "game_id")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    counts = t.groupBy("game_id").agg(F.count_if(F.col("l_shipdate") < cut).alias("n_before"), F.count_if(F.col("l_shipdate") >= cut).alias("n_after"), F.countDistinct("l_suppkey").alias("suppliers"), F.min("l_shipdate").alias("first_at"))
    pivot = t.groupBy("game_id").pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_quantity"))
    return counts.join(pivot, "game_id").select(counts["*"], F.round(F.col("O") - F.col("F"), 6).alias("diff"))


@query("mode_and_share", "A32 A35 A37 A38 A07", """
WITH c AS (SELECT o_custkey AS user_id, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL)
SELECT user_id, label AS common, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share, bool_or(label = '1-URGENT') OVER (PARTITION BY user_id) AS any_urgent FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) = 1""")
def mode_and_share(spark: S, d: str) -> DataFrame:
    c = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    by = c.groupBy("user_id").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("best"), F.sum("n").alias("total"), F.bool_or(F.col("label") == "1-URGENT").alias("any_urgent"))
    return by.select("user_id", F.col("best.label").alias("common"), F.col("best.n").alias("n"), F.round(F.col("best.n") / F.col("total"), 6).alias("share"), "any_urgent")


@query("quantile_summary", "A30 Z09 Z10 N20", """
WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT max(x) FILTER (i = CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1) AS p50, max(x) FILTER (i = CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1) AS p90, max(x) FILTER (i = CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1) AS p99, max(x) FILTER (i = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) + 1) AS cut, max(x) AS top FROM r""")
def quantile_summary(spark: S, d: str) -> DataFrame:
    """Quantiles by index of the sorted rows."""
    r = ordering.global_number(read(spark, d, "orders").select("o_totalprice", "o_orderkey"), [F.col("o_totalprice"), F.col("o_orderkey")], "i")
    n = r.agg(F.count(F.lit(1)).alias("n"))
    at = lambda q: F.floor(F.lit(q) * (F.col("n") - 1)) + 1
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col("o_totalprice")))
    return r.join(F.broadcast(n)).agg(pick(at(0.5)).alias("p50"), pick(at(0.9)).alias("p90"), pick(at(0.99)).alias("p99"), pick(F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1) + 1).alias("cut"), F.max("o_totalprice").alias("top"))


@query("sequence_windows", "W15 W16 W17 W18 W19 W20 W22 W27 T27 T28", """
SELECT event_id, row_number() OVER w - 1 AS pos, lag(event_type, 2) OVER w AS lag2, lead(event_id) OVER w AS next_id, round(epoch(ts - lag(ts) OVER w) / 86400, 6) AS gap, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share,
       min(ts) OVER (PARTITION BY user_id, event_type) < ts AS seen_before, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS code, round(cume_dist() OVER (PARTITION BY user_id ORDER BY value), 6) AS ecdf FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def sequence_windows(spark: S, d: str) -> DataFrame:
    u = Window.partitionBy("user_id")
    w = u.orderBy("ts", "event_id")
    return read(spark, d, "events").select(
        "event_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.lag("event_type", 2).over(w).alias("lag2"), F.lead("event_id").over(w).alias("next_id"), F.round(N.days_between(F.col("ts"), F.lag("ts").over(w)), 6).alias("gap"), F.round(F.col("value") / F.sum("value").over(u), 6).alias("share"),
        (F.min("ts").over(Window.partitionBy("user_id", "event_type")) < F.col("ts")).alias("seen_before"), F.dense_rank().over(u.orderBy("event_type")).cast("long").alias("code"), F.round(F.cume_dist().over(u.orderBy("value")), 6).alias("ecdf"),
    )


@query("binned_mean", "W21 N06", """
WITH b AS (SELECT value, l, CAST(floor((rank() OVER (ORDER BY l) - 1) * 10 / count(*) OVER ()) AS INTEGER) AS bin FROM (SELECT value, length(event_type) AS l FROM events))
SELECT bin, count(*) AS n, round(avg(value), 6) AS mean FROM b GROUP BY bin""")
def binned_mean(spark: S, d: str) -> DataFrame:
    """Bins of equal counts with ties together. Ranks come from counts of the different values, so no single task sees the rows."""
    e = read(spark, d, "events").select("value", F.length("event_type").alias("l"))
    per = e.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    ranked = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    bins = ranked.withColumn("bin", F.floor(F.col("before") * 10 / F.col("total")).cast("int"))
    return bins.groupBy("bin").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


@query("partial_sums", "G06 A15 A16 A17 A18 A19 A24 A39 S17 S18", M.with_model("""
SELECT game_id, count(*) AS n, CAST(count_if(is_positive) AS BIGINT) AS p, max(reviewed_at) AS newest, round(ln(count(*) / sum(count(*)) OVER ()), 6) AS log_share, CAST(count_if(reviewed_at > (SELECT max(reviewed_at) FROM ledger) - INTERVAL 400 DAY) AS BIGINT) AS recent,
       CAST(min(review_id) AS BIGINT) AS best_rank FROM ledger GROUP BY game_id"""))
def partial_sums(spark: S, d: str) -> DataFrame:
    e = M.ledger(spark, d)
    top = e.agg(F.max("reviewed_at").alias("top"))
    g = e.join(F.broadcast(top)).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_positive").alias("p"), F.max("reviewed_at").alias("newest"), F.count_if(F.col("reviewed_at") > F.col("top") - F.expr("interval 400 days")).alias("recent"), F.min("review_id").alias("best_rank"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).withColumn("log_share", F.round(F.log(F.col("n") / F.col("total")), 6)).drop("total")


@query("hash_sample_users", "T15 T16 T17 S09", """
SELECT o_orderkey, o_custkey FROM orders WHERE ((o_custkey % 1000003) * 2654435761 + 12345) % 1000003 < 200000 AND o_totalprice > 1000""")
def hash_sample_users(spark: S, d: str) -> DataFrame:
    return read_sampled(read(spark, d, "orders"), "o_custkey", 0.2, ["o_orderkey", "o_custkey"], F.col("o_totalprice") > 1000)


@query("cap_per_user", "W23", """
SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ((o_orderkey % 1000003) * 2654435761 + 97 * 5 + 12345) % 1000003, o_orderkey) <= 3""")
def cap_per_user(spark: S, d: str) -> DataFrame:
    return ordering.cap_per_group(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 3, seed=5)


@query("exact_sample", "O21", """
SELECT o_orderkey FROM orders ORDER BY ((o_orderkey % 1000003) * 2654435761 + 97 * 3 + 12345) % 1000003, o_orderkey LIMIT 500""")
def exact_sample(spark: S, d: str) -> DataFrame:
    return ordering.sample_rows(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, seed=3)


@query("shuffled_games", "T20 T21", M.with_model("""
WITH a AS (SELECT *, row_number() OVER (ORDER BY review_id) AS p FROM ledger), b AS (SELECT game_id AS g, row_number() OVER (ORDER BY ((review_id % 1000003) * 2654435761 + 97 * 1 + 12345) % 1000003, review_id) AS p FROM ledger)
SELECT review_id, user_id, g AS game_id FROM a JOIN b USING (p)"""))
def shuffled_games(spark: S, d: str) -> DataFrame:
    """A null model: the games of all reviews dealt out anew."""
    return ordering.permuted(M.ledger(spark, d).select("review_id", "user_id", "game_id"), "review_id", "game_id", seed=1)


@query("shuffled_order", "T21 N04", M.with_model("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reviewed_at, review_id) AS p FROM ledger), b AS (SELECT user_id, game_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ((review_id % 1000003) * 2654435761 + 97 * 2 + 12345) % 1000003, review_id) AS p FROM ledger)
SELECT review_id, user_id, reviewed_at, g AS game_id FROM a JOIN b USING (user_id, p)"""))
def shuffled_order(spark: S, d: str) -> DataFrame:
    """A null model: each user's games in another order, times kept."""
    e = M.ledger(spark, d).select("review_id", "user_id", "reviewed_at", "game_id")
    return ordering.permuted(e, "review_id", "game_id", seed=2, within=["user_id"], order=["reviewed_at", "review_id"])


@query("union_labelled", "U04 U05 N13", """
SELECT 'status' AS flag, o_orderstatus AS value, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY 2""")
def union_labelled(spark: S, d: str) -> DataFrame:
    """Rates by each of several flags from one pass: flags are unpivoted before one aggregation."""
    o = read(spark, d, "orders")
    long = o.select("o_totalprice", F.explode(F.array(F.struct(F.lit("status").alias("flag"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("flag"), F.col("o_orderpriority").alias("value")))).alias("x"))
    return long.groupBy("x.flag", "x.value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("left_lookups", "J04 J17 J24 J26 J29", """
SELECT p.p_partkey, coalesce(s.n, 0) AS suppliers, n.n_name AS nation, CASE WHEN s.first_supp IS NULL THEN 1 ELSE s.first_supp + 1 END AS code FROM part p
LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS first_supp FROM lineitem GROUP BY 1) s ON s.l_partkey = p.p_partkey LEFT JOIN supplier u ON u.s_suppkey = s.first_supp LEFT JOIN nation n ON n.n_nationkey = u.s_nationkey""")
def left_lookups(spark: S, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("first_supp"))
    u, n = read(spark, d, "supplier").select(F.col("s_suppkey").alias("first_supp"), "s_nationkey"), read(spark, d, "nation")
    out = read(spark, d, "part").select("p_partkey").join(s, "p_partkey", "left").join(u, "first_supp", "left").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return out.select("p_partkey", F.coalesce("n", F.lit(0)).alias("suppliers"), F.col("n_name").alias("nation"), F.coalesce(F.col("first_supp") + 1, F.lit(1)).alias("code"))


@query("pairs_in_cluster", "J26", """
SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS cluster FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def pairs_in_cluster(spark: S, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("cluster"))
    return s.join(s.withColumnRenamed("a", "b"), "cluster").filter("a < b").select("a", "b", "cluster")


@query("mart_contracts", "Q01 Q02 Q03 Q04 Q08 F18 K09", M.with_model("""
SELECT 'unique_review' AS rule, count(*) AS violations FROM (SELECT review_id FROM raw GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unique_pair', count(*) FROM (SELECT user_id, game_id FROM ledger GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'not_null', count(*) FROM ledger WHERE user_id IS NULL UNION ALL SELECT 'known_game', count(*) FROM ledger WHERE game_id NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'ratio', count(*) FROM features WHERE NOT (ratio > 0 AND ratio < 1) UNION ALL SELECT 'monday', count(*) FROM weekly WHERE isodow(week_start) <> 1"""))
def mart_contracts(spark: S, d: str) -> DataFrame:
    from cairn.operators import contracts as C

    e = M.ledger(spark, d)
    checks = {
        "unique_review": C.not_unique(M.raw_reviews(spark, d), ["review_id"]), "unique_pair": C.not_unique(e, ["user_id", "game_id"]), "not_null": C.nulls(e, "user_id"),
        "known_game": C.orphans(e, "game_id", read(spark, d, "part"), "p_partkey"), "ratio": C.violations(M.features(e), "ratio > 0 AND ratio < 1"), "monday": C.violations(M.weekly(e), "weekday(week_start) = 0"),
    }
    return C.summary(checks)
