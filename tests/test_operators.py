"""Operators on examples worked by hand."""

import hashlib
import hmac
import random
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.functions import text as X
from cairn.operators import contracts as C
from cairn.operators import metrics as E
from cairn.operators import models, ordering, pit, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_history_before(spark):
    events = spark.createDataFrame([(7, 10, 2), (7, 20, 3), (7, 30, 4), (9, 10, 5)], "u long, t long, g long")
    rows = spark.createDataFrame([(1, 7, 30), (2, 7, 31), (3, 7, 10), (4, 9, 11), (5, 8, 50)], "r long, u long, t long")
    got = {r["r"]: r["history"] for r in pit.history(rows, events, "u", "t", "g", 2).collect()}
    assert got == {1: [3, 2], 2: [4, 3], 3: [0, 0], 4: [5, 0], 5: [0, 0]}


def test_events_after_leave_the_target_out(spark):
    events = spark.createDataFrame([(0, 10, 5), (0, 20, 6), (0, 30, 7), (1, 15, 5)], "u long, t long, g long")
    rows = spark.createDataFrame([(1, 0, 10, 5), (2, 0, 20, 6), (3, 1, 15, 5)], "r long, u long, t long, g long")
    got = {r["r"]: r["items"] for r in pit.events_before(rows, events, "u", "t", "g", "r", target="g", after=True).collect()}
    assert got == {1: [6, 7], 2: [7], 3: []}


@pytest.mark.parametrize("after", [False, True])
def test_events_before_and_totals_against_pairs(spark, after):
    import random

    rng = random.Random(3)
    some = lambda n: rng.choice([None, *range(n)])
    events = [(some(4), some(9), some(6)) for _ in range(150)] + [(7, t, t % 50) for t in range(300)]
    rows = [(i, some(4), some(9), rng.randrange(6)) for i in range(80)] + [(100 + t, 7, t, t % 50) for t in range(0, 300, 7)] + [(99, 0, 4, None)]
    df = lambda x, cols: spark.createDataFrame(x, ", ".join(f"{c} long" for c in cols))
    r, e = df(rows, "rutg"), df(events, "utg")
    want = {}
    for i, u, t, g in rows:
        timed = [x for k, s, x in events if None not in (k, s, x, u, t, g) and k == u and (s > t if after else s < t)]
        want[i] = sorted({x for x in timed if x != g})
    got = pit.events_before(r, e, "u", "t", "g", "r", target="g", after=after)
    assert {x["r"]: x["items"] for x in got.collect()} == want
    totals = pit.totals_before(r, e, "u", "t", "g", "r", target="g", after=after)
    assert {x["r"]: (x["n"], x["total"]) for x in totals.collect()} == {i: (len(v), sum(v)) for i, v in want.items()}


@pytest.mark.parametrize("slice_seconds", [None, 40])
def test_asof_is_strictly_before(spark, slice_seconds):
    rng = random.Random(3)
    features = sorted({(k, rng.randrange(200)) for k in range(4) for _ in range(rng.randrange(12))})
    events = [(i, rng.randrange(5), rng.randrange(220)) for i in range(120)] + [(900, None, 5)]
    f = spark.createDataFrame([(k, t, k * 1000 + t) for k, t in features], "k long, s long, v long").withColumn("ts", F.timestamp_seconds("s"))
    e = spark.createDataFrame(events, "i long, k long, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r["i"]: r["v"] for r in pit.asof_join(e, f, "k", "at", "ts", ["v"], slice_seconds).collect()}
    want = {}
    for i, k, t in events:
        times = [x for kk, x in features if kk == k]
        j = bisect_left(times, t)
        want[i] = k * 1000 + times[j - 1] if j else None
    assert got == want
    reached = pit.asof_candidates(f, e, "k", "at", "ts")
    assert {r["i"]: r["v"] for r in pit.asof_join(e, reached, "k", "at", "ts", ["v"]).collect()} == want and reached.count() <= f.count()


def test_previous_value_skips_equal_times(spark):
    e = spark.createDataFrame([(1, 1, 10, "a"), (2, 1, 10, "b"), (3, 1, 20, None), (4, 1, 30, "c")], "i long, u long, s long, v string").withColumn("t", F.timestamp_seconds("s"))
    got = {r["i"]: r["p"] for r in pit.previous_value(e, "u", "t", F.col("v"), "p").collect()}
    assert (got[1], got[2], got[3] in "ab", got[4] in "ab") == (None, None, True, True)


def test_numbering_sums_and_picks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, a long, w long")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r["i"]: r["n"] for r in ordering.global_number(df, [F.col("a").desc(), F.col("i")], "n", start=5).collect()} == {r[0]: k + 5 for k, r in enumerate(want)}
    held, before = 0, {}
    for i, _, w in rows:
        before[i] = held
        held += w
    assert {r["i"]: r["w_before"] for r in ordering.running_sum(df, [F.col("i")], ["w"]).collect()} == before
    picks = ordering.weighted_pick(spark.range(3000).withColumnRenamed("id", "r"), "r", spark.createDataFrame([(1, 700), (2, 0), (3, 300)], "g long, w long"), "g", "w", seed=1).collect()
    share = np.mean([p["g"] == 1 for p in picks])
    assert len(picks) == 3000 and {p["g"] for p in picks} == {1, 3} and abs(share - 0.7) < 0.05


def test_permutations_keep_the_bag(spark):
    df = spark.createDataFrame([(i, i % 3, i * 7 % 11) for i in range(60)], "i long, u long, g long")
    for got in (ordering.permuted(df, "i", "g", 1).collect(), ordering.permuted(df, "i", "g", 1, within=["u"]).collect()):
        assert sorted(r["g"] for r in got) == sorted(r["g"] for r in df.collect()) and [r["g"] for r in sorted(got)] != [r["g"] for r in df.collect()]
    assert [sorted(r["g"] for r in got if r["u"] == u) for u in range(3)] == [sorted(r["g"] for r in df.collect() if r["u"] == u) for u in range(3)]


def test_bins_and_buckets(spark):
    assert ordering.balanced_bins([(1, 5), (2, 4), (3, 3), (4, 3)], 2) == {1: 0, 2: 1, 3: 1, 4: 0}
    assert one(spark, ordering.merged_buckets(F.array(*[F.lit(x).cast("long") for x in (3, 3, 9, 1, 1, 8)]), 5)) == [0, 0, 1, 2, 2, 2]


def test_metrics_by_hand(spark):
    p = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "q long, p int")
    r = E.single_target(p, "p", [1, 2]).first()
    assert (r["recall_1"], r["recall_2"], r["ndcg_2"]) == (0, round(1 / 3, 6), round(1 / np.log2(3) / 3, 6))
    lists = spark.createDataFrame([(0, 1, True, 2), (0, 2, False, 2), (0, 3, True, 2), (1, 1, False, 1), (1, 2, False, 1)], "g long, r int, rel boolean, n int")
    two, three = E.list_metrics(lists, "g", "r", "rel", "n", 2).first(), E.list_metrics(lists, "g", "r", "rel", "n", 3).first()
    assert (two["precision"], two["recall"], three["recall"], three["map"]) == (0.25, 0.25, 0.5, round(5 / 6 / 2, 6))
    g = lambda v: E.gini(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()["gini"]
    assert (g([1, 1, 1, 1]), g([0, 0, 0, 10]), g([0, 0])) == (0, 0.75, None)
    a = spark.createDataFrame([(0, 0.9, 1), (0, 0.5, 0), (0, 0.5, 1), (1, 0.1, 1), (2, None, 0)], "g long, s double, l int")
    assert E.group_auc(a, "g", "s", "l").first()["auc"] == 0.75 and E.auc(a, "s", "l").first()["auc"] == round(1.5 / 3, 6)
    s = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (None, 1)], "a int, b int")
    assert E.spearman(s, "a", "b").first()["spearman"] == 0.6
    e = E.entropy(spark.createDataFrame([(1, x) for x in ("horror", "zombies", "horror", "racing")], "u long, l string"), "u", "l").first()
    assert (e["n"], e["top"], e["top_share"], e["entropy"], e["effective"]) == (4, "horror", 0.5, 1.5, round(2**1.5, 6))


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>").repartition(3)
    q = items.filter("item_id < 5").withColumnRenamed("item_id", "query_id")
    gone = spark.createDataFrame([(0, 3), (0, 7), (2, 2)], "query_id long, item_id long")
    for exclude, rows in ((None, 1024), (gone, 1024), (gone, 3)):  # in one block, and in many
        got = {}
        for r in retrieval.dense_top_k(q, items, 4, exclude=exclude, query_rows=rows, item_rows=rows * 4).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
        for i in range(5):
            s = x @ x[i]
            bad = {b for a, b in [(0, 3), (0, 7), (2, 2)] if a == i} if exclude is not None else set()
            assert [j for _, j in sorted(got[i])] == [j for j in np.argsort(-s) if j not in bad][:4]


def test_top_k_at_a_time(spark):
    """A query meets the items of its own week only."""
    items = spark.createDataFrame([(w, i, [float(i * w % 5), 1.0]) for w in (1, 2, 3) for i in range(9)], "week int, item_id long, vector array<double>")
    q = spark.createDataFrame([(7, 1, [1.0, 0.0]), (8, 3, [1.0, 0.0]), (9, 4, [1.0, 0.0])], "query_id long, week int, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in retrieval.dense_top_k(q, items, 2, at="week").collect())
    assert got == [(7, 1, 4, 4.0), (7, 2, 3, 3.0), (8, 1, 3, 4.0), (8, 2, 8, 4.0)]


def test_trees_send_missing_values_to_the_default(spark):
    t = models.Trees([0, -1, -1], [1.0, 0, 0], [1, 0, 0], [2, 0, 0], [0, 10, 20], [0], [False] * 3)
    assert t.predict(np.array([[0.5], [2.0], [np.nan], [0.0]])).tolist() == [10, 20, 20, 10]
    t.zero_missing = True
    assert t.predict(np.array([[0.0]])).tolist() == [20]
    df = spark.createDataFrame([(1, 0.5), (2, None)], "i long, x double")
    assert [r["score"] for r in sorted(t.score(df, ["x"]).collect())] == [10, 20]


def test_attention_ignores_absent_items():
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=(2, 4, 3)), [rng.normal(size=(3, 3)) for _ in range(3)]
    here = np.array([[True, True, False, False], [False] * 4])
    y = models.attention_summary(v, here, *w)
    v[0, 2:] = 99
    assert np.allclose(models.attention_summary(v, here, *w), y) and np.allclose(y[1], 0)


def test_text_columns(spark):
    key = b"secret"
    want = int.from_bytes(hmac.new(key, b"12345", hashlib.sha256).digest()[:8]) >> 1
    assert one(spark, X.keyed_hash63(F.lit("12345"), key)) == want
    assert one(spark, X.clean_html(F.lit("<p>a &amp;\n b</p><br> "))) == "a & b" and one(spark, X.clean_html(F.lit("<p> </p>"))) is None
    assert one(spark, X.language_list(F.lit("English<strong>*</strong>, French, <br>*with audio"))) == ["English", "French"]
    assert one(spark, X.truncate_words(F.lit("one two three four"), 12)) == "one two…"
    assert one(spark, X.fold(F.lit(" Élan  Vôtre "))) == "elan votre" and one(spark, X.year_of(F.lit("in 1999!"))) == 1999
    assert [one(spark, X.code_in(F.lit(x), ["english", "german"])) for x in ("English", "german", "x")] == [2, 3, 1]
    assert one(spark, X.contains_word(F.lit("Half-Life 2!"), F.lit("life 2"))) is False and one(spark, X.contains_word(F.lit("Half Life 2!"), F.lit("Life 2"))) is True


def test_number_columns(spark):
    lits = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, N.clean_array(lits(" a ", "", "b", "a"))) == ["a", "b"] and one(spark, N.normalised(lits(3.0, -1.0, 1.0))) == [0.75, 0, 0.25] and one(spark, N.normalised(lits(0.0, -1.0))) == [0.5, 0.5]
    assert round(one(spark, N.jaccard(lits("x", "y"), lits("y", "z"))), 6) == round(1 / 3, 6) and one(spark, N.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) is None
    assert one(spark, N.bitmask(lits(0, 2, 2))) == 5 and one(spark, N.has_bit(F.lit(5).cast("long"), 2)) and not one(spark, N.has_bit(F.lit(-1).cast("long"), 2))
    assert str(one(spark, N.release_date(F.lit("21 Aug, 2012")))) == "2012-08-21" and one(spark, N.release_date(F.lit("Coming soon"))) is None
    assert str(one(spark, N.week_start(N.iso_week(F.lit("2024-01-03").cast("date"))))) == "2024-01-01"


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [1, 2]), (2, "c", None)], "i long, s string, x array<int>").withColumn("y", F.array(F.lit(1)))
    assert C.not_unique(df, ["i"]).count() == 1 and C.nulls(df, "s").count() == 1 and C.violations(df, "s = 'a'").count() == 1 and C.unaligned(df, "x", "y").count() == 2
    assert C.not_dense(df, "i").count() == 1 and C.not_dense(df.limit(0), "i").count() == 0 and C.orphans(df, "i", df.filter("i = 1"), "i").count() == 2
    with pytest.raises(C.ContractBroken):
        C.require({"unique": C.not_unique(df, ["i"])})
