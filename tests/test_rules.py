"""Decision rules by hand."""

from pyspark.sql import functions as F

from cairn.operators import rules as R

GAME = "struct<name: string, developers: array<string>, tags: array<string>, genres: array<string>>"


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def test_adult_signs(spark):
    names = {"Naked Sushi": True, "Sexy Chess": True, "Sussex Rally": False, "Strip Poker Night": True, "Middlesex": False, "A Game 18+": True, "Unsexed": False, "HENTAI": True, None: False}
    got = {r["n"]: r["x"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", R.adult_name(F.col("n")).alias("x")).collect()}
    assert got == names
    votes = [(["NSFW", "A"], [17, 83], True), (["NSFW", "A"], [16, 84], False), (["NSFW", "A", "B", "C", "D", "E", "F", "G"], [13, 13, 13, 13, 12, 12, 12, 12], True), (["NSFW", "A"], [0, 0], False), ([], [], False), (["A"], [3], False), (["Nudity", "Hentai", "A"], [10, 10, 80], True)]
    rows = spark.createDataFrame([(i, t, w) for i, (t, w, _) in enumerate(votes)], "i int, t array<string>, w array<long>").select("i", R.adult_votes(F.col("t"), F.col("w")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: v for i, (_, _, v) in enumerate(votes)}
    whole = R.adult(F.col("n"), F.col("g"), F.col("t"), F.col("w"), F.col("d"))
    cases = [("Chess", ["Nudity"], ["A"], [1], [1], True), ("Chess", ["Action"], ["A"], [1], [5, 3], True), ("Chess", ["Action"], ["A"], [1], [5], False), ("Chess", None, None, None, None, False)]
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, n string, g array<string>, t array<string>, w array<long>, d array<int>").select("i", whole.alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: c[5] for i, c in enumerate(cases)}


def test_explanations(spark):
    souls, three, chess = ("Dark Lake", ["Oak"], ["Hard"], ["RPG"]), ("Dark Lake III", ["Oak"], ["Hard"], ["RPG"]), ("Chéss+", ["Pine", "Elm"], ["Calm"], ["Board", "RPG"])
    schema = f"t string, c {GAME}, l array<{GAME}>"
    named = R.names_candidate(F.col("t"), F.col("c"), F.col("l"))
    assert one(spark, named, schema, "Like dark  LAKE, but longer", souls, [three]) and not one(spark, named, schema, "Like Dark Lake III", souls, [three])
    assert not one(spark, named, schema, "A darkly lake", souls, []) and one(spark, named, schema, "because chess+ is fun", chess, [])
    problem = R.explanation_problem(F.col("t"), F.col("c"), F.col("l"), 40)
    assert one(spark, problem, schema, "You liked Chéss+", souls, [chess]) is None and one(spark, problem, schema, "More from oak", souls, [chess]) is None
    assert one(spark, problem, schema, "Fits your taste", souls, [chess]) == "not grounded" and one(spark, problem, schema, "x" * 41, souls, [chess]) == "too long"
    said = lambda c, *l, language="en": one(spark, R.template_explanation(F.col("c"), F.col("l"), language), schema, "", c, list(l))
    assert said(souls, chess) == "Because you liked Chéss+, which is also RPG." and said(souls, chess, three) == "Because you liked Chéss+, which is also RPG."
    assert said(souls, three) == "Because you liked Dark Lake III, from the same studio (Oak)." and said(("X", [], [], []), chess) == "Because you liked Chéss+."
    assert said(souls) == "Fits your taste for RPG games." and said(("X", [], [], [])) == "Recommended from your reviews." and said(souls, language="es") == "Encaja con tu gusto por los juegos de RPG."


def test_guarded_updates_change_nothing_twice(spark):
    df = spark.createDataFrame([(None, None, 5, 9, 10), (None, True, 5, 9, 10), (7, None, 5, 9, 10), (None, None, None, None, None), (None, None, 5, 10, None)], "o long, c boolean, fo long, f long, t long")
    o, c = R.seeded(*(F.col(x) for x in "o c fo f t".split()))
    once = df.select(o.alias("o"), c.alias("c"), "fo", "f", "t")
    assert [tuple(r)[:2] for r in once.collect()] == [(5, False), (None, True), (7, None), (None, True), (5, True)]
    twice = once.select(o.alias("o"), c.alias("c"), "fo", "f", "t")
    assert [tuple(r) for r in twice.collect()][:2] == [tuple(r) for r in once.collect()][:2]
    again = R.reopened(F.col("o"), F.col("c"), F.col("s"), F.col("f"), F.col("t"), 1000)
    cases = [(1, True, None, 10, 500, 10), (1, True, 1000, 10, 500, None), (1, False, None, 10, 500, None), (None, True, None, 10, 500, None), (1, True, None, 450, 500, None), (1, True, None, 10, None, None), (1, True, None, None, 200, 0)]
    got = [r["x"] for r in spark.createDataFrame([x[:5] for x in cases], "o long, c boolean, s long, f long, t long").select(again.alias("x")).collect()]
    assert got == [x[5] for x in cases]
    status, attempts = R.after_failure(F.col("s"), F.col("a"), 3)
    rows = spark.createDataFrame([("pending", None), ("pending", 2), ("scraped", 5)], "s string, a int").select(status, attempts).collect()
    assert [tuple(r) for r in rows] == [("pending", 1), ("failed", 3), ("scraped", 6)]


def test_gates(spark):
    said = lambda *v: one(spark, R.promotion(F.col("s"), F.col("c"), F.col("f"), 0.01), "s double, c double, f double", *v)
    assert [said(0.3, 0.2, 0.1), said(0.21, 0.2, 0.1), said(0.1, None, 0.1), said(0.2, None, 0.1), said(None, 0.2, 0.1)] == ["better than the champion", "gain too small", "not above the baseline", "first champion", "no metric"]
    assert said(0.205, 0.2, 0.1) == "gain too small"
    runs = [(1, False, 0.1, 0.0, 0.0, 0.0, 0.0, 0.5, 0.3), (2, True, 0.9, 0.0, 0.0, 0.0, 0.0, 0.5, 0.3), (3, True, None, 0.4, 0.4, 0.0, 0.0, 0.5, 0.3), (4, True, 0.1, 0.5, 0.4, 0.1, 0.2, 0.5, 0.3), (5, False, 0.1, 0.0, 0.0, 0.0, 0.0, 0.5, 0.3), (6, False, None, 0.0, 0.0, 0.0, 0.0, 0.5, 0.3), (7, False, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.3)]
    challengers = [(1, 1, 0.9, 0.9, 0.9), (1, 2, 0.2, 0.6, 0.3), (1, 3, None, 0.6, 0.4), (2, 1, 0.1, 0.9, 0.9), (3, 1, 0.1, 0.9, 0.9), (4, 1, 0.1, 0.9, 0.9), (5, 1, 0.8, 0.9, 0.9), (6, 1, 0.1, 0.9, 0.2)]
    out = R.pair_promotion(spark.createDataFrame(runs, "run int, changed boolean, reach double, new_recall double, old_recall double, new_ceiling double, old_ceiling double, recall double, ndcg double"), spark.createDataFrame(challengers, "run int, pair int, reach double, recall double, ndcg double"), 0.5, 0.01, 0.01)
    assert sorted(map(tuple, out.collect())) == [(1, 3, "better"), (2, None, "one item in too many lists"), (3, None, "retrieval not better"), (4, None, "ceiling fell"), (5, None, "every challenger floods"), (6, None, "final lists not better"), (7, None, "every challenger floods")]
    history = spark.createDataFrame([(1, 1, "promote", "a"), (1, 2, "promote", "b"), (1, 3, "evaluate", "c"), (1, 4, "promote", "b"), (2, 1, "promote", "a")], "run int, at int, action string, pair string")
    assert [tuple(r) for r in R.rollback(history, "run", "at", "action", "pair").collect()] == [(1, "a")]
