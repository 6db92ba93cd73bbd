import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.llm import language, quality, toxicity
from cairn.llm.linear import fit_logistic, sigmoid
from cairn.llm.queries import QUERIES

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_logistic_model_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = (rng.random(400) < sigmoid(x @ np.array([1.0, -2.0, 0.5]) + 0.3)).astype(np.float32)
    w, b = fit_logistic(x, y, l2=1.0)
    r = sigmoid(x @ w + b) - y
    assert np.abs(x.T @ r / 400 + w / 400).max() < 2e-3 and abs(r.mean()) < 2e-3
    assert np.isfinite(fit_logistic(x, np.zeros(400, np.float32))[1])


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = QUERIES["op3_quality"](spark, MIDDLE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_lookup_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20, pair_rounds=60, n_pairs=2)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95
    by_hand = []
    for row in x[:20]:
        b = [int((e <= v).sum()) for e, v in zip(model.edges, row, strict=True)]
        z = model.intercept + sum(t[k] for t, k in zip(model.tables, b, strict=True)) + sum(t[b[i] // model.coarse, b[j] // model.coarse] for i, j, t in model.pairs)
        by_hand.append(1 / (1 + np.exp(-z)))
    assert np.allclose(model.score(x[:20]), by_hand)


def test_trees_and_pairs_against_all_splits():
    """The first split of a tree is the best of all cuts, and the pairs chosen are those whose grids promise most."""
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=9), rng.random(9) + 0.5
    leaf = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    k = max(range(1, 9), key=lambda k: leaf(0, k) + leaf(k, 9))
    want = np.concatenate([np.full(k, g[:k].sum() / (h[:k].sum() + 1)), np.full(9 - k, g[k:].sum() / (h[k:].sum() + 1))])
    assert np.allclose(quality._tree(g, h, 1, 1.0, 0.1), want)
    gg, hh = rng.normal(size=(5, 5)), rng.random((5, 5)) + 0.5
    cell = lambda m: gg[m].sum() ** 2 / (hh[m].sum() + 1.0)
    cuts = []
    for axis in (0, 1):
        for k in range(1, 5):
            m = np.zeros((5, 5), bool)
            m[(slice(k), slice(None)) if axis == 0 else (slice(None), slice(k))] = True
            cuts.append((cell(m) + cell(~m), m))
    m = max(cuts, key=lambda c: c[0])[1]
    grid = quality._grid_tree(gg, hh, 1, 1.0, 0.1)
    assert np.allclose(grid, np.where(m, gg[m].sum() / (hh[m].sum() + 1), gg[~m].sum() / (hh[~m].sum() + 1)))
    x = rng.random((800, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    assert {(i, j) for i, j, _ in quality.fit(x, y, rounds=5, pair_rounds=5, n_pairs=1).pairs} <= {(3, 1), (1, 3)}


def test_quality_features_by_hand():
    x = quality.features(pa.array(["", "a a b", "AB\nAB\nc9!"], pa.large_string()))
    f = dict(zip(quality.FEATURES, x.T, strict=True))
    assert f["words"].tolist() == np.log1p([0, 3, 3]).tolist()
    assert np.allclose(f["repeated_next"], [0, 1 / 3, 1 / 3]) and np.allclose(f["repeated_lines"], [0, 0, 1 / 3])
    assert np.allclose(f["upper"], [0, 0, 4 / 9]) and np.allclose(f["bangs"], [0, 0, 1 / 9])


def test_quality_without_labels(spark, small_docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    scores = quality.score(small_docs, quality.train(small_docs, none)).collect()
    assert len(scores) == small_docs.count() and {r["score"] for r in scores} == {0.5}
    assert quality.score(small_docs.limit(0), quality.Gam()).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language"](spark, MIDDLE)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bundles_are_sums_of_bound_letters():
    texts = ["ab", "Ab é", "", "1 2", "x"]
    found = {lo + i: (v, some) for lo, x, has in language.bundles(pa.array(texts, pa.large_string()), 64) for i, (v, some) in enumerate(zip(x, has, strict=True))}
    for i, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        line = " ".join(["", *words, ""]) if words else ""
        want = np.zeros(64)
        for k in range(len(line) - 2):
            v = np.ones(64)
            for p, c in enumerate(line[k : k + 3]):
                v *= np.roll(language.letter(0 if c == " " else ord(c), 64).astype(float), 2 - p)
            want += v
        assert np.array_equal(found[i][0], want) and found[i][1] == bool(words)


def test_prototypes_and_cosines_by_hand(spark):
    """Prototypes are sums of unit bundles a language, and a text's score is its cosine with the best."""
    texts = [("the cat and the dog", "en"), ("a house of cards", "en"), ("der hund und die katze", "de"), ("ein haus aus karten", "de"), ("le chat", "fr")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    bundle = {i: v for i, t in enumerate(t for t, _ in texts) for _, v, _ in language.bundles(pa.array([t], pa.large_string()), 256)}
    unit = lambda v: v / np.linalg.norm(v)
    want = {x: sum(unit(bundle[i].astype(float)[0]) for i, (_, own) in enumerate(texts) if own == x) for x in ("de", "en", "fr")}
    got = language.train(docs, dimensions=256)
    assert list(got) == ["de", "en", "fr"] and all(np.allclose(got[x], want[x], atol=1e-5) for x in want)
    for r in language.predict(docs, got).collect():
        cosine = {x: float(unit(bundle[r["doc_id"]][0].astype(float)) @ unit(want[x])) for x in want}
        best = max(cosine, key=lambda x: cosine[x])
        assert r["lang_pred"] == best and abs(r["score"] - cosine[best]) < 1e-4


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, "x", None), (4, None, "en"), (5, "12 ?", "de"), (5, "12 ?", "de")], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.predict(docs, language.train(docs)).collect())
    assert [g for g in got if g[0] > 3] == [(4, "und"), (5, "und"), (5, "und")] and dict(got)[1] == "en" and dict(got)[2] == "de" and dict(got)[3] in ("en", "de")
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}
    assert language.predict(docs.limit(0), {}).count() == 0


def test_toxicity_finds_labelled_documents(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = QUERIES["op5_toxicity"](spark, MIDDLE).withColumnRenamed("toxic", "said")
    rows = got.join(labels, "doc_id").collect()
    hit = sum(r["said"] and r["toxic"] for r in rows)
    assert hit >= 0.85 * sum(r["toxic"] for r in rows) and hit >= 0.95 * sum(r["said"] for r in rows)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.filter("NOT said").count()


def test_toxicity_on_held_out_documents(spark):
    """Trained on four fifths of the labels, judged on the others: toxic documents caught, clean ones left alone."""
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").filter("toxic IS NOT NULL")
    chain = toxicity.train(docs, labels.filter(fold != 0), toxicity.label_categories())
    held = labels.filter(fold == 0)
    rows = toxicity.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), chain).withColumnRenamed("toxic", "said").join(held, "doc_id").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    # A tenth of the toxic labels stand at texts that hold nothing abusive.
    assert len(toxic) > 50 and sum(r["said"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["said"] for r in clean) <= 0.005 * len(clean)


def test_toxic_labels_of_unknown_quality_teach(spark):
    docs = spark.createDataFrame([(i, "you are a vile creature" if i % 4 == 0 else "the weather is fine today") for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(NULL AS int) AS quality", "cast(doc_id % 4 = 0 AS int) AS toxic")
    assert toxicity.drop_toxic(docs, labels).count() == 150
    some = labels.selectExpr("doc_id", "CASE WHEN doc_id % 8 = 0 THEN 1 END AS quality", "toxic")
    chain = toxicity.train(docs, some, toxicity.label_categories())
    assert chain.names[-1] == "toxic" and toxicity.score(docs, chain).filter("toxic").count() == 50


def test_selection_and_folds_by_hand():
    """Feature statistics over known labels only, and probabilities of later models from folds that haven't seen the document."""
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 30, 8)).astype(np.uint32) for _ in range(200)]
    y = np.array([[np.nan if i % 3 == 0 else 3 in d, 3 in d or 4 in d] for i, d in enumerate(docs)], np.float32)
    fold = np.arange(200) % toxicity.FOLDS
    stat = np.zeros(30)
    for c in range(2):
        known = [i for i in range(200) if not np.isnan(y[i, c])]
        p = np.mean([y[i, c] for i in known])
        for f in range(30):
            m = [y[i, c] for i in known if f in docs[i]]
            a, b = sum(m), len(m) - sum(m)
            g = (a * np.log(a / (len(m) * p)) if a else 0) + (b * np.log(b / (len(m) * (1 - p))) if b else 0)
            stat[f] = max(stat[f], g)
    want = sorted(f for f in np.argsort(-stat, kind="stable")[:5] if stat[f] > 2)
    assert toxicity.select(docs, y, 5).tolist() == want and 3 in want and 4 in want
    chain = toxicity.fit_chain(docs, y, fold, ["a", "b"], 5)
    x = np.array([[f in d for f in chain.kept] for d in docs], np.float32)
    known = ~np.isnan(y[:, 0])
    own = np.zeros(200)
    for f in range(toxicity.FOLDS):
        w, b = fit_logistic(x[known & (fold != f)], y[known & (fold != f), 0])
        own[fold == f] = sigmoid(x[fold == f] @ w + b)
    w, b = fit_logistic(np.column_stack([x, toxicity._log_odds(own)]), y[:, 1])
    assert np.allclose(chain.weights[1], w, atol=1e-4) and abs(chain.intercepts[1] - b) < 1e-4


def test_chain_probabilities_by_hand():
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 40, 12)).astype(np.uint32) for _ in range(300)]
    y = np.array([[7 in d, 7 in d and 9 in d] for d in docs], np.float32)
    chain = toxicity.fit_chain(docs, y, np.arange(300) % 5, ["a", "b"], 20)
    h, d = np.concatenate(docs), np.repeat(np.arange(300), [len(x) for x in docs])
    p = chain.probabilities(h, d, 300)
    for i in range(0, 300, 37):
        at = [k for k, f in enumerate(chain.kept) if f in docs[i]]
        a = sigmoid(chain.intercepts[0] + chain.weights[0][at].sum())
        b = sigmoid(chain.intercepts[1] + chain.weights[1][at].sum() + chain.weights[1][len(chain.kept)] * toxicity._log_odds(np.array([a]))[0])
        assert np.allclose(p[i], [a, b], atol=1e-6)
    assert np.mean((p[:, 1] > 0.5) == y[:, 1]) > 0.97


def test_toxicity_edges(spark, small_docs):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(small_docs, labels)
    assert kept.count() == small_docs.count() and kept.columns == small_docs.columns
    assert toxicity.drop_toxic(small_docs.limit(0), labels).count() == 0


def test_rows_are_rejected_by_their_own_text(spark):
    """A repeated id with a toxic and a clean text loses the toxic one only; a null id is judged as well."""
    good, bad = "the weather is fine today", "you are a vile creature"
    docs = spark.createDataFrame([(i, bad if i % 4 == 0 else good, i) for i in range(200)], "doc_id long, text string, p_toxic int")
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 4 = 0 AS int) AS toxic")
    more = docs.union(spark.createDataFrame([(1, bad, 1), (4, good, 1), (None, bad, 1), (None, good, 1), (1, good, 1), (700, None, 1), (701, bad + " " + "wort " * 700_000, 1)], docs.schema))
    kept = toxicity.drop_toxic(more, labels)
    assert kept.schema == docs.schema
    extra = sorted((r["doc_id"] or 0, (r["text"] or "")[:3]) for r in kept.collect())
    assert len(extra) >= 150 + 4 and extra.count((1, "the")) == 2 and (4, "the") in extra and (0, "the") in extra and (700, "") in extra
    assert not any(t == "you" and len(k) < 50 for k, t in ((r["text"] or "", (r["text"] or "")[:3]) for r in kept.collect()))
