"""Queries without SQL, held against numpy."""

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import models
from cairn.plans import catalog

SMALL = "/root/testdata/sf0.001"


def vectors(df, key="id", value="vector"):
    return {r[key]: np.array(list(r[value]), float) for r in df.collect()}


def test_effective_rank(spark):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()], float)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / s.sum()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = (unit @ unit.T)[~np.eye(len(x), dtype=bool)].mean()
    r = catalog.QUERIES["effective_rank"](spark, SMALL).first()
    assert r["rows"] == len(x) and r["dim"] == 64 and np.isclose(r["mean_cosine"], cosine) and np.isclose(r["effective_rank"], np.exp(-(p * np.log(p)).sum()), rtol=1e-6)
    flat = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],), (None,)], "v array<double>")
    assert models.embedding_health(flat, "v")[3] == 0.0 and models.embedding_health(flat.limit(0), "v") == (0, 0, 0.0, 0.0, 0.0)


def test_item_tower(spark):
    rows = [(1, "a", "x", ["p", "q"], True, 2.0), (2, None, "x", [], None, None), (3, "a", None, None, False, 1.0)]
    df = spark.createDataFrame(rows, "k long, d string, g string, t array<string>, f boolean, n double")
    got = vectors(models.item_tower(df, "k", ["d", "g"], "t", ["f", "n"], 8))
    rng = np.random.default_rng(0)
    w1, b1, w2 = rng.normal(size=(10, 8)) / np.sqrt(8), rng.normal(size=8) / 8, rng.normal(size=(8, 8)) / np.sqrt(8)
    of = lambda *names: models.hashed_vectors(list(names), 8)
    for k, d, g, t, f, n in rows:
        x = of(f"id {k}")[0] + sum(of(f"{c} {v}")[0] for c, v in (("d", d), ("g", g)) if v)
        if t:
            x = x + of(*[f"t {v}" for v in t]).mean(0)
        y = np.maximum(np.concatenate([x, [float(f or 0), float(n or 0)]]) @ w1 + b1, 0) @ w2
        assert np.allclose(got[k], y / np.linalg.norm(y))
    all_items = vectors(catalog.QUERIES["item_tower"](spark, SMALL))
    assert len(all_items) == 200 and all(np.isclose(np.linalg.norm(v), 1) for v in all_items.values())


def test_svd_items(spark):
    rng = np.random.default_rng(1)
    likes = {(int(u), int(i)) for u, i in zip(rng.integers(0, 60, 500), rng.integers(0, 12, 500) ** 2 // 12, strict=True)} | {(1, 13)}
    got = vectors(models.svd_items(spark.createDataFrame(sorted(likes), "u long, i long"), "u", "i", 4))
    count = {i: sum(b == i for _, b in likes) for i in {b for _, b in likes}}
    m = np.zeros((60, 14))
    for u, i in likes:
        m[u, i] = 1 / np.sqrt(count[i])
    _, s, v = np.linalg.svd(m, full_matrices=False)
    want = v[:4].T * np.sqrt(s[:4])
    want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert not got[13].any() and set(got) == set(count)
    ids = [i for i in count if count[i] >= 5]
    # Signs of singular vectors are free: their products aren't.
    assert np.allclose([got[a] @ got[b] for a in ids for b in ids], [want[a] @ want[b] for a in ids for b in ids], atol=1e-6)
    assert models.svd_items(spark.createDataFrame([], "u long, i long"), "u", "i", 4).count() == 0


def test_attention_users(spark):
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    rng = np.random.default_rng(0)
    wq, wk, wv, w = (rng.normal(size=(64, 16)) / 8 for _ in range(4))
    got = vectors(catalog.QUERIES["attention_users"](spark, SMALL), "user_id")
    for user in list(got)[::40]:
        x = np.stack([e[i] for i in sorted((i for i in e if i % 200 == user), reverse=True)[:8]])
        s = (x @ wq) @ (x @ wk).T / 4
        a = np.exp(s - s.max(1, keepdims=True))
        y = (a / a.sum(1, keepdims=True) @ (x @ wv)).mean(0) @ w[:16]
        assert np.allclose(got[user], y / np.linalg.norm(y))


def test_clusters_are_nearest_centres(spark):
    rows = catalog.QUERIES["tag_clusters"](spark, SMALL).collect()
    p = {r["p_partkey"]: (float(r["p_size"]), r["p_retailprice"] / 100) for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    x, c = np.array([p[r["p_partkey"]] for r in rows]), np.array([r["cluster"] for r in rows])
    centres = np.stack([x[c == k].mean(0) for k in range(c.max() + 1)])
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    xy = np.array([(r["x"], r["y"]) for r in rows])
    assert np.allclose(np.abs(xy), np.abs(x @ v.T))  # signs of components are free
    assert len(rows) == len(p) and c.max() == 4 and (d[np.arange(len(x)), c] <= d.min(1) + 0.5).all()


def test_item_factors_fit_the_events(spark):
    """Items that share users have closer factors than others."""
    df = spark.createDataFrame([(u, i + (4 if u % 2 else 0)) for u in range(40) for i in range(4) if (u * 7 + i) % 5], "u long, i long")
    v = vectors(models.item_vectors(df, "u", "i", 4), "id", "features")
    cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert set(v) == set(range(8)) and min(cos(a, b) for a in range(4) for b in range(4)) > max(cos(a, b) for a in range(4) for b in range(4, 8))


def test_text_embeddings_are_unit_and_group_like_texts(spark):
    df = spark.createDataFrame([(i, ("red fox runs" if i % 2 else "blue whale swims deep") + f" {i % 3}") for i in range(20)], "k long, text string")
    v = vectors(models.text_vectors(df, "text", 3, 256), "k")
    assert all(np.isclose(np.linalg.norm(x), 1) for x in v.values()) and v[1] @ v[7] > 0.99 > v[1] @ v[2]


def test_importances_and_ablation(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("double").alias("y"), ((F.col("id") % 2) * 3 + F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    _, share = models.ranker(df, ["a", "b"], "y", trees=3, depth=2)
    assert np.isclose(sum(share.values()), 1) and share["a"] > 0.9
    rows = {r["family"]: (r["auc"], r["delta"]) for r in models.ablation(df, {"good": ["a"], "noise": ["b"]}, "y", folds=3).collect()}
    assert rows["good"][1] < -0.2 and abs(rows["noise"][1]) < 0.1 and rows["all"][1] == 0
    assert models.cross_validated_auc(df, ["a"], "y", 3) > 0.8
