"""Queries of cairn.plans.training on small tables that the given ones don't hold."""

from datetime import datetime

import duckdb
import numpy as np
import pytest

from cairn.operators import models, retrieval
from cairn.plans import catalog


def tables(spark, folder, **rows):
    """Writes name=(rows, schema) as tables, and gives a database that sees them."""
    db = duckdb.connect()
    for name, (x, schema) in rows.items():
        spark.createDataFrame(x, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return db


def same_as_sql(spark, db, folder, name):
    found = db.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()), key=repr) == want
    return [dict(zip(columns, r, strict=True)) for r in want]


def test_target_positions_of_users_without_orders(spark, tmp_path):
    day = lambda n: datetime(1996, 1, n)
    orders = [(1, 1, 60e3, day(1)), (2, 1, 200e3, day(2)), (3, 1, 60e3, day(3)), (4, 2, 1e3, day(1)), (8, 2, 2e3, day(2)), (5, 3, None, day(1)), (6, 3, 1e3, day(1)), (7, 3, None, day(2)), (9, 4, 1e3, day(3)), (9, 4, 90e3, day(2)), (1, 4, 70e3, day(4)), (None, 6, 1e3, day(1))]
    db = tables(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"), customer=([(k,) for k in (1, 2, 3, 3, 4, 5, 6)], "c_custkey long"))
    got = {r["user_id"]: (r["position"], r["hits"]) for r in same_as_sql(spark, db, tmp_path, "target_positions")}
    assert got[5] == (-1, None) and got[1] == (1, 1) and got[2] == (-1, 1)


@pytest.mark.parametrize("blocks", [(8192, 8192, 4096), (7, 3, 4)])
def test_shared_top_k_against_all_scores(spark, monkeypatch, blocks):
    query_rows, vector_rows, shared = blocks
    monkeypatch.setattr(retrieval, "SHARED", shared)
    rng = np.random.default_rng(5)
    v, u = rng.integers(-2, 3, (9, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)
    vec, bias = {i: int(rng.integers(9)) if i % 3 else 4 for i in range(60)}, {}
    for i in range(60):
        for at in rng.permutation(4)[: rng.integers(4)].tolist():
            bias[i, at] = float(rng.integers(1, 4)) / 4
    gone = {q: sorted(rng.permutation(70)[: rng.integers(25)].tolist()) if q % 4 else None for q in range(40)}
    spare = max(sum(vec.get(i) == x for i in g or []) for g in gone.values() for x in range(9))
    queries = spark.createDataFrame([(q, q % 4, u[q].tolist(), gone[q]) for q in range(40)], "query_id long, at int, vector array<double>, gone array<long>")
    rows = [(i, vec[i], [a for j, a in bias if j == i] or None, [b for (j, _), b in bias.items() if j == i] or None) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, vec_id long, ats array<int>, biases array<double>")
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(9)], "vec_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in retrieval.shared_top_k(queries, items, vectors, 5, -0.25, spare, query_rows=query_rows, vector_rows=vector_rows).collect()}
    want = {}
    for q in range(40):
        s = sorted((-float(u[q] @ v[vec[i]] + bias.get((i, q % 4), -0.25)), i) for i in range(60) if i not in (gone[q] or []))
        want |= {(q, rank + 1): (i, -x) for rank, (x, i) in enumerate(s[:5])}
    assert got == want


def test_top_k_of_the_month_sends_no_row_for_each_month_and_game(spark, monkeypatch):
    """Every row that meets a query is of a vector, or of the first games of a bucket and month."""
    monkeypatch.setattr(retrieval, "dense_top_k", None)
    assert catalog.QUERIES["top_k_of_the_month"](spark, "/root/testdata/sf0.001").count() > 0


def test_svd_of_many_items_with_equal_singular_values(spark):
    """Two copies of the same events: each singular value comes twice."""
    rng = np.random.default_rng(2)
    one = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 80, 3000), rng.integers(0, 300, 3000) ** 2 // 300, strict=True)})
    likes = one + [(u + 80, i + 300) for u, i in one]
    count = np.bincount([i for _, i in likes], minlength=600)
    got = {r["id"]: np.array(r["vector"]) for r in models.svd_items(spark.createDataFrame(likes, "u long, i long"), "u", "i", 6).collect()}
    m = np.zeros((160, 600))
    for u, i in likes:
        m[u, i] = 1 / np.sqrt(count[i])
    _, s, v = np.linalg.svd(m, full_matrices=False)
    want = v[:6].T * np.sqrt(s[:6])
    want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert set(got) == set(np.flatnonzero(count).tolist()) and max(got) >= 512
    ids = [i for i in got if count[i] >= 5][::3]
    a, b = np.stack([got[i] for i in ids]), want[ids]
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-5) and not any(got[i].any() for i in got if count[i] < 5)
