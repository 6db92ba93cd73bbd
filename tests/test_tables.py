"""Versioned tables, dictionaries and streams over two batches."""

import pytest
from pyspark.sql import functions as F

from cairn.operators.tables import Conflict, SchemaChanged, Table, assign_ids, cached, changed_only, check_card, extend_dictionary, gone_keys, publish
from cairn.sources.tables import Snapshot, find_files, read_declared, run_sql, vocabulary_size
from cairn.streaming import incremental as I


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merge_keeps_versions(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at long"), ["k"])
    pinned = Snapshot({"t": t})
    t.merge(spark.createDataFrame([(2, "old", 0), (3, "c", 2), (1, "new", 5)], "k long, v string, at long"), ["k"], newer="at")
    assert rows(t.read()) == [(1, "new", 5), (2, "b", 1), (3, "c", 2)] and rows(pinned.read("t")) == [(1, "a", 1), (2, "b", 1)]
    assert t.high_water("at", 0) == 5 and Table(spark, f"file://{tmp_path}/none").high_water("at", 7) == 7
    wide = spark.createDataFrame([(3, "z", 9, True)], "k long, v string, at long, flag boolean")
    with pytest.raises(SchemaChanged):
        t.merge(wide, ["k"])
    t.merge(wide, ["k"], on_schema_change="append_new_columns")
    assert set(t.read().columns) == {"k", "v", "at", "flag"} and t.read().filter("flag IS NULL").count() == 2
    t.merge(wide.drop("at"), ["k"], on_schema_change="sync_all_columns")
    assert set(t.read().columns) == {"k", "v", "flag"}
    before = rows(t.read())
    t.compact(1)
    t.vacuum()
    assert rows(t.read()) == before and len(t.manifest()["versions"]) == 1


def test_pinned_versions_stay_after_vacuum(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/v")
    for k in range(3):
        t.overwrite(spark.createDataFrame([(k,)], "v long"))
    t.vacuum()
    pinned = Snapshot({"t": t})
    for k in range(3, 5):
        t.overwrite(spark.createDataFrame([(k,)], "v long"))
    assert rows(pinned.read("t")) == [(2,)] and rows(t.read()) == [(4,)] and t.manifest()["versions"] == ["v000002", "v000003", "v000004"]


def test_a_failed_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = Table(spark, f"file://{tmp_path}/c")
    t.overwrite(spark.createDataFrame([(1,)], "v long"))
    swap = Table._swap

    def crash(*_):
        raise OSError

    monkeypatch.setattr(Table, "_swap", crash)
    with pytest.raises(OSError):
        t.overwrite(spark.createDataFrame([(2,)], "v long"))
    monkeypatch.setattr(Table, "_swap", swap)
    assert rows(t.read()) == [(1,)]
    before = t.manifest()
    t.overwrite(spark.createDataFrame([(3,)], "v long"))
    assert rows(t.read()) == [(3,)]
    with pytest.raises(Conflict):  # a writer that began before
        t._commit(t.read(), t.manifest_of(t.version())["parts"], after=before)
    assert rows(t.read()) == [(3,)]


def test_a_merge_writes_touched_buckets_only(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/b", buckets=8, by=["k"])
    t.merge(spark.range(100).selectExpr("id AS k", "id AS v"), ["k"])
    first = set(t.manifest_of(t.version())["parts"])
    assert len(first) == 8
    t.merge(spark.createDataFrame([(3, -3), (500, 5)], "k long, v long"), ["k"], note={"batch": 4})
    second = set(t.manifest_of(t.version())["parts"])
    assert 6 <= len(first & second) < 8 and t.note() == {"batch": 4}
    assert dict(rows(t.read())) == {k: k for k in range(100)} | {3: -3, 500: 5}
    t.merge(spark.createDataFrame([(4, 4, "x")], "k long, v long, n string"), ["k"], on_schema_change="append_new_columns")
    assert t.read().filter("n IS NOT NULL").count() == 1 and t.read().count() == 101
    t.vacuum()
    assert t.read().count() == 101 and t.near(spark.createDataFrame([(4,)], "k long")).count() < 101
    empty = Table(spark, f"file://{tmp_path}/e", buckets=8, by=["k"])
    empty.overwrite(spark.createDataFrame([], "k long, v long"))
    assert empty.read().count() == 0


def test_dictionaries_only_grow(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/d")
    first = spark.createDataFrame([("plum",), ("fig",), (None,), ("quince",), ("apple",), ("plum",)], "name string")
    extend_dictionary(t, first, "name", "id")
    extend_dictionary(t, spark.createDataFrame([("cherry",), ("fig",), ("banana",)], "name string"), "name", "id")
    assert {r["name"]: r["id"] for r in t.read().collect()} == {"apple": 2, "fig": 3, "plum": 4, "quince": 5, "banana": 6, "cherry": 7}
    version = t.version()
    extend_dictionary(t, first, "name", "id")
    assert t.version() == version and vocabulary_size(t.read(), "id") == 8
    assert assign_ids(first.limit(0), "name", t.read(), "id").count() == 0


def test_change_only_publication(spark, tmp_path):
    stored = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, h string")
    items = spark.createDataFrame([(1, "x"), (2, "other"), (4, "w")], "k long, h string")
    assert rows(changed_only(items, stored, "k", "h")) == [(2, "other"), (4, "w")] and rows(gone_keys(items, stored, "k")) == [(3,)]
    t = Table(spark, f"file://{tmp_path}/p")
    assert publish(t, items, expected_rows=3, title="lists")["rows"] == 3
    assert rows(check_card(t, ["k", "h"])) == rows(items)
    for bad in (lambda: publish(t, items, expected_rows=4), lambda: check_card(t, ["other"])):
        with pytest.raises(ValueError):
            bad()
    t.append(items)
    assert check_card(t, ["k"]).count() == 3


def test_cached_results(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(len(built))
    count = lambda **k: cached(spark, f"file://{tmp_path}/c", "x", build, **k).count()
    assert [count(), count(), count(refresh=True)] == [1, 1, 2]


def test_sources(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/a.parquet")
    spark.range(2).selectExpr("id", "'x' AS note").coalesce(1).write.parquet(f"file://{tmp_path}/a-001.parquet")
    files = find_files(spark, f"file://{tmp_path}", "a")
    assert len(files) == 2
    assert read_declared(spark, files, "id long, note string").filter("note IS NULL").count() == 3
    with pytest.raises(FileNotFoundError):
        find_files(spark, f"file://{tmp_path}", "b")
    with pytest.raises(ValueError):
        run_sql(spark, "SELECT * FROM {t}", t="a; DROP TABLE b")


def test_streams_consume_each_row_once(spark, tmp_path):
    schema = "user long, good long, n long, ts timestamp"
    folder, table = f"file://{tmp_path}/in", Table(spark, f"file://{tmp_path}/state")
    ledger = Table(spark, f"file://{tmp_path}/ledger")

    def batch(values):
        spark.createDataFrame(values, "user long, good long, n long, s long").select("user", "good", "n", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(folder)

    def run():
        s = I.source(spark, folder, spark.createDataFrame([], schema).schema)
        I.running_counts(s, table, "user", ["good", "n"], f"file://{tmp_path}/c1").awaitTermination()
        I.append_ledger(s, ledger, ["user"], [F.col("ts")], f"file://{tmp_path}/c2").awaitTermination()

    batch([(1, 1, 1, 10), (1, 0, 1, 20), (2, 1, 1, 5)])
    run()
    assert rows(table.read().select("user", "good", "n")) == [(1, 1, 2), (2, 1, 1)]
    run()
    batch([(1, 1, 1, 1), (3, 1, 1, 2)])
    run()
    assert rows(table.read().select("user", "good", "n")) == [(1, 2, 3), (2, 1, 1), (3, 1, 1)]
    assert {r["user"]: r["ts"].timestamp() for r in ledger.read().collect()} == {1: 10, 2: 5, 3: 2}


def test_sessions(spark, tmp_path):
    spark.createDataFrame([(1, 0), (1, 60), (1, 4000), (2, 10)], "u long, s long").select("u", F.timestamp_seconds("s").alias("ts")).write.parquet(f"file://{tmp_path}/e")
    out = I.session_counts(I.source(spark, f"file://{tmp_path}/e", spark.createDataFrame([], "u long, ts timestamp").schema), "ts", "u")
    q = out.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination()
    assert sorted((r["u"], r["n"]) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]
