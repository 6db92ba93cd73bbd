import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline

from cairn.llm.decontaminate import contaminated
from cairn.sources import shared
from tests.llm.test_duplicates import classes_by_hand, lower
from tests.llm.test_tokens import plain

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, small_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert [n.split("_")[0] for n in names] == ["op5", "op8", "op10", "op4", "op9"]
    clean = corpus_pipeline.toxicity(spark, small_docs, SMALL)
    assert clean.columns == small_docs.columns and clean.count() > 0.8 * small_docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    first = {}
    for k in sorted(texts):
        first.setdefault(lower(texts[k]), k)
    exact = corpus_pipeline.exact(spark, clean, SMALL)
    assert {r["doc_id"] for r in exact.collect()} == set(first.values())
    near = corpus_pipeline.near(spark, exact, SMALL)
    assert {r["doc_id"] for r in near.collect()} == set(classes_by_hand({k: texts[k] for k in first.values()}).values())
    bench = corpus_pipeline.benchmark(spark, near, SMALL)
    assert bench.columns == small_docs.columns
    found = {r["doc_id"] for r in contaminated(near, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in bench.collect()} == {r["doc_id"] for r in near.select("doc_id").collect()} - found and found
    packed = corpus_pipeline.packing(spark, bench, SMALL).collect()
    rows = bench.select("doc_id", "text").collect()
    pieces, windows = defaultdict(dict), defaultdict(dict)
    for r in packed:
        pieces[r["doc_id"]][r["start"]] = r
        windows[r["sequence_id"]][r["offset"]] = r["length"]
    assert len(packed) == sum(map(len, pieces.values())) == sum(map(len, windows.values()))
    for r, ids in zip(rows, plain([r["text"] or "" for r in rows]), strict=True):
        ids, at = [*ids.tolist(), 0], 0
        for start in sorted(pieces[r["doc_id"]]):
            p = pieces[r["doc_id"]][start]
            assert start == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids) == p["doc_tokens"]
    for w in windows.values():
        assert sum(w.values()) <= 1024 and sorted(w) == [sum(w[o] for o in w if o < x) for x in sorted(w)]


def test_run_leaves_only_what_its_result_reads(spark, small_docs, tmp_path):
    small_docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"file://{tmp_path}/{t}.parquet")
    before = set(shared._made)
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    left = sorted(x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in set(shared._made) - before)
    assert left == ["op4_decontamination", "pieces"] and out.count() > 100


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
