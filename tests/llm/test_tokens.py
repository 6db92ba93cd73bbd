import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import runtime
from cairn.llm.packing import CapacityTree, best_fit_decreasing, pack, sequences
from cairn.llm.token_output import read_document, read_tokens, write_tokens
from cairn.llm.tokens import encoder

PATH = runtime.tokenizer_path()


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [np.array(e.ids, "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85 　a'sB9é<|>endoftext.ßا"), max_size=40), max_size=5))
def test_pieces_encode_as_whole_texts(texts):
    assert encoder(PATH).encode(texts) == [x.tobytes() for x in plain(texts)]


def test_special_strings_are_the_tokens_of_the_library():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|><|endoftext|>", " \n<|endoftext|> \n y", "<|endoftext|", ""]
    got = encoder(PATH).encode(texts)
    assert got == [x.tobytes() for x in plain(texts)]
    assert np.frombuffer(got[0], "<u4").tolist() == [64, 220, 50256, 275]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "word", "'s", "é", "<|", "7"]), max_size=12).map("".join), max_size=4))
def test_texts_with_special_strings(texts):
    assert encoder(PATH).encode(texts) == [x.tobytes() for x in plain(texts)]


def rows_of(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())


def test_token_files_round_trip(spark, small_docs):
    out = runtime.scratch(spark, "tokens")
    write_tokens(small_docs, out, PATH, end_id=2)
    rows = rows_of(small_docs)
    want = [np.append(x, 2).astype("<u4") for x in plain([t for _, t in rows])]
    start = np.cumsum([0] + [len(x) for x in want])
    got = sorted(read_tokens(spark, out).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(k, s, len(x), zlib.crc32(x.tobytes())) for (k, _), s, x in zip(rows, start, want, strict=False)]
    assert all(r["ids"] == x.tolist() for r, x in zip(got, want, strict=True))
    assert all(read_document(out, rows[k][0]).tolist() == want[k].tolist() for k in (0, 7, len(rows) - 1))
    with pytest.raises(KeyError):
        read_document(out, -5)


def test_token_files_of_no_documents_and_of_repeated_ids(spark):
    out = runtime.scratch(spark, "tokens")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert write_tokens(empty, out, PATH, end_id=2)["shards"] == []
    assert read_tokens(spark, out).count() == 0
    out = runtime.scratch(spark, "tokens")
    twice = spark.createDataFrame([(1, "a b"), (1, "c"), (None, None), (1, "a b")], "doc_id long, text string")
    write_tokens(twice, out, PATH, end_id=2)
    got = sorted(read_tokens(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1]
    assert json.loads(runtime.read_file(f"{out}/manifest.json"))["end_id"] == 2
    assert len(read_document(out, 1)) in (2, 3)


@pytest.mark.parametrize("n", [4, 400])
def test_dictionary_and_rolled_shards(spark, n):
    """Too few documents train no dictionary, which the manifest says; shards close at a number of documents."""
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60 + id % 50), x -> concat('word', (x * id) % 97))) AS text")
    out = runtime.scratch(spark, "tokens")
    manifest = write_tokens(docs, out, PATH, end_id=2, roll_docs=30)
    assert manifest["dictionary_trained"] == (n > 100) == (len(runtime.read_file(f"{out}/{manifest['dictionary']}")) > 0)
    assert all(s["docs"] <= 30 for s in manifest["shards"]) and (len(manifest["shards"]) >= n / 30)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in read_tokens(spark, out).collect()}
    assert got == {k: [*x.tolist(), 2] for k, x in zip(texts, plain(list(texts.values())), strict=True)}
    assert read_document(out, n - 1).tolist() == got[n - 1]


def best_fit_by_hand(counts, window):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, free in enumerate(bins) if free >= length]
            if fits:
                i = min(fits, key=lambda i: bins[i])
                bins[i] -= length
            else:
                bins.append(window - length)
    return sorted(bins)


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    used, ranks = defaultdict(list), defaultdict(list)
    for length, first, n, base, fit, offset in best_fit_decreasing(counts, 16):
        for j in range(n):
            used[base + j // fit].append((offset + j % fit * length, length))
            ranks[length].append(first + j)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 16
    assert sorted(16 - sum(x for _, x in v) for v in used.values()) == best_fit_by_hand(counts, 16)


def test_capacity_tree_against_a_scan():
    rng, tree, state = np.random.default_rng(1), CapacityTree(100), set()
    for _ in range(500):
        c = int(rng.integers(1, 101))
        (state.add if rng.random() < 0.4 else state.discard)(c)
        tree.set(c, c in state)
        q = int(rng.integers(1, 101))
        assert tree.tightest(q) == min((x for x in state if x >= q), default=None)


@pytest.mark.parametrize("part", [250_000, 3])
def test_packing_holds_every_id_once(spark, small_docs, part):
    rows = pack(small_docs, PATH, with_ids=True, part=part)
    got = rows.collect()
    docs = defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
    for (key, _), x in zip(rows_of(small_docs), plain([t for _, t in rows_of(small_docs)]), strict=True):
        want = np.append(x, 0).astype("<u4").tobytes()
        # A row that is there twice has every piece twice.
        copies = len([k for k, _ in rows_of(small_docs) if k == key])
        pieces = sorted(docs[key], key=lambda r: r["start"])[::copies]
        assert b"".join(bytes(p["ids"]) for p in pieces) == want
        assert all(p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and p["doc_tokens"] == len(want) // 4 for p in pieces)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0] + [n for _, n in sorted(v)])[:-1].tolist() and sum(n for _, n in v) <= 1024
    total = sum(r["length"] for r in got)
    assert len(seqs) * 1024 - total < 0.02 * total
    built = {r["sequence_id"]: r for r in sequences(rows).collect()}
    assert set(built) == set(seqs) and all(r["n_tokens"] == sum(n for _, n in seqs[k]) for k, r in built.items())
    assert all(len(r["ids"]) == 1024 or len(r["ids"]) == r["n_tokens"] and r["n_tokens"] & (r["n_tokens"] - 1) == 0 for r in built.values())


def test_packing_of_repeated_rows_ties_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None), (2, ""), (3, "wort " * 9000)], "doc_id long, text string").selectExpr("*", "7 AS length", "8 AS part")
    got = pack(docs, PATH, window=64).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got if r["start"] == 0 and r["doc_id"] != 3) == [(0, 1), (1, 2), (1, 3), (1, 3), (2, 1)]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == max(r["doc_tokens"] for r in got)


def test_packing_of_no_documents(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
