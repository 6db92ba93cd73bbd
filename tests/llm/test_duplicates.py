import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import vec
from cairn.llm.components import components
from cairn.llm.exact_dedup import exact_dedup, exact_groups
from cairn.llm.minhash import near_dedup, near_duplicate_groups, probminhash


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, small_docs, keep):
    docs = small_docs.union(small_docs.limit(3).selectExpr("doc_id + 5000", "upper(text)", "lang", "source", "n_chars", "hash", "key"))
    rows = [(r["doc_id"], lower(r["text"])) for r in docs.collect()]
    by = defaultdict(list)
    for k, t in rows:
        by[t].append(k)
    pick = min if keep == "min" else max
    want = sorted((k, pick(by[t]), len(by[t]), k == pick(by[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in rows)
    assert sorted(map(tuple, exact_groups(docs, keep=keep, with_sha256=True).collect())) == want
    kept = exact_dedup(docs, keep=keep)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(pick(v) for v in by.values())


def test_exact_dedup_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "z"), (4, None), (3, "")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in exact_dedup(docs).collect()) == [(0, "z"), (1, "a"), (1, "b"), (3, "")]
    none = docs.limit(0)
    assert exact_dedup(none).count() == exact_groups(none).count() == 0


def shingles(text, k=5):
    import re

    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes_by_hand(texts, threshold=0.8):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in keys}


def test_near_duplicate_groups_against_all_pairs(spark, small_docs):
    rng = random.Random(5)
    texts = {r["doc_id"]: r["text"] for r in small_docs.collect()}
    base = [t for t in texts.values() if t and len(t.split()) > 60][:12]
    for i, t in enumerate(base):
        w = t.split()
        for j in range(1 + 6 * (i % 4)):
            v = list(w)
            for _ in range(max(1, len(w) // 60)):
                v[rng.randrange(len(v))] = f"word{rng.randrange(99)}"
            texts[20000 + 100 * i + j] = " ".join(v)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()}
    assert got == classes_by_hand(texts)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_large_bucket_keeps_all_links(spark):
    """Hundreds of variants of one text, and as many texts that share half of their words."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    core = [word() for _ in range(150)]
    texts = {}
    for i in range(250):
        v = list(core)
        v[rng.randrange(150)] = word()
        texts[i] = " ".join(v)
    for i in range(60):
        own = [word() for _ in range(150)]
        texts[1000 + 2 * i] = " ".join(core + own)
        own[10] = word()
        texts[1001 + 2 * i] = " ".join(core + own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()} == classes_by_hand(texts)


def test_pairs_in_a_large_family_just_below_the_threshold(spark):
    """1,040 texts on one template, 0.777 alike, each with a partner at 0.825: the star to the least member verifies for one of them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    core, texts = [word() for _ in range(150)], {}
    for i in range(520):
        own = [word() for _ in range(5)]
        for j in (i, 5000 + i):
            texts[j] = " ".join(core + own + [word() for _ in range(16)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes_by_hand(texts)
    assert want == {j: j % 5000 for j in texts}
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()} == want


def test_repeat_counts_that_differ_hide_no_pair(spark):
    """Pairs whose sets are 0.8 or more alike, one text repeating lines 100 times and the other once."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for i in range(120):
        body, line, more = ([word() for _ in range(n)] for n in (84, 20, 16))
        texts[2 * i] = " ".join(body + line * 100)
        texts[2 * i + 1] = " ".join(body + line + line[:4] + more)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes_by_hand(texts)
    assert want == {j: j - j % 2 for j in texts}
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()} == want


def test_weights_of_both_signatures():
    """A text without repeats has one signature; the weighted one of a text with repeats meets texts whose repeated parts agree."""
    from cairn.llm.minhash import _signatures

    words = [f"w{i}" for i in range(60)]
    line = " ".join(words[:12])
    texts = [" ".join(words), f"{line} " * 40 + " ".join(words), f"{line} " * 30 + " ".join([*words[:30], *(f"x{i}" for i in range(60))])]
    batch = pa.record_batch([pa.array([0, 1, 2]), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
    rows = next(_signatures(5, 200, 1)(iter([batch]))).to_pylist()
    assert rows[0]["weighted"] is None and all(len(r["weighted"]) == 200 for r in rows[1:])
    same = lambda a, b, c: sum(x == y for x, y in zip(rows[a][c], rows[b][c], strict=True))
    assert same(1, 2, "weighted") > same(1, 2, "bands")


def test_large_bucket_with_repeats_keeps_all_links(spark):
    """Hundreds of variants of a text with repeated lines, some of which repeat them less."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line, core, texts = [word() for _ in range(12)], [word() for _ in range(120)], {}
    for i in range(300):
        v = list(core)
        for _ in range(2 + i % 3):
            v[rng.randrange(120)] = word()
        texts[i] = " ".join(line * (1 + i % 4 * 10) + v)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_groups(docs).collect()} == classes_by_hand(texts)


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_groups(none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "one two"), (4, "one two"), (5, "one, TWO"), (None, "one two"), (6, "other"), (6, "one two")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in near_duplicate_groups(odd).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 4)]


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    h = vec.mix(np.arange(300, dtype=np.uint64))
    x, y = rng.random(300) * (rng.random(300) < 0.8), rng.random(300) * 0.3 + np.arange(300) % 3
    d = np.repeat([0, 1], [np.count_nonzero(x), np.count_nonzero(y)])
    sig = probminhash(np.concatenate([h[x > 0], h[y > 0]]), d, np.concatenate([x[x > 0], y[y > 0]]), 2, 4096)
    p, q = x / x.sum(), y / y.sum()
    want = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in np.flatnonzero((p > 0) & (q > 0)))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5


def test_shingles_against_plain_code():
    texts = ["", "a", "A b, c d", "eins zwei drei vier fünf sechs eins zwei drei vier fünf", "x" * 10, "a b c d e a b c d e a"]
    col = pa.array(texts, pa.large_string())
    h, d, c = vec.distinct(*vec.word_shingles(col))
    assert [int((d == i).sum()) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    assert c.max() == 2


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(260)) if a != b] + [(0, i) for i in range(1000, 1300)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
