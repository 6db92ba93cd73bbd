import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm.decontaminate import Index, banded_alignment, contaminated, decontaminate, normalise, parts_of, scan


def plain(t):
    return " ".join(re.findall(r"[0-9a-zà-ÿß]+", (t or "").lower()))


def least_edits(item, text):
    """Of the whole item against the best part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        i, kind = rng.randrange(len(t)), rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("xyz")
        elif kind == 1:
            t.insert(i, rng.choice("xyz"))
        else:
            del t[i]
    return "".join(t)


def random_text(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "tion", "é", "ha"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_scan_against_all_alignments():
    rng = random.Random(4)
    items = [(k, random_text(rng, rng.randint(8, 30))) for k in range(12)]
    texts = ["", "?"]
    for _ in range(60):
        parts = [random_text(rng, rng.randint(0, 40))]
        if rng.random() < 0.7:
            t = items[rng.randrange(12)][1]
            parts.append(edited(rng, t, rng.randint(0, int(0.14 * len(t)))))
        parts.append(random_text(rng, rng.randint(0, 40)))
        texts.append(" ".join(parts))
    index = Index(items, 0.1, 20)
    chars, off, _ = normalise(pa.array(texts, pa.large_string()))
    got = {(d, index.items[i][0]): e for d, i, _, _, e in sorted(scan(index, chars, off), key=lambda x: -x[4])}
    want = {}
    for d in range(len(texts)):
        text = chars[off[d] : off[d + 1]].tolist()
        for n, (i, item) in enumerate(index.items):
            e = least_edits(item.tolist(), text)
            if e <= index.edits[n]:
                want[d, i] = e
    assert got == want and len(want) > 10


def test_windows_of_a_long_text(monkeypatch):
    import cairn.llm.decontaminate as m

    rng = random.Random(1)
    item = random_text(rng, 20)
    text = " ".join(x for _ in range(30) for x in (random_text(rng, 60), item))
    index = Index([(1, item)], 0.1, 8)
    chars, off, _ = normalise(pa.array(["a", text, item], pa.large_string()))
    whole = scan(index, chars, off)
    monkeypatch.setattr(m, "WINDOW", 700)
    assert scan(index, chars, off) == whole and len(whole) == 31


def test_common_phrases_are_looked_at_in_bounded_parts(monkeypatch):
    """Items that share a phrase, and texts full of it: halving windows and items finds what one look finds."""
    import cairn.llm.decontaminate as m

    rng = random.Random(8)
    phrase = random_text(rng, 12)
    items = [(k, f"{random_text(rng, 8)} {phrase} {random_text(rng, 8)}") for k in range(40)]
    texts = [" ".join([phrase] * 200), *(" ".join([random_text(rng, 30), phrase, items[k][1], phrase]) for k in range(0, 40, 3)), phrase]
    chars, off, _ = normalise(pa.array(texts, pa.large_string()))
    whole = scan(Index(items, 0.1, 20), chars, off)
    assert {(d, k) for d, k, _, _, e in whole if e == 0} == {(1 + n, k) for n, k in enumerate(range(0, 40, 3))}
    monkeypatch.setattr(m, "EXPAND", 300)
    assert scan(Index(items, 0.1, 20), chars, off) == whole


def test_short_items_match_exactly_between_words():
    items = [(1, "Art of war"), (2, "a"), (3, "x-ray vision, 2024"), (4, "?"), (5, None), (1, "art OF war"), (6, "art of war")]
    texts = ["The art of   war!", "part of war", "art of warsaw", "A", "", "an X ray vision 2024", "x ray vision 20245", "art of", None, "the art of war and art of war"]
    index = Index(items, 0.1)
    chars, off, place = normalise(pa.array([t or "" for t in texts], pa.large_string()))
    got = sorted((d, index.shorts[k - len(index.items)][0], texts[d][place[off[d] + s] : place[off[d] + e - 1] + 1]) for d, k, s, e, _ in scan(index, chars, off))
    war = "art of   war"
    assert got == [(0, 1, war), (0, 6, war), (3, 2, "A"), (5, 3, "X ray vision 2024"), (9, 1, "art of war"), (9, 1, "art of war"), (9, 6, "art of war"), (9, 6, "art of war")]


def test_parts_of_long_items(spark):
    """A text that holds half of a long item holds it."""
    rng = random.Random(9)
    item = random_text(rng, 700)
    t = normalise(pa.array([item], pa.large_string()))[0]
    cut = parts_of(t, 600)
    assert len(cut) > 8 and all(300 <= len(p) <= 600 for p in cut[:-1])
    joined = t.tobytes()
    assert all(p.tobytes() in joined for p in cut) and joined.startswith(cut[0].tobytes()) and joined.endswith(cut[-1].tobytes())
    assert [len(p) for p in parts_of(np.full(1500, 97, np.uint32), 600)] == [600, 600, 300]
    half = " ".join(item.split()[200:450])
    docs = spark.createDataFrame([(1, half), (2, item), (3, random_text(rng, 700)), (4, " ".join(item.split()[200:215]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = contaminated(docs, items).collect()
    assert {r["doc_id"] for r in rows} == {1, 2} and {r["part"] for r in rows if r["doc_id"] == 2} == set(range(len(cut)))
    assert [r["doc_id"] for r in decontaminate(docs, items).orderBy("doc_id").collect()] == [3, 4]


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(10)
    item, clean = random_text(rng, 30), random_text(rng, 50)
    docs = spark.createDataFrame([(1, f"x {item}", 1), (1, clean, 2), (None, item, 3), (None, None, 4), (1, clean, 2), (2, "", 5), (3, clean + " " + "wort " * 500_000 + item, 6)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string")
    kept = decontaminate(docs, items)
    assert kept.schema == docs.schema and sorted(r["item_id"] for r in kept.collect()) == [2, 2, 4, 5]
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in contaminated(docs, items).collect()) == [(0, 0), (0, 7), (1, 0), (1, 7), (3, 0), (3, 7)]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
        text = [rng.randrange(3) for _ in range(rng.randint(0, 14))]
        edits, s, e = banded_alignment(np.array(item, np.uint32), np.array(text, np.uint32), 40, 14)
        assert edits == least_edits(item, text)
        part, row = text[s:e], list(range(len(text[s:e]) + 1))
        for i, c in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(part, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        assert row[-1] == edits


@pytest.mark.parametrize("block_chars", [2_000_000, 300])
def test_contaminated(spark, small_docs, block_chars):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "the")], "item_id long, text string")
    got = contaminated(small_docs, items.union(odd), block_chars=block_chars)
    rows = got.collect()
    texts = {r["doc_id"]: r["text"] for r in small_docs.collect()}
    known = {r["item_id"]: plain(r["text"]) for r in items.union(odd).collect()}
    exact = {(d, i) for d, t in texts.items() for i, p in known.items() if p and (p in plain(t) if len(p) >= 32 else f" {p} " in f" {plain(t)} ")}
    assert exact and exact == {(r["doc_id"], r["item_id"]) for r in rows if r["edits"] == 0}
    for r in rows:
        if r["edits"] == 0:
            assert plain(texts[r["doc_id"]][r["start_char"] : r["end_char"]]) == known[r["item_id"]]
    kept = decontaminate(small_docs, items)
    assert kept.schema == small_docs.schema
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {r["doc_id"] for r in rows if r["item_id"] < 900}


def test_nothing_to_find(spark, small_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(small_docs, items).count() == 0 and contaminated(small_docs.limit(0), items).count() == 0
    assert decontaminate(small_docs, items).count() == small_docs.count()
