import base64
import gzip
import hashlib
import json
from collections import Counter

import duckdb
import pytest

from cairn.llm import runtime
from cairn.llm.licenses import TEMPLATES, anchors, license_runs, template_bigrams
from cairn.llm.queries import ORACLE, QUERIES
from cairn.llm.warc import id_cells, id_ranges, read_warc, with_range, write_warc

SMALL = "/root/testdata/sf0.001"


def against_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = db.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    return Counter(found.fetchall()), Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SMALL).collect())


@pytest.mark.parametrize("name", ["op2_warc", "op7_licenses", "op8_exact_dedup"])
def test_queries_match_their_sql(spark, name):
    want, got = against_oracle(spark, name)
    assert got == want and want


def dice(a, b):
    a, b = Counter(x.rsplit(" ", 1)[0] for x in a), Counter(x.rsplit(" ", 1)[0] for x in b)
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def runs_by_hand(texts):
    import re

    grams, want = [(n, template_bigrams(t)) for n, t in TEMPLATES], {}
    for i, t in enumerate(texts):
        segments = [x for x in (re.sub("[^a-z0-9]+", " ", x).strip() for x in re.split(r"\n|(?<=[.!?;:])\s+", (t or "").lower())) if x]
        for a in range(len(segments)):
            best = None
            for b in range(a + 1, len(segments) + 1):
                g = template_bigrams(" ".join(segments[a:b]))
                if len(g) > 420:
                    break
                for name, tg in grams if g else []:
                    d = round(dice(g, tg), 6)
                    if d >= 0.8 and (best is None or (-d, b - a, name) < best):
                        best = (-d, b - a, name)
            if best:
                want[i, a] = (best[1], best[2], -best[0])
    return want


def test_license_runs_by_hand(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    paragraphs = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    prose = "It was a plain morning of the year.\nNobody came to the house, and the rain went on.\n\n" * 6
    isc = next(t for n, t in TEMPLATES if n == "ISC").replace(". ", ".\n\n")
    bsd = next(t for n, t in TEMPLATES if n == "BSD-3-Clause" and len(t) > 500)
    texts = [prose + paragraphs + "\n\n" + prose, "Copyright 2020 X. Released under the MIT License.", prose, None, "", "word", prose + isc + "\n" + prose, "released\nunder\nthe\nmit\nlicense", "Released under\n\nthe MIT License. " + prose, "the\nof\nto\n" * 30,
             "Released under the MIT License.", "released  UNDER the mit licence!", mit.replace(". ", ".\n"), "a\n\nLicensed under\nCC BY 4.0.\n\nb", "Licensed under CC BY-ND 4.0.", mit + " and " + "other words " * 40, "the the the the the", bsd.replace("2. ", "\n2. ").replace("3. ", "\n3. ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS segment", "3 AS t")
    got = {(r["doc_id"], r["segment"]): (r["segments"], r["license"], r["dice"]) for r in license_runs(docs).collect()}
    assert got == runs_by_hand(texts)
    assert {(i, x[1]) for (i, _), x in got.items()} >= {(0, "MIT"), (1, "MIT"), (6, "ISC"), (7, "MIT"), (8, "MIT"), (12, "MIT"), (13, "CC-BY-4.0"), (17, "BSD-3-Clause")}
    assert got[10, 0] == (1, "MIT", 1.0) and not {3, 4, 5, 16} & {i for i, _ in got}
    assert license_runs(docs.limit(0)).count() == 0


def test_every_template_is_found_and_anchored(spark):
    """Each template as it is, and with a third of its words changed at most as far as the threshold lets it: what matches holds an anchor."""
    import random

    rng = random.Random(3)
    texts = [t for _, t in TEMPLATES]
    for _, t in TEMPLATES:
        w = t.split()
        for _ in range(max(1, len(w) // 12)):
            w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["segment"]): (r["segments"], r["license"], r["dice"]) for r in license_runs(docs).collect()}
    assert got == runs_by_hand(texts)
    for i, (name, _) in enumerate(TEMPLATES):
        assert got[i, 0][1:] == (name, 1.0)
    words = anchors(TEMPLATES, 2 / 3)
    for name, t in TEMPLATES:
        g = template_bigrams(t)
        assert sum(not set(x.split(" ")[:2]) & set(words) for x in g) < 2 / 3 * len(g), name


def test_license_runs_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "x\nReleased under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["segment"], r["segments"]) for r in license_runs(docs).collect())
    assert got.count((1, 0, 1)) == 1 and (0, 0, 1) in got and (1, 1, 1) in got


PAGES = [(1, "http://a/x y", "p" * 1500), (2, None, "p" * 1500), (3, "http://b\r\nX: 1", "é" * 600), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "v", "p" * 1500), (9, "w", "é" * 600), (None, "n", "p" * 1500)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS size", "2 AS payload")
    out = f"file://{tmp_path}/warc"
    manifest = write_warc(pages, out, roll_bytes=700, range_bytes=2000)
    got = {r["page_id"]: r for r in read_warc(spark, out, with_payload=True).collect()}
    for page_id, url, html in PAGES:
        r, body = got[page_id], (html or "").encode()
        revisit = {1: 8, 2: 8, None: 8, 3: 9}.get(page_id)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", revisit)
        assert bytes(r["payload"]) == (b"" if revisit else body) and (r["url"] is None) == (url is None)
    assert got[3]["url"] == "http://b%0D%0AX:%201" and len(manifest["files"]) > 3
    names = sorted(p.name for p in (tmp_path / "warc").iterdir() if not p.name.startswith("."))
    assert names == ["manifest.json", *[f["file"] for f in manifest["files"]]]
    for f in manifest["files"]:
        data = (tmp_path / "warc" / f["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and len(data) == f["bytes"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    again = write_warc(pages.repartition(5), f"file://{tmp_path}/again", roll_bytes=700, range_bytes=2000)
    assert [f["sha256"] for f in again["files"]] == [f["sha256"] for f in manifest["files"]]


def test_warc_files_do_not_depend_on_the_layout(spark, tmp_path):
    """40,000 pages in 3 and in 11 partitions, ids crowded at one end: equal files."""
    pages = spark.range(40_000).selectExpr("CASE WHEN id % 10 = 0 THEN id * 1000003 ELSE id END AS page_id", "concat('http://h/', id) AS url", "repeat(concat('x', id % 3000), 5 + cast(id % 40 AS int) * 20) AS html")
    made = [write_warc(pages.repartition(n, "url"), f"file://{tmp_path}/{n}", range_bytes=1 << 20, roll_bytes=1 << 16) for n in (3, 11)]
    assert made[0] == made[1] and len(made[0]["files"]) > 10 and sum(f["records"] for f in made[0]["files"]) == 40_000
    bounds = [(f["first"], f["last"]) for f in made[0]["files"]]
    assert all(a <= z for a, z in bounds) and all(x[1] <= y[0] for x, y in zip(bounds, bounds[1:], strict=False))


def test_warc_of_one_hot_id(spark, tmp_path):
    """An id with a third of all rows, and as many without one, are cut by their digests; copies of a row stay together."""
    pages = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 3 = 1 THEN id END AS page_id", "'u' AS url", "repeat(concat('y', id), 100) AS html")
    out = f"file://{tmp_path}/hot"
    made = write_warc(pages.union(pages.limit(7)), out, range_bytes=20_000)
    assert sum(f["records"] for f in made["files"]) == 907 and max(f["records"] for f in made["files"]) < 120
    got = read_warc(spark, out).groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in got if r["page_id"] in (5, None)}.keys() == {5, None} and sum(r["count"] for r in got) == 907


def test_cells_and_ranges_by_hand(spark):
    sizes = {i: 1 + i % 7 for i in [*range(0, 50), *range(10**15, 10**15 + 300), -(2**63), 2**63 - 1]}
    heads = spark.createDataFrame(list(sizes.items()), "page_id long, size long")
    cells = id_cells(heads, 40, grid=8)
    leaves = [x for x in cells if x.finer is None]
    assert sum(x.bytes for x in leaves) == sum(sizes.values()) and all(x.bytes <= 40 or x.first == x.last for x in leaves)
    for x in cells:
        assert x.bytes == sum(s for i, s in sizes.items() if x.first <= i <= x.last)
    ranges = id_ranges(cells, 40)
    assert [x for own in ranges for x in own] == leaves and all(sum(x.bytes for x in own) <= 40 for own in ranges)
    want = {i: k for i in sizes for k, own in enumerate(ranges, 1) for x in own if x.first <= i <= x.last}
    placed, n = with_range(heads.selectExpr("*", "sha1('x') AS sha1"), cells, ranges, 40)
    assert {r["page_id"]: r["range"] for r in placed.collect()} == want and n == len(ranges) + 1
    assert id_ranges([], 40) == [] and id_cells(heads.limit(0), 40) == []


def test_warc_digests_are_checked(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    m = write_warc(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"), out)
    path = tmp_path / "w" / m["files"][0]["file"]
    raw = gzip.decompress(path.read_bytes())
    digest = base64.b32encode(hashlib.sha1(b"hello").digest())
    assert digest in raw
    path.write_bytes(b"".join(gzip.compress(b"WARC/1.1" + x) for x in raw.replace(b"hello", b"jello").split(b"WARC/1.1")[1:]))
    with pytest.raises(Exception, match="digest"):
        read_warc(spark, out).collect()


def test_warc_of_no_pages(spark):
    out = runtime.scratch(spark, "warc")
    assert write_warc(spark.createDataFrame([], "page_id long, url string, html string"), out) == {"files": []}
    assert read_warc(spark, out).count() == 0 and json.loads(runtime.read_file(f"{out}/manifest.json")) == {"files": []}
