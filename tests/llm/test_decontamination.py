import random
import re

import pytest

from rasterloom.llm import decontamination as d
from rasterloom.llm.queries import SQL, op4_decontamination
from tests.oracle import compare


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for x in [v[k : k + 10] for k in range(max(1, len(v) - 9))] if v and i is not None else []:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(str(i))
    return len(w), sorted(hit), sorted(found)


def rows(df):
    return sorted((repr(r.doc_id), r.n_words, [p for a, b in zip(r.starts, r.stops, strict=True) for p in range(a, b)], r["items"]) for r in df.collect())


def test_against_sql(spark, sf_dir):
    assert compare(op4_decontamination(spark, sf_dir), SQL["op4_decontamination"], sf_dir) >= 200


def fixture(spark, odd, prose):
    texts = prose(60, vocabulary=60)
    items = [(i, t) for i, t in enumerate(prose(12, seed=9, vocabulary=60, least=3, most=40))]
    items += [(100, "A b C d e"), (101, "漢字 😀"), (102, None), (103, "..."), (None, "a b c d"), (7, "x x x x x x x x x x x x"), (7, "one two"), (104, "one two")]
    for k, (_, t) in enumerate(items[:12]):
        w = (t or "").split()
        texts[k] = " ".join(["Before", *w[:15], "middle", *w[2:], *w])
    docs = odd.union(spark.createDataFrame([(200 + i, t, "en", "s", 1) for i, t in enumerate(texts)], odd.schema))
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force_in_one_and_many_blocks(spark, odd, prose):
    docs, bench = fixture(spark, odd, prose)
    items = [tuple(r) for r in bench.collect()]
    want = sorted((repr(r.doc_id), *brute(r.text, items)) for r in docs.collect())
    assert any(x[2] for x in want)
    clash = docs.selectExpr("*", "1 as n_words", "2 as block", "3 as key")
    assert rows(d.scan(clash, bench)) == want
    assert rows(d.scan(clash, bench, limit=7)) == want


def test_small_blocks_of_the_index(spark, odd, prose, monkeypatch):
    docs, bench = fixture(spark, odd, prose)
    want = rows(d.scan(docs, bench))
    monkeypatch.setattr(d, "BLOCK_WORDS", 1)
    assert rows(d.scan(docs, bench)) == want


def test_empty_tables_and_cleaning(spark, odd, prose):
    docs, bench = fixture(spark, odd, prose)
    assert d.scan(docs.limit(0), bench).count() == 0
    assert all(not r[2] for r in rows(d.scan(docs, bench.limit(0))))
    items = [tuple(r) for r in bench.collect()]
    left = d.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(r.doc_id) for r in docs.collect() if not brute(r.text, items)[1])


def near(text, items, slop):
    """items with a window whose words stand in order with at most slop others between them, from every first word on"""
    w, out = words(text), set()
    for i, t in items:
        v = words(t)
        for x in [v[k : k + 10] for k in range(max(1, len(v) - 9))] if v and i is not None else []:
            for a in [a for a, y in enumerate(w) if y == x[0]]:
                at = a
                for y in x[1:]:
                    at = next((k for k in range(at + 1, len(w)) if w[k] == y), None)
                    if at is None:
                        break
                if at is not None and at - a - (len(x) - 1) <= slop:
                    out.add(str(i))
    return sorted(out)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha big beta gamma small delta"), (3, "delta far far far alpha beta gamma"), (4, "beta alpha gamma delta"), (5, "alpha a b c beta gamma delta")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "alpha beta gamma delta")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in d.scan(docs, bench, slop=2).collect()}
    assert got == {1: (["5"], ["5"]), 2: ([], ["5"]), 3: ([], []), 4: ([], []), 5: ([], [])}


def test_proximity_ends_with_the_document(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(5, "alpha beta")], "item_id long, text string")
    assert all(r.near_items == [] for r in d.scan(docs, bench, slop=d.GAP - 1).collect())
    for slop in (-1, d.GAP, 80):
        with pytest.raises(ValueError):
            d.scan(docs, bench, slop=slop)


def test_proximity_against_brute_force(spark, prose):
    r = random.Random(3)
    items = [(i, t) for i, t in enumerate(prose(25, seed=4, vocabulary=25, least=1, most=14))]
    texts = prose(40, seed=5, vocabulary=25)
    for _, t in items:  # passages with words put in, left out and swapped
        w = t.split()
        for _ in range(4):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(v) + 1)
                v[k:k] = [r.choice(v or ["x"])]
            texts.append(" ".join(["so", *v, "on"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slop in (1, 2, 5):
        want = {k: (brute(t, items)[2], near(t, items, slop)) for k, t in enumerate(texts)}
        assert {x.doc_id: (x["items"], x.near_items) for x in d.scan(docs, bench, slop=slop, limit=40).collect()} == want
    assert any(a != b for a, b in want.values())


def test_one_index_serves_several_benchmarks(spark, odd, prose):
    docs, bench = fixture(spark, odd, prose)
    index = d.build_index(docs.select("doc_id", "text"))
    for some in (bench, bench.where("item_id < 5")):
        got = d.found_in(index, d.packed_windows(index, d.windows(some), 100)).withColumnRenamed("key", "doc_id")
        assert rows(got) == rows(d.scan(docs, some))
