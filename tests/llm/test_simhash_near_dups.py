import random
import re
from collections import Counter

import numpy as np
import xxhash

from rasterloom.llm import simhash_near_dups as s
from rasterloom.llm.queries import op10_simhash_near_dups


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps):
    """component's least index for each of the fingerprints, by all pairs"""
    a, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2)[0]:
            x, y = sorted((top(i), top(i + 1 + int(j))))
            parent[y] = x
    return [top(i) for i in range(len(a))]


def expected(rows):
    fps, heads = [fingerprint(t) for _, t in rows], {}
    roots = reach(fps)
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            heads[r] = min(heads.get(r, d), d)
    return Counter((d, f"{f:016x}", heads.get(r)) for (d, _), f, r in zip(rows, fps, roots, strict=True))


def test_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op10_simhash_near_dups(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected(rows)


def test_odd_rows_and_empty_tables(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = s.near_dups(odd.selectExpr("*", "1 as fp", "2 as component_id")).collect()
    assert Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got) == expected(rows)
    assert s.near_dups(odd.limit(0)).count() == 0


def test_links_and_chains_of_planted_fingerprints(spark, monkeypatch):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(300)]
    for x in fps[:120]:
        y = x
        for _ in range(r.randint(1, 6)):  # chains of fingerprints, up to 3 bits apart
            for b in r.sample(range(64), r.randint(1, 3)):
                y ^= 1 << b
            fps.append(y)
    fps = sorted(set(fps), key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    passed = {x.fp for x in s.candidates(df).collect()}
    a = np.array(fps, np.uint64)
    linked = {signed[i] for i in range(len(a)) if (np.bitwise_count(a ^ a[i]) <= 2).sum() > 1}
    assert linked <= passed and len(passed) < len(fps)
    for hot in (s.HOT, 1, 3):  # all keys compared pair by pair, dealt anew, or both
        monkeypatch.setattr(s, "HOT", hot)
        edges = s.links(df).collect()
        assert all((x.a ^ x.b).bit_count() <= 2 or ((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 2 for x in edges)
        tree = {x.a: x.b for x in s.components(s.links(df)).collect()}
        assert [tree.get(x, x) for x in signed] == [signed[i] for i in reach(fps)]


def test_chains_hold_all_pairs_within_the_distance(spark):
    r, rows = random.Random(6), []
    for n in (0, 1, 2, 3, 4, 6):
        rows += [(n, sum(1 << b for b in r.sample(range(64), n))) for _ in range(300)]
    rows = [(n, x - (1 << 64) if x >> 63 else x) for n, x in rows]
    got = spark.createDataFrame(rows, "n int, x long").select("n", s.chained(s.F.col("x")).alias("ok")).collect()
    assert all(g.ok for g in got if g.n <= 2) and not all(g.ok for g in got if g.n > 2)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(8)
    base = r.getrandbits(63)
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 2))) for _ in range(1500)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    tree = {x.a: x.b for x in s.components(s.links(df)).collect()}
    assert [fps.index(tree.get(x, x)) for x in fps] == reach(fps) == [0] * len(fps)
    assert s.links(df).count() < 40 * 6 * len(fps)


def test_components_of_a_path_and_a_star(spark):
    path = [(i + 1, i) for i in range(100, 160)] + [(i, 1) for i in range(2, 60)]
    got = {r.a: r.b for r in s.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 1 for i in range(2, 60)}}
