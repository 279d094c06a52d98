import zlib

import numpy as np

from rasterloom.llm import toxicity as t
from rasterloom.llm.queries import op2_toxicity


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in op2_toxicity(spark, sf).collect()}
    assert len(rows) == 1000
    for r in rows.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    labels = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x.doc_id].held_out]
    bad = np.array([rows[x.doc_id].score for x in labels if x.toxic == 1])
    fine = np.array([rows[x.doc_id].score for x in labels if x.toxic == 0])
    assert np.mean([(b > fine).mean() for b in bad]) > 0.8 and (fine < 0.3).mean() > 0.95


def brute(text):
    """cells by plain integers"""
    raw, out = " " + (text or "").encode().translate(t._LOWER).decode() + " ", set()
    for n in t.ORDERS if len(raw) > 2 else ():
        for i in range(len(raw) - n + 1):
            h = 0
            for c in raw[i : i + n]:
                h = (h * int(t._NEXT) + ord(c)) % 2**64
            out.add((h * int(t._MIX[n]) % 2**64) >> (64 - t.BITS))
    return out


def test_scores_by_plain_python(spark, odd, prose):
    texts = prose(80, least=30)
    docs = odd.union(spark.createDataFrame([(100 + i, x + " awfulword" * (i % 4 == 0), "en", "s", 1) for i, x in enumerate(texts)], odd.schema))
    model = t.learn(docs, spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int"))
    want = []
    for r in docs.collect():
        z = model.bias + sum(model.weights[model.chosen[c]] for c in brute(r.text) if model.chosen[c] >= 0)
        want.append((str(r.doc_id), round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)))
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in t.score(docs, model).collect()) == sorted(want)


def test_copies_of_an_id_do_not_add_rows(spark, odd):
    docs = spark.createDataFrame([(1, "a text with words"), (1, "another text with words"), (2, "one more text")], "doc_id long, text string")
    many = docs.crossJoin(spark.range(500)).select("doc_id", "text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert {tuple(r) for r in t.score(docs, t.learn(many, labels)).collect()} == {tuple(r) for r in t.score(docs, t.learn(docs, labels)).collect()}


def test_cells_of_whole_texts_in_slices(monkeypatch, prose):
    texts = [None, "", "a", "ab", "abc", "Ünï çode 漢字", *prose(5)]
    want = [brute(x) for x in texts]
    for size in (1 << 20, 64, 9):
        monkeypatch.setattr(t, "SLICE", size)
        assert [set(np.concatenate([*t.cells(x), np.zeros(0, np.int64)]).astype(int)) for x in texts] == want


def test_learning_and_odd_rows(spark, odd, prose):
    texts = prose(200, least=30)
    rows = [(100 + i, x + " awfulword" * (i % 4 == 0) + x, "en", "s", 1) for i, x in enumerate(texts)]
    docs = odd.union(spark.createDataFrame(rows, odd.schema)).selectExpr("*", "1 as label", "2 as score", "3 as cell")
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (2, None), (101, 0)], "doc_id long, toxic int")
    model = t.learn(docs, labels)
    got = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    assert all((got[100 + i] >= 0.3) == (i % 4 == 0) for i in range(200))
    assert t.score(docs.limit(0), model).count() == 0
    assert {round(r.score) for r in t.score(odd, t.learn(docs, labels.limit(0))).collect()} <= {0, 1}
    assert all(r.score < 0.01 for r in t.score(odd, t.learn(docs, labels.where("toxic = 0"))).collect())
