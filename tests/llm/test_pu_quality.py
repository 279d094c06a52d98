import zlib

import numpy as np

from rasterloom.llm import pu_quality as p
from rasterloom.llm.queries import op1_pu_quality


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in op1_pu_quality(spark, sf).collect()}
    assert len(rows) == 1000
    for r in rows.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    labels = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x.doc_id].held_out]
    good = np.array([rows[x.doc_id].score for x in labels if x.quality == 1])
    bad = np.array([rows[x.doc_id].score for x in labels if x.quality == 0])
    assert np.mean([(good > b).mean() for b in bad]) > 0.9 and (good >= 0.3).mean() > 0.95


def test_prior_and_risk_on_made_up_rows():
    r = np.random.default_rng(3)
    good, bad = r.normal(0, 1, (3000, len(p.NAMES))), r.normal(1.5, 1, (900, len(p.NAMES)))
    model = p.fit(good[:1500], np.concatenate([good[1500:], bad[:500]]))
    assert abs(model.prior - 0.75) < 0.08
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad[500:]) < 0.5).mean() > 0.85
    assert np.allclose(p.fit(good[:0], bad).score(bad), 0.5)


def test_negative_labels_are_never_read(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    more = labels.union(spark.createDataFrame([(8, 0, 0), (9, 0, 0), (1, None, 0)], labels.schema))
    clash = odd.selectExpr("*", "1 as score", "2 as p", "3 as x", "4 as label")
    a, b = p.learn(clash, labels), p.learn(clash, more)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior
    rows = p.score(clash, a).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert p.score(odd.limit(0), a).count() == 0
    assert {r.score for r in p.score(odd, p.learn(odd, labels.limit(0))).collect()} == {0.5}


def test_scores_by_plain_python(spark, odd, prose):
    docs = odd.union(spark.createDataFrame([(100 + i, t + "!?# " * (i % 5), "en", "s", 1) for i, t in enumerate(prose(60))], odd.schema))
    model = p.learn(docs, spark.createDataFrame([(100 + i, 1) for i in range(0, 60, 5)], "doc_id long, quality int"))
    want = []
    for r in docs.collect():
        z = model.bias + sum(model.weights[f][sum(cut < x for cut in model.cuts[f])] for f, x in enumerate(p.statistics(r.text)))
        want.append((repr(r.doc_id), round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)))
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in p.score(docs, model).collect()) == sorted(want)


def test_copies_of_an_id_do_not_add_rows(spark, monkeypatch):
    many = spark.createDataFrame([(i % 30, f"text {i % 30} {'x' * (i // 30 % 4)}") for i in range(3000)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(p, "fit", lambda a, b, **_: seen.append((len(a), len(b))))
    p.learn(many, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"), max_positive=7, max_unlabelled=11)
    assert seen == [(7, 11)]
