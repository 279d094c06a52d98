import math
from collections import Counter

from rasterloom.llm import lm_scoring as m
from rasterloom.llm.queries import SQL, op3_lm_scoring
from tests.llm.test_decontamination import words
from tests.oracle import compare


def brute(texts, order, backoff=m.BACKOFF, least=m.MIN_COUNT):
    docs = [words(t) for t in texts]
    c = Counter(tuple(w[i : i + n]) for w in docs for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, docs))

    def s(gram):
        if len(gram) == 1:
            return math.log(c[gram] / total)
        return math.log(c[gram] / c[gram[:-1]]) if c[gram] >= least else math.log(backoff) + s(gram[1:])

    out = []
    for w in docs:
        grams = [tuple(w[max(0, i - order + 1) : i + 1]) for i in range(len(w))]
        out.append((len(w), sum(len(g) > 1 and c[g] < least for g in grams), sum(map(s, grams))))
    return out


def check(got, ids, want, digits=6):
    got = sorted((repr(r.doc_id), r.n_words, r.n_backoff, round(r.log_score, digits)) for r in got)
    assert got == sorted((repr(i), a, b, round(x, digits)) for i, (a, b, x) in zip(ids, want, strict=True))


def test_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(op3_lm_scoring(spark, sf_dir).collect(), [r.doc_id for r in rows], brute([r.text for r in rows], m.ORDER), 4)


def test_orders_blocks_and_parts(spark, odd, prose, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_WORDS", 300)
    more = [(100 + i, t, "en", "s", 1) for i, t in enumerate(prose(60, vocabulary=30))]
    docs = odd.union(spark.createDataFrame(more, odd.schema)).selectExpr("*", "1 as block", "2 as part", "3 as n_words")
    rows = docs.collect()
    for order, part in ((1, 100), (2, 50), (3, 1000), (4, 10**9)):
        check(m.score(docs, order, part_ngrams=part).collect(), [r.doc_id for r in rows], brute([r.text for r in rows], order))


def test_empty_tables_and_texts(spark, odd):
    assert m.score(odd.limit(0)).count() == 0
    got = m.score(odd.where("doc_id <= 3")).collect()
    assert {(r.n_words, r.log_score, r.mean_log_score) for r in got} == {(0, 0.0, None)}


def test_query_tells_common_pairs_in_rare_sequences(spark, odd, tmp_path):
    # every word pair of the last text is common, its three-word sequences are not
    texts = ["a b c a b c a b c"] * 3 + ["b a c b a c b a c"] * 3 + ["a b a c a b a c"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], odd.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_lm_scoring(spark, str(tmp_path)).collect()
    check(got, range(len(texts)), brute(texts, 3), 4)
    assert {r.doc_id: r.n_backoff > 0 for r in got} == {i: i == len(texts) - 1 for i in range(len(texts))}


def test_against_sql(spark, sf_dir):
    assert compare(op3_lm_scoring(spark, sf_dir), SQL["op3_lm_scoring"], sf_dir) >= 200


def test_distinct_ngrams_take_little_memory():
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(3)
    grams = [r.integers(0, 1 << 20, 200_000).astype(np.uint64) for _ in range(3)]
    grams[1][:1000] = 0
    tracemalloc.start()
    keys = m._keys(grams)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys.tolist() == sorted(set(np.concatenate(grams).tolist()) - {0})
    assert peak < 2.5 * sum(g.nbytes for g in grams)
