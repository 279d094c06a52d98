from collections import Counter

import corpus_pipeline
from rasterloom.llm import quality_rules
from rasterloom.llm import secret_scan as secret
from rasterloom.llm.common import table
from tests.llm import test_decontamination, test_mixing, test_quality_rules, test_secret_scan, test_simhash_near_dups


def rejected(rules, text):
    n_words, word_chars, n_symbols, n_dup, n_repeat = test_quality_rules.brute(text)
    if n_words < 10 or 100 * n_repeat > 20 * n_words:
        return True
    t = text or ""
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    w = [x for x in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    count = lambda s: sum(c in s for c in t)
    f = {
        "symbol_ratio": n_symbols / max(word_chars, 1), "repeat_ratio": n_repeat / max(n_words, 1), "dup_line_ratio": n_dup / max(len(lines), 1),
        "upper_ratio": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(word_chars, 1), "bang_ratio": count("!?") / max(n_words, 1), "word_length": word_chars / max(n_words, 1),
        "distinct_ratio": len(set(w)) / max(n_words, 1), "digit_ratio": count("0123456789") / max(word_chars, 1), "n_words": n_words,
    }
    return any(all(f[n] <= at if op == "<=" else f[n] > at for n, op, at in r.tests) for r in rules)


def test_rows_against_plain_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    rows = [r for r in rows if not rejected(rules, r[1])]
    fps = [test_simhash_near_dups.fingerprint(r[1]) for r in rows]
    roots, head = test_simhash_near_dups.reach(fps), {}
    for r, root in zip(rows, roots, strict=True):
        head[root] = min(head.get(root, r), r, key=lambda x: x[0])
    rows = list(head.values())
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    grams = {tuple(w[k : k + 10]) for _, t in items if (w := test_decontamination.words(t)) for k in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    rows = [r for r in rows if not hit(test_decontamination.words(r[1]))]
    cleaned = []
    for d, text, lang, source in rows:
        at, last = [], -1
        for a, _, b in test_secret_scan.brute(text)[1]:
            if a > last or not at:
                at.append([a, b])
            at[-1][1] = last = max(last, b)
        for a, b in reversed(at):
            text = text[:a] + "[secret]" + text[b:]
        cleaned.append((d, text, lang, source))
    want = {(int(d), copies): n for d, _, _, _, n, copies, _ in test_mixing.brute(cleaned, corpus_pipeline.mixing.TENTHS)}
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [*docs.columns, "copies"]
    texts = {d: t for d, t, *_ in cleaned}
    have = got.collect()
    assert Counter((r.doc_id, r.copies) for r in have) == Counter(want.keys())
    assert all(r.text == texts[r.doc_id] for r in have)


def test_stages_bear_odd_rows_and_empty_tables(spark, sf_dir, odd):
    docs = odd.selectExpr("*", "1 as n_words", "'x' as root", "2 as copies", "3 as _1", "4 as _2", "5 as _d", "6 as _k1", "7 as _key", "8 as id", "9 as _doc", "10 as k1")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == (docs.columns if name != "mixing" else [c for c in docs.columns if c != "copies"] + ["copies"])
        rows = out.collect()
        assert len(rows) <= docs.count()
        assert {(r._1, r._2, r._d, r._k1, r._key, r.id, r._doc, r.k1) for r in rows} <= {(3, 4, 5, 6, 7, 8, 9, 10)}
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_repeated_rows_leave_one(spark, odd, sf_dir):
    rows = [(1, "a b c d", "en", "s", 1), (1, "a b c d", "en", "s", 1), (1, "w x y z", "en", "s", 1), (None, "a b c d", "en", "s", 1), (None, None, "en", "s", 1), (4, "", "en", "s", 1)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, odd.schema), sf_dir).collect()
    assert Counter((r.doc_id, r.text) for r in got) == {(1, "a b c d"): 1, (1, "w x y z"): 1, (4, ""): 1}


def test_marks_are_no_secrets():
    assert not test_secret_scan.brute("[secret]")[1] and secret.REACH > 0
