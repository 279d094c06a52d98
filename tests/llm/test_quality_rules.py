import re
from collections import Counter

from rasterloom.llm import quality_rules as q
from rasterloom.llm.queries import op5_quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def check(rows, texts):
    assert len(rows) == len(texts)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((d, *brute(t)) for d, t in texts)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_against_brute_force(spark, sf_dir):
    rows = op5_quality_rules(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(rows, [tuple(d) for d in docs])


def test_odd_rows_and_empty_tables(spark, odd):
    docs = odd.selectExpr("*", "1 as n_words", "2 as kept")
    check(q.decide(docs, []).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.learn(odd, labels) == []
    assert q.decide(odd.limit(0), []).count() == 0


def test_windows_at_their_edges(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f a b c d e", "a b c d", "a b c d e", "1 2 3 4 5 6 9 2 3 4 5 6 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(q.decide(df, []).collect(), list(enumerate(texts)))


def test_the_list_follows_the_labels(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    rules = q.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert rules and all(1 <= len(r.tests) <= 3 for r in rules)
    kept = {r.doc_id: r.kept for r in op5_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [kept[x.doc_id] for x in labels if x.quality == 1]
    bad = [kept[x.doc_id] for x in labels if x.quality == 0]
    assert sum(good) > 0.9 * len(good) and sum(bad) < 0.35 * len(bad)


def test_covering_and_pruning():
    rows = [(i % 10 == 0, *[0.9 if (i % 10 == 0) == (f == 2) else 0.1 for f in range(len(q.FEATURES))]) for i in range(600)]
    rules = q.grow_list(rows)
    assert rules and rules[0].errors == 0 and rules[0].hits == 60


def number_of_rule(rules, text):
    """The first rule that a text meets, by plain Python."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute(text)
    t = text or ""
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    count = lambda s: sum(c in s for c in t)
    f = {
        "symbol_ratio": n_symbols / max(word_chars, 1), "repeat_ratio": n_repeat / max(n_words, 1), "dup_line_ratio": n_dup / max(len(lines), 1),
        "upper_ratio": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(word_chars, 1), "bang_ratio": count("!?") / max(n_words, 1), "word_length": word_chars / max(n_words, 1),
        "distinct_ratio": len(set(w)) / max(n_words, 1), "digit_ratio": count("0123456789") / max(word_chars, 1), "n_words": n_words,
    }
    return next((k for k, r in enumerate(rules, 1) if all(f[n] <= at if op == "<=" else f[n] > at for n, op, at in r.tests)), 0)


def test_verdicts_by_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [q.Rule((("symbol_ratio", ">", 0.02), ("n_words", ">", 40.0))), q.Rule((("upper_ratio", ">", 0.1),)), q.Rule((("distinct_ratio", "<=", 0.6), ("digit_ratio", "<=", 0.01), ("word_length", ">", 4.0)))]
    for rules in (q.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), made):
        got = {r.doc_id: (r.rule, r.kept) for r in q.decide(docs, rules).collect()}
        for r in docs.collect():
            rule = number_of_rule(rules, r.text)
            n_words, *_, n_repeat = brute(r.text)
            assert got[r.doc_id] == (rule, rule == 0 and n_words >= 10 and 100 * n_repeat <= 20 * n_words)
    assert {x for x, _ in got.values()} >= {0, 1, 2}


def test_sample_is_bounded_whatever_ids_repeat(spark, monkeypatch):
    many = spark.createDataFrame([(i % 50, "a b c d e f g h i j k l " + "#" * (i % 3) + f" w{i % 50}") for i in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "grow_list", lambda rows, **_: seen.append(len(rows)) or [])
    q.learn(many, labels, max_rows=20)
    assert seen == [20]


def test_a_very_long_text(spark, odd):
    text = " ".join(f"w{i % 70_000}" for i in range(150_000)) + "\nline\nline"
    docs = spark.createDataFrame([(1, text, "en", "z", 1)], odd.schema)
    check(q.decide(docs, []).collect(), [(1, text)])
