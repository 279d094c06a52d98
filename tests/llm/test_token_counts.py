import base64
import random

import regex
import tiktoken
from pyspark.sql import functions as F

from rasterloom.llm import token_counts as t
from rasterloom.llm.queries import op8_token_counts


def encoding():
    with open(t.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_counts_and_masked_digits(spark, sf_dir):
    e = encoding()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    edited = 0
    for r in op8_token_counts(spark, sf_dir).collect():
        after, n = regex.subn("[0-9]{6,}|\r?\n", lambda m: " " if m[0][-1] == "\n" else "<num>", text[r.doc_id])
        edited += n > 0
        assert (r.n_tokens, r.n_edits, r.n_edited_tokens) == (len(e.encode_ordinary(text[r.doc_id])), n, len(e.encode_ordinary(after)))
        assert r.n_encoded <= n * 600
    assert edited > 0.8 * len(text)


def test_random_edits(monkeypatch, prose):
    monkeypatch.setattr(t, "LEAF", 3)
    monkeypatch.setattr(t, "FAN", 2)
    e, find, count, r = encoding(), regex.compile(t.PATTERN), t.counter(), random.Random(4)
    bits = ["", "a", " ", "  ", "\n\n", "'ll", "'", "l", "12", "é漢", "<|endoftext|>", " the end.", "\t x", "😀", "s " * 40]
    for text in ["", "x", " ", *prose(12, most=60), "it's we'll  \n  they've 'd " * 20, "word" * 200]:
        tree = t.Tree(text, count, find)
        for _ in range(60):
            a = r.randint(0, len(text) + 1)
            b = min(len(text), a + r.choice([0, 0, 1, 2, 5, 30]))
            put = r.choice(bits) + r.choice(bits)
            text = text[:a] + put + text[max(a, b) :]
            tree.edit(a, b, put)
            assert tree.text == text
            if r.random() < 0.5:  # several at once, in any order
                many = []
                for _ in range(r.randint(2, 6)):
                    a = r.randint(0, len(text) + 1)
                    b = min(len(text), a + r.choice([0, 0, 1, 4]))
                    many.append((a, b, r.choice(bits)))
                    text = text[:a] + many[-1][2] + text[max(a, b) :]
                    if r.random() < 0.4:
                        a, b = sorted((r.randint(0, len(text)), r.randint(0, len(text))))
                        spots = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, 4)))
                        more = [(x, min(y, x + 2), r.choice(bits)) for x, y in zip(spots, spots[1:], strict=False)]
                        for x, y, put in reversed(more):
                            text = text[:x] + put + text[y:]
                        many += reversed(more)
                tree.apply(many)
                assert tree.text == text
            lengths = [n for leaf, _ in tree.leaves for n in leaf]
            assert tree.tokens == len(e.encode_ordinary(text))
            assert lengths == [len(x) for x in find.findall(text)]
            assert tree.levels[-1][0][:2] == (len(text), len(lengths)) and len(tree.levels[-1]) == 1
            for low, high in zip(tree.levels, tree.levels[1:], strict=False):
                assert high == [tuple(map(sum, zip(*low[i : i + t.FAN], strict=True))) for i in range(0, len(low), t.FAN)]


def test_edits_touch_little(prose):
    count, find = t.counter(), regex.compile(t.PATTERN)
    tree = t.Tree(" ".join(prose(400)), count, find)
    whole, tree.encoded = len(tree.text), 0
    tree.edit(whole // 2, whole // 2 + 3, "new words")
    assert whole > 50_000 and 0 < tree.encoded < 1000


def test_edit_tables_and_odd_rows(spark, odd):
    e = encoding()
    edits = spark.createDataFrame([(7, 1, 0, 1, "first "), (7, 2, 0, 0, "zero "), (6, 1, 3, 99999, None), (1, 1, 0, 0, "now text"), (77, 1, 0, 0, "nowhere")], "doc_id long, ordinal int, start int, stop int, text string")
    docs = odd.selectExpr("*", "1 as edits", "2 as n_tokens")
    got = {(r.doc_id, r.n_edited_tokens, r.n_edits) for r in t.with_edits(docs, edits).collect()}
    n = lambda x: len(e.encode_ordinary(x))
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    want = {(d, n(x), 0) for d, x in text.items() if d not in (1, 6, 7)}
    assert got == want | {(7, n("zero first " + text[7][1:]), 2), (6, n(text[6][:3]), 1), (1, n("now text"), 1)}
    assert t.count(odd.limit(0)).count() == 0
    packed = t.count(odd, trees=True).collect()
    assert all(len(r.tree) % 12 == 0 for r in packed)


def test_stored_trees_take_further_rounds(spark, odd, prose):
    e = encoding()
    n = lambda x: len(e.encode_ordinary(x))
    long = " ".join(prose(100))
    docs = odd.union(spark.createDataFrame([(100, long, "en", "z", 1)], odd.schema))
    put = F.expr("array(struct(1 as start, 2 as stop, 'new ' as text))")
    first = t.count(docs, put, trees=True).localCheckpoint()
    second = t.edited(first, put, trees=True).localCheckpoint()
    after = lambda x: x[:1] + "new " + x[2:]
    texts = [r.text or "" for r in docs.collect()]
    assert sorted((r.text, r.n_edited_tokens) for r in first.collect()) == sorted((after(x), n(after(x))) for x in texts)
    want = sorted((after(after(x)), n(after(x)), n(after(after(x)))) for x in texts)
    assert sorted((r.text, r.n_tokens, r.n_edited_tokens) for r in second.collect()) == want
    assert max(r.n_encoded for r in second.where("doc_id = 100").collect()) < 1000 < len(long)
    find, count, encoded = regex.compile(t.PATTERN), t.counter(), []
    for r in second.collect():
        tree = t.Tree.load(r.text, bytes(r.tree), encoded.append, find)
        whole = t.Tree(r.text, count, find)
        assert tree.levels[-1] == whole.levels[-1] and tree.packed() == bytes(r.tree)
    assert not encoded


def test_many_edits_of_a_long_text_are_one_pass(spark, odd):
    find, count = regex.compile(t.PATTERN), t.counter()
    text = "some words 1234567 and\n more of them\n" * 50_000
    spots = [m.span() for m in regex.finditer("[0-9]{6,}|\n", text)]
    for order in (1, -1):
        tree, shift, edits = t.Tree(text, count, find), 0, []
        for a, b in spots[::order]:
            edits.append((a + shift, b + shift, "<num>" if b - a > 1 else " "))
            shift += (len(edits[-1][2]) - (b - a)) if order > 0 else 0
        assert len(list(t.batches(edits, len(text)))) == 1 and len(edits) == 150_000
        tree.apply(edits)
        after = regex.sub("\n", " ", regex.sub("[0-9]{6,}", "<num>", text))
        assert tree.text == after and tree.levels[-1] == t.Tree(after, count, find).levels[-1]
    found = spark.createDataFrame([(1, text, "en", "z", 1)], odd.schema).select(t.unwrapped(F.col("text")).alias("e")).first().e
    assert [(x.start, x.stop) for x in found] == spots[::-1]


def test_one_edit_sums_one_path(prose, monkeypatch):
    find, count = regex.compile(t.PATTERN), t.counter()
    tree = t.Tree(" ".join(prose(400)), count, find)
    kept = [list(level) for level in tree.levels]
    monkeypatch.setattr(tree, "_build", None)
    tree.edit(1000, 1003, "a few more words than there were")
    assert all(sum(x is not y for x, y in zip(a, b, strict=True)) <= 2 for a, b in zip(kept, tree.levels, strict=True))
