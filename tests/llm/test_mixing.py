import hashlib
import re
from collections import defaultdict
from fractions import Fraction

from rasterloom.llm import mixing as m
from rasterloom.llm.queries import SQL, op6_mixing
from tests.oracle import compare


def test_against_sql(spark, sf_dir):
    assert compare(op6_mixing(spark, sf_dir), SQL["op6_mixing"], sf_dir) > 50
    sf = sf_dir.replace("0.001", "0.01")
    assert compare(op6_mixing(spark, sf), SQL["op6_mixing"], sf) > 300


def fill(budget, kids):
    """kids: name -> (cap, weight). Shares by repeated rounds: whoever fills up is set aside and the rest shared again."""
    out, left, open_ = {}, budget, dict(kids)
    while open_:
        w = sum(x[1] for x in open_.values())
        full = [k for k, (c, x) in open_.items() if c <= Fraction(left * x, w)]
        if not full:
            return out | {k: left * x // w for k, (_, x) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[0]
        left = budget - sum(out.values())
    return out


def brute(rows, tenths):
    leaves = defaultdict(list)
    for d, text, lang, source in rows:
        n = int(source[3:]) if source and source.startswith("src") and source[3:].isdigit() else None
        domain = "other" if n is None else "web" if n < 8 else "books" if n < 14 else "forum" if n < 18 else "code"
        leaves[domain, lang or "", source or ""].append((d, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    tokens = {k: sum(x[1] for x in v) for k, v in leaves.items()}
    cap = lambda *at: m.MAX_EPOCHS * sum(v for k, v in tokens.items() if k[: len(at)] == at)
    out = []
    top = fill(sum(tokens.values()) * tenths // 10, {d: (cap(d), m.DOMAIN_WEIGHTS.get(d, 1)) for d in {k[0] for k in leaves}})
    for d, b in top.items():
        for g, c in fill(b, {g: (cap(d, g), m.LANG_WEIGHTS.get(g, 1)) for g in {k[1] for k in leaves if k[0] == d}}).items():
            for s, e in fill(c, {s: (cap(d, g, s), 1) for s in {k[2] for k in leaves if k[:2] == (d, g)}}).items():
                own = leaves[d, g, s]
                epochs = e // tokens[d, g, s] if tokens[d, g, s] else 0
                rest = e - epochs * tokens[d, g, s]
                h = lambda i, epochs=epochs: hashlib.md5(f"{m.SEED}:{epochs}:{'' if i is None else i}".encode()).hexdigest()
                for i, n in own:
                    upto = sum(y for x, y in own if h(x) <= h(i))
                    copies = epochs + (rest > 0 and upto <= rest)
                    if copies:
                        out.append((repr(i), d, g, s, n, copies, e))
    return sorted(out)


def test_against_repeated_sharing(spark, odd, prose):
    texts = prose(150, most=200)
    more = [(100 + i, t, ["en", "de", None, "xx"][i % 4 if i % 7 else 0], f"src{(i * i) % 21}", 1) for i, t in enumerate(texts)]
    docs = odd.union(spark.createDataFrame(more, odd.schema))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    for tenths in (3, 9, 22, 40):
        got = m.mix(docs.selectExpr("*", "1 as copies", "2 as h", "3 as cap"), tenths=tenths).collect()
        assert sorted((repr(r.doc_id), r.domain, r.lang, r.source, r.n_tokens, r.copies, r.leaf_budget) for r in got) == brute(rows, tenths)


def test_documents_keep_their_columns(spark, odd):
    out = m.mix_documents(odd.selectExpr("*", "1 as docs"), tenths=10)
    assert out.columns == [*odd.columns, "docs", "copies"]
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(repr(r.doc_id) for r in m.mix(odd, tenths=10).collect())
    assert m.mix(odd.limit(0)).count() == 0 and m.mix_documents(odd.limit(0)).count() == 0
