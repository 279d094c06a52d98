import re
import textwrap
from collections import Counter

import duckdb

from rasterloom.llm import license_scan as s
from rasterloom.llm.queries import SQL, op7_license_scan, op7_license_scan_wrapped
from tests.oracle import compare


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, templates=s.TEMPLATES, containment=s.CONTAINMENT):
    w = words(text)
    at = [(i, label) for p, label in s.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best = {}
    for line in (text or "").split("\n"):
        have = set(words(line))
        for label, has, need in s.template_sets(templates, containment):
            if len(have & set(has)) >= need:
                best[label] = max(best.get(label, 0), len(have & set(has)) / len(has))
    starts = [i for i, _ in at]
    labels = {x for _, x in at}
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(best))), 1.0 if at else max(best.values(), default=0.0)


def test_against_sql(spark, sf_dir):
    assert compare(op7_license_scan(spark, sf_dir), SQL["op7_license_scan"], sf_dir) >= 200


def test_against_brute_force(spark, odd):
    texts = [t for _, t in s.TEMPLATES] + [" ".join(t.split()[:-2]) for _, t in s.TEMPLATES]
    texts += [
        "cc by cc-by CC BY. ccc by cc bye", "All Rights\nReserved; general public license", "license the under mit RELEASED\n", "x\n" * 500 + "Released under MIT License",
        "the under license mit released the under license mit released " * 300, "CC BY all rights reserved cc by", "licensed\nunder\nthe\napache\nlicense",
    ]
    docs = odd.union(spark.createDataFrame([(100 + i, t, "en", "z", 1) for i, t in enumerate(texts)], odd.schema))
    for containment in (0.8, 0.4):
        got = s.scan(docs.selectExpr("*", "1 as blocks", "2 as t", "3 as score"), containment=containment).collect()
        want = Counter((r.doc_id, *brute(r.text, containment=containment)) for r in docs.collect())
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels), ",".join(r.labels), r.score) for r in got) == want


def test_empty_tables_and_no_templates(spark, odd):
    assert s.scan(odd.limit(0)).count() == 0
    assert {r.score for r in s.scan(odd, ()).collect()} == {0.0}


def test_wrapped_notices(spark, odd, sf_dir, tmp_path):
    notices = {label: t for label, t in s.TEMPLATES if len(t) > 80}
    assert {"mit", "bsd", "mpl-2.0"} <= set(notices)
    texts = [(f"Some file.\n \t\n{end.join(textwrap.wrap(t, 72))}{end}\n\nmore", label) for label, t in notices.items() for end in ("\n", "\r\n")]
    texts += [("\n\n".join(t.split()), None) for t in notices.values()]
    docs = odd.union(spark.createDataFrame([(100 + i, t, "en", "z", 1) for i, (t, _) in enumerate(texts)], odd.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_license_scan_wrapped(spark, str(tmp_path)).collect()
    found = {r.doc_id: r.labels.split(",") for r in got}
    for i, (_, label) in enumerate(texts):
        assert label is None or label in found[100 + i]
    as_lines = lambda t: "\n".join(p.replace("\n", " ") for p in re.split(r"\n[ \t\x0b\x0c\r]*\n", t or ""))
    want = Counter((r.doc_id, *brute(as_lines(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    assert Counter(con.execute(f"SELECT {columns} FROM ({SQL['op7_license_scan_wrapped']})").fetchall()) == want
    assert compare(op7_license_scan_wrapped(spark, sf_dir), SQL["op7_license_scan_wrapped"], sf_dir) >= 200
