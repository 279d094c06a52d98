"""Queries op1 to op10 over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontamination, license_scan, lm_scoring, mixing, pu_quality, quality_rules, secret_scan, simhash_near_dups, token_counts, toxicity
from rasterloom.llm.common import remainder, stored, table


#: Further words that op4's proximity matches may have between a window's words.
SLOP = 2


def _classified(scores: DataFrame, mod: int, held: int) -> DataFrame:
    return scores.select("doc_id", (remainder(F.col("doc_id"), mod) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pu_quality.learn(docs, table(spark, sf_dir, "labels"), keep=remainder(F.col("doc_id"), 5) != 0)
    return _classified(pu_quality.score(docs, model), 5, 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), keep=remainder(F.col("doc_id"), 4) != 2)
    return _classified(toxicity.score(docs, model), 4, 2)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(table(spark, sf_dir, "documents"))
    # sums of logarithms differ in their last digits by the order they are added in
    return found.select("doc_id", "n_words", "n_backoff", *[F.round(c, 4).alias(c) for c in ("log_score", "mean_log_score")])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.decide(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str, paragraphs: bool = False) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), paragraphs=paragraphs)
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op7_license_scan_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_license_scan(spark, sf_dir, paragraphs=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores each document's text and tree; then edits nearly all of the stored ones, encoding what the edits touch."""
    trees = stored(token_counts.count(table(spark, sf_dir, "documents"), trees=True).select("doc_id", "text", "tree"), "token_trees")
    return token_counts.edited(trees, token_counts.unwrapped(F.col("text")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op10_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_near_dups.near_dups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_near_dups.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": op1_pu_quality,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_license_scan": op7_license_scan,
    "op7_license_scan_wrapped": op7_license_scan_wrapped,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scan": op9_secret_scan,
    "op10_simhash_near_dups": op10_simhash_near_dups,
}
_STRICT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _license_sql(blocks: str = "string_split(text, chr(10))") -> str:
    rows = ", ".join(f"({i}, '{label}', {has}, {need})" for i, (label, has, need) in enumerate(license_scan.template_sets()))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in license_scan.PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {_STRICT} AS w FROM d),
phrase AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) x(p, label)),
pos AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM w),
place AS (SELECT rid, i - 1 AS i, label FROM pos JOIN phrase ON list_slice(w, i, i + len(p) - 1) = p),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place GROUP BY rid),
tpl AS (SELECT * FROM (VALUES {rows}) x(t, label, has, need)),
line AS (SELECT rid, unnest({blocks}) AS text FROM d),
block AS (SELECT rid, list_distinct({_STRICT}) AS w FROM line),
held AS (SELECT rid, label, max(len(list_intersect(w, has)) / len(has)) AS score FROM block, tpl WHERE len(list_intersect(w, has)) >= need GROUP BY rid, label),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT rid, label FROM place) GROUP BY rid),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT rid, label FROM place UNION SELECT rid, label FROM held) GROUP BY rid),
sc AS (SELECT rid, max(score) AS score FROM held GROUP BY rid)
SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM d JOIN w USING (rid) LEFT JOIN base USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)"""


def _share_sql(name: str, source: str, parents: str, node: str) -> str:
    """One level of the tree: siblings of source (parents, node, cap, w, b) to their budgets b."""
    return f"""
{name}0 AS (SELECT *, CAST(cap AS HUGEINT) * sum(w) OVER (PARTITION BY {parents} ORDER BY cap / w, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= CAST(w AS HUGEINT) * (b - coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap / w, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM {source}),
{name}1 AS (SELECT *, b - coalesce(sum(CASE WHEN filled THEN cap END) OVER (PARTITION BY {parents}), 0) AS remains, sum(CASE WHEN NOT filled THEN w END) OVER (PARTITION BY {parents}) AS among FROM {name}0),
{name} AS (SELECT * EXCLUDE (b, filled, remains, among, w), CAST(CASE WHEN filled THEN cap ELSE (CAST(remains AS HUGEINT) * w) // among END AS BIGINT) AS b FROM {name}1)"""


def _mixing_sql() -> str:
    weight = lambda c, ws: f"CAST(CASE {' '.join(f"WHEN {c} = '{k}' THEN {w}" for k, w in ws.items())} ELSE 1 END AS BIGINT)"
    n = "CAST(nullif(regexp_extract(source, '^src([0-9]{1,9})$', 1), '') AS INT)"
    return f"""
WITH counts AS (SELECT doc_id, CASE WHEN {n} < 8 THEN 'web' WHEN {n} < 14 THEN 'books' WHEN {n} < 18 THEN 'forum' WHEN {n} >= 18 THEN 'code' ELSE 'other' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {mixing.MAX_EPOCHS} AS cap FROM counts GROUP BY ALL),
top_ AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {weight("domain", mixing.DOMAIN_WEIGHTS)} AS w, 1 AS root, (SELECT CAST(sum(tokens) AS BIGINT) * {mixing.TENTHS} // 10 FROM leaves) AS b FROM leaves GROUP BY domain),
{_share_sql("a", "top_", "root", "domain")},
mid AS (SELECT l.*, a.b FROM (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, {weight("lang", mixing.LANG_WEIGHTS)} AS w FROM leaves GROUP BY domain, lang) l JOIN a USING (domain)),
{_share_sql("m", "mid", "domain", "lang")},
low AS (SELECT l.*, CAST(1 AS BIGINT) AS w, m.b FROM leaves l JOIN m USING (domain, lang)),
{_share_sql("f", "low", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, b AS budget, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS epochs, b - CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END * tokens AS rest FROM f),
run AS (SELECT c.*, budget, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mixing.SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM counts c JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies, budget AS leaf_budget
FROM run WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0"""


def _secret_sql() -> str:
    lit = lambda p: "'" + p.replace("'", "''") + "'"
    x = secret_scan
    patterns = {0: x.ASSIGN, 1: x.ACCESS, 2: x.HEX, 3: x.IDENT, 4: x.BLOB, 5: x.ENDPOINT, 6: x.BLANK_LINES}
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, i, m, g, {'len(v) >= 6' if k == 0 else 'true'} AS ok FROM (SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g{', unnest(vs) AS v' if k == 0 else ''}"
        f" FROM (SELECT rid, regexp_extract_all(t, {lit(p)}) AS ms, string_split_regex(t, {lit(p)}) AS gs{f', regexp_extract_all(t, {lit(p)}, 1) AS vs' if k == 0 else ''} FROM d))"
        for k, p in patterns.items()
    )
    names = "CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(x.KINDS)) + " END"
    listed = f"string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
p AS (SELECT rid, k, m, ok, CAST(sum(len(g)) OVER w + sum(len(m)) OVER w - len(m) AS BIGINT) AS s, CAST(sum(len(g)) OVER w + sum(len(m)) OVER w AS BIGINT) AS e FROM f WINDOW w AS (PARTITION BY rid, k ORDER BY i)),
n AS (SELECT rid, k, s, e, m, ok, max(CASE WHEN k = 6 THEN s END) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
  min(CASE WHEN k = 6 THEN s END) OVER (PARTITION BY rid ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM p),
q AS (SELECT n.rid, k, s, e, coalesce(lo, 0) AS lo, coalesce(hi, len(t)) - coalesce(lo, 0) <= {x.SECTION} AS short FROM n JOIN d USING (rid) WHERE ok AND k < 6 AND (k <> 4 OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')))),
l AS (SELECT DISTINCT a.rid, a.k, a.s, a.e FROM q a JOIN q b ON a.rid = b.rid AND (a.k = 4) = (b.k IN (1, 3, 5)) AND (b.e <= a.s OR b.s >= a.e)
  AND ((b.e + {x.REACH} >= a.s AND b.s <= a.e + {x.REACH}) OR (a.short AND a.lo = b.lo)) WHERE a.k >= 3
  AND NOT EXISTS (SELECT 1 FROM q c WHERE c.rid = a.rid AND c.k < 3 AND c.s < a.e AND c.e > a.s)),
b AS (SELECT rid, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS n2, {listed} AS base FROM q WHERE k < 3 GROUP BY rid),
a AS (SELECT rid, {listed} AS spans FROM (SELECT rid, k, s, e FROM q WHERE k < 3 UNION ALL SELECT * FROM l) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""


#: For windows of each size the places, counted from their first word, at which the words of a proximity match can stand.
_SPREADS = ", ".join(f"({n}, [{', '.join(map(str, (1, *c)))}])" for n in range(1, decontamination.WINDOW + 1) for c in combinations(range(2, n + SLOP + 1), n - 1))
def _backoff_sql() -> str:
    x = lm_scoring
    gram = lambda n, end="i": " || ' ' || ".join(f"w[{end} - {k}]" for k in reversed(range(n)))  # noqa: E731  the n-gram that ends at a place
    count = lambda n: f"k{n} AS (SELECT g{n} AS g, count(*) AS c FROM p WHERE g{n} IS NOT NULL GROUP BY g{n})"
    best, backed = "ln(c1) - ln((SELECT count(*) FROM p))", "false"
    for n in range(2, x.ORDER + 1):
        best = f"CASE WHEN i < {n} THEN {best} WHEN c{n} >= {x.MIN_COUNT} THEN ln(c{n}) - ln(o{n - 1}) ELSE {best} + ln({x.BACKOFF}) END"
        backed = f"CASE WHEN i < {n} THEN {backed} ELSE c{n} < {x.MIN_COUNT} END"
    orders = range(1, x.ORDER + 1)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_STRICT} AS w FROM documents),
p AS (SELECT rid, i, {', '.join(f"CASE WHEN i >= {n} THEN {gram(n)} END AS g{n}" for n in orders)}, {', '.join(f"CASE WHEN i > {n} THEN {gram(n, '(i - 1)')} END AS b{n}" for n in range(1, x.ORDER))} FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
{', '.join(count(n) for n in orders)},
s AS (SELECT rid, {best} AS best, {backed} AS backed FROM (SELECT p.rid, p.i, {', '.join(f'k{n}.c AS c{n}' for n in orders)}, {', '.join(f'o{n}.c AS o{n}' for n in range(1, x.ORDER))} FROM p {' '.join(f'LEFT JOIN k{n} ON k{n}.g = p.g{n}' for n in orders)} {' '.join(f'LEFT JOIN k{n} o{n} ON o{n}.g = p.b{n}' for n in range(1, x.ORDER))})),
t AS (SELECT rid, sum(best) AS best, sum(CASE WHEN backed THEN 1 ELSE 0 END) AS backed FROM s GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(backed, 0) AS BIGINT) AS n_backoff, round(coalesce(best, 0.0), 4) AS log_score, round(best / len(w), 4) AS mean_log_score FROM d LEFT JOIN t USING (rid)"""


SQL: dict[str, str] = {
    "op3_lm_scoring": _backoff_sql(),
    "op9_secret_scan": _secret_sql(),
    "op6_mixing": _mixing_sql(),
    "op7_license_scan": _license_sql(),
    "op7_license_scan_wrapped": _license_sql(f"string_split_regex(text, '{license_scan.BLANK_LINES}')"),
    "op4_decontamination": f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_STRICT} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_STRICT} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dg AS (SELECT rid, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
       FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
occ AS (SELECT DISTINCT dg.rid, dg.i, dg.size, win.item FROM dg JOIN win ON dg.g = win.g AND dg.size = win.size),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM occ)) GROUP BY rid),
nw AS (SELECT DISTINCT item, w, len(w) AS size FROM (SELECT item, list_slice(w, i, i + least(len(w), 10) - 1) AS w FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0))),
seg AS (SELECT rid, list_slice(w, i, i + {decontamination.WINDOW + SLOP - 1}) AS seg FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM dw)),
near AS (SELECT rid, count(DISTINCT item) AS n_near FROM (SELECT rid, item, seg, nw.w, nw.size FROM seg JOIN nw ON seg.seg[1] = nw.w[1] AND (nw.size = 1 OR list_contains(list_slice(seg, 2, {2 + SLOP}), nw.w[2]))
         AND list_contains(list_slice(seg, nw.size, nw.size + {SLOP}), nw.w[nw.size])) c JOIN (VALUES {_SPREADS}) x(size, spread) ON c.size = x.size AND len(seg) >= spread[c.size] AND list_select(seg, spread) = c.w GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM dw LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid) LEFT JOIN near USING (rid)""",
}
