"""Quality rules: a learned decision list over text statistics, applied as one Spark conditional expression.

Cases: a null text has no words and is rejected by the base rule, as is an empty one; ratios of an empty text are 0; a very long text is
judged whole, in O(n log n) of its words; repeated rows are each judged alone, and of rows of one doc_id one is learnt from, that of
the least statistics; of rules of equal gain the first by feature and threshold is taken; an empty table gives an empty result; further columns are left out of the result
of decide() unless named in keep; without usable labels the list is empty and only the base rule rejects.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import SPACES, UPPER, count_of, labelled_sample, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Ratios that rules may test.
FEATURES = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio", "bang_ratio", "word_length", "distinct_ratio", "digit_ratio", "n_words")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold) that rejects what meets it."""

    tests: tuple[tuple[str, str, float], ...]
    hits: int = 0
    errors: int = 0

    def condition(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            out = out & (F.col(name) <= at if op == "<=" else F.col(name) > at)
        return out


def _repeated(w: Column) -> Column:
    """Words that lie in 5-word windows found twice or more. Only texts with such windows are sorted; all is O(n log n).

    A window is told by the 64-bit hash of its five words."""

    def covered(found: Column) -> Column:
        # found: positions of repeated windows, ascending; each covers up to the next one, 5 words at most
        reach = F.transform(found, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(found, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(ordered: Column) -> Column:
        same = F.filter(
            F.transform(ordered, lambda e, i: F.when((e["h"] == F.get(ordered, i - 1)["h"]) | (e["h"] == F.get(ordered, i + 1)["h"]), e["p"])),
            lambda p: p.isNotNull(),
        )
        return let(F.sort_array(same), covered)

    def of(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), positions))

    def hashes(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(WINDOW)]))

    return let(w, lambda v: F.when(F.size(v) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes(v), of)))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each whole text, and the ratios that rules test. One narrow pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    flat = docs.select(*[F.col(c).alias(f"_in_{c}") for c in keep], text)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    some = flat.select(
        *[f"_in_{c}" for c in keep],
        words(F.col("text")).alias("w"),
        lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        count_of(F.col("text"), UPPER).alias("n_upper"),
        count_of(F.col("text"), "!?").alias("n_bang"),
        count_of(F.col("text"), "0123456789").alias("n_digits"),
    )
    counted = some.select(
        *[f"_in_{c}" for c in keep],
        F.size("w").cast("long").alias("n_words"),
        "word_chars", "n_symbols", "n_upper", "n_bang", "n_digits",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        _repeated(F.col("w")).alias("n_repeat_words"),
    )
    ratio = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return counted.select(
        *[F.col(f"_in_{c}").alias(c) for c in keep if c not in BASE],
        *BASE,
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_bang", "n_words").alias("bang_ratio"),
        ratio("word_chars", "n_words").alias("word_length"),
        ratio("n_distinct", "n_words").alias("distinct_ratio"),
        ratio("n_digits", "word_chars").alias("digit_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def grow_list(rows: list[tuple], max_rules: int = 12, max_tests: int = 3, cuts: int = 48, min_cover: int = 8, min_precision: float = 0.9) -> list[Rule]:
    """Sequential covering over (bad, *FEATURES) rows: two thirds grow a rule by FOIL's gain, one third prunes it.

    Row sets are bit masks, so a candidate test costs an AND and a bit count."""
    if not rows:
        return []
    mask = lambda keep: sum(1 << i for i, r in enumerate(rows) if keep(i, r))
    bad, prune = mask(lambda i, r: r[0]), mask(lambda i, r: i % 3 == 2)
    grow, left = ~prune & ((1 << len(rows)) - 1), (1 << len(rows)) - 1
    tests: dict[tuple[str, str, float], int] = {}
    for f, name in enumerate(FEATURES, 1):
        values = sorted(r[f] for r in rows)
        low = sorted(r[f] for r in rows if r[0]) or values
        at = {v[min(len(v) - 1, k * len(v) // cuts)] for v in (values, low) for k in range(1, cuts)}
        for a in sorted(at):
            under = mask(lambda i, r, a=a, f=f: r[f] <= a)
            tests[name, "<=", a], tests[name, ">", a] = under, ((1 << len(rows)) - 1) & ~under
    count = int.bit_count
    found: list[Rule] = []
    while len(found) < max_rules:
        picked, cover = [], left & grow
        while len(picked) < max_tests:
            p, n = count(cover & bad), count(cover)
            if not p or p == n:
                break
            before, best = math.log2(p / n), (0.0, None)
            for t, m in tests.items():
                both = cover & m
                if (q := count(both & bad)) >= min_cover:
                    best = max(best, (q * (math.log2(q / count(both)) - before), t), key=lambda x: x[0])
            if best[1] is None:
                break
            picked.append(best[1])
            cover &= tests[best[1]]
        if not picked:
            break

        def worth(k: int) -> tuple[float, int, int]:
            m = left & prune
            for t in picked[:k]:
                m &= tests[t]
            hit, all_ = count(m & bad), count(m)
            return (2 * hit - all_) / all_ if all_ else -1.0, hit, all_

        k = max(range(1, len(picked) + 1), key=lambda k: (worth(k)[0], -k))
        _, hit, all_ = worth(k)
        if not all_ or hit < min_precision * all_:
            break
        got = left
        for t in picked[:k]:
            got &= tests[t]
        found.append(Rule(tuple(picked[:k]), count(got), count(got & ~bad)))
        left &= ~got
    return found


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 8000, seed: int = 7, **grow) -> list[Rule]:
    """A decision list from at most max_rows labelled documents that pass the base rule (label 0 is to be rejected).

    The bound holds at every input size, so the broadcast ids and the collected statistics are a few hundred kB."""
    ids = labelled_sample(labels, label, max_rows, seed)
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # what fails the base rule is left out here, not by a filter: Catalyst would take that below the join, and work out every text's statistics
    got = statistics(known.select("doc_id", "text", "label"), ("doc_id", "label"))
    seen = F.struct((F.col("label") == 0).alias("bad"), *[F.col(f).cast("double").alias(f) for f in FEATURES], base_failed().alias("failed"))
    # of rows with one id the least counts, so that no more than the sample's ids come to the driver
    rows = got.select("doc_id", seen.alias("x")).groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    return grow_list([tuple(r.x)[:-1] for r in sorted(rows, key=lambda r: r.doc_id) if not r.x.failed], **grow)


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the number of the first rule met, 0 for none."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(r.condition(), k) if out is None else out.when(r.condition(), k)
    return out.otherwise(0) if out is not None else F.lit(0)


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents kept, with all their columns."""
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), "text")
    # the verdict is worked out and taken in one generator: a filter would be moved below the projections, to work out the words once for each use
    kept = F.when(~base_failed() & (verdict(rules) == 0), F.array("_doc"))
    return statistics(whole, ("_doc",)).select(F.explode(kept).alias("_doc")).select("_doc.*")


def decide(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, BASE, base_failed, kept and the rule that rejected (0: none)."""
    rule = verdict(rules)
    return statistics(docs, keep).select(*keep, *BASE, base_failed().alias("base_failed"), (~base_failed() & (rule == 0)).alias("kept"), rule.alias("rule"))
