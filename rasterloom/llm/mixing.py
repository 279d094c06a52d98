"""Mixing sources to target weights: hierarchical budgeting over a domain - language - source tree.

A budget of tokens flows down the tree by the weights of each node's children. A child gets no more than its capacity, the
tokens below it times max_epochs; what it can't use goes to its siblings by their weights, and only what all siblings can't
use is left to their parent's siblings, as a parent is never given more than its children can hold. Each level is one window
over siblings: sorted by capacity to weight, those that fill up are a prefix, and two running sums tell where it ends. Token
sums are integers throughout; shares are rounded down, so a level may leave a token per child unspent.

Each leaf takes whole epochs and then a prefix of the next one, in the order of a seeded hash that differs by epoch: all
documents before which, and with which, the running sum of tokens stays within the rest of the budget. The cut is found in two
steps, so that no leaf, however large, is sorted in one task: hash ranges, as many as the square root of the leaf's documents,
are summed; then only the range that holds the cut is ordered.

Cases: a null text has no tokens; null languages and sources are leaves named ""; repeated rows of one doc_id stand or
fall together; documents without tokens go with the prefix they lie in; a leaf without tokens gets none; an empty table gives
an empty result; further columns are left out of mix() unless named in keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import stored, words

LEAF = ("domain", "lang", "source")
#: Weights of domains and of languages, each among its siblings: fixed values of the query. What isn't named has weight 1.
DOMAIN_WEIGHTS = {"web": 6, "books": 4, "forum": 2, "code": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}
#: The budget as tenths of all tokens, the epochs a leaf may be repeated, the seed of the orders.
TENTHS, MAX_EPOCHS, SEED = 8, 3, 17


def domain_of(source: Column) -> Column:
    """The domain of a source srcN of these tables."""
    n = F.nullif(F.regexp_extract(source, "^src([0-9]{1,9})$", 1), F.lit("")).cast("int")
    return F.when(n < 8, "web").when(n < 14, "books").when(n < 18, "forum").when(n >= 18, "code").otherwise("other")


def leaf_columns() -> list[Column]:
    return [domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]


def counted(docs: DataFrame) -> DataFrame:
    """Stored: doc_id, leaf and tokens of each whole text."""
    return stored(docs.select("doc_id", *leaf_columns(), F.size(words(F.col("text"))).cast("long").alias("n_tokens")), "mixing_counts")


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(F.col(name) == k, w).otherwise(out)
    return out.cast("decimal(38,0)")


def _share(rows: DataFrame, parents: list[str], node: str) -> DataFrame:
    """Of siblings (parents, node, cap, w) under a parent's budget b, each one's own budget."""
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), node)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy(*parents)
    d = lambda c: F.col(c).cast("decimal(38,0)")
    full = d("cap") * F.sum("w").over(rest).cast("decimal(20,0)") <= F.col("w").cast("decimal(9,0)") * (F.col("b") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("full", full)
    left = F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0))
    among = F.sum(F.when(~F.col("full"), F.col("w"))).over(all_)
    rows = rows.withColumns({"left": left, "among": among})
    return rows.withColumn("b", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(cast(left as decimal(20,0)) * cast(w as decimal(9,0))) div among"))).drop("full", "left", "among", "w")


def budgets(counts: DataFrame, domain_weights=None, lang_weights=None, source_weights=None, tenths: int = TENTHS, max_epochs: int = MAX_EPOCHS, total: int | None = None) -> DataFrame:
    """Stored: per leaf its tokens, documents, budget, whole epochs and what remains for the next one."""
    leaves = stored(counts.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).withColumn("cap", F.col("tokens") * max_epochs), "mixing_leaves")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    # the few domains are the children of one root, whose budget is a sum over them
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("root", F.lit("all"))
    whole = F.lit(total).cast("long") if total is not None else F.expr(f"(sum(tokens) OVER (PARTITION BY root)) * {tenths} div 10")
    top = domains.withColumns({"w": _weight("domain", domain_weights or DOMAIN_WEIGHTS), "b": whole}).drop("tokens")
    top = _share(top, ["root"], "domain").select("domain", "b")
    middle = langs.withColumn("w", _weight("lang", lang_weights or LANG_WEIGHTS)).join(top, "domain")
    middle = _share(middle, ["domain"], "lang").select("domain", "lang", "b")
    low = _share(leaves.withColumn("w", _weight("source", source_weights or {})).join(middle, ["domain", "lang"]), ["domain", "lang"], "source")
    epochs = F.when(F.col("tokens") > 0, F.expr("b div tokens")).otherwise(0)
    low = low.select(*LEAF, "tokens", "docs", F.col("b").alias("budget"), epochs.alias("epochs"))
    return stored(low.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "mixing_budgets")


def _ordered(docs: DataFrame, seed: int) -> DataFrame:
    """Adds h, a document's place in its leaf's partial epoch, and its hash range."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = docs.withColumn("h", h)
    return docs.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.ceil(F.sqrt("docs")) / F.lit(2**32)))


def plan(counts: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """Stored: budgets(), with the hash range and the last hash of each leaf's prefix."""
    leaves = budgets(counts, **options)
    rows = _ordered(counts.join(leaves.where("rest > 0"), list(LEAF)), seed)
    sums = rows.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    cut = stored(sums.withColumn("upto", upto).where("upto > rest and upto - n <= rest").select(*LEAF, F.col("bucket").alias("cut"), (F.col("upto") - F.col("n")).alias("before")), "mixing_cuts")
    inside = rows.join(cut, list(LEAF)).where("bucket = cut")
    run = F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", F.col("before") + run).where("upto <= rest").groupBy(*LEAF).agg(F.max("h").alias("last"))
    return stored(leaves.join(cut.drop("before"), list(LEAF), "left").join(last, list(LEAF), "left"), "mixing_plan")


def apply(docs: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """docs, which has doc_id and the leaf's columns, with copies, the times each is taken (0: not), and its leaf's budget."""
    rows = _ordered(docs.join(leaves, list(LEAF)), seed)
    chosen = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (F.col("h") <= F.col("last")))
    copies = F.col("epochs") + F.when(chosen, 1).otherwise(0)
    return rows.select(*docs.columns, copies.cast("long").alias("copies"), F.col("budget").cast("long").alias("leaf_budget"))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """doc_id, leaf, tokens, copies and the leaf's budget of each document that is taken at least once."""
    counts = counted(docs)
    return apply(counts, plan(counts, seed, **options), seed).where("copies > 0")


def mix_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The documents taken, with all their columns and copies."""
    leaves = plan(counted(docs), seed, **options)
    held = docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns], "doc_id", *leaf_columns())
    out = apply(held, leaves, seed).where("copies > 0")
    return out.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns if c != "copies"], "copies")
