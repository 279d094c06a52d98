"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text or, with paragraphs, all lines up to the next blank one, so that a notice wrapped over lines is one block; it
is taken as a set of words. It holds a template if at least CONTAINMENT of the template's words are among its own. The join is a prefix
join: tokens are put in one global order, rarest in the corpus first, by one count over all words of all documents; a block that holds
o of a template's n tokens, o being the overlap needed, has one of the template's first n - o + 1 in that order, its prefix.

So one pass looks each block's words up in the prefixes, in documents that have any such word; blocks that have none end there. For the few
others the template tokens' places in the order are stored. They are joined to the prefix table; pairs that are too short (length
filter) or whose shared token leaves too few behind it on either side (positional filter) are dropped, and of what is left
the overlap is counted. Templates are a parameter of at most max_templates, which bounds the prefix table that is broadcast.

Cases: a null text counts as an empty one; a very long text is one row's work, linear in its words; repeated rows each get the same labels; an
empty table gives an empty result; blocks without template tokens are dropped; equal frequencies are ordered by token; further columns are
left out unless named in keep.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import BREAKS, LOWER, UPPER, stored

CONTAINMENT = 0.8
#: What parts paragraphs.
BLANK_LINES = r"\n[ \t\x0B\x0C\r]*\n"
MAX_TEMPLATES = 1000
#: Base phrases and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels and the notices that tell them: fixed values, common wordings of public licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher"),
)


def tokens(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def template_sets(templates=TEMPLATES, containment: float = CONTAINMENT, max_templates: int = MAX_TEMPLATES) -> list[tuple[str, list[str], int]]:
    """(label, distinct tokens, overlap needed) of each template."""
    if len(templates) > max_templates:
        raise ValueError(f"more than max_templates = {max_templates} templates")
    return [(label, sorted(set(t)), max(1, math.ceil(containment * len(set(t)) - 1e-9))) for label, text in templates if (t := tokens(text))]


def _flat(text: Column) -> Column:
    """The text with A-Z lower-cased and blanks between words."""
    return F.translate(text, UPPER + BREAKS, LOWER + " " * len(BREAKS))


def ordered_tokens(docs: DataFrame, sets: list[tuple[str, list[str], int]]) -> list[str]:
    """The templates' tokens in their global order, rarest among all words of all documents first, equal ones by token."""
    vocabulary = sorted({w for _, has, _ in sets for w in has})
    if not vocabulary:
        return []
    some = F.filter(F.split(_flat(F.coalesce(F.col("text"), F.lit(""))), " "), lambda w: w.isin(*vocabulary))
    often = {r.w: r.n for r in docs.select(F.explode(some).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (often.get(w, 0), w))


def prefixes(sets: list[tuple[str, list[str], int]], order: list[str]) -> list[tuple]:
    """The prefix table: (w, i, size, need, label, template), w the place in order of a template's i-th token."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for label, has, need in sets:
        own = sorted(rank[w] for w in has)
        rows += [(w, i, len(own), need, label, own) for i, w in enumerate(own[: len(own) - need + 1])]
    return rows


def prepared(docs: DataFrame, order: list[str], probes: list[str], keep: tuple[str, ...] = ("doc_id",), paragraphs: bool = False) -> DataFrame:
    """Stored: keep, a row number, the base counts, and, of blocks that have any of probes, how many distinct words they have and
    which of order's tokens, by place."""
    ins = [f"_in_{c}" for c in keep]
    some = docs.select(*[F.col(c).alias(f"_in_{c}") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    some = some.select(*ins, "text", F.array_remove(F.split(_flat(F.col("text")), " "), "").alias("w"))
    # each word with a space of its own on either side
    spaced = F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))
    probed = (lambda w: F.exists(w, lambda x: x.isin(*probes))) if probes else (lambda w: F.lit(False))
    some = some.select(*ins, "text", spaced.alias("t"), F.size("w").cast("long").alias("n_words"), probed(F.col("w")).alias("probed"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    before = lambda c: F.floor(spaces(c) / 2).cast("long")  # noqa: E731  words in a part that holds whole words
    columns, hits = [], {}
    for phrase, label in PHRASES.items():
        p = f" {phrase.replace(' ', '  ')} "
        hits[label] = F.col("t").contains(p)
        size = len(phrase.split())
        columns.append((
            F.when(hits[label], ((F.length("t") - F.length(F.replace("t", F.lit(p), F.lit("")))) / len(p)).cast("long")).otherwise(0),
            F.when(hits[label], before(F.substring_index("t", p, 1))),
            F.when(hits[label], F.col("n_words") - size - before(F.substring_index("t", p, -1))),
        ))
    place = F.create_map(*[x for i, w in enumerate(order) for x in (F.lit(w), F.lit(i))]) if order else None
    blocks = F.expr("cast(array() as array<struct<n:int,has:array<int>>>)")
    if place is not None:
        texts = F.split("text", BLANK_LINES if paragraphs else "\n")
        told = F.filter(F.transform(texts, lambda x: F.split(_flat(x), " ")), probed)
        own = lambda w: F.array_sort(F.transform(F.array_intersect(w, F.array(*map(F.lit, order))), lambda x: F.element_at(place, x)))
        found = F.transform(told, lambda w: F.struct(F.size(F.array_remove(F.array_distinct(w), "")).alias("n"), own(w).alias("has")))
        blocks = F.when(F.col("probed"), found).otherwise(blocks)
    labels = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in hits.items()])))
    out = some.select(
        *[F.col(f"_in_{c}").alias(c) for c in keep],
        F.monotonically_increasing_id().alias("row_no"),
        "n_words",
        sum((c[0] for c in columns[1:]), columns[0][0]).cast("long").alias("n_base"),
        F.least(*[c[1] for c in columns]).alias("first_word"),
        F.greatest(*[c[2] for c in columns]).alias("last_word"),
        labels.alias("base_labels"),
        blocks.alias("blocks"),
    )
    return stored(out, "license_blocks")


def joined(blocks: DataFrame, table: list[tuple]) -> DataFrame:
    """(row_no, label, score) of each document and template label that one of its blocks holds; score is the largest containment."""
    index = F.broadcast(blocks.sparkSession.createDataFrame(table, "w int, i int, size int, need int, label string, template array<int>"))
    rows = blocks.select("row_no", F.posexplode("blocks").alias("block_no", "b")).select("row_no", "block_no", "b.*")
    pairs = rows.select("*", F.posexplode("has").alias("j", "w")).join(index, "w").where("n >= need and size(has) >= need")
    # the shared token leaves size - i template tokens and size(has) - j block tokens, itself included
    pairs = pairs.where("least(size - i, size(has) - j) + least(i, j) >= need")
    found = pairs.withColumn("shared", F.size(F.array_intersect("has", "template"))).where("shared >= need")
    return found.groupBy("row_no", "label").agg(F.max(F.col("shared") / F.col("size")).alias("score"))


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, keep: tuple[str, ...] = ("doc_id",), paragraphs: bool = False, max_templates: int = MAX_TEMPLATES) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays) and score: 1 with a base place, else the
    largest containment of a template, 0 for none."""
    sets = template_sets(templates, containment, max_templates)
    order = ordered_tokens(docs, sets)
    table = prefixes(sets, order)
    found = prepared(docs, order, sorted({order[w] for w, *_ in table}), keep, paragraphs)
    if not sets:
        return found.select(*keep, "n_words", "n_base", "first_word", "last_word", "base_labels", F.col("base_labels").alias("labels"), F.when(F.size("base_labels") > 0, 1.0).otherwise(0.0).alias("score"))
    more = joined(found, table).groupBy("row_no").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    out = found.drop("blocks").join(more, "row_no", "left")
    labels = F.when(F.col("more").isNull(), F.col("base_labels")).otherwise(F.array_sort(F.array_union("base_labels", "more")))
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return out.select(*keep, "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
