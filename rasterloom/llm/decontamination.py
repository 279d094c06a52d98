"""Benchmark decontamination by a distributed positional inverted index.

build_index() cuts the corpus into blocks of documents and stores, for each block, the postings of all its terms: for each
term, told by its 64-bit hash, its places, ascending, in a numbering that leaves a gap after each document, so that no phrase runs on into
the next one. A block is one row of a table in the shared folder; nothing is shuffled, and the index knows nothing of the benchmark: any
number of searches can read it.

The benchmark's windows are a table. Their terms are joined to the terms' corpus frequencies, summed from the postings; windows
with a term that is nowhere end there, of the others each knows its terms from the rarest on. They are then packed into blocks of at
most about BLOCK_WINDOWS pairs of window and item, and search() goes through the index once for each: it intersects, for each window, the
lists from the rarest term on, each shifted by the term's offset. Most windows end at the first, empty list. What the driver and a task
hold is one block of windows and one block of the index, however large the benchmark and the corpus.

With slop it also gives proximity matches: the window's words in their order, with at most slop further words between them in all. Lists
are first intersected within that tolerance; from what is left the nearest words before and after are followed one by one.

Cases: a null or empty text has no words; an item without words has no windows, an item of fewer than 10 words is one window;
items of one item_id count as one; a null item_id is left out; a very long text is a block of its own, whole; repeated documents are each
judged alone; of equally frequent terms the first in the window is the rarest; empty tables give no hits or no rows; further columns are
left out of scan() and kept by clean(), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import running, stored

WINDOW = 10
#: Words of a block; a longer text is a block of its own.
BLOCK_WORDS = 400_000
#: Pairs of window and item sent to the tasks at a time: about 100 MB of Python objects at most.
BLOCK_WINDOWS = 250_000
#: Places left after a document; slop must be less.
GAP = 64
_LOW = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_LOW).split()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(w, item): the term hashes of each distinct window of an item, a row each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = np.array([xxhash.xxh64_intdigest(w) for w in words_of(text.as_py())], np.uint64).astype(np.int64)
                n = max(1, len(h) - size + 1) if len(h) else 0
                for a in range(0, n, 10_000):
                    w = [h[i : i + size] for i in range(a, min(n, a + 10_000))]
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.list_(pa.int64())), pa.array([item] * len(w), pa.string())], ["w", "item"])

    some = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null")
    return some.mapInArrow(run, "w array<long>, item string").distinct()


def build_index(docs: DataFrame, key: str = "doc_id", name: str = "postings") -> DataFrame:
    """The stored index: a row a block, with its documents' keys and word counts, its terms' hashes, ascending, how many
    places each has, and the places: the first of each term, then the steps from one to the next, as 32-bit numbers byte plane by byte plane."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        import xxhash

        from rasterloom.llm.lm_scoring import planed

        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64() if kind == "bigint" else pa.string())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary())])

        def row(keys: list, counts: list[int], number: dict, terms: list) -> pa.RecordBatch:
            n = np.array(counts, np.int64)
            place = np.arange(n.sum()) + GAP * np.repeat(np.arange(len(n)), n)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number)).astype(np.int64)
            rank = np.empty(len(hashes), np.int32)
            rank[np.argsort(hashes)] = np.arange(len(hashes), dtype=np.int32)
            t = rank[np.concatenate(terms)]
            place = place[np.argsort(t, kind="stable")]
            each = np.bincount(t, minlength=len(hashes))
            step = np.diff(place, prepend=0)
            first = np.cumsum(each) - each
            step[first] = place[first]
            cells = (uuid.uuid4().int >> 65, keys, n, np.sort(hashes), each, planed(step.astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

        keys, counts, number, terms, total = [], [], {}, [], 0
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words_of(text.as_py())
                keys.append(k)
                counts.append(len(w))
                terms.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int32, len(w)))
                total += len(w) + GAP
                if total >= BLOCK_WORDS:
                    yield row(keys, counts, number, terms)
                    keys, counts, number, terms, total = [], [], {}, [], 0
        if keys:
            yield row(keys, counts, number, terms)

    got = docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"block long, ids array<{kind}>, n_words array<int>, terms array<long>, counts array<int>, places binary")
    return stored(got, name)


def packed_windows(index: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Stored: rows of at most about limit pairs of a window and an item, all of whose terms the index has: items, sizes, the windows' terms
    end to end, and their offsets from the rarest term on, likewise."""
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "windows")
    terms = pairs.select("pair", F.posexplode("w").alias("at", "term"))
    heads = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    often = heads.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    order = terms.join(often, "term").groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("order"))
    live = stored(pairs.join(order, "pair").where(F.size("order") == F.size("w")).select("w", "item", F.col("order.at").alias("order")), "live_windows")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            w, item, order = (table.column(c).combine_chunks() for c in ("w", "item", "order"))
            cells = (item.to_pylist(), w.value_lengths().to_pylist(), w.flatten().to_pylist(), order.flatten().to_pylist())
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(k)) for c, k in zip(cells, kinds, strict=True)], ["items", "sizes", "terms", "order"])

    parts = max(1, math.ceil(live.count() / limit))
    return stored(live.repartition(parts).mapInArrow(run, "items array<string>, sizes array<int>, terms array<long>, order array<int>"), "packed_windows")


def search(index: DataFrame, block: tuple[list[str], list[int], list[int], list[int]], slop: int = 0) -> DataFrame:
    """For each document of the index that has any of a block's windows: block, ordinal, the runs of its hit words (starts, stops), its
    items, and with slop the items that have a window near (near_items, exact ones included)."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from rasterloom.llm.lm_scoring import unplaned

        names, sizes, terms, order = sent.value
        sizes, terms, order = np.array(sizes, np.int64), np.array(terms, np.int64), np.array(order, np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        schema = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

        def at_or_after(p: np.ndarray, x: np.ndarray) -> np.ndarray:
            """The first of places p from x on; far away if there is none."""
            k = np.searchsorted(p, x)
            return np.where(k < len(p), p[np.minimum(k, len(p) - 1)], 1 << 40)

        def at_or_before(p: np.ndarray, x: np.ndarray) -> np.ndarray:
            k = np.searchsorted(p, x, "right") - 1
            return np.where(k >= 0, p[np.maximum(k, 0)], -(1 << 40))

        def places_of(w: int, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """Starts of a window's exact places, and places of its rarest term with the others near."""
            offsets = order[begins[w] : ends[w]].tolist()
            r, at = offsets[0], own[offsets[0]]
            for i in offsets[1:]:
                d = i - r
                low = at + d if d > 0 else at + d - slop
                at = at[at_or_after(own[i], low) <= low + slop]
                if not len(at):
                    return at, at
            if not slop:
                return at - r, at[:0]
            exact, first, last = np.ones(len(at), bool), at, at
            for i in range(len(offsets)):
                exact &= at_or_after(own[i], at + i - r) == at + i - r
            for i in range(r + 1, len(offsets)):
                last = at_or_after(own[i], last + 1)
            for i in range(r - 1, -1, -1):
                first = at_or_before(own[i], first - 1)
            return at[exact] - r, at[last - first - (len(offsets) - 1) <= slop]

        for b in batches:
            for row in range(b.num_rows):
                cell = lambda c, row=row, b=b: b.column(b.schema.get_field_index(c))[row]
                have, each, n = (cell(c).values.to_numpy(zero_copy_only=False) for c in ("terms", "counts", "n_words"))
                base = np.cumsum(n.astype(np.int64) + GAP) - n - GAP
                if not len(have) or not len(terms):
                    continue
                known = np.searchsorted(have, terms)
                here = have[np.minimum(known, len(have) - 1)] == terms
                whole = np.flatnonzero(np.minimum.reduceat(here, begins))
                if not len(whole):
                    continue
                step = unplaned(cell("places").as_py(), np.uint32).astype(np.int64)
                top = np.cumsum(each.astype(np.int64))
                list_of = lambda t, top=top, each=each, step=step: np.cumsum(step[top[t] - each[t] : top[t]])
                lists: dict[int, np.ndarray] = {}
                hit = np.zeros(int(base[-1] + n[-1]) + 2, np.int32)  # +1 where a hit begins, -1 where it ends
                items: dict[int, set] = {}
                near: dict[int, set] = {}
                for w in whole.tolist():
                    own = known[begins[w] : ends[w]].tolist()
                    for t in own:
                        if t not in lists:
                            lists[t] = list_of(t)
                    exact, loose = places_of(w, [lists[t] for t in own])
                    if len(exact):
                        np.add.at(hit, exact, 1)
                        np.add.at(hit, exact + int(sizes[w]), -1)
                        for d in np.unique(np.searchsorted(base, exact, "right") - 1).tolist():
                            items.setdefault(d, set()).add(names[w])
                    for d in np.unique(np.searchsorted(base, loose, "right") - 1).tolist():
                        near.setdefault(d, set()).add(names[w])
                found = sorted(items.keys() | near.keys())
                if not found:
                    continue
                edges = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]]))
                on, off = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
                first = np.searchsorted(np.searchsorted(base, on, "right") - 1, np.arange(len(n) + 1))
                local = lambda x, d, first=first, base=base: x[first[d] : first[d + 1]] - base[d]
                cells = ([cell("block").as_py()] * len(found), found, [local(on, d) for d in found], [local(off, d) for d in found], [sorted(items.get(d, ())) for d in found], [sorted(near.get(d, ())) for d in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    out = "block long, ordinal int, starts array<int>, stops array<int>, items array<string>, near_items array<string>"
    return index.select("block", "n_words", "terms", "counts", "places").mapInArrow(run, out)


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", size: int = WINDOW, slop: int = 0, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: key, n_words, n_hit, starts and stops of its runs of hit words, items and near_items (sorted as strings).

    key is a column of integers or strings; it need not be unique. slop is less than GAP."""
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    kind = "bigint" if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    index = build_index(docs.select(F.col(key).cast(kind).alias(key), "text"), key)
    return found_in(index, packed_windows(index, windows(benchmark, size), limit), slop).withColumnRenamed("key", key)


def found_in(index: DataFrame, packed: DataFrame, slop: int = 0) -> DataFrame:
    """scan()'s columns, for an index and its packed windows; the driver holds one block of windows at a time."""
    rows = index.select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ordinal", "x")).select("block", "ordinal", F.col("x.ids").alias("key"), F.col("x.n_words").cast("long").alias("n_words"))
    none = "cast(array() as array<{}>)"
    found = None
    for r in packed.toLocalIterator():
        part = stored(search(index, (r["items"], r["sizes"], r["terms"], r["order"]), slop), "hits")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("key", "n_words", F.lit(0).cast("long").alias("n_hit"), *[F.expr(none.format("int")).alias(c) for c in ("starts", "stops")], *[F.expr(none.format("string")).alias(c) for c in ("items", "near_items")])
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    both = found.groupBy("block", "ordinal").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "stops")))).alias("runs"), together("items"), together("near_items"))
    # runs of several blocks may overlap: one begins where a start lies beyond all earlier stops
    both = both.withColumn("tops", running(F.col("runs.stops"), F.lit(-1), F.greatest))
    new = F.filter(F.transform("runs", lambda x, i: F.struct(x["starts"].alias("s"), F.when(i > 0, F.get("tops", i - 1)).otherwise(-1).alias("t"))), lambda x: x["s"] > x["t"])
    both = both.withColumn("new", new).select("block", "ordinal", "items", "near_items", F.col("new.s").alias("starts"), F.filter(F.concat(F.slice("new.t", 2, F.size("new")), F.array(F.array_max("tops"))), lambda x: x.isNotNull()).alias("stops"))
    out = rows.join(both, ["block", "ordinal"], "left")
    filled = [F.coalesce(c, F.expr(none.format(t))).alias(c) for c, t in (("starts", "int"), ("stops", "int"), ("items", "string"), ("near_items", "string"))]
    n_hit = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("key", "n_words", *filled).select("key", "n_words", n_hit.alias("n_hit"), "starts", "stops", "items", "near_items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns kept: texts with hits are told by their content, so that ids need not be unique."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws(":", *[m.cast("string") for m in (F.xxhash64(text), F.xxhash64(F.lit(1), text))])
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), key.alias("_key"), text.alias("text"))
    bad = stored(scan(keyed.select("_key", "text"), benchmark, "_key").where("n_hit > 0").select("_key").distinct(), "contaminated")
    return keyed.join(bad, "_key", "left_anti").select("_doc.*")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
