"""LM scoring: stupid backoff over the corpus's own n-gram counts, joined by hash.

Three relations, each row of which carries packed arrays instead of single n-grams:

* blocks: some documents' words as numbers into the block's own word list, stored once;
* n-grams (part, block, hashes, counts): each block's distinct n-grams of all orders, cut by the leading bits of their 64-bit hash
  into parts, so that a frequent n-gram is one entry a block and no part grows with it;
* counts (block, part, totals): one group a part adds up its blocks' counts and gives each block its totals back.

The parts are sent and added up in PASSES passes, each of which ends in a table of totals in the shared folder, so that the n-grams of
one pass only are on disk at a time. The totals are joined to their block, where n-grams are exploded again, scored and summed per
document. The number of parts follows the corpus, so that a part holds about PART_NGRAMS entries at every size; empty cuts aren't sent.
All counts cover all documents.

S(w | context) is c(context w) / c(context) if the n-gram's count is at least MIN_COUNT, else BACKOFF times S with the first word of the
context left out; the last resort is c(w) / words of the corpus. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are
lower-cased; at its start a document has as much context as there is.

Cases: null and empty texts have no words, score 0 and a null mean; repeated rows are scored alike (and count as often as they are there);
an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import stored
from rasterloom.llm.decontamination import words_of

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Words of a block, a longer text being a block of its own; entries of a part, aimed at.
BLOCK_WORDS, PART_NGRAMS = 1_000_000, 2_000_000
#: Passes over the blocks, each sending its share of the parts.
PASSES = 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that leading bits are even."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def ngrams(vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n from 1 to order, the hash of the n-gram that ends at each word; n-grams that would begin before their document are 0."""
    h = _mixed(vocabulary + _A)[tokens]
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = [h]
    for n in range(2, order + 1):
        longer = np.zeros(len(h), np.uint64)
        longer[1:] = _mixed(out[-1][:-1] * _A + h[1:] + np.uint64(n))
        longer[place < n - 1] = 0
        out.append(longer)
    return out


def planed(x: np.ndarray) -> bytes:
    """An array's bytes, all lowest ones first, then the next: high bytes of small or sorted numbers repeat, and compress to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def blocks_of(docs: DataFrame) -> DataFrame:
    """Stored blocks; once written their rows stay as they are whatever is lost."""

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        import xxhash

        schema = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("tokens", pa.binary())])

        def row(ids: list, lengths: list, number: dict, tokens: list) -> pa.RecordBatch:
            v = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            cells = (uuid.uuid4().hex, ids, lengths, v.tobytes(), planed(np.concatenate(tokens)))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

        ids, lengths, number, tokens, total = [], [], {}, [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words_of(text.as_py())
                ids.append(i)
                lengths.append(len(w))
                tokens.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int32, len(w)))
                total += len(w) + 1
                if total >= BLOCK_WORDS:
                    yield row(ids, lengths, number, tokens)
                    ids, lengths, number, tokens, total = [], [], {}, [], 0
        if ids:
            yield row(ids, lengths, number, tokens)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(some.mapInArrow(run, "block string, ids array<long>, n_words array<int>, vocabulary binary, tokens binary"), "lm_blocks")


def _arrays(batch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, tokens and document lengths of a block."""
    cell = lambda n: batch.column(batch.schema.get_field_index(n))[r]
    lengths = cell("n_words").values.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(cell("vocabulary").as_buffer(), np.uint64), unplaned(cell("tokens").as_buffer(), np.int32), lengths


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all orders, ascending by hash, and their counts."""
    all_ = np.concatenate(grams)
    return np.unique(all_[all_ != 0], return_counts=True)


def _keys(grams: list[np.ndarray]) -> np.ndarray:
    """The distinct n-grams alone. They are sorted in place, as copies of a block's n-grams are what a worker's memory is made of."""
    all_ = np.concatenate(grams)
    all_.sort()
    first = np.empty(len(all_), bool)
    first[:1] = True
    np.not_equal(all_[1:], all_[:-1], out=first[1:])
    first &= all_ != 0
    return all_[first]


def _freed(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the driver collects what refers to them; without this a pass's files may outlast the next pass."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, part_ngrams: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_backoff (words whose longest n-gram was too rare), log_score (natural, the sum) and mean_log_score."""
    part_ngrams = part_ngrams or PART_NGRAMS
    blocks = blocks_of(docs)
    total = blocks.select(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first().n or 0
    bits = max(1, int(np.ceil(np.log2(max(2, total * order / part_ngrams)))))

    def send(turn: int):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for r in range(b.num_rows):
                    block = b.column(b.schema.get_field_index("block"))[r].as_py()
                    keys, counts = _distinct([g[(g >> np.uint64(64 - bits)) % np.uint64(PASSES) == turn] for g in ngrams(*_arrays(b, r), order)])
                    if not len(keys):
                        continue
                    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    which, first = np.unique(part, return_index=True)
                    ends = np.append(first[1:], len(keys))
                    spans = list(zip(first.tolist(), ends.tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which, pa.int64()), pa.array([block] * len(which)), pa.array([planed(keys[a:e]) for a, e in spans], pa.binary()), pa.array([planed(counts[a:e].astype(np.uint32)) for a, e in spans], pa.binary())],
                        ["part", "block", "hashes", "counts"],
                    )

        return run

    def add(table):
        import pyarrow as pa

        hashes = [unplaned(x, np.uint64) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([unplaned(x, np.uint32) for x in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(at, weights=counts).astype(np.uint64)[at]
        ends = np.cumsum([len(x) for x in hashes])
        kind = np.uint32 if sums.max(initial=0) < 1 << 32 else np.uint64
        return pa.table({"block": table.column("block"), "part": table.column("part"), "wide": pa.array([kind is np.uint64] * len(hashes)), "totals": pa.array([planed(s.astype(kind)) for s in np.split(sums, ends[:-1])], pa.binary())})

    def summed(own, given):
        import pyarrow as pa

        out = {"doc_id": [], "n_words": [], "n_backoff": [], "log_score": []}
        for b in own.to_batches():
            for r in range(b.num_rows):
                v, tokens, lengths = _arrays(b, r)
                grams = ngrams(v, tokens, lengths, order)
                keys = _keys(grams)
                order_of = sorted(range(given.num_rows), key=given.column("part").to_pylist().__getitem__)
                wide, raw = given.column("wide").to_pylist(), given.column("totals")
                totals = np.concatenate([unplaned(raw[i].as_buffer(), np.uint64 if wide[i] else np.uint32) for i in order_of]) if order_of else np.zeros(0)

                def counted(n: int, grams=grams, keys=keys, totals=totals) -> np.ndarray:
                    """The counts of the n-grams that end at each word; the n-grams themselves are done with."""
                    g, grams[n - 1] = grams[n - 1], None
                    if not len(keys):
                        return np.zeros(0)
                    at = np.searchsorted(keys, g)
                    np.minimum(at, len(keys) - 1, out=at)
                    found = totals[at].astype(np.float64)
                    found[g == 0] = 0
                    return found

                place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                shorter = counted(1)
                best = np.log(shorter) - np.log(total) if len(tokens) else np.zeros(0)
                backed = np.zeros(len(tokens), bool)
                for n in range(2, order + 1):
                    have, count = place >= n - 1, counted(n)
                    found = have & (count >= min_count)
                    context = np.append(1.0, shorter[:-1]) if len(tokens) else np.zeros(0)
                    longer = np.log(np.maximum(count, 1)) - np.log(np.maximum(context, 1))
                    best = np.where(found, longer, np.where(have, best + np.log(backoff), best))
                    backed = np.where(have, ~found, backed)
                    shorter = count
                at = np.concatenate([[0], np.cumsum(lengths)])
                out["doc_id"] += b.column(b.schema.get_field_index("ids"))[r].as_py()
                out["n_words"] += lengths.tolist()
                out["n_backoff"] += np.diff(np.concatenate([[0], np.cumsum(backed)])[at]).tolist()
                out["log_score"] += [float(best[a:e].sum()) for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_backoff": pa.array(out["n_backoff"], pa.int64()), "log_score": pa.array(out["log_score"], pa.float64())})

    def added(turn: int) -> DataFrame:
        sent = blocks.drop("ids").mapInArrow(send(turn), "part long, block string, hashes binary, counts binary")
        out = stored(sent.groupBy("part").applyInArrow(add, "block string, part long, wide boolean, totals binary"), "lm_totals")
        del sent
        _freed(docs.sparkSession)
        return out

    totals = reduce(DataFrame.unionByName, [added(turn) for turn in range(PASSES)])
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(summed, "doc_id long, n_words long, n_backoff long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
