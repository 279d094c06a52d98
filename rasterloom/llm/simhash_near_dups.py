"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of all whole texts, grouped to distinct ones first, so exact copies cost one row. A fingerprint's 64 bits are a ring of four
segments. By the pigeonring principle two fingerprints that differ in at most 2 bits have a first segment from which every chain
of l consecutive segments differs in at most l * 2/4 bits: in none for the first segment, in at most one for the first two and the first
three, in at most two for all four. Such a chain has two whole segments that are equal: the first and the second, or, if the second takes
the one difference allowed, the first and the third. So a fingerprint has six keys, one for each pair of segments, of 32 bits each;
candidates() are the rows that share one. Fingerprints of a key are held against each other: the chains' budgets first, then the full
Hamming check.

A key of more than HOT fingerprints isn't compared pair by pair: its rows are dealt anew by the rest of their bits and by the rest with one
bit flipped. Two rows are within 2 bits just if they share such a finer key, and all that share one are within 2 bits of each other, so
each is linked to the least of them: true links only, linear in the rows, and no link between different fingerprints is lost to
reachability. Components come from repeated star contraction, with every round written to the shared folder.

Cases: a null text counts as an empty one; texts without words have fingerprint zero and are linked like any other; a very long text is
taken in slices; repeated rows get the same component; a null doc_id is never a component's id unless all of it are null; equal least ids
are told apart by the texts' hashes; an empty table gives an empty result; further columns are left out of near_dups() and kept by
representatives(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import clear_stored, mark, stored

DISTANCE, SHINGLE, SEED = 2, 3, 42
#: Segments of the ring, bits of each, fingerprints of a key that are still compared pair by pair.
SEGMENTS, BITS, HOT = 4, 16, 32


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (signed 64 bits) and, to tell texts apart, two more hashes of the text, of each row. Python over Arrow batches: bits are counted in numpy, a text at a time
    and a slice of a long text at a time, so memory does not grow with the text beyond the text itself."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
        hashed, powers, step = xxhash.xxh64_intdigest, np.uint64(1) << np.arange(64, dtype=np.uint64), 1 << 14

        def of(text: str | None) -> int:
            w = (text or "").encode().translate(low).split()
            if not w:
                return 0
            if len(w) < shingle:
                return int(np.uint64(hashed(b" ".join(w), SEED)).astype(np.int64))
            n, ones = len(w) - shingle + 1, np.zeros(64, np.int64)
            for a in range(0, n, step):
                part = w[a : a + step + shingle - 1]
                shingles = map(b" ".join, zip(*[part[k:] for k in range(shingle)], strict=False))
                h = np.array([hashed(x, SEED) for x in shingles], dtype="<u8")
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(powers[2 * ones > n].sum(dtype=np.uint64).astype(np.int64))

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(x.as_py()) for x in b.column(1)], pa.int64()), b.column(2), b.column(3)], ["doc_id", "fp", "k1", "k2"])

    text = F.col("text").cast("string")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    return some.mapInArrow(run, "doc_id long, fp long, k1 long, k2 long")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1))


def _mask(segments: list[int]) -> Column:
    m = sum(((1 << BITS) - 1) << BITS * k for k in segments)
    return F.lit(m - (1 << 64) if m >> 63 else m).cast("long")


_PAIRS = list(combinations(range(SEGMENTS), 2))


def candidates(fps: DataFrame) -> DataFrame:
    """(fp, key, n): of the distinct fingerprints' keys those that n > 1 of them have. A key is a pair of segments' number and values."""
    fp = F.col("fp")
    keys = [F.lit(i << 2 * BITS).bitwiseOR(F.shiftleft(_segment(fp, a), BITS)).bitwiseOR(_segment(fp, b)) for i, (a, b) in enumerate(_PAIRS)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes exploded rows to be as few as they were before, and so would broadcast far more than its limit without the hint
    return keyed.join(often.hint("merge"), "key").select("fp", "key", "n")


def chained(x: Column) -> Column:
    """Whether differing bits x keep the budgets of the chains of one to three segments from some first one on."""
    within = lambda i, n: F.bit_count(x.bitwiseAND(_mask([(i + k) % SEGMENTS for k in range(n)]))) <= n * DISTANCE // SEGMENTS
    out = F.lit(False)
    for i in range(SEGMENTS):
        out = out | (within(i, 1) & within(i, 2) & within(i, 3))
    return out


def _compared(cold: DataFrame) -> DataFrame:
    """True links of keys of few fingerprints."""
    near = lambda x, y: chained(x.bitwiseXOR(y)) & (F.bit_count(x.bitwiseXOR(y)) <= DISTANCE)
    lists = cold.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pair = lambda x, y: F.struct(y.alias("a"), x.alias("b"))
    pairs = F.flatten(F.transform("fps", lambda x, i: F.transform(F.filter(F.slice("fps", i + 2, F.size("fps")), lambda y: near(x, y)), lambda y: pair(x, y))))
    return lists.select(F.explode(pairs).alias("x")).select("x.a", "x.b")


def _dealt_anew(hot: DataFrame) -> DataFrame:
    """Star links of keys of many fingerprints, by the rest of their bits with at most one of them flipped."""
    rest = None
    for i, pair in enumerate(_PAIRS):
        free = [k for k in range(SEGMENTS) if k not in pair]
        value = F.shiftleft(_segment(F.col("fp"), free[0]), BITS).bitwiseOR(_segment(F.col("fp"), free[1]))
        is_it = F.shiftrightunsigned("key", 2 * BITS) == i
        rest = F.when(is_it, value) if rest is None else rest.when(is_it, value)
    flips = F.array(*[F.lit(x).cast("long") for x in (0, *[1 << b for b in range(2 * BITS)])])
    finer = hot.select("fp", "key", rest.alias("rest")).select("fp", "key", F.explode(F.transform(flips, lambda x: F.col("rest").bitwiseXOR(x))).alias("rest"))
    least = finer.groupBy("key", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "rest", "b")
    return finer.join(least.hint("merge"), ["key", "rest"]).where("fp > b").select(F.col("fp").alias("a"), "b")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), b < a, between distinct fingerprints of at most 2 differing bits; reachability is that of all such pairs."""
    found = stored(candidates(fps), "candidates")
    return _compared(found.where(F.col("n") <= HOT)).unionByName(_dealt_anew(found.where(F.col("n") > HOT))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with b the least node that a can reach, for each a that isn't that node itself. Edges (a, b) with b < a.

    Alternating large-star and small-star rounds; a round ends in a table in the shared folder, and the driver sees only its
    count and checksum. The joins are plain equi-joins with the least neighbour of each node, whose hot keys AQE can split."""

    def star(pairs: DataFrame, own: bool) -> DataFrame:
        # pairs (u, v): u's neighbours v; each is linked to the least of u and its neighbours
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = pairs.join(least, "u")
        far = out.where("v > u" if not own else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return (far.unionByName(least.where("u > m").select(F.col("u").alias("a"), F.col("m").alias("b"))) if own else far).where("a > b").distinct()

    edges, seen = stored(edges, "edges"), None
    while True:
        since = mark()
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = stored(star(both, False), "large")
        edges = stored(star(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), True), "small")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        clear_stored(edges.sparkSession, since - 1, keep=edges)  # this round's other table and the last one's edges
        if state == seen:
            return edges
        seen = state


def near_dups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable), root (the component's least fingerprint) and the text's hashes of each row."""
    marked = stored(fingerprints(docs), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    tree = components(links(fps))
    whole = fps.join(tree.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    known = whole.select("fp", "root").join(heads, "root").select("fp", "component_id", "root")
    return marked.join(known, "fp").select("doc_id", "fp", "component_id", "root", "k1", "k2")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that of the least doc_id (null last), of repeated ids that of the
    least text hashes, of repeated rows any one."""
    rows = near_dups(docs).groupBy("root", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    found = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2", "copies")).alias("x"))
    chosen = stored(found.select(F.col("x.doc_id").alias("d"), F.col("x.k1").alias("c1"), F.col("x.k2").alias("c2"), "x.copies"), "representatives")
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.col("doc_id").cast("long").alias("id"))
    own = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("id").eqNullSafe(F.col("d"))
    # both joins read one exchange of the texts; repeated rows become one a task before they are dealt again
    single = keyed.join(chosen.where("copies = 1"), own, "left_semi")
    several = keyed.join(chosen.where("copies > 1"), own, "left_semi").dropDuplicates(["k1", "k2", "id"])
    return single.unionByName(several).select("_doc.*")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
