"""What the operators share: tables kept in the cluster's shared folder, word rules, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word of the plain kind: [^\x20\x09-\x0D]+
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that end a word of the strict kind: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


#: Folders that stored() has made: (application, path).
_TABLES: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one is set in local mode; a
    cluster's executors couldn't read one, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='rasterloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, a lost executor costs no more than its tasks.
    Tables lie in a folder of the application, which is deleted at its end."""
    spark, app = df.sparkSession, df.sparkSession.sparkContext.applicationId
    own = f"{shared_dir(spark)}/rasterloom/{app}"
    at = f"{own}/{name}-{uuid.uuid4().hex}"
    if not any(a == app for a, _ in _TABLES):
        path, system = _path(spark, own)
        system.mkdirs(path)
        system.deleteOnExit(path)
    _TABLES.append((app, at))
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def mark() -> int:
    """A point in time for clear_stored()."""
    return len(_TABLES)


def clear_stored(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes this application's tables that stored() made since mark(), but for keep, itself one of them; no other result that reads them may be in use."""
    app = spark.sparkContext.applicationId
    for i, (a, at) in enumerate(_TABLES):
        if i >= since and a == app and at != getattr(keep, "stored_at", None):
            path, system = _path(spark, at)
            system.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being worked out once a row whatever Catalyst inlines."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step's results from the first value up to each one, step being associative and start its neutral element.

    Values are taken in runs of about the square root of their number, each run by itself and then from where the runs before it
    have come to: n to the power of 1.5 copies of an element, where appending to one array would make n squared."""

    def fold(of: Column) -> Column:
        first = F.struct(start.alias("p"), F.slice(F.array(start), 1, 0).alias("a"))
        put = lambda acc, x: let(step(acc["p"], x), lambda p: F.struct(p.alias("p"), F.concat(acc["a"], F.array(p)).alias("a")))
        return F.aggregate(of, first, put, lambda acc: acc["a"])

    def cut(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: fold(F.slice(v, k * size + 1, size)))
        return let(runs, joined)

    def joined(runs: Column) -> Column:
        before = fold(F.transform(runs, lambda r: F.element_at(r, -1)))
        return let(before, lambda b: F.flatten(F.transform(runs, lambda r, k: F.when(k == 0, r).otherwise(F.transform(r, lambda x: step(F.get(b, k - 1), x))))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.slice(F.array(start), 1, 0)).otherwise(cut(v)))


def match_starts(text: Column, pattern: str) -> Column:
    """Pairs (s, m): start, in code points, and text of each match of a pattern, leftmost and non-overlapping; patterns match no empty text."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(m: Column) -> Column:
        # a match begins where the gap before it ends: behind all earlier gaps and matches
        spans = let(gaps, lambda g: F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x)))
        ends = running(spans, F.lit(0), lambda a, b: a + b)
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("s"), x.alias("m")))

    none = F.expr("cast(array() as array<struct<s:int,m:string>>)")
    return F.when(text.rlike(pattern), let(matches, of)).otherwise(none)


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(flat, " "), "")


def strict_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased, none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.array_remove(F.split(flat, " "), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def least_hashed(rows: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """The max_rows distinct doc_ids of least seeded hash, with all columns of one of their rows.

    Rows are first cut at a hash that leaves little more than max_rows ids, so that no task sorts more than that at any size."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    n = rows.count()
    share = min(1.0, (max_rows + 8 * max_rows**0.5 + 64) / max(1, n))
    while True:
        some = rows if share >= 1 else rows.where(h <= F.lit(int(share * 2**64) - 2**63))
        some = some.dropDuplicates(["doc_id"])
        if share >= 1 or some.count() >= max_rows:
            return some.orderBy(h, "doc_id").limit(max_rows)
        share = min(1.0, 4 * share)


def labelled_sample(labels: DataFrame, label: str, max_rows: int, seed: int, keep: Column | None = None) -> DataFrame:
    """doc_id and label of at most max_rows labelled documents, those of the least seeded hash; several labels of one id: the largest."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.where(keep) if keep is not None else rows
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    return least_hashed(rows, max_rows, seed)
