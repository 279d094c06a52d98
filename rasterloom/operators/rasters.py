"""Rasters worked out from the tables of a folder: deterministic, the same in Spark and in SQL.

There are no images among the tables, so pixels, samples, frames and measurements are derived from rows by formulas.
Everything is BIGINT. Images are generated within their row's partition: no shuffle stands before the first operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = ("img", "x", "y", "r", "g", "b", "a")

TILES_SQL = """SELECT img, x, y, CASE WHEN img % 2 = 0 THEN (l + img % 5) & 255 ELSE (x * 17) & 255 END AS r, l AS g,
    CASE WHEN img % 3 = 0 THEN (y * 17) & 255 ELSE (l + 3) & 255 END AS b, CAST(255 AS BIGINT) AS a
  FROM (SELECT img, x, y, (x * x * (1 + img % 3) + y * y * sz + x * y) & 255 AS l
    FROM (SELECT CAST(p_partkey AS BIGINT) AS img, CAST(p_size AS BIGINT) AS sz, pos & 15 AS x, pos >> 4 AS y FROM part, (SELECT unnest(range(256)) AS pos)))"""
VECS_SQL = """SELECT img, pos % 8 AS x, pos // 8 AS y, CAST(floor((greatest(-1, least(1, v)) + 1) * 127.5) AS BIGINT) AS s
  FROM (SELECT CAST(vec_id AS BIGINT) AS img, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)"""
RGBA4_SQL = f"""SELECT img, p % 4 AS x, p // 4 AS y, max(CASE WHEN c = 0 THEN s END) AS r, max(CASE WHEN c = 1 THEN s END) AS g, max(CASE WHEN c = 2 THEN s END) AS b, max(CASE WHEN c = 3 THEN s END) AS a
  FROM (SELECT img, s, (y * 8 + x) // 4 AS p, (y * 8 + x) % 4 AS c FROM ({VECS_SQL})) GROUP BY ALL"""
MEAS_SQL = """SELECT 'm' || CAST(l_partkey % 2 AS VARCHAR) AS machine, l_returnflag AS engine, l_linestatus AS mode, CAST(l_suppkey % 23 AS VARCHAR) AS file, CAST(l_linenumber AS BIGINT) AS effort,
    CAST(max(CASE WHEN l_quantity > 10 THEN l_quantity * 100 END) AS BIGINT) AS bytes, max(l_extendedprice) AS ms, max(CASE WHEN l_discount > 0.02 THEN l_discount * 100 END) AS psnr
  FROM lineitem GROUP BY ALL"""
FRAMES_SQL = """SELECT anim, k, event_id % 8 AS x0, event_id % 5 AS y0, 2 + event_id % 7 AS w, 2 + event_id % 6 AS h, (event_id * 7919) % 256 AS v, event_id % 3 = 0 AS dispose
  FROM (SELECT CAST(user_id AS BIGINT) AS anim, CAST(event_id AS BIGINT) AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_image(rows: DataFrame, by: tuple[str, ...] = ("img",)) -> DataFrame:
    """Rows of images dealt out by image, or by a group of images, before their pixels are made: pixels then lie by it, and no window or
    aggregate over it shuffles them again. A number is given, as one left open would be cut to the size of these few rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by)


def tiles(spark: SparkSession, sf_dir: str, groups: dict[str, str] | None = None) -> DataFrame:
    """A 16 x 16 RGB image, one macroblock, for each part. With groups, further columns by formulas over img, images are dealt out by these."""
    more = tuple(groups or ())
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("img"), F.col("p_size").cast("long").alias("sz"))
    part = by_image(part.select("*", *[F.expr(e).alias(n) for n, e in (groups or {}).items()]), more or ("img",))
    at = part.select(*more, "img", "sz", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("pos"))
    at = at.select(*more, "img", "sz", F.expr("pos & 15").alias("x"), F.expr("shiftright(pos, 4)").alias("y"))
    at = at.select(*more, "img", "x", "y", F.expr("(x * x * (1 + img % 3) + y * y * sz + x * y) & 255").alias("l"))
    return at.select(
        *more, "img", "x", "y",
        F.expr("CASE WHEN img % 2 = 0 THEN (l + img % 5) & 255 ELSE (x * 17) & 255 END").alias("r"),
        F.col("l").alias("g"),
        F.expr("CASE WHEN img % 3 = 0 THEN (y * 17) & 255 ELSE (l + 3) & 255 END").alias("b"),
        F.lit(255).cast("long").alias("a"),
    )


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 plane of samples for each embedding."""
    rows = by_image(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("img"), "embedding"))
    rows = rows.select("img", F.posexplode("embedding").alias("pos", "v"))
    s = F.expr("cast(floor((greatest(-1, least(1, cast(v as double))) + 1) * 127.5) as bigint)")
    return rows.select("img", F.expr("cast(pos % 8 as bigint)").alias("x"), F.expr("cast(pos div 8 as bigint)").alias("y"), s.alias("s"))


def rgba4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 RGBA image for each embedding, built within its row."""
    rows = by_image(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("img"), F.col("embedding").alias("e")))
    rows = rows.select("img", "e", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    at = lambda c: F.expr(f"cast(floor((greatest(-1, least(1, cast(get(e, p * 4 + {c}) as double))) + 1) * 127.5) as bigint)")
    return rows.select("img", F.expr("cast(p % 4 as bigint)").alias("x"), F.expr("cast(p div 4 as bigint)").alias("y"), *[at(c).alias(n) for c, n in enumerate("rgba")])


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec measurements: a row per machine, engine, mode, file and effort."""
    rows = _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_partkey") % 2).cast("string")).alias("machine"),
        F.col("l_returnflag").alias("engine"),
        F.col("l_linestatus").alias("mode"),
        (F.col("l_suppkey") % 23).cast("string").alias("file"),
        F.col("l_linenumber").cast("long").alias("effort"),
        "l_quantity", "l_extendedprice", "l_discount",
    )
    return rows.groupBy("machine", "engine", "mode", "file", "effort").agg(
        F.max(F.when(F.col("l_quantity") > 10, F.col("l_quantity") * 100)).cast("long").alias("bytes"),
        F.max("l_extendedprice").alias("ms"),
        F.max(F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 100)).alias("psnr"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An opaque frame for each event of a user: a rectangle in one value on a 16 x 12 canvas, and whether it is disposed of."""
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("anim"), F.col("event_id").cast("long").alias("event_id"), "ts")
    k = F.row_number().over(Window.partitionBy("anim").orderBy("ts", "event_id")).cast("long") - 1
    rows = rows.withColumn("k", k)
    return rows.selectExpr("anim", "k", "event_id % 8 as x0", "event_id % 5 as y0", "2 + event_id % 7 as w", "2 + event_id % 6 as h", "(event_id * 7919) % 256 as v", "event_id % 3 = 0 as dispose")
