"""Further queries: coding statistics, headers, planes, quality conventions and the tables of a measurement run."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import formulas as f
from rasterloom.operators import blocks, container, encoder, measurement, pixels, rasters, statistics
from rasterloom.plans import registry as r
from rasterloom.sources import webp

query, T, V, M = r.query, r.T, r.V, r.M


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("img"), F.col("p_size").cast("long").alias("sz"))


PART = "(SELECT CAST(p_partkey AS BIGINT) AS img, CAST(p_size AS BIGINT) AS sz FROM part)"

# errors ------------------------------------------------------------------------------------------------------------------------------

_COARSE = "(SELECT img, plane, x, y, CASE WHEN img % 10 = 0 THEN v ELSE (v >> 2) << 2 END AS v FROM s WHERE NOT (img % 7 = 0 AND x = 0 AND y = 0))"


@query(f"""WITH s AS (SELECT * FROM {r._YUV}), e AS (SELECT a.img, CAST(coalesce(sum((a.v - b.v) * (a.v - b.v)), 0) AS BIGINT) AS sse, count(b.v) AS n, count(*) - count(b.v) AS unmatched FROM s a LEFT JOIN {_COARSE} b USING (img, plane, x, y) GROUP BY a.img),
q AS (SELECT *, CASE WHEN sse > 0 THEN round(10 * log10(65025 / (sse / n)), 6) END AS db FROM e)
SELECT img, sse, n, unmatched, CASE WHEN unmatched = 0 THEN db END AS psnr, CASE WHEN unmatched > 0 THEN -1.0 ELSE coalesce(db, 99.0) END AS psnr_99, CASE WHEN unmatched = 0 THEN CASE WHEN sse > 0 THEN printf('%.2f', db) ELSE '-' END END AS told FROM q""")
def frame_quality(spark, sf_dir):
    own = pixels.yuv420(rasters.tiles(spark, sf_dir))
    coarse = own.where("NOT (img % 7 = 0 AND x = 0 AND y = 0)").withColumn("v", F.expr("CASE WHEN img % 10 = 0 THEN v ELSE shiftleft(shiftright(v, 2), 2) END"))
    return blocks.quality(blocks.frame_error(own, coarse))


@query(f"""WITH b AS ({r._pivot_sql(r._RES)}), h AS ({r._stages_sql('b', f.hadamard(blocks.C), f.transposed(f.hadamard(f.transposed(blocks.C))))})
SELECT img, CAST(sum({r._SATD}) AS BIGINT) AS satd, count(*) AS blocks FROM h GROUP BY img""")
def satd_grid(spark, sf_dir):
    own = rasters.vecs(spark, sf_dir)
    both = own.join(own.select("img", F.col("y").alias("x"), F.col("x").alias("y"), F.col("s").alias("t")), ["img", "x", "y"])
    return blocks.satd_grid(blocks.pivoted(both.select("img", "x", "y", (F.col("s") - F.col("t")).alias("s"))))


@query(f"WITH {r._REC} SELECT img, sse AS distortion, sad > 0 AS residual, 4 + img % 60 AS q, sad > 0 AND 8 * sse > (4 + img % 60) * (4 + img % 60) * 5 AS tried FROM er")
def sub_block_trials(spark, sf_dir):
    own = rasters.vecs(spark, sf_dir).withColumn("s", F.col("s") - 128)
    rec = blocks.unpivoted(blocks.inverse_dct(blocks.dequantize(blocks.quantize(blocks.forward_dct(blocks.pivoted(own)), 23, 31), 23, 31)))
    errors = blocks.squared_error(own, rec).select("img", F.col("sse").alias("distortion"), (F.col("sad") > 0).alias("residual"), F.expr("4 + img % 60").alias("q"))
    return statistics.sub_block_trial(errors, 5)


# token and coefficient statistics --------------------------------------------------------------------------------------------------------

_TOKENS = f"(SELECT img, CASE WHEN (x * 7 + y * 3 + img) % 5 = 0 AND img % 4 <> 0 THEN 'copy' WHEN (x + y) % 6 = 1 THEN 'slot' ELSE 'literal' END AS kind, r, g, b, a, 2 + g % 30 AS length, 1 + r * 4 + b AS distance, (r + g) % 16 AS slot FROM {T})"
_LENGTH, _DISTANCE = f.prefix_code("length", f.DUCK)[0], f.prefix_code("distance", f.DUCK)[0]
_HISTS = f"""tk AS (SELECT * FROM {_TOKENS}), sy AS (SELECT img, 'green' AS alphabet, CAST(CASE kind WHEN 'literal' THEN g WHEN 'copy' THEN 256 + {_LENGTH} ELSE 280 + slot END AS BIGINT) AS symbol FROM tk
  UNION ALL SELECT img, unnest(['red', 'blue', 'alpha']), unnest([r, b, a]) FROM tk WHERE kind = 'literal' UNION ALL SELECT img, 'distance', CAST({_DISTANCE} AS BIGINT) FROM tk WHERE kind = 'copy'),
th AS (SELECT img, alphabet, symbol, count(*) AS n FROM sy GROUP BY ALL UNION ALL SELECT i.img, al.alphabet, 0, 1 FROM (SELECT DISTINCT img FROM tk) i, (SELECT unnest(['green', 'red', 'blue', 'alpha', 'distance']) AS alphabet) al
  WHERE NOT EXISTS (SELECT 1 FROM sy WHERE sy.img = i.img AND sy.alphabet = al.alphabet))"""


def _tokens(spark, sf_dir, groups=None):
    kind = "CASE WHEN (x * 7 + y * 3 + img) % 5 = 0 AND img % 4 <> 0 THEN 'copy' WHEN (x + y) % 6 = 1 THEN 'slot' ELSE 'literal' END as kind"
    return rasters.tiles(spark, sf_dir, groups).selectExpr(*(groups or ()), "img", kind, "r", "g", "b", "a", "2 + g % 30 as length", "1 + r * 4 + b as distance", "(r + g) % 16 as slot")


@query(f"WITH {_HISTS} SELECT * FROM th")
def token_histograms(spark, sf_dir):
    return statistics.token_histograms(_tokens(spark, sf_dir))


@query(f"""WITH {_HISTS}, m AS (SELECT img // 10 AS grp, alphabet, symbol, sum(n) AS n FROM th GROUP BY ALL),
c AS (SELECT grp, alphabet, symbol, greatest(1, CAST(ceil(round(log2(sum(n) OVER (PARTITION BY grp, alphabet) / n), 9)) AS BIGINT)) AS bits FROM m)
SELECT grp, img, CAST(sum(n * bits) AS BIGINT) AS bits FROM th JOIN c ON c.grp = th.img // 10 AND c.alphabet = th.alphabet AND c.symbol = th.symbol GROUP BY grp, img""")
def code_costs(spark, sf_dir):
    tokens = _tokens(spark, sf_dir, {"grp": "img div 10"})
    return statistics.shared_costs(statistics.token_histograms(tokens, ("grp", "img")), ("grp",), ("grp", "img"))


_NODES = " UNION ALL ".join(f"SELECT grp, band, ctx, {n} AS node, CAST({one} AS BIGINT) AS one FROM pl WHERE {a}" for n, a, one in [(0, "(i = 0 OR p > 0) AND i <= last", "i < last"), *[(n, f"i < last AND {a}", one) for n, a, one in statistics.SIZE_NODES]])


@query(f"""WITH {r._BLOCK}, q AS ({r._stages_sql('b', *r._DCT, r._Q)}),
z AS (SELECT img % 9 AS grp, [{', '.join(f'c{k}' for k in f.ZIGZAG)}] AS levels, greatest({', '.join(f'CASE WHEN c{k} <> 0 THEN {i + 1} ELSE 0 END' for i, k in enumerate(f.ZIGZAG))}) AS last FROM q),
pl AS (SELECT grp, last, i, abs(levels[i + 1]) AS v, abs(levels[i]) AS p, {list(statistics.BANDS)}[i + 1] AS band, CASE WHEN i = 0 THEN 0 ELSE least(2, abs(levels[i])) END AS ctx FROM (SELECT *, unnest(range(16)) AS i FROM z)),
n AS ({_NODES}) SELECT grp, CAST(band AS BIGINT) AS band, CAST(ctx AS BIGINT) AS ctx, CAST(node AS BIGINT) AS node, count(*) AS total, CAST(sum(one) AS BIGINT) AS ones FROM n GROUP BY ALL""")
def coefficient_statistics(spark, sf_dir):
    scanned = blocks.scanned(blocks.quantize(blocks.forward_dct(r._centred(spark, sf_dir)), 23, 31))
    return statistics.coefficient_statistics(scanned.withColumn("grp", F.col("img") % 9), ("grp",))


_RATES = ", ".join(f"('{t}', '{m}', {[(p if not b else 255 - p) for p, b in way]})" for t, modes in statistics.MODE_TREES.items() for m, way in modes.items())


@query(f"""WITH {r._COSTS}, w AS (SELECT tree, mode, unnest(ps) AS p FROM (VALUES {_RATES}) x(tree, mode, ps)), rt AS (SELECT tree, mode, CAST(sum(cost) AS BIGINT) AS rate FROM w JOIN k USING (p) GROUP BY ALL),
u AS (SELECT 'luma' AS tree, ['sub-blocks', 'dc', 'vertical', 'horizontal', 'motion'][img * 7 % 5 + 1] AS mode FROM {PART} UNION ALL SELECT 'chroma', ['dc', 'vertical', 'horizontal', 'motion'][img * 3 % 4 + 1] FROM {PART})
SELECT tree, mode, count(*) AS n, CAST(sum(rate) AS BIGINT) AS bits256 FROM u JOIN rt USING (tree, mode) GROUP BY tree, mode""")
def mode_rates(spark, sf_dir):
    costs = [x.cost for x in encoder.bit_costs(spark).orderBy("p").collect()]
    rates = F.broadcast(spark.createDataFrame(statistics.mode_rates(costs), "tree string, mode string, rate long"))
    trees = [F.array(*map(F.lit, statistics.MODE_TREES[t])) for t in ("luma", "chroma")]
    pick = lambda t, k, i, n: F.struct(F.lit(t).alias("tree"), F.get(trees[i], (F.col("img") * k % n).cast("int")).alias("mode"))
    used = _part(spark, sf_dir).select(F.explode(F.array(pick("luma", 7, 0, 5), pick("chroma", 3, 1, 4))).alias("u")).select("u.*")
    return used.join(rates, ["tree", "mode"]).groupBy("tree", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum("rate").alias("bits256"))


_HEAD = {"base": "img % 128", "y1_dc": "img % 31 - 15", "y2_dc": "img % 29 - 14", "y2_ac": "img % 27 - 13", "uv_dc": "img % 25 - 12", "uv_ac": "img % 23 - 11", "segmented": "img % 3 > 0", "absolute": "img % 2 = 0"}
_AT = lambda t, d, top=127: f"CAST({list(t)}[greatest(0, least({top}, q + {d})) + 1] AS BIGINT)"


@query(f"""WITH h AS (SELECT img, {', '.join(f'{e} AS {n}' for n, e in _HEAD.items())} FROM {PART}), s AS (SELECT *, segment * 30 + img % 20 - CASE WHEN absolute THEN 0 ELSE 60 END AS own FROM h, (SELECT unnest(range(4)) AS segment)),
g AS (SELECT *, CASE WHEN NOT segmented THEN base WHEN absolute THEN own ELSE base + own END AS q FROM s)
SELECT img, segment, q, {_AT(f.DC_STEPS, 'y1_dc')} AS y1_dc_step, {_AT(f.AC_STEPS, '0')} AS y1_ac_step, 2 * {_AT(f.DC_STEPS, 'y2_dc')} AS y2_dc_step, greatest(8, ({_AT(f.AC_STEPS, 'y2_ac')} * 101581) >> 16) AS y2_ac_step,
  {_AT(f.DC_STEPS, 'uv_dc', 117)} AS uv_dc_step, {_AT(f.AC_STEPS, 'uv_ac')} AS uv_ac_step FROM g""")
def decoder_steps(spark, sf_dir):
    heads = _part(spark, sf_dir).selectExpr("img", *[f"{e} as {n}" for n, e in _HEAD.items()])
    segments = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda k: k * 30 + F.col("img") % 20 - F.when(F.col("absolute"), 0).otherwise(60))
    return statistics.decoder_steps(heads.withColumn("segments", segments))


# headers ---------------------------------------------------------------------------------------------------------------------------------

_SIZES = "img % 5 <> 1 AS riff, img % 11 <> 3 AS form, CASE img % 13 WHEN 5 THEN 8 WHEN 6 THEN 4294967290 ELSE 12 + (img * 37) % 5000 END AS size, CASE WHEN img % 17 = 2 THEN 4294967295 ELSE (img * 53) % 5200 END AS csize, (img * 101) % 6000 AS body, img % 19 = 4 AS cut"


@query(f"""WITH s AS (SELECT img, {_SIZES} FROM {PART}), l AS (SELECT *, CASE WHEN riff THEN 12 ELSE 0 END AS at_, CASE WHEN cut THEN 11 ELSE CASE WHEN riff THEN 12 ELSE 0 END + 12 + body END AS length FROM s),
c AS (SELECT *, CASE WHEN riff THEN size + 8 END AS riff_end, CASE WHEN length >= at_ + 8 THEN csize END AS chunk_size FROM l), e AS (SELECT *, at_ + 8 + chunk_size + chunk_size % 2 AS chunk_end FROM c)
SELECT img, riff AS is_riff, riff_end, CASE WHEN length >= at_ + 8 THEN 'VP8L' END AS chunk, chunk_size, chunk_end, CASE WHEN length < 12 THEN 'no header' WHEN riff AND NOT form THEN 'another form' WHEN riff AND NOT (size BETWEEN 12 AND 4294967286) THEN 'size out of bounds'
  WHEN length < at_ + 8 THEN 'no chunk' WHEN chunk_size > 4294967286 THEN 'chunk too large' WHEN chunk_end > riff_end THEN 'chunk beyond its container' END AS problem, coalesce(greatest(riff_end, chunk_end) > length, true) AS missing FROM e""")
def first_chunks(spark, sf_dir):
    """Files made with all kinds of sizes, read back."""
    own = _part(spark, sf_dir).selectExpr("img", *_SIZES.replace(" AS ", " as ").split(", "))
    own = own.withColumn("length", F.expr("CASE WHEN cut THEN 11 ELSE (CASE WHEN riff THEN 12 ELSE 0 END) + 12 + body END"))
    head = F.when(F.col("riff"), container.riff_header(F.col("size"), F.when(F.col("form"), container.tag("WEBP")).otherwise(container.tag("WAVE")))).otherwise(container.tag(""))
    content = F.concat(head, container.tag("VP8L"), container.le(F.col("csize"), 4), F.lit(bytearray(4)))
    made = own.select("img", "length", F.substring(content, F.lit(1), F.col("length").cast("int")).alias("content"))
    return container.with_first_chunk(made).drop("content", "length")


_FRAME = "img % 16384 AS w, (img * 7 + img % 5) % 16384 AS h, CAST(img % 10 = 0 AS INTEGER) + 2 * (img % 5) + 16 * CAST(img % 7 <> 0 AS INTEGER) + 32 * (img % 900) AS bits, 400 + img % 300 AS size, img % 3 <> 0 AS same"


@query(f"""WITH s AS (SELECT img, {_FRAME} FROM {PART}) SELECT img, w AS width, h AS height, img % 10 <> 0 AND img % 5 <= 3 AND img % 7 <> 0 AND img % 900 < size AND w > 0 AND h > 0 AS valid,
  same AS on_canvas, CASE WHEN img % 2 = 0 THEN 'nycbcra' ELSE 'ycbcr' END AS model FROM s""")
def lossy_headers(spark, sf_dir):
    """Frames and canvases made and read back. A canvas has at least one pixel a side, so a frame without any is on one of side 1."""
    own = _part(spark, sf_dir).selectExpr("img", *[x.replace("INTEGER", "int") for x in _FRAME.split(", ")])
    made = own.select("img", "size", container.lossy_header(F.col("w"), F.col("h"), F.col("bits")).alias("vp8"), container.vp8x_payload(16 * (1 - F.col("img") % 2), F.greatest(F.col("w"), F.lit(1)) + 1 - F.col("same").cast("int"), F.greatest(F.col("h"), F.lit(1))).alias("vp8x"))
    rows = made.select("img", *container.read_lossy(F.col("vp8"), F.col("size")), *container.read_vp8x(F.col("vp8x")))
    model = container.colour_model(F.lit("lossy"), F.col("flags").bitwiseAND(F.lit(webp.ALPHA)) != 0, F.lit(False))
    return rows.select("img", "width", "height", "valid", ((F.col("canvas_width") == F.greatest("width", F.lit(1))) & (F.col("canvas_height") == F.greatest("height", F.lit(1)))).alias("on_canvas"), model.alias("model"))


_ANMF = {"fx": "img % 40", "fy": "(img * 3) % 30", "w": "1 + (img * 7) % 200", "h": "1 + (img * 11) % 150", "duration": "(img * 13) % 5000", "flags": "CASE WHEN img % 9 = 0 THEN 4 ELSE 0 END + img % 4"}


@query(f"""WITH s AS (SELECT img, {', '.join(f'{e} AS {n}' for n, e in _ANMF.items())} FROM {PART})
SELECT img, 2 * fx AS x, 2 * fy AS y, w AS width, h AS height, duration, img % 4 < 2 AS blend, img % 2 = 1 AS dispose, 2 * fx + w <= 240 AND 2 * fy + h <= 180 AND img % 9 <> 0 AS valid FROM s""")
def animation_frame_headers(spark, sf_dir):
    own = _part(spark, sf_dir).selectExpr("img", *[f"{e} as {n}" for n, e in _ANMF.items()])
    made = own.select("img", container.anmf_payload(*[F.col(c) for c in _ANMF]).alias("p"))
    return made.select("img", *container.read_anmf(F.col("p"), F.lit(240), F.lit(180)))


# planes ----------------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT img, px AS x, py AS y, s FROM (SELECT img, px, py, least(7, px) AS x, least(7, py) AS y FROM (SELECT DISTINCT img FROM {V}), (SELECT unnest(range(16)) AS px), (SELECT o.py, 1 AS one FROM (SELECT unnest(range(16)) AS py) o)) JOIN {V} v USING (img, x, y)")
def padded_planes(spark, sf_dir):
    return pixels.padded(rasters.vecs(spark, sf_dir), 16, 16)


@query(f"""WITH s AS (SELECT * FROM {r._YUV}), c AS (SELECT img, plane, x, y, CAST(CASE plane WHEN 'y' THEN {f.range_map('v', f.LUMA_LIMITED, f.LUMA_FULL, f.DUCK)} ELSE {f.range_map('v', f.CHROMA_LIMITED, f.CHROMA_FULL, f.DUCK)} END AS BIGINT) AS v FROM s)
SELECT img, plane, count(*) AS n, CAST(sum(v * (x + 17 * y + 1)) AS BIGINT) AS mark FROM c GROUP BY img, plane""")
def full_range_planes(spark, sf_dir):
    full = pixels.converted(pixels.converted(pixels.yuv420(rasters.tiles(spark, sf_dir)), "limited", "full"), "full", "full")
    return full.groupBy("img", "plane").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(v * (x + 17 * y + 1))").alias("mark"))


_PLANE = "CASE img % 4 WHEN 0 THEN '444' ELSE '420' END AS ratio, img % 6 AS min_x, img % 10 AS min_y, img % 7 <> 0 AS opaque, 1 + img % 500 AS w, 1 + sz AS h, img % 500 + img % 3 AS stride, (img % 500 + 1) * (sz + 1) - img % 40 AS length"


@query(f"WITH s AS (SELECT img, {_PLANE} FROM {PART}) SELECT img, ratio = '420' AND min_x % 2 = 0 AND min_y % 2 = 0 AND opaque AS planar, stride >= w AND length >= (h - 1) * stride + w AS fits FROM s")
def planar_images(spark, sf_dir):
    own = _part(spark, sf_dir).selectExpr("img", *_PLANE.split(", "))
    return own.select("img", pixels.planar().alias("planar"), statistics.fits(*[F.col(c) for c in ("length", "stride", "w", "h")]).alias("fits"))


# measurement runs ----------------------------------------------------------------------------------------------------------------------------

_WHOLE = f"(SELECT machine, engine, mode, file, effort, bytes, CAST(floor(ms) AS BIGINT) AS ms FROM {M} WHERE bytes > 0)"


@query(f"""WITH w AS (SELECT * FROM {_WHOLE}), o AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY mode, engine, file, effort) AS n FROM w)
SELECT machine AS path, 4 + n AS n, 'Machine ' || machine AS heading, engine, 'sweep-' || mode AS mode, file, effort, bytes, CAST(40.5 AS DOUBLE) AS psnr, CAST(ms AS DOUBLE) AS ms, CAST(NULL AS DOUBLE) AS mib_per_mp FROM o""")
def result_tables(spark, sf_dir):
    """Measurements written as result files, a file a machine, and read back: every second line by blanks, columns in both orders."""
    from pyspark.sql import Window

    rows = rasters.measurements(spark, sf_dir).where("bytes > 0").withColumn("ms", F.floor("ms"))
    n = F.row_number().over(Window.partitionBy("machine").orderBy("mode", "engine", "file", "effort"))
    by_engine = F.concat_ws(" ", "engine", "mode", "effort", "file", F.lit("1"), F.lit("1"), "bytes", F.lit("40.5"), F.lit("1"), "ms")
    by_file = F.concat_ws(", ", "file", "mode", "engine", "effort", F.lit("1"), F.lit("1"), "bytes", F.lit("40.5"), F.lit("1"), "ms")
    body = rows.select(F.col("machine").alias("path"), (n + 4).cast("long").alias("n"), F.when(n % 2 == 0, by_engine).otherwise(by_file).alias("line"))
    last = body.groupBy("path").agg((F.max("n") + 1).alias("n"))
    head = last.select("path", F.posexplode(F.array(F.lit("# Results"), F.concat(F.lit("## Machine "), F.col("path")), F.lit("Effort sweep"), F.lit("```"))).alias("n", "line")).select("path", (F.col("n") + 1).cast("long").alias("n"), "line")
    lines = head.unionByName(body).unionByName(last.select("path", "n", F.lit("```").alias("line")))
    return measurement.parsed(lines)


@query(f"SELECT row_number() OVER (ORDER BY engine, mode, file, effort, machine, bytes) AS n, concat_ws(',', engine, mode, file, effort, machine, bytes) AS line FROM {_WHOLE}")
def aligned_results(spark, sf_dir):
    return measurement.aligned(rasters.measurements(spark, sf_dir).where("bytes > 0"), ("engine", "mode", "file", "effort", "machine", "bytes"))


@query(f"SELECT machine, file, row_number() OVER (PARTITION BY machine ORDER BY file) AS n FROM (SELECT DISTINCT machine, file FROM {M})")
def measured_files(spark, sf_dir):
    return measurement.files(rasters.measurements(spark, sf_dir))


_KNOBS = [("one", "lossless", 0, 6), ("one", "lossy", 0, 9), ("two", "lossless", 0, 9), ("two", "lossy", 0, 6), ("three", "lossy", 2, 4)]


@query(f"SELECT p_name || p_partkey AS file, engine, mode, unnest(range(low, high + 1)) AS effort FROM part, (VALUES {', '.join(map(str, _KNOBS))}) k(engine, mode, low, high) WHERE engine IN ('one', 'three')")
def run_cases(spark, sf_dir):
    images = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("file"))
    return measurement.cases(images, _KNOBS, ("one", "three"))


@query(f"""WITH e AS (SELECT machine, engine, min(ms) AS low, max(ms) AS high FROM {M} WHERE ms > 0 GROUP BY ALL), t AS (SELECT *, round(power(10.0::DOUBLE, p) * s, 9) AS tick FROM e, (SELECT unnest(range(-1, 8)) AS p) a, (SELECT unnest([1, 2, 5]) AS s) b)
SELECT machine, engine, tick FROM t WHERE tick >= low - 1e-9 AND tick <= high + 1e-9""")
def axis_ticks(spark, sf_dir):
    e = rasters.measurements(spark, sf_dir).where("ms > 0").groupBy("machine", "engine").agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    return measurement.ticks(e, ("machine", "engine"))


@query(f"SELECT img, round(greatest(0, (peak - base) / 1024.0::DOUBLE) / (w * h / 1e6::DOUBLE), 6) AS mib_per_mp FROM (SELECT img, sz * 4000 AS peak, 20000 + img % 9000 AS base, 100 + img % 3000 AS w, 100 + sz * 50 AS h FROM {PART})")
def memory_by_size(spark, sf_dir):
    own = _part(spark, sf_dir).selectExpr("img", "sz * 4000 as peak", "20000 + img % 9000 as base", "100 + img % 3000 as w", "100 + sz * 50 as h")
    return own.select("img", measurement.mib_per_megapixel(F.col("peak"), F.col("base"), F.col("w"), F.col("h")).alias("mib_per_mp"))
