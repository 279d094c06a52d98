"""Queries of the image-coding and measurement operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import formulas as f
from rasterloom.operators import animation, blocks, container, encoder, measurement, pixels, prediction, rasters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "plan_choice"

T, V, R4, M, FR = (f"({s})" for s in (rasters.TILES_SQL, rasters.VECS_SQL, rasters.RGBA4_SQL, rasters.MEAS_SQL, rasters.FRAMES_SQL))
HIST = "SELECT {k}, channel, value, count(*) AS n FROM (SELECT {k}, unnest(['a', 'r', 'g', 'b']) AS channel, unnest([a, r, g, b]) AS value FROM {src}) GROUP BY ALL"
BITS = "round(sum(n) * log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))), 6)"


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


# entropy and transform plans ---------------------------------------------------------------------------------------------------

_PLANS = f"""plans AS (SELECT img, 'raw' AS plan, 0 AS ord, a, r, g, b FROM {T} UNION ALL SELECT img, 'subgreen', 1, a, (r - g) & 255, g, (b - g) & 255 FROM {T}),
hist AS ({HIST.format(k="img, plan, ord", src="plans")}),
ent AS (SELECT img, plan, ord, channel, {BITS} AS bits FROM hist GROUP BY ALL),
moved AS (SELECT img FROM {T} GROUP BY img HAVING max(g) > 0),
scores AS (SELECT img, plan, ord, CAST(floor(round(sum(bits), 5) / 8) AS BIGINT) + ord AS score FROM ent WHERE ord = 0 OR img IN (SELECT img FROM moved) GROUP BY img, plan, ord)"""


@query(f"WITH {_PLANS}, best AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score, ord) AS k FROM scores) SELECT plan, count(*) AS images, CAST(sum(score) AS BIGINT) AS total FROM best WHERE k = 1 GROUP BY plan")
def plan_choice(spark, sf_dir):
    best = pixels.plan_scores(rasters.tiles(spark, sf_dir)).groupBy("img").agg(F.min(F.struct("score", "ord", "plan")).alias("m"))
    return best.groupBy("m.plan").agg(F.count(F.lit(1)).alias("images"), F.sum("m.score").alias("total"))


@query(f"""WITH {_PLANS}, r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score, ord) AS rank, min(score) OVER (PARTITION BY img) AS best FROM scores)
SELECT img, plan, ord, score, rank, NOT (rank > 1 AND score * 100 >= best * 101) AS tried FROM r WHERE rank <= 2""")
def plan_shortlist(spark, sf_dir):
    return pixels.shortlist(pixels.plan_scores(rasters.tiles(spark, sf_dir)), 2, 101)


@query(HIST.format(k="img % 7 AS grp", src=T).replace("SELECT img % 7 AS grp, channel, value, count", "SELECT grp, channel, value, count"))
def channel_histogram(spark, sf_dir):
    return pixels.histogram(rasters.tiles(spark, sf_dir).withColumn("grp", F.col("img") % 7), ("grp",))


@query(f"WITH hist AS ({HIST.format(k='img', src=T)}) SELECT img, channel, {BITS} AS bits FROM hist GROUP BY img, channel")
def channel_entropy(spark, sf_dir):
    return pixels.channel_entropy(rasters.tiles(spark, sf_dir))


@query(f"""WITH h AS ({HIST.format(k="grp, img", src=f"(SELECT img // 10 AS grp, * FROM {T})")}),
one AS (SELECT grp, img, channel, {BITS} AS bits FROM h GROUP BY ALL), apart AS (SELECT grp, round(sum(bits), 6) AS apart FROM one GROUP BY grp),
m AS (SELECT grp, channel, value, sum(n) AS n FROM h GROUP BY ALL), c AS (SELECT grp, channel, {BITS} AS bits FROM m GROUP BY ALL), both_ AS (SELECT grp, round(sum(bits), 6) AS together FROM c GROUP BY grp)
SELECT grp, apart, together FROM apart JOIN both_ USING (grp)""")
def combined_entropy(spark, sf_dir):
    return pixels.combined_entropy(rasters.tiles(spark, sf_dir).withColumn("grp", F.expr("img div 10")), ("img",), ("grp",))


# colour ------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT x, y, CAST(sum((r - g) & 255) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum((b - g) & 255) AS BIGINT) AS b FROM {T} GROUP BY x, y")
def subtract_green(spark, sf_dir):
    return pixels.subtract_green(rasters.tiles(spark, sf_dir)).groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in "rgb"])


@query(f"SELECT img, count(*) AS n, CAST(0 AS BIGINT) AS changed FROM {T} GROUP BY img")
def green_round_trip(spark, sf_dir):
    own = rasters.tiles(spark, sf_dir)
    back = pixels.add_green(pixels.subtract_green(own.withColumns({"r0": F.col("r"), "b0": F.col("b")})))
    return back.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when((F.col("r") != F.col("r0")) | (F.col("b") != F.col("b0")), 1).otherwise(0)).alias("changed"))


@query(f"""SELECT img, max(x) + 1 AS width, max(y) + 1 AS height, count(*) = (max(x) + 1) * (max(y) + 1) AS complete, bool_or(a <> 255) AS has_alpha, bool_and(a = 255) AS opaque,
min({f.packed()}) AS least_argb, max({f.packed()}) AS greatest_argb FROM {R4} GROUP BY img""")
def pixel_validation(spark, sf_dir):
    return pixels.validated(rasters.rgba4(spark, sf_dir))


@query(f"""WITH p AS (SELECT img, {f.packed()} AS argb FROM {R4})
SELECT img, CAST(sum({f.channel("argb", 24)}) AS BIGINT) AS a, CAST(sum({f.channel("argb", 16)}) AS BIGINT) AS r, CAST(sum({f.channel("argb", 8)}) AS BIGINT) AS g, CAST(sum({f.channel("argb", 0)}) AS BIGINT) AS b, CAST(sum(((argb * 506832829) & 4294967295) >> 24) AS BIGINT) AS cache_slots FROM p GROUP BY img""")
def packed_channels(spark, sf_dir):
    p = rasters.rgba4(spark, sf_dir).select("img", F.expr(f.packed()).alias("argb"))
    slot = F.expr("((argb * 506832829) & 4294967295) >> 24").alias("s")
    return p.select("img", *[F.expr(f.channel("argb", s)).alias(c) for c, s in zip("argb", (24, 16, 8, 0), strict=True)], slot).groupBy("img").agg(*[F.sum(c).alias(c) for c in "argb"], F.sum("s").alias("cache_slots"))


_QUADS = f"(SELECT img, x >> 1 AS x, y >> 1 AS y, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM {T} GROUP BY ALL)"
_YUV = f"(SELECT img, 'y' AS plane, x, y, {f.luma()} AS v FROM {T} UNION ALL SELECT img, 'u', x, y, {f.chroma_u('r', 'g', 'b')} FROM {_QUADS} UNION ALL SELECT img, 'v', x, y, {f.chroma_v('r', 'g', 'b')} FROM {_QUADS})"


@query(f"SELECT img, plane, count(*) AS n, CAST(sum(v * (x + 17 * y + 1)) AS BIGINT) AS mark FROM {_YUV} GROUP BY img, plane")
def rgb_to_yuv420(spark, sf_dir):
    return pixels.yuv420(rasters.tiles(spark, sf_dir)).groupBy("img", "plane").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(v * (x + 17 * y + 1))").alias("mark"))


_JOINED = f"""WITH s AS (SELECT * FROM {_YUV}), j AS (SELECT a.img, a.x, a.y, a.v AS yy, b.v AS u, c.v AS v FROM s a JOIN s b ON b.img = a.img AND b.plane = 'u' AND b.x = a.x >> 1 AND b.y = a.y >> 1
JOIN s c ON c.img = a.img AND c.plane = 'v' AND c.x = a.x >> 1 AND c.y = a.y >> 1 WHERE a.plane = 'y')"""
_RGB = f.yuv_to_rgb()


@query(f"{_JOINED} SELECT img, CAST(sum(({_RGB['r']}) * (x + 1)) AS BIGINT) AS r, CAST(sum(({_RGB['g']}) * (x + 1)) AS BIGINT) AS g, CAST(sum(({_RGB['b']}) * (x + 1)) AS BIGINT) AS b FROM j GROUP BY img")
def yuv_to_rgb(spark, sf_dir):
    return pixels.rgb_of(pixels.yuv420(rasters.tiles(spark, sf_dir))).groupBy("img").agg(*[F.sum(F.col(c) * (F.col("x") + 1)).alias(c) for c in "rgb"])


@query(f"""WITH s AS (SELECT * FROM {_YUV}), c AS (SELECT img, x, y, v FROM s WHERE plane = 'u'),
p AS (SELECT img, x, y, x >> 1 AS ox, y >> 1 AS oy, greatest(0, least(7, (x >> 1) + CASE WHEN x % 2 = 1 THEN 1 ELSE -1 END)) AS sx, greatest(0, least(7, (y >> 1) + CASE WHEN y % 2 = 1 THEN 1 ELSE -1 END)) AS sy FROM s WHERE plane = 'y')
SELECT img, count(*) AS n, CAST(sum(v * (x + 17 * y + 1)) AS BIGINT) AS mark FROM (SELECT p.img, p.x, p.y, ((((n.v + d.v + 8 + 3 * (h.v + w.v)) >> 3) + n.v) >> 1) AS v FROM p JOIN c n ON n.img = p.img AND n.x = ox AND n.y = oy JOIN c h ON h.img = p.img AND h.x = sx AND h.y = oy
JOIN c w ON w.img = p.img AND w.x = ox AND w.y = sy JOIN c d ON d.img = p.img AND d.x = sx AND d.y = sy) GROUP BY img""")
def chroma_upsampling(spark, sf_dir):
    return pixels.upsampled(pixels.yuv420(rasters.tiles(spark, sf_dir)), "u").groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(v * (x + 17 * y + 1))").alias("mark"))


def _ranges(d):
    pairs = {"luma_to_full": (f.LUMA_LIMITED, f.LUMA_FULL), "luma_to_limited": (f.LUMA_FULL, f.LUMA_LIMITED), "chroma_to_full": (f.CHROMA_LIMITED, f.CHROMA_FULL), "chroma_to_limited": (f.CHROMA_FULL, f.CHROMA_LIMITED)}
    return {n: f.range_map("s", *p, d) for n, p in pairs.items()}


@query(f"SELECT s, count(*) AS n, {', '.join(f'CAST({e} AS BIGINT) AS {n}' for n, e in _ranges(f.DUCK).items())} FROM {V} GROUP BY s")
def range_conversion(spark, sf_dir):
    counts = rasters.vecs(spark, sf_dir).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("s", "n", *[F.expr(e).cast("long").alias(n) for n, e in _ranges(f.SPARK).items()])


# palettes and cross-colour --------------------------------------------------------------------------------------------------------

_PAL = f"""cols AS (SELECT DISTINCT img, {f.packed()} AS argb FROM {T}),
pal0 AS (SELECT img, argb, row_number() OVER (PARTITION BY img ORDER BY argb) - 1 AS idx, count(*) OVER (PARTITION BY img) AS size FROM cols),
pal AS (SELECT *, CASE WHEN size <= 2 THEN 3 WHEN size <= 4 THEN 2 WHEN size <= 16 THEN 1 ELSE 0 END AS xbits FROM pal0 WHERE size <= {{most}})"""


@query(f"WITH {_PAL.format(most=256)} SELECT img, argb, idx, size, CAST(xbits AS BIGINT) AS xbits FROM pal")
def palette(spark, sf_dir):
    return pixels.palette(rasters.tiles(spark, sf_dir))


_SMALL = f"(SELECT img, x, y, (r >> 6) * 64 AS r, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS b, a FROM {T})"
_PACK = f"""{_PAL.format(most=256).replace(T, _SMALL)}, pk AS (SELECT s.img, x >> xbits AS px, y, CAST(sum(idx << CAST((x & ((1 << xbits) - 1)) * (8 >> xbits) AS INTEGER)) * 256 AS BIGINT) AS packed
FROM (SELECT img, x, y, {f.packed()} AS argb FROM {_SMALL}) s JOIN pal USING (img, argb) GROUP BY ALL)"""


def _small(spark, sf_dir):
    return rasters.tiles(spark, sf_dir).selectExpr("img", "x", "y", "shiftright(r, 6) * 64 as r", "0L as g", "0L as b", "a")


@query(f"WITH {_PACK} SELECT img, px, y, packed FROM pk")
def palette_packing(spark, sf_dir):
    own = _small(spark, sf_dir)
    return pixels.packed_indexes(own, pixels.palette(own))


@query(f"SELECT img, x, y, {f.packed()} AS argb FROM {_SMALL}")
def palette_round_trip(spark, sf_dir):
    own = _small(spark, sf_dir)
    colours = pixels.palette(own)
    return pixels.unpacked(pixels.packed_indexes(own, colours), colours, 16)


@query(f"""WITH {_PAL.format(most=256)}, c AS (SELECT img, idx, {', '.join(f"{f.channel('argb', s)} AS {c}" for c, s in zip('argb', (24, 16, 8, 0), strict=True))} FROM pal)
SELECT img, idx, {', '.join(f"({c} - coalesce(lag({c}) OVER (PARTITION BY img ORDER BY idx), 0)) & 255 AS {c}" for c in 'argb')} FROM c""")
def palette_deltas(spark, sf_dir):
    return prediction.palette_deltas(pixels.palette(rasters.tiles(spark, sf_dir)))


@query(f"WITH {_PAL.format(most=256)} SELECT img, idx, argb FROM pal")
def palette_delta_round_trip(spark, sf_dir):
    return prediction.palette_sums(prediction.palette_deltas(pixels.palette(rasters.tiles(spark, sf_dir))))


def _coef(num, den):
    return f"greatest(-128, least(127, CASE WHEN {den} = 0 THEN 0 ELSE (32 * {num}) // {den} END))"


_CROSS = f"""px AS (SELECT *, x >> 3 AS tx, y >> 3 AS ty FROM {T}),
s1 AS (SELECT img, tx, ty, CAST(sum({f.signed('r')} * {f.signed('g')}) AS BIGINT) AS rg, CAST(sum({f.signed('b')} * {f.signed('g')}) AS BIGINT) AS bg, CAST(sum({f.signed('g')} * {f.signed('g')}) AS BIGINT) AS gg FROM px GROUP BY ALL),
f1 AS (SELECT img, tx, ty, {_coef('rg', 'gg')} AS g2r, {_coef('bg', 'gg')} AS g2b FROM s1),
p1 AS (SELECT px.*, g2r, g2b, (b - {f.cross_delta('g2b', 'g')}) & 255 AS tb FROM px JOIN f1 USING (img, tx, ty)),
s2 AS (SELECT img, tx, ty, g2r, g2b, CAST(sum({f.signed('tb')} * {f.signed('r')}) AS BIGINT) AS br, CAST(sum({f.signed('r')} * {f.signed('r')}) AS BIGINT) AS rr FROM p1 GROUP BY ALL),
fit AS (SELECT img, tx, ty, g2r, g2b, {_coef('br', 'rr')} AS r2b FROM s2)"""
_TILE = ("img", "tx", "ty")


def _tiled(spark, sf_dir):
    return rasters.tiles(spark, sf_dir).withColumns({"tx": F.shiftright("x", 3), "ty": F.shiftright("y", 3)})


@query(f"WITH {_CROSS} SELECT img, tx, ty, CAST(g2r AS BIGINT) AS g2r, CAST(g2b AS BIGINT) AS g2b, CAST(r2b AS BIGINT) AS r2b FROM fit")
def cross_colour_fit(spark, sf_dir):
    return pixels.cross_colour(_tiled(spark, sf_dir), _TILE).select(*_TILE, *[F.col(c).cast("long").alias(c) for c in ("g2r", "g2b", "r2b")])


@query(f"""WITH {_CROSS} SELECT img, tx, ty, CAST(sum((r - {f.cross_delta('g2r', 'g')}) & 255) AS BIGINT) AS r, CAST(sum((b - {f.cross_delta('g2b', 'g')} - {f.cross_delta('r2b', 'r')}) & 255) AS BIGINT) AS b
FROM px JOIN fit USING (img, tx, ty) GROUP BY img, tx, ty""")
def cross_colour_apply(spark, sf_dir):
    own = _tiled(spark, sf_dir)
    return pixels.apply_cross(own, pixels.cross_colour(own, _TILE), _TILE).groupBy(*_TILE).agg(F.sum("r").alias("r"), F.sum("b").alias("b"))


@query(f"SELECT img, CAST(sum(r * (x + 1)) AS BIGINT) AS r, CAST(sum(b * (y + 1)) AS BIGINT) AS b FROM {T} GROUP BY img")
def cross_colour_round_trip(spark, sf_dir):
    own = _tiled(spark, sf_dir)
    fits = pixels.cross_colour(own, _TILE)
    back = pixels.undo_cross(pixels.apply_cross(own, fits, _TILE), fits, _TILE)
    return back.groupBy("img").agg(F.expr("sum(r * (x + 1))").alias("r"), F.expr("sum(b * (y + 1))").alias("b"))


# prediction ------------------------------------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY img ORDER BY y, x)"
_NEAR = f"""nb AS (SELECT *, {', '.join(f"lag({c}, {k}) {_W} AS {p}_{c}" for c in 'argb' for p, k in (('l', 1), ('t', 16), ('tl', 17), ('tr', 15)))} FROM {T}),
er AS (SELECT img, x >> 3 AS tx, y >> 3 AS ty, {', '.join(f"{prediction.error(m, f.DUCK)} AS e{m}" for m in range(14))} FROM nb),
sm AS (SELECT img, tx, ty, {', '.join(f"CAST(sum(e{m}) AS BIGINT) AS e{m}" for m in range(14))} FROM er GROUP BY ALL),
cs AS (SELECT img, tx, ty, unnest(range(14)) AS mode, unnest([{', '.join(f'e{m}' for m in range(14))}]) AS cost FROM sm),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img, tx, ty ORDER BY cost, mode) AS k FROM cs) WHERE k = 1)"""


@query(f"WITH {_NEAR} SELECT mode, count(*) AS tiles, CAST(sum(cost) AS BIGINT) AS cost FROM cs GROUP BY mode")
def predictor_costs(spark, sf_dir):
    return prediction.costs(rasters.tiles(spark, sf_dir), 16).groupBy("mode").agg(F.count(F.lit(1)).alias("tiles"), F.sum("cost").alias("cost"))


@query(f"WITH {_NEAR} SELECT img, tx, ty, mode, cost FROM bm")
def best_predictors(spark, sf_dir):
    return prediction.best_modes(rasters.tiles(spark, sf_dir), 16)


def _pick(c):
    return "CASE " + " ".join(f"WHEN mode = {m} THEN {prediction.guess(m, c, f.DUCK)}" for m in range(14)) + " END"


@query(f"""WITH {_NEAR}, j AS (SELECT nb.*, mode FROM nb JOIN bm ON bm.img = nb.img AND bm.tx = nb.x >> 3 AND bm.ty = nb.y >> 3)
SELECT img, {', '.join(f"CAST(sum((({c} - ({_pick(c)})) & 255) * (x + 16 * y + 1)) AS BIGINT) AS {c}" for c in 'rgb')} FROM j GROUP BY img""")
def predictor_residuals(spark, sf_dir):
    own = rasters.tiles(spark, sf_dir)
    out = prediction.residuals(own, prediction.best_modes(own, 16), 16)
    return out.groupBy("img").agg(*[F.expr(f"sum({c} * (x + 16 * y + 1))").alias(c) for c in "rgb"])


@query(f"SELECT img, x, y, (s - CASE WHEN x = 0 THEN coalesce(lag(s) OVER (PARTITION BY img, x ORDER BY y), 0) ELSE lag(s) OVER (PARTITION BY img, y ORDER BY x) END) & 255 AS s FROM {V}")
def alpha_filter_horizontal(spark, sf_dir):
    return prediction.filtered(rasters.vecs(spark, sf_dir), "horizontal")


@query(f"SELECT img, x, y, (s - CASE WHEN y = 0 THEN coalesce(lag(s) OVER (PARTITION BY img, y ORDER BY x), 0) ELSE lag(s) OVER (PARTITION BY img, x ORDER BY y) END) & 255 AS s FROM {V}")
def alpha_filter_vertical(spark, sf_dir):
    return prediction.filtered(rasters.vecs(spark, sf_dir), "vertical")


@query(f"SELECT img, x, y, s FROM {V}")
def alpha_unfilter_horizontal(spark, sf_dir):
    return prediction.unfiltered(prediction.filtered(rasters.vecs(spark, sf_dir), "horizontal"), "horizontal")


@query(f"SELECT img, x, y, s FROM {V}")
def alpha_unfilter_vertical(spark, sf_dir):
    return prediction.unfiltered(prediction.filtered(rasters.vecs(spark, sf_dir), "vertical"), "vertical")


# blocks -----------------------------------------------------------------------------------------------------------------------------


def _pivot_sql(src: str) -> str:
    return f"SELECT img, x >> 2 AS bi, y >> 2 AS bj, {', '.join(f'max(CASE WHEN (y & 3) * 4 + (x & 3) = {k} THEN s END) AS c{k}' for k in range(16))} FROM {src} GROUP BY ALL"


def _stages_sql(start: str, *stages: list[str]) -> str:
    """Nested selects of 16 columns."""
    out = f"SELECT * FROM {start}"
    for s in stages:
        out = f"SELECT img, bi, bj, {', '.join(f'{e} AS c{k}' for k, e in enumerate(s))} FROM ({out})"
    return out


_CENTRED = f"(SELECT img, x, y, s - 128 AS s FROM {V})"
_BLOCK = f"b AS ({_pivot_sql(_CENTRED)})"
_DCT = (f.dct_rows(blocks.C), f.dct_columns(blocks.C))
_IDCT = (f.idct_columns(blocks.C), f.idct_rows(blocks.C))
_Q = [f.quantized(c, str(23 if k == 0 else 31), f.DUCK) for k, c in enumerate(blocks.C)]
_DQ = [f"{c} * {23 if k == 0 else 31}" for k, c in enumerate(blocks.C)]


def _centred(spark, sf_dir):
    return blocks.pivoted(rasters.vecs(spark, sf_dir).withColumn("s", F.col("s") - 128))


@query(f"WITH {_BLOCK} {_stages_sql('b', *_DCT)}")
def forward_dct(spark, sf_dir):
    return blocks.forward_dct(_centred(spark, sf_dir))


@query(f"WITH {_BLOCK} {_stages_sql('b', *_DCT, *_IDCT)}")
def dct_round_trip(spark, sf_dir):
    return blocks.inverse_dct(blocks.forward_dct(_centred(spark, sf_dir)))


_HALF = [f"({x} >> 1)" for x in f.transposed(f.hadamard(f.transposed(blocks.C)))]


@query(f"WITH {_BLOCK} {_stages_sql('b', f.hadamard(blocks.C), _HALF)}")
def forward_wht(spark, sf_dir):
    return blocks.forward_wht(_centred(spark, sf_dir))


@query(f"WITH {_BLOCK} {_stages_sql('b', f.hadamard(blocks.C), _HALF, f.wht_inverse_columns(blocks.C), f.wht_inverse_rows(blocks.C))}")
def wht_round_trip(spark, sf_dir):
    return blocks.inverse_wht(blocks.forward_wht(_centred(spark, sf_dir)))


@query(f"""WITH {_BLOCK}, q AS ({_stages_sql('b', *_DCT, _Q)})
SELECT img, bi, bj, CAST({" + ".join(f"{i + 1} * c{k}" for i, k in enumerate(f.ZIGZAG))} AS BIGINT) AS mark, CAST(greatest({", ".join(f"CASE WHEN c{k} <> 0 THEN {i + 1} ELSE 0 END" for i, k in enumerate(f.ZIGZAG))}) AS BIGINT) AS last FROM q""")
def quantized_scan(spark, sf_dir):
    rows = blocks.scanned(blocks.quantize(blocks.forward_dct(_centred(spark, sf_dir)), 23, 31))
    mark = F.aggregate(F.transform("levels", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("img", "bi", "bj", mark.alias("mark"), "last")


_REC = f"""{_BLOCK}, k AS ({_stages_sql('b', *_DCT, _Q, _DQ, *_IDCT)}),
rec AS (SELECT img, bi * 4 + p % 4 AS x, bj * 4 + p // 4 AS y, t FROM (SELECT img, bi, bj, unnest(range(16)) AS p, unnest([{', '.join(blocks.C)}]) AS t FROM k)),
er AS (SELECT o.img, CAST(sum((s - t) * (s - t)) AS BIGINT) AS sse, CAST(sum(abs(s - t)) AS BIGINT) AS sad, count(*) AS n FROM {_CENTRED} o JOIN rec USING (img, x, y) GROUP BY o.img)"""


@query(f"WITH {_REC} SELECT img, sse, sad, n, CASE WHEN sse > 0 THEN round(10 * log10(65025 / (sse / n)), 6) END AS psnr, CASE WHEN sse > 0 THEN round(10 * log10(65025 / (sse / n)), 6) ELSE 99.0 END AS psnr_99, round(sad / n, 6) AS mean_abs FROM er")
def reconstruction_psnr(spark, sf_dir):
    own = rasters.vecs(spark, sf_dir).withColumn("s", F.col("s") - 128)
    rec = blocks.unpivoted(blocks.inverse_dct(blocks.dequantize(blocks.quantize(blocks.forward_dct(blocks.pivoted(own)), 23, 31), 23, 31)))
    return blocks.psnr(blocks.squared_error(own, rec))


@query(f"SELECT a.img, a.x >> 2 AS bi, a.y >> 2 AS bj, CAST(sum((a.s - b.s) * (a.s - b.s)) AS BIGINT) AS sse FROM {V} a JOIN {V} b ON a.img = b.img AND a.x = b.y AND a.y = b.x GROUP BY ALL")
def block_sse(spark, sf_dir):
    own = rasters.vecs(spark, sf_dir)
    turned = own.select("img", F.col("y").alias("x"), F.col("x").alias("y"), "s")
    marked = own.withColumns({"bi": F.shiftright("x", 2), "bj": F.shiftright("y", 2)})
    return blocks.squared_error(marked, turned, ("img", "bi", "bj")).select("img", "bi", "bj", "sse")


_SATD = "(" + " + ".join(f"{w} * abs(c{k})" for k, w in enumerate(f.SATD_WEIGHTS)) + ") >> 5"
_RES = f"(SELECT a.img, a.x, a.y, a.s - b.s AS s FROM {V} a JOIN {V} b ON a.img = b.img AND a.x = b.y AND a.y = b.x)"


@query(f"WITH b AS ({_pivot_sql(_RES)}), h AS ({_stages_sql('b', f.hadamard(blocks.C), f.transposed(f.hadamard(f.transposed(blocks.C))))}) SELECT img, bi, bj, {_SATD} AS satd FROM h")
def block_satd(spark, sf_dir):
    own = rasters.vecs(spark, sf_dir)
    both = own.join(own.select("img", F.col("y").alias("x"), F.col("x").alias("y"), F.col("s").alias("t")), ["img", "x", "y"])
    return blocks.satd(blocks.pivoted(both.select("img", "x", "y", (F.col("s") - F.col("t")).alias("s"))))


# intra prediction and edges ---------------------------------------------------------------------------------------------------------

_SIDES = f"""r AS (SELECT img, x, y, s, x >> 2 AS bi, y >> 2 AS bj FROM {V}),
g AS (SELECT a.img, a.bi, a.bj, a.x, a.y, a.s, t.s AS t, l.s AS l, c.s AS c, (SELECT sum(q.s) FROM r q WHERE q.img = a.img AND q.y = a.bj * 4 - 1 AND q.bi = a.bi) AS st, (SELECT sum(q.s) FROM r q WHERE q.img = a.img AND q.x = a.bi * 4 - 1 AND q.bj = a.bj) AS sl
FROM r a LEFT JOIN r t ON t.img = a.img AND t.x = a.x AND t.y = a.bj * 4 - 1 LEFT JOIN r l ON l.img = a.img AND l.y = a.y AND l.x = a.bi * 4 - 1 LEFT JOIN r c ON c.img = a.img AND c.x = a.bi * 4 - 1 AND c.y = a.bj * 4 - 1),
m AS (SELECT img, bi, bj, CAST(sum(abs(s - CASE WHEN st IS NOT NULL AND sl IS NOT NULL THEN CAST(st + sl + 4 AS BIGINT) >> 3 WHEN st IS NOT NULL THEN CAST(st + 2 AS BIGINT) >> 2 WHEN sl IS NOT NULL THEN CAST(sl + 2 AS BIGINT) >> 2 ELSE 128 END)) AS BIGINT) AS m0,
CAST(sum(abs(s - coalesce(t, 127))) AS BIGINT) AS m1, CAST(sum(abs(s - coalesce(l, 129))) AS BIGINT) AS m2,
CAST(sum(abs(s - greatest(0, least(255, coalesce(t, 127) + coalesce(l, 129) - CASE WHEN c IS NOT NULL THEN c WHEN bj = 0 THEN 127 ELSE 129 END)))) AS BIGINT) AS m3 FROM g GROUP BY img, bi, bj)"""


@query(f"WITH {_SIDES} SELECT img, bi, bj, unnest(range(4)) AS mode, unnest([m0, m1, m2, m3]) AS sad FROM m")
def intra_prediction(spark, sf_dir):
    return prediction.intra_costs(rasters.vecs(spark, sf_dir))


_STEP = "greatest(-128, least(127, greatest(-128, least(127, p1 - q1)) + 3 * (q0 - p0)))"


@query(f"""WITH v AS (SELECT * FROM {V}), e AS (SELECT a.img, a.y, a.s AS p1, b.s AS p0, c.s AS q0, d.s AS q1 FROM v a JOIN v b ON b.img = a.img AND b.y = a.y AND b.x = 3 JOIN v c ON c.img = a.img AND c.y = a.y AND c.x = 4 JOIN v d ON d.img = a.img AND d.y = a.y AND d.x = 5 WHERE a.x = 2),
n AS (SELECT img, y, abs(p0 - q0) * 2 + (abs(p1 - q1) >> 1) <= 60 AS near, greatest(0, least(255, p0 + (greatest(-128, least(127, {_STEP} + 3)) >> 3))) AS p, greatest(0, least(255, q0 - (greatest(-128, least(127, {_STEP} + 4)) >> 3))) AS q FROM e)
SELECT v.img, v.x, v.y, CASE WHEN near AND v.x = 3 THEN p WHEN near AND v.x = 4 THEN q ELSE s END AS s FROM v JOIN n ON n.img = v.img AND n.y = v.y""")
def loop_filter_simple(spark, sf_dir):
    return prediction.smoothed_edges(rasters.vecs(spark, sf_dir), 60)


@query(f"SELECT p.img, p.x, p.y, p.r, p.g, p.b, 255 - q.r AS a FROM {R4} p JOIN {R4} q ON q.img = p.img AND q.x = p.y AND q.y = p.x")
def alpha_apply(spark, sf_dir):
    own = rasters.rgba4(spark, sf_dir)
    return pixels.with_alpha(own, own.select("img", F.col("y").alias("x"), F.col("x").alias("y"), (255 - F.col("r")).alias("s")))


@query(f"SELECT img, x, y, {', '.join(f'CASE WHEN a = 0 THEN 0 ELSE least(255, (255 * {c}) // a) END AS {c}' for c in 'rgb')}, a FROM {R4}")
def straight_alpha(spark, sf_dir):
    return pixels.straight(rasters.rgba4(spark, sf_dir))


# encoder decisions -----------------------------------------------------------------------------------------------------------------------

_ACT = f"""lu AS (SELECT img, x, y, {f.luma()} AS s FROM {T}),
ac AS (SELECT img, CAST(sum(coalesce(abs(s - l), 0) + coalesce(abs(s - u), 0)) AS BIGINT) AS activity FROM (SELECT *, lag(s) OVER (PARTITION BY img, y ORDER BY x) AS l, lag(s) OVER (PARTITION BY img, x ORDER BY y) AS u FROM lu) GROUP BY img)"""
_CUT = "ct AS (SELECT grp, list(DISTINCT activity) AS cuts FROM (SELECT grp, activity, row_number() OVER (PARTITION BY grp ORDER BY activity) AS rk, count(*) OVER (PARTITION BY grp) AS n FROM g) WHERE rk IN (greatest(1, least(n - 1, n * 40 // 100)), greatest(1, least(n - 1, n * 75 // 100))) GROUP BY grp)"


def _activities(spark, sf_dir):
    luma = rasters.tiles(spark, sf_dir).select("img", "x", "y", F.expr(f.luma()).alias("s"))
    return prediction.activity(luma).select("img", (F.col("img") % 5).alias("grp"), "activity")


@query(f"WITH {_ACT} SELECT img, img % 5 AS grp, activity FROM ac")
def macroblock_activity(spark, sf_dir):
    return _activities(spark, sf_dir)


@query(f"""WITH {_ACT}, g AS (SELECT img, img % 5 AS grp, activity FROM ac), r AS (SELECT grp, activity, row_number() OVER (PARTITION BY grp ORDER BY activity) AS rk, count(*) OVER (PARTITION BY grp) AS n FROM g)
SELECT grp, CAST(p AS BIGINT) AS percent, activity AS threshold FROM r, (SELECT unnest([40, 75]) AS p) WHERE rk = greatest(1, least(n - 1, n * p // 100))""")
def segment_thresholds(spark, sf_dir):
    return encoder.thresholds(_activities(spark, sf_dir), (40, 75), "grp")


@query(f"""WITH {_ACT}, g AS (SELECT img, img % 5 AS grp, activity FROM ac), {_CUT},
s AS (SELECT grp, (SELECT count(*) FROM (SELECT unnest(cuts) AS c) WHERE c < activity) AS segment FROM g JOIN ct USING (grp)),
n AS (SELECT grp, {', '.join(f"CAST(sum(CASE WHEN segment = {k} THEN 1 ELSE 0 END) AS BIGINT) AS n{k}" for k in range(4))} FROM s GROUP BY grp)
SELECT *, {f.share('n0 + n1', 'n2 + n3', f.DUCK)} AS p0, {f.share('n0', 'n1', f.DUCK)} AS p1, {f.share('n2', 'n3', f.DUCK)} AS p2 FROM n""")
def segment_probabilities(spark, sf_dir):
    return encoder.segment_stats(encoder.segments(_activities(spark, sf_dir), (40, 75), "grp"), "grp")


_DC, _AC = (f"[{', '.join(map(str, t))}]" for t in (f.DC_STEPS, f.AC_STEPS))


@query(f"""WITH q AS (SELECT quality, {f.base_quantizer('quality')} AS q FROM (SELECT unnest(range(101)) AS quality)),
s AS (SELECT *, CAST({_DC}[q + 1] AS BIGINT) AS y1_dc, CAST({_AC}[q + 1] AS BIGINT) AS y1_ac, CAST(2 * {_DC}[q + 1] AS BIGINT) AS y2_dc, greatest(8, (CAST({_AC}[q + 1] AS BIGINT) * 101581) >> 16) AS y2_ac, CAST({_DC}[least(q, 117) + 1] AS BIGINT) AS uv_dc FROM q),
m AS (SELECT *, greatest(y1_ac, 8) AS i, greatest(y2_ac, 8) AS j FROM s)
SELECT * EXCLUDE (i, j), greatest(3 * j * j, 128) AS lambda_i16, greatest(3 * i * i, 128) >> 7 AS lambda_i4, greatest(3 * i * i, 128) >> 6 AS lambda_uv, greatest(i * i, 128) >> 7 AS lambda_mode, greatest((j * j) >> 2, 1) AS lambda_trellis_i16, greatest((7 * i * i) >> 3, 1) AS lambda_trellis_i4,
CASE WHEN q <= 10 THEN 0 ELSE least(63, (3 * q + 2) // 4) END AS filter_level, array_to_string(list_sort(list_distinct([0, least(63, (q + 1) // 2), least(63, q), least(63, least(127, (3 * q + 1) // 2)), least(63, least(127, 2 * q))])), ',') AS filter_candidates FROM m""")
def quantizer_tables(spark, sf_dir):
    return encoder.quantizers(spark)


@query("""SELECT level, sharpness, inner_limit, 2 * level + inner_limit AS edge_limit, CASE WHEN level >= 40 THEN 2 WHEN level >= 15 THEN 1 ELSE 0 END AS high_variance
FROM (SELECT level, sharpness, greatest(1, CASE WHEN sharpness = 0 THEN level ELSE least(9 - sharpness, level >> CASE WHEN sharpness > 4 THEN 2 ELSE 1 END) END) AS inner_limit FROM (SELECT unnest(range(1, 64)) AS level), (SELECT unnest(range(8)) AS sharpness))""")
def loop_filter_strengths(spark, sf_dir):
    return encoder.filter_strengths(spark)


@query("SELECT p, CAST(floor(round(-log2(greatest(1, p) / 256.0::DOUBLE) * 256.0::DOUBLE + 0.5::DOUBLE, 9)) AS BIGINT) AS cost FROM (SELECT unnest(range(256)) AS p)")
def bit_costs(spark, sf_dir):
    return encoder.bit_costs(spark)


@query(f"""WITH {_BLOCK}, q AS ({_stages_sql('b', *_DCT, [f.quantized(c, '140', f.DUCK) for c in blocks.C])}), s AS (SELECT img % 9 AS grp, {' AND '.join(f'c{k} = 0' for k in range(16))} AS skip FROM q),
n AS (SELECT grp, count(*) AS total, CAST(sum(CASE WHEN skip THEN 1 ELSE 0 END) AS BIGINT) AS skips FROM s GROUP BY grp)
SELECT *, CASE WHEN skips > 0 THEN greatest(1, least(254, ((total - skips) * 255 + total // 2) // total)) END AS prob FROM n""")
def skip_probability(spark, sf_dir):
    q = blocks.quantize(blocks.forward_dct(_centred(spark, sf_dir)), 140, 140)
    skip = F.lit(True)
    for c in blocks.C:
        skip = skip & (F.col(c) == 0)
    return encoder.skip_probability(q.select((F.col("img") % 9).alias("grp"), skip.alias("skip")), "grp")


_MODES = f"""sd AS (SELECT a.img, a.x >> 2 AS bi, a.y >> 2 AS bj, m AS mode, CAST(sum(abs(a.s - CASE m WHEN 0 THEN 128 WHEN 1 THEN b.s WHEN 2 THEN (a.s + b.s) // 2 ELSE 255 - b.s END)) AS BIGINT) AS sad
FROM {V} a JOIN {V} b ON a.img = b.img AND a.x = b.y AND a.y = b.x, (SELECT unnest(range(4)) AS m) GROUP BY ALL), md AS (SELECT img, bi, bj, mode, sad * 8 + mode * 3 AS score FROM sd)"""


@query(f"WITH {_MODES} SELECT * FROM (SELECT img, bi, bj, mode, score, row_number() OVER (PARTITION BY img, bi, bj ORDER BY score, mode) AS rank FROM md) WHERE rank <= 2")
def mode_screen(spark, sf_dir):
    own = rasters.vecs(spark, sf_dir)
    both = own.join(own.select("img", F.col("y").alias("x"), F.col("x").alias("y"), F.col("s").alias("t")), ["img", "x", "y"])
    guess = [F.lit(128), F.col("t"), F.expr("(s + t) div 2"), 255 - F.col("t")]
    sums = both.groupBy("img", F.shiftright("x", 2).alias("bi"), F.shiftright("y", 2).alias("bj")).agg(*[F.sum(F.abs(F.col("s") - g)).alias(f"m{k}") for k, g in enumerate(guess)])
    cells = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("mode"), (F.col(f"m{k}") * 8 + k * 3).alias("score")) for k in range(4)]))
    return encoder.top_modes(sums.select("img", "bi", "bj", cells.alias("c")).select("img", "bi", "bj", "c.*"), 2, ("img", "bi", "bj"))


_SYM, _EXTRA, _VALUE = f.prefix_code("v", f.DUCK)


@query(f"SELECT v, CAST({_SYM} AS BIGINT) AS symbol, CAST({_EXTRA} AS BIGINT) AS extra_bits, CAST({_VALUE} AS BIGINT) AS extra_value FROM (SELECT unnest(range(1, 4097)) AS v)")
def prefix_codes(spark, sf_dir):
    sym, extra, value = f.prefix_code("v")
    return spark.range(1, 4097).select(F.col("id").alias("v")).select("v", *[F.expr(e).cast("long").alias(n) for e, n in ((sym, "symbol"), (extra, "extra_bits"), (value, "extra_value"))])


# more encoder decisions ----------------------------------------------------------------------------------------------------------------


@query(f"WITH c AS (SELECT img, count(DISTINCT {f.packed()}) AS colours FROM {T} GROUP BY img) SELECT img, colours, CAST(least(10, CASE WHEN colours <= 1 THEN 0 ELSE ceil(round(log2(CAST(colours AS DOUBLE)), 9)) END) AS BIGINT) AS bits FROM c")
def colour_cache_bits(spark, sf_dir):
    return encoder.cache_bits(rasters.tiles(spark, sf_dir))


_COSTS = "k AS (SELECT p, CAST(floor(round(-log2(greatest(1, p) / 256.0::DOUBLE) * 256.0::DOUBLE + 0.5::DOUBLE, 9)) AS BIGINT) AS cost FROM (SELECT unnest(range(256)) AS p))"
_STAT = "l_orderkey % 97 AS nb, l_orderkey % 97 + 1 + l_partkey % 400 AS total, 1 + l_suppkey % 255 AS old, 1 + (l_orderkey * 7) % 255 AS upd"


@query(f"""WITH {_COSTS}, s AS (SELECT DISTINCT {_STAT} FROM lineitem), n AS (SELECT *, CASE WHEN nb = 0 THEN 255 ELSE 255 - (nb * 255) // total END AS new FROM s),
c AS (SELECT n.*, n.nb * a.cost + (n.total - n.nb) * b.cost + e.cost AS old_cost, n.nb * c.cost + (n.total - n.nb) * d.cost + g.cost + 2048 AS new_cost FROM n JOIN k a ON a.p = 255 - old JOIN k b ON b.p = old JOIN k e ON e.p = upd
JOIN k c ON c.p = 255 - new JOIN k d ON d.p = new JOIN k g ON g.p = 255 - upd) SELECT *, CASE WHEN old_cost > new_cost THEN new ELSE old END AS kept FROM c""")
def probability_updates(spark, sf_dir):
    stats = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey % 97 as nb", "l_orderkey % 97 + 1 + l_partkey % 400 as total", "1 + l_suppkey % 255 as old", "1 + (l_orderkey * 7) % 255 as upd").distinct()
    return encoder.updated_probabilities(stats, encoder.bit_costs(spark))


def _presets_sql() -> str:
    values = ", ".join(f"({i}, {effort}, {mb}, '{','.join(map(str, percents))}', {deltas})" for i, (effort, mb, percents, deltas) in enumerate(encoder.even_presets()))
    return f"""WITH b AS (SELECT DISTINCT (1 + o_orderkey % 2500) AS mb_count, o_orderkey % 10 AS effort, (o_custkey * 3) % 128 AS q FROM orders)
SELECT mb_count, effort, q, CAST(i AS BIGINT) AS ord, percents, array_to_string([greatest(0, least(127, q + d)) for d in deltas], ',') AS quantizers
FROM b JOIN (VALUES {values}) x(i, from_effort, from_mb, percents, deltas) ON effort >= from_effort AND mb_count >= from_mb"""


@query(_presets_sql())
def segment_presets(spark, sf_dir):
    bases = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("1 + o_orderkey % 2500 as mb_count", "o_orderkey % 10 as effort", "(o_custkey * 3) % 128 as q").distinct()
    return encoder.segment_presets(bases)


@query(f"""WITH {_REC}, q AS (SELECT img, sse, sse % 977 + 40 AS bytes, CAST({_AC}[img % 128 + 1] AS BIGINT) AS y1_ac FROM er), c AS (SELECT *, sse * 128 + bytes * 8 * greatest(3 * greatest(y1_ac, 8) * greatest(y1_ac, 8), 128) AS cost FROM q)
SELECT img % 50 AS frame, arg_min(img, (cost, img)) AS best, min(cost) AS cost FROM c GROUP BY img % 50""")
def frame_choice(spark, sf_dir):
    own = rasters.vecs(spark, sf_dir).withColumn("s", F.col("s") - 128)
    rec = blocks.unpivoted(blocks.inverse_dct(blocks.dequantize(blocks.quantize(blocks.forward_dct(blocks.pivoted(own)), 23, 31), 23, 31)))
    step = F.expr(f"cast(element_at(array({', '.join(map(str, f.AC_STEPS))}), cast(img % 128 + 1 as int)) as bigint)")
    rows = blocks.squared_error(own, rec).select("img", "sse", F.expr("sse % 977 + 40").alias("bytes"), step.alias("y1_ac"))
    least = encoder.frame_cost(rows).groupBy((F.col("img") % 50).alias("frame")).agg(F.min(F.struct("cost", "img")).alias("m"))
    return least.select("frame", F.col("m.img").alias("best"), F.col("m.cost").alias("cost"))


@query(f"""WITH h AS ({HIST.format(k="img", src=T)}), e AS (SELECT img, channel, {BITS} AS bits FROM h GROUP BY img, channel),
s AS (SELECT img % 20 AS grp, img, max(CASE WHEN channel = 'g' THEN bits END) AS green, max(CASE WHEN channel = 'r' THEN bits END) AS red, max(CASE WHEN channel = 'b' THEN bits END) AS blue FROM e GROUP BY img),
m AS (SELECT *, {', '.join(f"min({c}) OVER (PARTITION BY grp) AS lo_{c}, max({c}) OVER (PARTITION BY grp) AS hi_{c}" for c in ('green', 'red', 'blue'))} FROM s)
SELECT grp, img, {' + '.join(f"(CASE WHEN hi_{c} <= lo_{c} THEN 0 ELSE least(3, CAST(floor(round(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 4, 9)) AS BIGINT)) END) * {w}" for c, w in (('green', 16), ('red', 4), ('blue', 1)))} AS bin FROM m""")
def entropy_bins(spark, sf_dir):
    e = pixels.channel_entropy(rasters.tiles(spark, sf_dir))
    s = e.groupBy("img").agg(*[F.max(F.when(F.col("channel") == k, F.col("bits"))).alias(n) for k, n in (("g", "green"), ("r", "red"), ("b", "blue"))]).withColumn("grp", F.col("img") % 20)
    return encoder.signature_bins(s, "grp").select("grp", "img", "bin")


# animation ----------------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH fr AS (SELECT * FROM {FR}), cv AS (SELECT unnest(range(16)) AS x, o.y FROM (SELECT unnest(range(12)) AS y) o),
ev AS (SELECT anim, k, x, y, CASE WHEN x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h THEN v END AS put, CASE WHEN dispose AND x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h THEN 1 ELSE 0 END AS cleared FROM fr, cv),
st AS (SELECT anim, k, x, y, put, CASE WHEN put IS NOT NULL THEN put WHEN coalesce(lag(cleared) OVER (PARTITION BY anim, x, y ORDER BY k), 0) = 1 OR k = 0 THEN 0 END AS known FROM ev),
fl AS (SELECT anim, k, x, y, last_value(known IGNORE NULLS) OVER (PARTITION BY anim, x, y ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM st)
SELECT anim, k, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (x + 16 * y + 1)) AS BIGINT) AS mark FROM fl GROUP BY anim, k""")
def animation_canvas(spark, sf_dir):
    done = animation.composited(rasters.frames(spark, sf_dir), 16, 12)
    return done.groupBy("anim", "k").agg(F.sum("v").alias("total"), F.expr("sum(v * (x + 16 * y + 1))").alias("mark"))


_BL = {c: f.blended(f"p.{c}", f"q.{c}", "p.a", "q.a", f.DUCK) for c in "rgb"}


@query(f"SELECT p.img, p.x, p.y, {', '.join(f'CAST({e} AS BIGINT) AS {c}' for c, e in _BL.items())}, CAST({f.blended_alpha('p.a', 'q.a')} AS BIGINT) AS a FROM {R4} p JOIN {R4} q ON p.img = q.img AND p.x = q.y AND p.y = q.x")
def alpha_blending(spark, sf_dir):
    own = rasters.rgba4(spark, sf_dir)
    return animation.blend(own, own.select("img", F.col("y").alias("x"), F.col("x").alias("y"), "r", "g", "b", "a"))


@query(f"SELECT anim, k, format('{{}}_{{:04d}}.bmp', 'user' || CAST(anim AS VARCHAR), k) AS path FROM {FR}")
def frame_paths(spark, sf_dir):
    return rasters.frames(spark, sf_dir).select("anim", "k", animation.frame_path(F.concat(F.lit("user"), F.col("anim").cast("string")), F.col("k")).alias("path"))


# containers ----------------------------------------------------------------------------------------------------------------------------------

_HEX = """SELECT img, CASE WHEN img % 11 = 0 THEN 'garbage ' ELSE 'RIFF' || chr(CAST(1 + img % 100 AS INTEGER)) || chr(0) || chr(0) || chr(0) END AS head, 1 + (img * 37) % 16000 AS w, 1 + (img * 101) % 16000 AS h, img % 2 = 0 AS alpha FROM (SELECT CAST(p_partkey AS BIGINT) AS img FROM part)"""


@query(f"""SELECT img, img % 11 <> 0 AS is_webp, CASE WHEN img % 11 <> 0 THEN w END AS width, CASE WHEN img % 11 <> 0 THEN h END AS height, CASE WHEN img % 11 <> 0 THEN alpha END AS has_alpha,
CASE WHEN img % 11 <> 0 THEN 'lossless' ELSE 'undefined' END AS format FROM ({_HEX})""")
def lossless_headers(spark, sf_dir):
    """Headers written for made-up sizes, read back with column expressions."""
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("img"))
    made = own.selectExpr("img", "1 + (img * 37) % 16000 as w", "1 + (img * 101) % 16000 as h", "img % 2 = 0 as alpha")
    content = F.when(F.col("img") % 11 == 0, F.lit("garbage garbage garbage").cast("binary")).otherwise(container.lossless_header(F.col("w"), F.col("h"), F.col("alpha")))
    return container.with_features(made.select("img", content.alias("content"))).select("img", "is_webp", "width", "height", "has_alpha", "format")


@query("""SELECT img, CAST(img % 5 AS BIGINT) AS flags, 1 + (img * 7) % 5000 AS canvas_width, 1 + (img * 13) % 5000 AS canvas_height, img % 3 AS compression, (img // 3) % 4 AS filter, img % 4 AS preprocessing,
img % 3 <= 1 AND img % 4 <= 2 AS valid FROM (SELECT CAST(p_partkey AS BIGINT) AS img FROM part)""")
def extended_and_alpha_headers(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("img"))
    vp8x = container.vp8x_payload(F.expr("img % 5"), F.expr("1 + (img * 7) % 5000"), F.expr("1 + (img * 13) % 5000"))
    alph = container.le(F.expr("img % 3 + ((img div 3) % 4) * 4 + (img % 4) * 16"), 1)
    rows = own.select("img", vp8x.alias("vp8x"), alph.alias("alph"))
    return rows.select("img", *container.read_vp8x(F.col("vp8x")), *container.read_alph(F.col("alph")))


# measurements --------------------------------------------------------------------------------------------------------------------------------

_FIRST = f"first AS (SELECT machine, engine, mode, file, effort, bytes, ms, psnr FROM (SELECT *, row_number() OVER (PARTITION BY machine, engine, mode, file ORDER BY effort) AS k FROM {M}) WHERE k = 1)"
_POINTS = f"{_FIRST}, pts AS (SELECT o.machine, o.mode, o.file, round(o.bytes / b.bytes, 6) AS size_ratio, round(o.psnr - b.psnr, 6) AS psnr_diff FROM first o JOIN first b ON o.machine = b.machine AND o.mode = b.mode AND o.file = b.file WHERE o.engine = 'R' AND b.engine = 'N' AND o.psnr IS NOT NULL AND b.psnr IS NOT NULL)"
_GEO = f"geo AS (SELECT machine, mode, engine, round(exp(avg(ln(ms))), 6) AS gmean, count(*) AS n FROM {M} WHERE ms > 0 GROUP BY ALL)"


@query("""WITH u AS (SELECT 'm' || CAST(l_partkey % 2 AS VARCHAR) AS machine, l_returnflag AS engine, l_linestatus AS mode, CAST(l_suppkey % 23 AS VARCHAR) AS file, CAST(l_linenumber AS BIGINT) AS effort, l_orderkey * 10 + l_linenumber AS seen,
  CASE WHEN l_quantity > 10 THEN CAST(l_quantity * 100 AS BIGINT) END AS bytes, CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS ms, CASE WHEN l_discount > 0.02 THEN l_discount END AS psnr FROM lineitem)
SELECT machine, engine, mode, file, effort, first(bytes ORDER BY seen DESC, bytes DESC) FILTER (WHERE bytes > 0) AS bytes, first(ms ORDER BY seen DESC, ms DESC) FILTER (WHERE ms > 0) AS ms, first(psnr ORDER BY seen DESC, psnr DESC) FILTER (WHERE psnr IS NOT NULL) AS psnr FROM u GROUP BY ALL""")
def measurement_merge(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "concat('m', cast(l_partkey % 2 as string)) as machine", "l_returnflag as engine", "l_linestatus as mode", "cast(l_suppkey % 23 as string) as file", "cast(l_linenumber as bigint) as effort", "l_orderkey * 10 + l_linenumber as seen",
        "CASE WHEN l_quantity > 10 THEN cast(l_quantity * 100 as bigint) END as bytes", "CASE WHEN l_tax > 0.01 THEN l_extendedprice END as ms", "CASE WHEN l_discount > 0.02 THEN l_discount END as psnr",
    )
    return measurement.merged(rows, "seen")


@query(f"WITH {_POINTS} SELECT * FROM pts")
def baseline_ratio(spark, sf_dir):
    return measurement.against_baseline(measurement.first_effort(rasters.measurements(spark, sf_dir)), "N", "R")


@query(f"WITH {_POINTS} SELECT mode, round(least(min(size_ratio), 1) - 0.06, 6) AS x_min, round(greatest(max(size_ratio), 1) + 0.06, 6) AS x_max, round(floor(min(psnr_diff)) - 0.4, 6) AS y_min, round(greatest(max(psnr_diff), 0) + 0.5, 6) AS y_max FROM pts GROUP BY mode")
def axis_extents(spark, sf_dir):
    return measurement.extents(measurement.against_baseline(measurement.first_effort(rasters.measurements(spark, sf_dir)), "N", "R"), ("mode",))


@query(f"WITH {_GEO} SELECT * FROM geo")
def geometric_mean(spark, sf_dir):
    return measurement.geometric_mean(rasters.measurements(spark, sf_dir), "ms")


@query(f"""WITH {_GEO}, k AS (SELECT *, row_number() OVER (PARTITION BY machine, mode ORDER BY gmean DESC, engine) AS k FROM geo), t AS (SELECT machine, mode, max(CASE WHEN k = 1 THEN gmean END) AS top, max(CASE WHEN k = 2 THEN gmean END) AS second FROM k GROUP BY ALL),
c AS (SELECT *, coalesce(bool_or(top > 2 * second) OVER (PARTITION BY mode), false) AS clip FROM t) SELECT machine, mode, clip, CASE WHEN clip AND second IS NOT NULL THEN second ELSE top END AS scale FROM c""")
def clip_rule(spark, sf_dir):
    return measurement.clipped(measurement.geometric_mean(rasters.measurements(spark, sf_dir), "ms"))


_SWEEP = f"""gd AS (SELECT * FROM {M} WHERE ms > 0 AND bytes > 0), ef AS (SELECT machine, engine, mode, count(DISTINCT effort) AS ne FROM gd GROUP BY ALL),
fu AS (SELECT machine, engine, mode, file FROM gd JOIN ef USING (machine, engine, mode) GROUP BY machine, engine, mode, file, ne HAVING count(*) = ne),
sw AS (SELECT machine, engine, mode, effort, round(sum(ms) / 1000, 6) AS seconds, round(sum(bytes) / 1048576, 6) AS mib, round(avg(psnr), 6) AS psnr, count(psnr) AS images FROM gd JOIN fu USING (machine, engine, mode, file) GROUP BY machine, engine, mode, effort)"""


@query(f"WITH {_SWEEP} SELECT * FROM sw")
def sweep_curve(spark, sf_dir):
    return measurement.sweep(rasters.measurements(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SWEEP}, o AS (SELECT *, row_number() OVER (PARTITION BY machine, engine, mode ORDER BY effort) AS i FROM sw),
w AS (SELECT machine, engine, mode, effort, i, seconds AS last, true AS kept FROM o WHERE i = 1
UNION ALL SELECT o.machine, o.engine, o.mode, o.effort, o.i, CASE WHEN abs(o.seconds - w.last) >= 0.05 * w.last THEN o.seconds ELSE w.last END, abs(o.seconds - w.last) >= 0.05 * w.last
FROM w JOIN o ON o.machine = w.machine AND o.engine = w.engine AND o.mode = w.mode AND o.i = w.i + 1) SELECT machine, engine, mode, effort FROM w WHERE kept""")
def moving_settings(spark, sf_dir):
    return measurement.moving_settings(measurement.sweep(rasters.measurements(spark, sf_dir)), "seconds", 0.05)


@query(f"""WITH {_SWEEP}, lg AS (SELECT DISTINCT machine, mode, round(log10(seconds), 9) AS v FROM sw WHERE seconds > 0), r AS (SELECT *, row_number() OVER (PARTITION BY machine, mode ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY machine, mode) AS n, lag(v) OVER (PARTITION BY machine, mode ORDER BY v) AS below FROM lg),
gp AS (SELECT *, round(v - below, 9) AS gap FROM r), rk AS (SELECT *, row_number() OVER (PARTITION BY machine, mode ORDER BY gap DESC NULLS LAST, i) AS g FROM gp),
a AS (SELECT machine, mode, max(v) AS top, max(n) AS n, max(CASE WHEN g = 1 THEN gap END) AS widest, max(CASE WHEN g = 2 THEN gap END) AS runner, max(CASE WHEN g = 1 THEN i END) AS place, max(CASE WHEN g = 1 THEN below END) AS under FROM rk GROUP BY ALL),
j AS (SELECT *, coalesce(n >= 4 AND widest >= 0.25 AND widest >= 3 * coalesce(runner, 0) AND place >= n // 2, false) AS jumps FROM a) SELECT machine, mode, round(pow(10.0, CASE WHEN jumps THEN under ELSE top END), 3) AS "limit", jumps FROM j""")
def outlier_gap(spark, sf_dir):
    return measurement.outlier_top(measurement.sweep(rasters.measurements(spark, sf_dir)), "seconds", ("machine", "mode"))


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'pexels-' ELSE '' END || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN '-' || CAST(p_partkey AS VARCHAR) || '-x' ELSE '' END || '.jpg' AS file FROM part),
s AS (SELECT *, regexp_replace(regexp_replace(file, '\\.[^./]*$', ''), '^pexels-', '') AS base FROM n), t AS (SELECT *, regexp_replace(base, '(^|-)[+-]?[0-9]+(-.*)?$', '') AS w FROM s)
SELECT file, CASE WHEN w = '' THEN base ELSE w END AS short FROM t""")
def short_names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    file = F.concat(F.when(F.col("p_partkey") % 3 == 0, "pexels-").otherwise(""), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), F.col("p_partkey").cast("string"), F.lit("-x"))).otherwise(""), F.lit(".jpg"))
    return part.select(file.alias("file")).select("file", measurement.short_name(F.col("file")).alias("short"))


@query(f"SELECT machine, engine, mode, file, effort, round(ms / 1048.576, 6) AS mib_per_mp, CASE WHEN ms >= 10000 THEN printf('%.0f s', round(ms / 1000, 6)) WHEN ms >= 1000 THEN printf('%.1f s', round(ms / 1000, 6)) ELSE printf('%.0f ms', ms) END AS took FROM (SELECT * REPLACE (floor(ms) + 0.25 AS ms) FROM {M})")
def formatted_times(spark, sf_dir):
    rows = rasters.measurements(spark, sf_dir).withColumn("ms", F.floor("ms") + 0.25)
    return rows.select("machine", "engine", "mode", "file", "effort", F.round(F.col("ms") / 1048.576, 6).alias("mib_per_mp"), measurement.duration(F.col("ms")).alias("took"))


from rasterloom.plans import coding  # noqa: E402, F401  adds its queries
