"""What entropy coders count: token alphabets, code lengths, coefficient branches, mode rates, decoder steps.

Histograms are exploded to one number or a few a row and combined before the shuffle; nothing is windowed over single tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import formulas as f

#: The five alphabets of a lossless token stream. Green holds literals, then length symbols, then places of the colour cache.
ALPHABETS = ("green", "red", "blue", "alpha", "distance")
LITERALS, LENGTHS = 256, 24
#: Band of each coefficient place: fixed values of the VP8 format.
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
#: Decision nodes on a coefficient's size v, as (node, asked if, one if): fixed by the format's token tree.
SIZE_NODES = (
    (1, "true", "v <> 0"),
    (2, "v >= 1", "v > 1"),
    (3, "v >= 2", "v > 4"),
    (4, "v BETWEEN 2 AND 4", "v <> 2"),
    (5, "v BETWEEN 3 AND 4", "v = 4"),
    (6, "v > 4", "v > 10"),
    (7, "v BETWEEN 5 AND 10", "v > 6"),
    (8, "v > 10", "v >= 35"),
    (9, "v BETWEEN 11 AND 34", "v >= 19"),
    (10, "v >= 35", "v >= 67"),
)
#: Ways to the modes of a key frame's macroblocks, as (probability, branch taken): fixed values of the VP8 format.
MODE_TREES = {
    "luma": {"sub-blocks": ((145, 0),), "dc": ((145, 1), (156, 0), (163, 0)), "vertical": ((145, 1), (156, 0), (163, 1)), "horizontal": ((145, 1), (156, 1), (128, 0)), "motion": ((145, 1), (156, 1), (128, 1))},
    "chroma": {"dc": ((142, 0),), "vertical": ((142, 1), (114, 0)), "horizontal": ((142, 1), (114, 1), (183, 0)), "motion": ((142, 1), (114, 1), (183, 1))},
}


def token_histograms(tokens: DataFrame, keys: tuple[str, ...] = ("img",)) -> DataFrame:
    """(keys, alphabet, symbol, n) of tokens (keys, kind, r, g, b, a, length, distance, slot): literals count in four alphabets, copies by the
    prefix symbols of their length and distance, cache hits by their slot. An alphabet without tokens has symbol 0 once."""
    cell = lambda k, s: F.struct(F.lit(k).alias("k"), s.cast("long").alias("symbol"))
    of = lambda c: F.expr(f.prefix_code(c)[0])
    literal = F.array(cell(0, F.col("g")), cell(1, F.col("r")), cell(2, F.col("b")), cell(3, F.col("a")))
    copy = F.array(cell(0, of("length") + LITERALS), cell(4, of("distance")))
    cells = F.when(F.col("kind") == "literal", literal).when(F.col("kind") == "copy", copy).otherwise(F.array(cell(0, F.col("slot") + LITERALS + LENGTHS)))
    counted = tokens.select(*keys, F.explode(cells).alias("c")).groupBy(*keys, "c.k", "c.symbol").agg(F.count(F.lit(1)).alias("n"))
    # the alphabets that a key has are a five-bit mask; those it lacks are added from it
    lacking = counted.groupBy(*keys).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("k"))).alias("m"))
    empty = lacking.select(*keys, F.explode(F.filter(F.array(*map(F.lit, range(len(ALPHABETS)))), lambda k: F.expr("m").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) == 0)).alias("k"))
    both = counted.unionByName(empty.select(*keys, "k", F.lit(0).cast("long").alias("symbol"), F.lit(1).cast("long").alias("n")))
    return both.select(*keys, F.get(F.array(*map(F.lit, ALPHABETS)), F.col("k").cast("int")).alias("alphabet"), "symbol", "n")


def shared_costs(histograms: DataFrame, by: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Bits of each histogram (keys, of them by) under one code for its group (by): the sum of counts times code lengths, which are whole-bit
    Shannon lengths of the group's added histograms, one bit at least.

    The added counts and their total stand beside each cell by windows over one sort, so no join has to tell how large histograms are."""
    # ordered by symbol, the alphabet's window has the order that the symbol's window needs
    alphabet = Window.partitionBy(*by, "alphabet").orderBy("symbol").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = histograms.withColumn("total", F.sum("n").over(alphabet)).withColumn("all_n", F.sum("n").over(Window.partitionBy(*by, "alphabet", "symbol")))
    bits = F.greatest(F.lit(1), F.ceil(F.round(F.log2(F.col("total") / F.col("all_n")), 9))).cast("long")
    return cells.groupBy(*keys).agg(F.sum(F.col("n") * bits).alias("bits"))


def coefficient_statistics(scanned: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, band, ctx, node, total, ones) of blocks in coding order (keys, levels, last): how often each decision of the token tree is asked
    and answered by one. Context is 0 at a block's start and behind a zero, 1 behind a one, 2 behind more. Behind a zero node 0, whether
    more coefficients follow, isn't asked."""
    places = F.transform("levels", lambda v, i: F.struct(i.alias("i"), F.abs(v).alias("v"), F.abs(F.get("levels", i - 1)).alias("p")))
    rows = scanned.select(*keys, "last", F.explode(places).alias("x")).select(*keys, "last", "x.*")
    rows = rows.withColumns({"band": F.get(F.array(*map(F.lit, BANDS)), F.col("i")).cast("long"), "ctx": F.expr("cast(least(2, coalesce(p, 0)) as long)")})
    asked = [(0, "(i = 0 OR p > 0) AND i <= last", "i < last"), *[(n, f"i < last AND {a}", one) for n, a, one in SIZE_NODES]]
    cells = F.array_compact(F.array(*[F.when(F.expr(a), F.struct(F.lit(n).cast("long").alias("node"), F.expr(one).cast("long").alias("one"))) for n, a, one in asked]))
    return rows.select(*keys, "band", "ctx", F.explode(cells).alias("c")).groupBy(*keys, "band", "ctx", "c.node").agg(F.count(F.lit(1)).alias("total"), F.sum("c.one").alias("ones"))


def mode_rates(costs: list[int]) -> list[tuple[str, str, int]]:
    """(tree, mode, rate) in 1/256 bit, of the 256 costs of an outcome by its probability."""
    return [(t, m, sum(costs[p if not taken else 255 - p] for p, taken in way)) for t, modes in MODE_TREES.items() for m, way in modes.items()]


def decoder_steps(headers: DataFrame) -> DataFrame:
    """A row for each segment of a frame's header (base, y1_dc, y2_dc, y2_ac, uv_dc, uv_ac: deltas; segmented, absolute, segments: four
    quantizers or deltas): its quantizer and the six steps."""
    rows = headers.select("*", F.posexplode("segments").alias("segment", "own"))
    rows = rows.withColumn("q", F.expr("CASE WHEN NOT segmented THEN base WHEN absolute THEN own ELSE base + own END"))
    table = {n: F.array(*map(F.lit, t)) for n, t in (("dc", f.DC_STEPS), ("ac", f.AC_STEPS))}
    step = lambda t, delta, top=127: F.get(table[t], F.greatest(F.lit(0), F.least(F.lit(top), F.col("q") + delta)).cast("int")).cast("long")
    zero = F.lit(0)
    steps = (
        ("y1_dc_step", step("dc", F.col("y1_dc"))), ("y1_ac_step", step("ac", zero)), ("y2_dc_step", 2 * step("dc", F.col("y2_dc"))),
        ("y2_ac_step", F.greatest(F.lit(8).cast("long"), F.shiftright(step("ac", F.col("y2_ac")) * 101581, 16))), ("uv_dc_step", step("dc", F.col("uv_dc"), 117)), ("uv_ac_step", step("ac", F.col("uv_ac"))),
    )
    return rows.select("img", F.col("segment").cast("long").alias("segment"), "q", *[c.alias(n) for n, c in steps])


def sub_block_trial(errors: DataFrame, strength: int) -> DataFrame:
    """Whether a block (distortion, residual, q) is worth trying in sub-blocks: it has a residual, and eight times its distortion is more
    than its squared step times strength."""
    return errors.withColumn("tried", F.col("residual") & (8 * F.col("distortion") > F.col("q") * F.col("q") * strength))


def fits(length: Column, stride: Column, width: Column, height: Column) -> Column:
    """Whether a plane's samples are enough: rows are stride apart, and only the last one may end with its samples."""
    return (stride >= width) & (length >= (height - 1) * stride + width)
